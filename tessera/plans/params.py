"""Parameters of the registered test queries (cleaning tables, seeds, sizes).

The reference takes its stopword list, stemmer and transliterator from external
language libraries; here they are plain tables passed to the operators. The values
below are parameters chosen for the four languages of the test corpus.
"""

STOPWORDS = ("the", "and", "of", "is", "a", "to", "in", "le", "la", "les", "de", "des", "du",
             "un", "et", "el", "los", "y", "en", "der", "die", "und", "das")
SUFFIXES = ("ing", "ed", "es", "s", "ment", "tion", "eux", "aux", "er", "en")
MIN_STEM = 2
# accented letters of the corpus -> ASCII (one-to-one), and one-to-many pairs
TRANSLIT_1TO1 = {"é": "e", "è": "e", "ê": "e", "ó": "o", "ñ": "n", "ç": "c", "ü": "u", "ä": "a",
                 "ö": "o", "í": "i", "É": "E", "È": "E", "Ê": "E", "Ó": "O", "Ñ": "N", "Ç": "C",
                 "Ü": "U", "Ä": "A", "Ö": "O", "Í": "I"}
TRANSLIT_1TON = {"ß": "ss"}
SEED = 42
DIGITS = 6
