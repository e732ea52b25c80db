"""Scalar text and token-array functions (Column -> Column), all JVM-side built-ins.

Regular expressions use explicit character classes that mean the same thing in Java's
regex engine and in RE2, so each function has a one-to-one SQL counterpart for the
oracle checks (``\\w`` differs between engines; ``[\\p{L}\\p{N}_]`` does not).
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ASCII punctuation as in Python's string.punctuation, in its natural order.
PUNCTUATION = string.punctuation  # !"#$%&'()*+,-./:;<=>?@[\]^_`{|}~
# Devanagari full stop and the character it is rewritten to before punctuation removal.
DANDA = "।"
# Characters collapsed to one space after punctuation handling: full stop, hyphen, ellipsis.
DOT_DASH_CLASS = "[.\\-…]+"
# Devanagari block used by the script tokenizer.
DEVANAGARI_RANGE = ("ऀ", "ॿ")
# Padding token of fixed-length sequences.
PAD = "<pad>"
# ---------------------------------------------------------------------------------------

# The characters beyond Java's \\s that Python's str.split() takes as white space.
OTHER_SPACES = "[\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
WORD_CHARS = "[\\p{L}\\p{N}_]"


def _char_class(chars: str) -> str:
    return "[" + "".join("\\" + c if not c.isalnum() else c for c in chars) + "]"


PUNCT_CLASS = _char_class(PUNCTUATION)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# T1
def to_lower(c) -> Column:
    return F.lower(col_(c))


# T2
def strip_punctuation(c, mode: str = "space") -> Column:
    """mode: "space" replaces each ASCII punctuation mark by a space, "delete" removes it,
    "none" keeps the text (the literal no-op of one reference cleaner, quirk Q1)."""
    c = col_(c)
    if mode == "none":
        return c
    if mode == "delete":
        return F.regexp_replace(c, PUNCT_CLASS, "")
    if mode == "space":
        return F.regexp_replace(c, PUNCT_CLASS, " ")
    raise ValueError(f"unknown punctuation mode {mode!r}")


# T3
def normalize_danda(c) -> Column:
    return F.regexp_replace(col_(c), DANDA, " |")


# T4
def collapse_dots_dashes(c) -> Column:
    return F.regexp_replace(col_(c), DOT_DASH_CLASS, " ")


# T8
def plain_spaces(c) -> Column:
    """White space beyond ASCII becomes a blank, so that ``\\s`` finds all that Python splits at."""
    return F.regexp_replace(col_(c), OTHER_SPACES, " ")


def _split_plain(c) -> Column:
    return F.filter(F.split(c, "\\s+"), lambda t: t != "")


def tokenize_whitespace(c) -> Column:
    """Python ``str.split()``: split on whitespace runs, no empty tokens; null -> []."""
    c = col_(c)
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(_split_plain(plain_spaces(c)))


# T5
def remove_stopwords(c, stopwords) -> Column:
    """Drop stopword tokens and re-join with single spaces (whitespace is normalised)."""
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.array().cast("array<string>")
    return F.array_join(F.filter(tokenize_whitespace(c), lambda t: ~F.array_contains(stop, t)), " ")


# T6
def suffix_pattern(suffixes, min_stem: int) -> str:
    alts = "|".join(re.escape(s) for s in sorted(set(suffixes), key=lambda s: (-len(s), s)))
    return f"^(.{{{min_stem},}}?)({alts})$"


def strip_suffixes_tokens(tokens, suffixes, min_stem: int = 2) -> Column:
    """Strip the longest listed suffix of each token, keeping at least ``min_stem`` chars."""
    pat = suffix_pattern(suffixes, min_stem)
    return F.transform(col_(tokens), lambda t: F.regexp_replace(t, pat, "$1"))


def strip_suffixes(c, suffixes, min_stem: int = 2) -> Column:
    return F.array_join(strip_suffixes_tokens(tokenize_whitespace(c), suffixes, min_stem), " ")


def strip_suffixes_inline(c, suffixes, min_stem: int = 2) -> Column:
    """Same stems as ``strip_suffixes`` in one pass over the text (token boundaries by
    lookaround), keeping the original whitespace; used inside ``clean_text`` whose stopword
    step normalises whitespace anyway."""
    alts = "|".join(re.escape(s) for s in sorted(set(suffixes), key=lambda s: (-len(s), s)))
    return F.regexp_replace(col_(c), f"(?<!\\S)(\\S{{{min_stem},}}?)({alts})(?!\\S)", "$1")


# T7
def _pre_stopwords(c, suffixes, min_stem, punct_mode) -> Column:
    x = plain_spaces(F.coalesce(col_(c), F.lit("")))
    if suffixes:
        x = strip_suffixes_inline(x, suffixes, min_stem)
    x = to_lower(x)
    x = normalize_danda(x)
    x = strip_punctuation(x, punct_mode)
    return collapse_dots_dashes(x)


def clean_text(c, stopwords=(), suffixes=(), min_stem: int = 2, punct_mode: str = "space") -> Column:
    """suffix strip -> lower -> danda -> punctuation -> dots/dashes -> stopwords; null -> ''."""
    return F.array_join(clean_tokens(c, stopwords, suffixes, min_stem, punct_mode), " ")


def clean_tokens(c, stopwords=(), suffixes=(), min_stem: int = 2, punct_mode: str = "space") -> Column:
    """The whitespace tokens of ``clean_text`` (T7 then T8) without joining and re-splitting:
    the stopword-filtered token array itself."""
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.array().cast("array<string>")
    toks = _split_plain(_pre_stopwords(c, suffixes, min_stem, punct_mode))
    return F.filter(toks, lambda t: ~F.array_contains(stop, t))


# T9
def tokenize_words(c) -> Column:
    """Words and punctuation marks as separate tokens (word runs, or single other marks)."""
    return F.regexp_extract_all(F.coalesce(col_(c), F.lit("")), F.lit(f"{WORD_CHARS}+|[^\\s\\p{{L}}\\p{{N}}_]"), 0)


# T10
def tokenize_script(c, lo: str = DEVANAGARI_RANGE[0], hi: str = DEVANAGARI_RANGE[1]) -> Column:
    return F.regexp_extract_all(F.coalesce(col_(c), F.lit("")), F.lit(f"[{lo}-{hi}]+"), 0)


# T11
def tokenize_default(c) -> Column:
    """Lower-cased runs of two or more word characters (the vectoriser default)."""
    return F.regexp_extract_all(F.lower(F.coalesce(col_(c), F.lit(""))), F.lit(f"{WORD_CHARS}{{2,}}"), 0)


# T12
def tokens_no_punct(c) -> Column:
    """Lower, word-tokenise, drop tokens that are a substring of the punctuation string."""
    punct = F.lit(PUNCTUATION)
    return F.filter(tokenize_words(F.lower(col_(c))), lambda t: ~F.contains(punct, t))


# T13
def text_length(tokens) -> Column:
    return F.size(col_(tokens))


# T14
def ngrams(tokens, n: int) -> Column:
    """Space-joined word n-grams in order; [] for null or fewer than n tokens."""
    t = F.coalesce(col_(tokens), F.array().cast("array<string>"))
    return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(t) - n + 1),
                    lambda i: F.array_join(F.slice(t, i, n), " ")))


def ngram_column_name(n: int) -> str:
    return f"n-gram-{n}"


# T15
def transliterate(c, one_to_one: dict, one_to_many: dict | None = None) -> Column:
    """Table-driven code-point mapping: ``translate`` for 1:1 pairs, ``replace`` for 1:n."""
    x = col_(c)
    for src, dst in (one_to_many or {}).items():
        x = F.replace(x, F.lit(src), F.lit(dst))
    if one_to_one:
        x = F.translate(x, "".join(one_to_one.keys()), "".join(one_to_one.values()))
    return x


# T16
def pad_truncate(tokens, max_len: int = 100, pad: str = PAD) -> Column:
    t = F.coalesce(col_(tokens), F.array().cast("array<string>"))
    return F.slice(F.concat(t, F.array_repeat(F.lit(pad), F.lit(max_len))), 1, max_len)


# T17
def pad_mask(tokens, pad: str = PAD) -> Column:
    return F.transform(col_(tokens), lambda t: t != F.lit(pad))


# T18
def concat_key(cols, sep: str = "_", null: str = "nan") -> Column:
    """The columns' text joined by ``sep``; a null becomes ``null``, a class of its own."""
    return F.concat_ws(sep, *[F.coalesce(col_(c).cast("string"), F.lit(null)) for c in cols])
