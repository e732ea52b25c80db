"""Registered queries: text cleaning, tokenizers, n-grams and corpus statistics
(T1-T18, C1-C5, A9, A10) over the whole ``documents`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import vocab as V
from tessera.plans import sqltext as S
from tessera.plans.params import DIGITS, MIN_STEM, STOPWORDS, SUFFIXES, TRANSLIT_1TO1, TRANSLIT_1TON
from tessera.plans.registry import query
from tessera.plans.tfidf_queries import CLEAN_TOKENS_SQL, clean_tokens
from tessera.sources.tables import ANNOTATED_SQL, LABELLED_SQL, ODD_DOCUMENTS_SQL, annotated, labelled, odd_documents, table


def _md5_tokens(c):
    return F.md5(F.array_join(c, " "))


def _md5_tokens_sql(e):
    return f"md5(array_to_string({e}, ' '))"


_CLEAN_TEXT_SQL = f"""SELECT doc_id, md5({S.clean_text('text', STOPWORDS, SUFFIXES, MIN_STEM)}) AS clean_md5,
  CAST(length({S.clean_text('text', STOPWORDS, SUFFIXES, MIN_STEM)}) AS INTEGER) AS clean_chars"""


def _clean_text(docs):
    d = docs.select("doc_id", T.clean_text("text", STOPWORDS, SUFFIXES, MIN_STEM).alias("c"))
    return d.select("doc_id", F.md5("c").alias("clean_md5"), F.length("c").alias("clean_chars"))


@query("clean_text", sql=f"""WITH {ODD_DOCUMENTS_SQL}
{_CLEAN_TEXT_SQL} FROM odd""")
def clean_text(spark, sf_dir):
    """T7 (T6 suffixes -> T1 lower -> T3 danda -> T2 punctuation -> T4 dots -> T5 stopwords), odd texts."""
    return _clean_text(odd_documents(spark, sf_dir))


@query("clean_text_original", sql=f"{_CLEAN_TEXT_SQL} FROM documents")
def clean_text_original(spark, sf_dir):
    """T7 on every text as it is."""
    return _clean_text(table(spark, sf_dir, "documents"))


_CLEANING_STEPS_SQL = f"""SELECT doc_id,
  md5(lower(text)) AS lower_md5,
  md5({S.strip_punctuation('text', 'space')}) AS punct_space_md5,
  md5({S.strip_punctuation('text', 'delete')}) AS punct_delete_md5,
  md5({S.strip_punctuation('text', 'none')}) AS punct_none_md5,
  md5(regexp_replace(text, '।', ' |', 'g')) AS danda_md5,
  md5(regexp_replace(text, '[.\\-…]+', ' ', 'g')) AS dots_md5,
  md5({S.remove_stopwords('lower(text)', STOPWORDS)}) AS stop_md5,
  md5({S.strip_suffixes('text', SUFFIXES, MIN_STEM)}) AS suffix_md5"""


def _cleaning_steps(docs):
    t = F.col("text")
    return docs.select(
        "doc_id",
        F.md5(T.to_lower(t)).alias("lower_md5"),
        F.md5(T.strip_punctuation(t, "space")).alias("punct_space_md5"),
        F.md5(T.strip_punctuation(t, "delete")).alias("punct_delete_md5"),
        F.md5(T.strip_punctuation(t, "none")).alias("punct_none_md5"),
        F.md5(T.normalize_danda(t)).alias("danda_md5"),
        F.md5(T.collapse_dots_dashes(t)).alias("dots_md5"),
        F.md5(T.remove_stopwords(T.to_lower(t), STOPWORDS)).alias("stop_md5"),
        F.md5(T.strip_suffixes(t, SUFFIXES, MIN_STEM)).alias("suffix_md5"))


@query("cleaning_steps", sql=f"""WITH {ODD_DOCUMENTS_SQL}
{_CLEANING_STEPS_SQL}
FROM odd""")
def cleaning_steps(spark, sf_dir):
    """Each cleaning step on its own (T1-T6), hashed per document, odd texts."""
    return _cleaning_steps(odd_documents(spark, sf_dir))


@query("cleaning_steps_original", sql=f"{_CLEANING_STEPS_SQL} FROM documents")
def cleaning_steps_original(spark, sf_dir):
    """T1-T6 on every text as it is."""
    return _cleaning_steps(table(spark, sf_dir, "documents"))


_TOKENIZERS_SQL = f"""SELECT doc_id,
  CAST(len({S.tokenize_whitespace('text')}) AS INTEGER) AS n_ws, {_md5_tokens_sql(S.tokenize_whitespace('text'))} AS ws_md5,
  CAST(len({S.tokenize_words('text')}) AS INTEGER) AS n_words, {_md5_tokens_sql(S.tokenize_words('text'))} AS words_md5,
  CAST(len({S.tokenize_script('text')}) AS INTEGER) AS n_script,
  CAST(len({S.tokenize_default('text')}) AS INTEGER) AS n_default, {_md5_tokens_sql(S.tokenize_default('text'))} AS default_md5,
  CAST(len({S.tokens_no_punct('text')}) AS INTEGER) AS n_no_punct, {_md5_tokens_sql(S.tokens_no_punct('text'))} AS no_punct_md5"""


def _tokenizers(docs):
    d = docs.select(
        "doc_id", T.tokenize_whitespace("text").alias("ws"), T.tokenize_words("text").alias("words"),
        T.tokenize_script("text").alias("script"), T.tokenize_default("text").alias("dflt"),
        T.tokens_no_punct("text").alias("np"))
    return d.select("doc_id", T.text_length("ws").alias("n_ws"), _md5_tokens("ws").alias("ws_md5"),
                    T.text_length("words").alias("n_words"), _md5_tokens("words").alias("words_md5"),
                    T.text_length("script").alias("n_script"),
                    T.text_length("dflt").alias("n_default"), _md5_tokens("dflt").alias("default_md5"),
                    T.text_length("np").alias("n_no_punct"), _md5_tokens("np").alias("no_punct_md5"))


@query("tokenizers", sql=f"""WITH {ODD_DOCUMENTS_SQL}
{_TOKENIZERS_SQL}
FROM odd""")
def tokenizers(spark, sf_dir):
    """Token counts (T13) and hashes of each tokenizer's output, odd texts."""
    return _tokenizers(odd_documents(spark, sf_dir))


@query("tokenizers_original", sql=f"{_TOKENIZERS_SQL} FROM documents")
def tokenizers_original(spark, sf_dir):
    """T8-T13 on every text as it is."""
    return _tokenizers(table(spark, sf_dir, "documents"))


@query("ngrams", sql=f"""WITH {CLEAN_TOKENS_SQL}
SELECT doc_id, CAST(len({S.ngrams('tokens', 2)}) AS INTEGER) AS n_bigrams, {_md5_tokens_sql(S.ngrams('tokens', 2))} AS bigrams_md5,
       CAST(len({S.ngrams('tokens', 3)}) AS INTEGER) AS n_trigrams, {_md5_tokens_sql(S.ngrams('tokens', 3))} AS trigrams_md5
FROM docs""")
def ngrams(spark, sf_dir):
    """Columns n-gram-2 / n-gram-3 ([] for short or null token lists)."""
    d = V.add_ngrams(V.add_ngrams(clean_tokens(spark, sf_dir), 2), 3)
    b, t = F.col(f"`{T.ngram_column_name(2)}`"), F.col(f"`{T.ngram_column_name(3)}`")
    return d.select("doc_id", F.size(b).alias("n_bigrams"), _md5_tokens(b).alias("bigrams_md5"),
                    F.size(t).alias("n_trigrams"), _md5_tokens(t).alias("trigrams_md5"))


@query("transliterate", sql=f"""SELECT doc_id, md5({S.transliterate('text', TRANSLIT_1TO1, TRANSLIT_1TON)}) AS roman_md5,
  CAST(length({S.transliterate('text', TRANSLIT_1TO1, TRANSLIT_1TON)}) AS INTEGER) AS roman_chars FROM documents""")
def transliterate(spark, sf_dir):
    """Table-driven code-point mapping (1:1 translate, 1:n replace)."""
    r = T.transliterate(F.col("text"), TRANSLIT_1TO1, TRANSLIT_1TON)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(r).alias("roman_md5"), F.length(r).alias("roman_chars"))


@query("pad_mask", sql=f"""WITH {CLEAN_TOKENS_SQL},
p AS (SELECT doc_id, {S.pad_truncate('tokens', 100)} AS padded FROM docs)
SELECT doc_id, CAST(len(padded) AS INTEGER) AS n_padded, {_md5_tokens_sql('padded')} AS padded_md5,
       CAST(len(list_filter(padded, lambda t: t <> '<pad>')) AS INTEGER) AS n_unmasked FROM p""")
def pad_mask(spark, sf_dir):
    """T16 pad/truncate to 100 and T17 mask."""
    p = clean_tokens(spark, sf_dir).select("doc_id", T.pad_truncate("tokens", 100).alias("padded"))
    p = p.withColumn("mask", T.pad_mask("padded"))
    return p.select("doc_id", F.size("padded").alias("n_padded"), _md5_tokens("padded").alias("padded_md5"),
                    F.size(F.filter("mask", lambda m: m)).alias("n_unmasked"))


@query("concat_key", sql=f"""WITH {ANNOTATED_SQL}
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'nan' ELSE sentiment END || '_' || CAST(polarity AS VARCHAR) AS key FROM annotated""")
def concat_key(spark, sf_dir):
    """T18, with every fifth sentiment null."""
    return annotated(spark, sf_dir).withColumn("sentiment", F.when(F.col("doc_id") % 5 != 0, F.col("sentiment"))).select("doc_id", T.concat_key(["sentiment", "polarity"]).alias("key"))


@query("concat_key_original", sql=f"""WITH {ANNOTATED_SQL}
SELECT doc_id, coalesce(sentiment, 'nan') || '_' || CAST(polarity AS VARCHAR) AS key FROM annotated""")
def concat_key_original(spark, sf_dir):
    """T18 on every row as it is."""
    return annotated(spark, sf_dir).select("doc_id", T.concat_key(["sentiment", "polarity"]).alias("key"))


# ---------------------------------------------------------------- C1-C5, A9, A10
_OCC_SQL = f"""{CLEAN_TOKENS_SQL},
occ AS (SELECT doc_id, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM docs),
cnt AS (SELECT term, count(*) AS count, min((doc_id, pos)) AS first_seen FROM occ GROUP BY term)"""


@query("word_counts", sql=f"""WITH {_OCC_SQL} SELECT term, count FROM cnt""")
def word_counts(spark, sf_dir):
    return V.word_counts(clean_tokens(spark, sf_dir))


@query("top_words", sql=f"""WITH {_OCC_SQL}
SELECT term, count FROM cnt ORDER BY count DESC, first_seen ASC LIMIT 10""")
def top_words(spark, sf_dir):
    return V.top_words(clean_tokens(spark, sf_dir), 10)


@query("bottom_words", sql=f"""WITH {_OCC_SQL}
SELECT term, count FROM cnt ORDER BY count ASC, first_seen DESC LIMIT 10""")
def bottom_words(spark, sf_dir):
    return V.bottom_words(clean_tokens(spark, sf_dir), 10)


@query("top_bigrams", sql=f"""WITH {CLEAN_TOKENS_SQL},
g AS (SELECT doc_id, {S.ngrams('tokens', 2)} AS ng FROM docs),
occ AS (SELECT doc_id, unnest(ng) AS term, unnest(range(len(ng))) AS pos FROM g),
cnt AS (SELECT term, count(*) AS count, min((doc_id, pos)) AS first_seen FROM occ GROUP BY term)
SELECT term AS ngram, count FROM cnt ORDER BY count DESC, first_seen ASC LIMIT 10""")
def top_bigrams(spark, sf_dir):
    return V.top_ngrams(clean_tokens(spark, sf_dir), 2, 10)


@query("class_term_counts", sql=f"""WITH {LABELLED_SQL},
t AS (SELECT target, {S.tokenize_whitespace(S.clean_text('text', STOPWORDS, SUFFIXES, MIN_STEM))} AS tokens FROM labelled)
SELECT target, term, count(*) AS count FROM (SELECT target, unnest(tokens) AS term FROM t) GROUP BY target, term""")
def class_term_counts(spark, sf_dir):
    """Term frequencies of every class in one pass (the table behind a word cloud)."""
    lab = labelled(spark, sf_dir).select(
        "target", T.clean_tokens("text", STOPWORDS, SUFFIXES, MIN_STEM).alias("tokens"))
    return V.class_term_counts(lab, "target")


@query("vocabulary_size", sql=f"""WITH {CLEAN_TOKENS_SQL}
SELECT count(DISTINCT term) AS vocabulary_size FROM (SELECT unnest(tokens) AS term FROM docs)""")
def vocabulary_size(spark, sf_dir):
    return V.vocabulary_size(clean_tokens(spark, sf_dir))


@query("sequence_length_stats", sql=f"""WITH {CLEAN_TOKENS_SQL}, l AS (SELECT len(tokens) AS length FROM docs)
SELECT count(*) AS n_rows, CAST(max(length) AS INTEGER) AS max_length, round(avg(length), {DIGITS}) AS mean_length,
  CAST(count_if(length > 100) AS BIGINT) AS n_over_max,
  round(quantile_cont(length, 0.5), {DIGITS}) AS p50, round(quantile_cont(length, 0.9), {DIGITS}) AS p90,
  round(quantile_cont(length, 0.95), {DIGITS}) AS p95, round(quantile_cont(length, 0.99), {DIGITS}) AS p99
FROM l""")
def sequence_length_stats(spark, sf_dir):
    s = V.sequence_length_stats(V.add_text_length(clean_tokens(spark, sf_dir)))
    return s.select("n_rows", "max_length", "n_over_max",
                    *[F.round(c, DIGITS).alias(c) for c in ("mean_length", "p50", "p90", "p95", "p99")])
