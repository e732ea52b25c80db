"""Registered TF-IDF queries over the whole ``documents`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import tfidf as TF
from tessera.operators.indexing import materialize
from tessera.plans import sqltext as S
from tessera.plans.params import DIGITS, MIN_STEM, STOPWORDS, SUFFIXES
from tessera.plans.registry import query
from tessera.sources.tables import table


def clean_tokens(spark, sf_dir):
    """documents -> (doc_id, tokens): cleaned (T7) then whitespace-tokenised."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.clean_tokens("text", STOPWORDS, SUFFIXES, MIN_STEM).alias("tokens"))


def tokens_once(spark, sf_dir):
    """``clean_tokens`` cleaned once and written to the shared folder, for queries that read the
    tokens more than once."""
    return materialize(clean_tokens(spark, sf_dir))


def default_tokens(spark, sf_dir):
    """documents -> (doc_id, tokens) with the vectoriser's default tokenizer."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.tokenize_default("text").alias("tokens"))


CLEAN_TOKENS_SQL = f"""docs AS (
  SELECT doc_id, {S.tokenize_whitespace(S.clean_text('text', STOPWORDS, SUFFIXES, MIN_STEM))} AS tokens FROM documents)"""
DEFAULT_TOKENS_SQL = f"""docs AS (SELECT doc_id, {S.tokenize_default('text')} AS tokens FROM documents)"""

TFIDF_SQL = """ndocs AS (SELECT count(*) AS n_docs FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM docs) GROUP BY doc_id, term),
dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
model AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_index, df,
                 ln((1 + n_docs) / (1.0 + df)) + 1 AS idf, n_docs FROM dfreq, ndocs),
wt AS (SELECT tf.doc_id, tf.term, model.term_index, tf.tf, model.idf, tf.tf * model.idf AS w
       FROM tf JOIN model ON tf.term = model.term),
tfidf AS (SELECT doc_id, term, term_index, tf, idf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM wt)"""


@query("tfidf_top_terms", sql=f"""
WITH {CLEAN_TOKENS_SQL}, {TFIDF_SQL}
SELECT term, round(sum(tfidf) / (SELECT n_docs FROM ndocs), {DIGITS}) AS mean_tfidf
FROM tfidf GROUP BY term ORDER BY sum(tfidf) DESC, term LIMIT 20""", headline=True)
def tfidf_top_terms(spark, sf_dir):
    """Flagship: clean -> tokens -> TF-IDF fit/transform -> top-20 terms by mean tf-idf."""
    docs = TF.in_blocks(clean_tokens(spark, sf_dir))
    n_docs = docs.select("doc_id").count()  # one count serves the idf and the mean
    model = TF.tfidf_fit(docs, with_index=False, n_docs=n_docs)
    tfidf = TF.tfidf_transform(docs, model)
    top = TF.top_terms_by_mean_tfidf(tfidf, n_docs, 20)
    return top.select("term", F.round("mean_tfidf", DIGITS).alias("mean_tfidf"))


@query("tfidf_vocabulary", sql=f"""WITH {CLEAN_TOKENS_SQL}, {TFIDF_SQL}
SELECT term, term_index, df, round(idf, {DIGITS}) AS idf, n_docs FROM model""")
def tfidf_vocabulary(spark, sf_dir):
    """C6 fit + C7 sorted vocabulary index (term_index by range-partitioned sort, no
    single-partition window)."""
    m = TF.tfidf_fit(clean_tokens(spark, sf_dir))
    return m.select("term", "term_index", "df", F.round("idf", DIGITS).alias("idf"), "n_docs")


@query("tfidf_doc_terms", sql=f"""WITH {CLEAN_TOKENS_SQL}, {TFIDF_SQL}
SELECT doc_id, term, term_index, tf, round(tfidf, {DIGITS}) AS tfidf FROM tfidf""")
def tfidf_doc_terms(spark, sf_dir):
    """Long-form tf-idf of every (document, term), L2-normalised per document."""
    docs = TF.in_blocks(clean_tokens(spark, sf_dir))
    t = TF.tfidf_transform(docs, TF.tfidf_fit(docs))
    return t.select("doc_id", "term", "term_index", "tf", F.round("tfidf", DIGITS).alias("tfidf"))


@query("tfidf_default_tokenizer", sql=f"""WITH {DEFAULT_TOKENS_SQL}, {TFIDF_SQL}
SELECT term, round(sum(tfidf) / (SELECT n_docs FROM ndocs), {DIGITS}) AS mean_tfidf
FROM tfidf GROUP BY term ORDER BY sum(tfidf) DESC, term LIMIT 20""")
def tfidf_default_tokenizer(spark, sf_dir):
    """C6/C8/C9 with the vectoriser's default tokenizer (lower, runs of >= 2 word chars)."""
    docs = TF.in_blocks(default_tokens(spark, sf_dir))
    tfidf = TF.tfidf_transform(docs, TF.tfidf_fit(docs, with_index=False))
    top = TF.top_terms_by_mean_tfidf(tfidf, docs.agg(F.count(F.lit(1)).alias("n_docs")), 20)
    return top.select("term", F.round("mean_tfidf", DIGITS).alias("mean_tfidf"))


def _first_documents(docs, model):
    """The first 10 document ids and the tf-idf of those documents alone."""
    first = materialize(docs.select("doc_id").orderBy("doc_id").limit(10))
    ids = [r[0] for r in first.collect()]
    return first, TF.tfidf_transform(docs.where(F.col("doc_id").isin(ids)), model)


@query("tfidf_heatmap", sql=f"""WITH {CLEAN_TOKENS_SQL}, {TFIDF_SQL},
top AS (SELECT term FROM tfidf GROUP BY term ORDER BY sum(tfidf) DESC, term LIMIT 10),
first_docs AS (SELECT doc_id FROM docs ORDER BY doc_id LIMIT 10)
SELECT f.doc_id, t.term, round(coalesce(x.tfidf, 0.0), {DIGITS}) AS tfidf
FROM first_docs f CROSS JOIN top t LEFT JOIN tfidf x ON x.doc_id = f.doc_id AND x.term = t.term""")
def tfidf_heatmap(spark, sf_dir):
    """First 10 documents x top-10 mean-tf-idf terms, zero filled (a fixed 10x10 block)."""
    docs = TF.in_blocks(clean_tokens(spark, sf_dir))
    model = materialize(TF.tfidf_fit(docs, with_index=False))
    tfidf = TF.tfidf_transform(docs, model)
    top = TF.top_terms_by_mean_tfidf(tfidf, docs.agg(F.count(F.lit(1)).alias("n_docs")), 10).select("term")
    first, of_first = _first_documents(docs, model)
    h = TF.tfidf_heatmap(of_first, first, top)
    return h.select("doc_id", "term", F.round("tfidf", DIGITS).alias("tfidf"))


@query("doc_word_scores", sql=f"""WITH {CLEAN_TOKENS_SQL}, {TFIDF_SQL},
occ AS (SELECT doc_id, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM docs)
SELECT o.doc_id, o.pos, o.term, round(coalesce(x.tfidf, 0.0), {DIGITS}) AS tfidf
FROM occ o LEFT JOIN tfidf x ON x.doc_id = o.doc_id AND x.term = o.term""")
def doc_word_scores(spark, sf_dir):
    """C11: tf-idf of each word occurrence, for every document."""
    docs = TF.in_blocks(clean_tokens(spark, sf_dir))
    tfidf = TF.tfidf_transform(docs, TF.tfidf_fit(docs, with_index=False))
    s = TF.doc_word_scores(tfidf, docs)
    return s.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "term", F.round("tfidf", DIGITS).alias("tfidf"))


@query("tfidf_sparse_vectors", sql=f"""WITH {CLEAN_TOKENS_SQL}, {TFIDF_SQL}
SELECT doc_id, CAST((SELECT count(*) FROM model) AS INTEGER) AS size, CAST(count(*) AS INTEGER) AS nnz,
       round(sum(tfidf), {DIGITS}) AS value_sum, CAST(min(term_index) AS INTEGER) AS first_index
FROM tfidf GROUP BY doc_id""")
def tfidf_sparse_vectors(spark, sf_dir):
    """Long form -> one ML SparseVector per document; checked through the vector's
    text form (size, stored entries, sum of values, first index)."""
    docs = TF.in_blocks(clean_tokens(spark, sf_dir))
    model = TF.tfidf_fit(docs)
    size = model.agg(F.max("term_index")).first()[0] + 1
    v = TF.to_ml_vector(TF.tfidf_transform(docs, model), size).select("doc_id", F.col("features").cast("string").alias("s"))
    idx = F.split(F.regexp_extract("s", r"^\(\d+,\[([^\]]*)\]", 1), ",")
    vals = F.split(F.regexp_extract("s", r"\],\[([^\]]*)\]\)$", 1), ",")
    return v.select("doc_id", F.regexp_extract("s", r"^\((\d+),", 1).cast("int").alias("size"),
                    F.size(idx).alias("nnz"),
                    F.round(F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x.cast("double")), DIGITS).alias("value_sum"),
                    F.element_at(idx, 1).cast("int").alias("first_index"))


@query("vectorizer_save_load", sql=f"""WITH {CLEAN_TOKENS_SQL}, {TFIDF_SQL}
SELECT term, term_index, df, round(idf, {DIGITS}) AS idf, n_docs FROM model""")
def vectorizer_save_load(spark, sf_dir):
    """Persist the fitted vocabulary + idf as Parquet in the shared scratch folder and
    load it back."""
    from tessera.session import scratch_path
    from tessera.sources import files
    path = scratch_path(spark, "vectorizer")
    files.save_vectorizer(TF.tfidf_fit(clean_tokens(spark, sf_dir)), path)
    m = files.load_vectorizer(spark, path)
    return m.select("term", "term_index", "df", F.round("idf", DIGITS).alias("idf"), "n_docs")


@query("tfidf_heatmap_wide", sql=f"""WITH {CLEAN_TOKENS_SQL}, {TFIDF_SQL},
top AS (SELECT term FROM tfidf GROUP BY term ORDER BY sum(tfidf) DESC, term LIMIT 10),
first_docs AS (SELECT doc_id FROM docs ORDER BY doc_id LIMIT 10),
ranked AS (SELECT t.term, row_number() OVER (ORDER BY sum(x.tfidf) DESC, t.term) AS r FROM top t JOIN tfidf x USING (term) GROUP BY t.term),
cells AS (SELECT f.doc_id, t.r, round(coalesce(x.tfidf, 0.0), {DIGITS}) AS tfidf
          FROM first_docs f CROSS JOIN ranked t LEFT JOIN tfidf x ON x.doc_id = f.doc_id AND x.term = t.term)
SELECT doc_id, {', '.join(f'max(CASE WHEN r = {k} THEN tfidf END) AS term_{k}' for k in range(1, 11))} FROM cells GROUP BY doc_id""")
def tfidf_heatmap_wide(spark, sf_dir):
    """C10 pivoted: the 10 x 10 block with one column per top term, named by its rank."""
    docs = TF.in_blocks(clean_tokens(spark, sf_dir))
    model = materialize(TF.tfidf_fit(docs, with_index=False))
    tfidf = TF.tfidf_transform(docs, model)
    top = TF.top_terms_by_mean_tfidf(tfidf, docs.agg(F.count(F.lit(1)).alias("n_docs")), 10)
    terms = [r.term for r in top.collect()]  # the 10 column names
    first, of_first = _first_documents(docs, model)
    block = TF.tfidf_heatmap(of_first, first, terms).withColumn("tfidf", F.round("tfidf", DIGITS))
    return TF.pivot_heatmap(block, terms).toDF("doc_id", *[f"term_{k}" for k in range(1, len(terms) + 1)])
