"""Corpus statistics over token arrays: word counts, top / bottom words, n-grams,
per-class term counts, vocabulary size and sequence-length statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.arrays import explode_rows


def _tokens_long(df: DataFrame, doc_col: str, tokens_col: str, extra=()) -> DataFrame:
    """(doc, pos, term) rows; map-only (explode keeps the scan's partitioning)."""
    return explode_rows(df, [doc_col, *extra], tokens_col, "term", pos="pos")


# C1
def word_counts(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(term, count) over the corpus. The partial (map-side) count collapses a hot term
    before the shuffle, so skew costs one row per map task."""
    return explode_rows(df, [], tokens_col, "term").groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def _first_seen_counts(df, doc_col, tokens_col):
    """(term, count, first_seen). For whole-number document ids the first appearance is one
    decimal (id, then position): unlike a struct it fits a hash aggregate's buffer, so the
    occurrences are not sorted."""
    if dict(df.dtypes)[doc_col] in ("bigint", "int", "smallint", "tinyint"):
        seen = F.col(doc_col).cast("decimal(19,0)") * F.lit(2 ** 31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
    else:
        seen = F.struct(F.col(doc_col).alias("d"), F.col("pos").alias("p"))
    return (_tokens_long(df, doc_col, tokens_col)
            .groupBy("term").agg(F.count(F.lit(1)).alias("count"), F.min(seen).alias("first_seen")))


# C2
def top_words(df: DataFrame, n: int = 10, doc_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """Most common n terms; ties keep first appearance (document order, then position).
    ``limit`` after ``orderBy`` plans as TakeOrderedAndProject: per-task top-n, no full sort."""
    c = _first_seen_counts(df, doc_col, tokens_col)
    return (c.orderBy(F.col("count").desc(), F.col("first_seen").asc()).limit(n)
             .select("term", "count"))


# C3
def bottom_words(df: DataFrame, n: int = 10, doc_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """The n least common terms, least first; among equal counts the later-seen first."""
    c = _first_seen_counts(df, doc_col, tokens_col)
    return (c.orderBy(F.col("count").asc(), F.col("first_seen").desc()).limit(n)
             .select("term", "count"))


# T14 as a DataFrame operator: column ``n-gram-{n}``
def add_ngrams(df: DataFrame, n: int, tokens_col: str = "tokens") -> DataFrame:
    return df.withColumn(T.ngram_column_name(n), T.ngrams(tokens_col, n))


# C4
def top_ngrams(df: DataFrame, n: int, top_n: int = 10, doc_col: str = "doc_id",
               tokens_col: str = "tokens") -> DataFrame:
    g = df.select(doc_col, T.ngrams(tokens_col, n).alias("ngrams"))
    out = top_words(g, top_n, doc_col, "ngrams")
    return out.withColumnRenamed("term", "ngram")


# C5
def class_term_counts(df: DataFrame, class_col: str, tokens_col: str = "tokens",
                      only_class=None) -> DataFrame:
    """(class, term, count); all classes in one pass, or one class (filter pushed first)."""
    if only_class is not None:
        df = df.where(F.col(class_col) == F.lit(only_class))
    return (explode_rows(df, [class_col], tokens_col, "term")
              .groupBy(class_col, "term").agg(F.count(F.lit(1)).alias("count")))


# A9
def vocabulary_size(df: DataFrame, tokens_col: str = "tokens", approx: bool = False,
                    rsd: float = 0.01) -> DataFrame:
    """Distinct tokens. Exact: two-level distinct (partial dedup per task, then count);
    approximate: HyperLogLog++ sketch merged across tasks, bounded memory."""
    t = explode_rows(df, [], tokens_col, "term")
    if approx:
        return t.agg(F.approx_count_distinct("term", rsd).alias("vocabulary_size"))
    return t.agg(F.count_distinct("term").alias("vocabulary_size"))


# T13
def add_text_length(df: DataFrame, tokens_col: str = "tokens", name: str = "length") -> DataFrame:
    return df.withColumn(name, T.text_length(tokens_col))


# A10
def sequence_length_stats(df: DataFrame, length_col: str = "length", max_len: int = 100,
                          percentiles=(0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """max / mean / exact percentiles of token counts and the share longer than max_len."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.max(length_col).alias("max_length"),
            F.avg(length_col).alias("mean_length"),
            F.count_if(F.col(length_col) > max_len).alias("n_over_max")]
    for p in percentiles:
        aggs.append(F.percentile(F.col(length_col), p).alias(f"p{int(round(p * 100))}"))
    return df.agg(*aggs)


def length_sketches(df: DataFrame, by, length_col: str = "length", k: int = 200) -> DataFrame:
    """A10 in parts: one mergeable KLL sketch of the lengths per group of ``by`` (a split, a day):
    (by..., sketch). It keeps about 3k values whatever the group's size; up to k values it is exact,
    beyond that ranks are off by about 2.3 / k**0.9 of the rows (99 % confidence). Nulls take no part."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_bigint(F.col(length_col).cast("long"), F.lit(k)).alias("sketch"))


def merged_length_stats(sketches: DataFrame, by=(), percentiles=(0.5, 0.9, 0.95, 0.99), sketch: str = "sketch", k: int = 200) -> DataFrame:
    """Sketches of several parts merged, e.g. stored by earlier runs: (by..., n_rows, p50, ...).
    A percentile is the smallest length whose rank reaches it; null without rows."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint(sketch, F.lit(k)).alias("_s"))
    n = F.kll_sketch_get_n_bigint("_s")
    at = [F.when(n > 0, F.kll_sketch_get_quantile_bigint("_s", F.lit(float(p)))).alias(f"p{int(round(p * 100))}") for p in percentiles]
    return merged.select(*by, n.alias("n_rows"), *at)
