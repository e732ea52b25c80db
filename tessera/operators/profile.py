"""Projection, filters, predicates and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.indexing import portable_random_key


# P1
def select_columns(df: DataFrame, cols) -> DataFrame:
    return df.select(*cols)


def drop_columns(df: DataFrame, cols) -> DataFrame:
    return df.drop(*cols)


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def column_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """Inclusive label range of columns, like ``.loc[:, first:last]``."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    return df.select(*cols[i:j + 1])


# P2
def move_last(df: DataFrame, col: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != col], col)


# P3
def drop_class(df: DataFrame, col: str, value) -> DataFrame:
    """Rows whose ``col`` is not ``value``; nulls are kept (null-safe inequality)."""
    return df.where(~F.col(col).eqNullSafe(F.lit(value)))


# P4
def filter_isin(df: DataFrame, col: str, values) -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def filter_greater(df: DataFrame, col: str, bound) -> DataFrame:
    return df.where(F.col(col) > F.lit(bound))


# P5
def filter_disjunction_rules(df: DataFrame, rules, cols=("sentiment", "polarity")) -> DataFrame:
    """Rows matching any rule (an OR of column-value tuples) via a semi join with the rule
    table. The rule table is a literal list of a few rows, so broadcasting it is bounded."""
    spark = df.sparkSession
    schema = ", ".join(f"{c} {t}" for c, t in zip(cols, [dict(df.dtypes)[c] for c in cols]))
    rule_df = spark.createDataFrame([tuple(r) for r in rules], schema)
    return df.join(F.broadcast(rule_df), list(cols), "left_semi")


# P6
def null_count(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    agg = F.count_if(F.col(col).isNull()).alias("n_null")
    return df.groupBy(by).agg(agg) if by else df.agg(agg)


# P7
def profile(df: DataFrame) -> DataFrame:
    """(column_name, dtype, non_null, n_rows): one pass of ``count(c)`` per column, then
    unpivoted to long form."""
    dtypes = dict(df.dtypes)
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    long = wide.unpivot("__rows", df.columns, "column_name", "non_null")
    types = df.sparkSession.createDataFrame([(c, t) for c, t in dtypes.items()], "column_name string, dtype string")
    return (long.join(F.broadcast(types), "column_name")  # one row per column: bounded
                .select("column_name", "dtype", "non_null", F.col("__rows").alias("n_rows")))


# P8
def sample_distinct(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """n rows without replacement, chosen by a hash of (seed, id): reproducible whatever the
    partitioning. ``orderBy().limit()`` plans as a per-task top-n, not a full sort."""
    return df.orderBy(portable_random_key(id_col, seed), F.col(id_col)).limit(n)


def assert_sample_size(df: DataFrame, n: int) -> None:
    total = df.count()
    if n > total:
        raise ValueError(f"sample of {n} rows requested from {total}")


# P9
def head(df: DataFrame, n: int, order_col: str) -> DataFrame:
    return df.orderBy(order_col).limit(n)


# P10
def validate_columns(df: DataFrame, required) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
