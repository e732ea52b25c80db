"""Array / vector column functions built from Spark higher-order functions (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_term_frequencies(df: DataFrame, tokens_col: str, out: str = "tfs") -> DataFrame:
    """Add ``out`` = array<struct<term, tf>>: the distinct tokens of each row with counts.

    Sorts the row's tokens and run-length encodes them, so term counts per document need
    no shuffle (every token of a document is in one row). The sorted array and the run
    starts are separate projections: Spark does not share subexpressions inside lambdas,
    and CollapseProject keeps an expensive column that is referenced several times.
    """
    empty_s = F.array().cast("array<string>")
    x = df.withColumn("_s", F.array_sort(F.coalesce(F.col(tokens_col), empty_s)))
    n = F.size("_s")
    x = x.withColumn("_st", F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(1), n),
                 lambda i: (i == 1) | (F.element_at("_s", i) != F.element_at("_s", F.greatest(i - 1, F.lit(1)))))))
    k = F.size("_st")
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
        lambda j: F.struct(
            F.element_at("_s", F.element_at("_st", j)).alias("term"),
            (F.when(j < k, F.element_at("_st", F.least(j + 1, k))).otherwise(n + 1)
             - F.element_at("_st", j)).cast("long").alias("tf")))
    return x.withColumn(out, F.when(k == 0, F.array().cast("array<struct<term:string,tf:bigint>>"))
                        .otherwise(runs)).drop("_s", "_st")


def to_double_array(v) -> Column:
    return F.transform(col_(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(col_(a), lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def cosine(a, b) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def sq_dist(a, b) -> Column:
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, x: acc + x)


def normalize(a) -> Column:
    nrm = l2_norm(a)
    return F.transform(col_(a), lambda x: x / nrm)


def scale(a, s) -> Column:
    return F.transform(col_(a), lambda x: x * s)


def axpy(x, u, y) -> Column:
    """x + u * (y - x), elementwise (SMOTE interpolation)."""
    return F.zip_with(col_(x), col_(y), lambda a, b: a + u * (b - a))


def softmax(logits) -> Column:
    lg = to_double_array(logits)
    m = F.array_max(lg)
    ex = F.transform(lg, lambda x: F.exp(x - m))
    tot = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / tot)


def argmax(v) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(col_(v), F.array_max(col_(v))) - 1).cast("int")


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def round_array(a, digits: int = 6) -> Column:
    return F.transform(col_(a), lambda x: F.round(x, digits))


def explode_rows(df: DataFrame, keep, array_col, alias: str = "e", pos: str | None = None) -> DataFrame:
    """explode (or posexplode) without the optimizer's inferred ``size(array) > 0`` filter.

    For ``explode`` Spark infers a filter that re-evaluates the whole array expression
    (a cleaning chain, a run-length encoding) a second time below the generator.
    ``explode_outer`` has no inferred filter; the null rows it emits for empty arrays are
    dropped right after. Array elements are never null here.
    """
    keep = list(keep)
    c = F.col(array_col) if isinstance(array_col, str) else array_col
    if pos:
        out = df.select(*keep, F.posexplode_outer(c).alias(pos, alias))
    else:
        out = df.select(*keep, F.explode_outer(c).alias(alias))
    return out.where(F.col(alias).isNotNull())
