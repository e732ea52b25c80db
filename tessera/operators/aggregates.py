"""Counts, shares, class weights, histograms, density and annotator agreement.

All are partially-aggregated group-bys: skewed groups collapse on the map side.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import explode_rows


# A1 / A5
def value_counts(df: DataFrame, cols) -> DataFrame:
    """Counts of (combinations of) values, nulls dropped, most frequent first."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return (df.dropna(subset=cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), *cols))


# A2
def group_size(df: DataFrame, keys, name: str = "size") -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


# A3
def class_share(df: DataFrame, cols) -> DataFrame:
    """Percent of all rows per value combination. The total comes from a window over the
    already-aggregated (small) group table, not over the rows."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("percent", F.lit(100.0) * F.col("count") / F.sum("count").over(Window.partitionBy()))


# A4
def split_class_counts(df: DataFrame, split: str = "split", label: str = "label", totals: bool = False) -> DataFrame:
    if totals:
        return df.cube(split, label).agg(F.count(F.lit(1)).alias("count"))
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("count"))


# A6
def balanced_class_weights(df: DataFrame, label: str = "label", normalize: bool = False) -> DataFrame:
    """w_c = n / (k * n_c); optionally divided by the sum of weights. Keyed by label, so it
    does not assume labels 0..k-1."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w_all = Window.partitionBy()  # over the k-row class table
    g = g.withColumn("weight", F.sum("n_c").over(w_all) / (F.count(F.lit(1)).over(w_all) * F.col("n_c")))
    if normalize:
        g = g.withColumn("weight", F.col("weight") / F.sum("weight").over(w_all))
    return g


# J6
def sample_weights(df: DataFrame, weights: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Per-row weight by class lookup (the class table has one row per class)."""
    return df.join(F.broadcast(weights.select(label, F.col("weight").alias(out))), label, "left")


# A7
def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed. (bin, lo, hi, count);
    empty bins are listed with count 0."""
    r = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()  # 2 scalars
    lo, hi = F.lit(r["lo"]), F.lit(r["hi"])
    width = (hi - lo) / bins
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1))).cast("int")
    counted = df.where(F.col(col).isNotNull()).select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counted, "bin", "left")
                .select("bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"),
                        F.coalesce("count", F.lit(0)).alias("count")))


# A8
def kde(df: DataFrame, col: str, points: int = 100) -> DataFrame:
    """Gaussian kernel density on an evenly spaced grid over [min, max], Scott bandwidth
    (n^(-1/5) * sample std). One sum per grid point in a single aggregate: no join, no row per
    (row, point)."""
    st = df.agg(F.count(col).alias("n"), F.stddev_samp(col).alias("sd"),
                F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()  # 4 scalars
    n = st["n"]
    h = st["sd"] * float(n) ** -0.2
    lo, hi = st["lo"], st["hi"]
    step = (hi - lo) / (points - 1)
    x = [lo + i * step for i in range(points)]
    sums = df.agg(*[F.sum(F.exp(-0.5 * F.pow((F.lit(p) - F.col(col)) / F.lit(h), 2))).alias(f"s{i}") for i, p in enumerate(x)])
    grid = F.array(*[F.struct(F.lit(i).alias("point"), F.lit(p).alias("x"), F.col(f"s{i}").alias("s")) for i, p in enumerate(x)])
    return sums.select(F.explode(grid).alias("g")).select(
        "g.point", "g.x", (F.col("g.s") / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density"))


# A11
def krippendorff_alpha_nominal(df: DataFrame, unit: str, raters) -> DataFrame:
    """Krippendorff's alpha for nominal data, missing ratings ignored.

    alpha = 1 - (n - 1) * sum_u (m_u^2 - sum_c n_uc^2) / (m_u - 1) / (n^2 - sum_c n_c^2),
    over pairable units (m_u >= 2), one row per unit. The unit's terms are computed in its row,
    then one aggregate per value: one scan, no rating pairs.
    """
    ratings = F.filter(F.array(*[F.col(r) for r in raters]), lambda v: v.isNotNull())
    rows = df.select(ratings.alias("_v")).where(F.size("_v") >= 2)
    m = F.size("_v")
    sq = F.aggregate("_v", F.lit(0), lambda acc, v: acc + F.size(F.filter("_v", lambda w: w == v)))  # sum of n_uc^2
    # the unit's share of the observed disagreement goes with its first rating
    rows = rows.select("_v", ((m * m - sq) / (m - 1)).alias("_d"))
    long = rows.select("_d", F.posexplode("_v").alias("_i", "value"))
    by_value = long.groupBy("value").agg(F.count(F.lit(1)).cast("double").alias("n_c"),
                                         F.sum(F.when(F.col("_i") == 0, F.col("_d"))).alias("d_o"))
    one = by_value.agg(F.sum("d_o").alias("d_o"), F.sum("n_c").alias("n"), F.sum(F.col("n_c") * F.col("n_c")).alias("sq_c"))
    return one.select(
        (F.lit(1.0) - (F.col("n") - 1) * F.col("d_o") / (F.col("n") * F.col("n") - F.col("sq_c"))).alias("alpha"),
        F.col("n").cast("long").alias("n_pairable_values"))
