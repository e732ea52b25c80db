"""As-of join and interpolation (J9) without a range join and without a window over a whole key.

Curve and grid rows are united and sorted once by (key, x): a hot key spreads over many range
partitions. Inside a partition the last curve row before (and the first one after) each grid row is
a running value; what a partition needs from its neighbours is one curve row per key, so a table of
at most (partitions x keys in them) rows carries it across.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.indexing import materialize


def _bracketed(curve: DataFrame, grid: DataFrame, x: str, by: list[str], carried: list[str], sides) -> DataFrame:
    """The grid's rows with ``_lo`` (last curve row at or before x) and ``_hi`` (first at or after x)."""
    key = [F.col(c) for c in by]
    # one curve row per (key, x): the largest of the carried values
    kept = curve.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.max(F.struct(*carried)).alias("_v"))
    point = F.struct(F.col(x).alias("x"), F.col("_v").alias("v"))
    left = kept.select(*key, F.col(x).alias("_x"), point.alias("_p"), F.lit(None).cast(grid.select(F.struct(*grid.columns)).schema[0].dataType).alias("_g"))
    right = grid.select(*key, F.col(x).alias("_x"), F.lit(None).cast(left.schema["_p"].dataType).alias("_p"), F.struct(*grid.columns).alias("_g"))
    rows = left.unionByName(right).orderBy(*by, "_x", F.col("_p").isNull())
    rows = materialize(rows.withColumn("_part", F.spark_partition_id()))
    out = rows
    ends = rows.where(F.col("_p").isNotNull()).groupBy("_part", *by).agg(F.min_by("_p", "_x").alias("_first"), F.max_by("_p", "_x").alias("_last"))
    parts = rows.select("_part", *by).distinct().join(ends, ["_part", *by], "left")  # one row per partition and key in it
    over = Window.partitionBy(*by).orderBy("_part") if by else Window.partitionBy(F.lit(0)).orderBy("_part")
    parts = parts.select("_part", *by, F.last("_last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_in_lo"),
                         F.first("_first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_in_hi"))
    within = Window.partitionBy("_part", *by)
    if "lo" in sides:  # at equal x the curve row comes first
        w = within.orderBy(F.col("_x"), F.col("_p").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("_lo", F.last("_p", True).over(w))
    if "hi" in sides:
        w = within.orderBy(F.col("_x").desc(), F.col("_p").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("_hi", F.last("_p", True).over(w))
    out = out.where(F.col("_g").isNotNull())
    cond = [out[c].eqNullSafe(parts[c]) for c in ["_part", *by]]
    all_of = cond[0]
    for c in cond[1:]:
        all_of = all_of & c
    out = out.join(parts, all_of, "left").select("_g", *[F.coalesce(f"_{s}", f"_in_{s}").alias(f"_{s}") for s in sides])
    return out


def asof_join(left: DataFrame, right: DataFrame, on: str, by=(), values=(), direction: str = "backward") -> DataFrame:
    """Every row of ``left`` with ``values`` of the last row of ``right`` at or before its ``on``
    ("backward"), or of the first at or after ("forward"), within equal ``by``.

    Columns added: ``right_<on>`` and the ``values`` (null without such a row). Several right rows at
    one ``on``: the one with the largest values, in order. A null ``on`` matches nothing; null keys
    are keys like any other; rows of ``left`` stay whole, repeated ones too.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be backward or forward")
    by, values, side = list(by), list(values), "lo" if direction == "backward" else "hi"
    known = left.where(F.col(on).isNotNull())
    out = _bracketed(right, known, on, by, values, [side])
    hit = out.select("_g.*", F.col(f"_{side}.x").alias(f"right_{on}"), *[F.col(f"_{side}.v.{v}").alias(v) for v in values])
    return hit.unionByName(left.where(F.col(on).isNull()), allowMissingColumns=True)


def interp_asof(curve: DataFrame, grid: DataFrame, x: str, y: str, by=(), out: str | None = None) -> DataFrame:
    """The grid's rows with ``y`` of the curve at their ``x``, linear between the bracketing points;
    left of the first and right of the last point their value holds (as ``numpy.interp``).

    Points with a null x or y are no points; of several at one x the largest y counts. Null without
    any point of the key, or for a null x.
    """
    by, out = list(by), out or y
    known = grid.where(F.col(x).isNotNull())
    rows = _bracketed(curve.where(F.col(y).isNotNull()), known, x, by, [y], ["lo", "hi"])
    at, lo, hi = F.col(f"_g.{x}").cast("double"), F.col("_lo"), F.col("_hi")
    x0, x1, y0, y1 = (c.cast("double") for c in (lo["x"], hi["x"], lo["v"][y], hi["v"][y]))
    value = F.when(lo.isNull(), y1).when(hi.isNull() | (x0 == x1), y0).otherwise(y0 + (y1 - y0) * (at - x0) / (x1 - x0))
    hit = rows.select("_g.*", value.alias(out))
    return hit.unionByName(grid.where(F.col(x).isNull()), allowMissingColumns=True)
