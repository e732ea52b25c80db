"""Dense row numbers without single-task windows.

``row_number() OVER (PARTITION BY g ORDER BY k)`` sends every row of a group to one task;
with one group holding a third of the data (a majority class, a hot run) that task holds a
third of the data, and without PARTITION BY the whole table goes to one task.

Instead: range-partition and sort on (g, k) — Spark samples the keys, so a hot group is
split over many partitions — tag rows with ``monotonically_increasing_id`` (ordered within a
partition), count rows per (partition, group) — a table of at most
#partitions + #groups rows — and turn those counts into offsets. The tagged table is
checkpointed first so that the ids and the offsets come from one materialisation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def _cols(cs):
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dense_index(df: DataFrame, order_cols, name: str = "idx", group_cols=(), start: int = 0) -> DataFrame:
    """Add ``name`` = position of the row within its group in ``order_cols`` order.

    ``order_cols`` must make the order total within a group (add an id as tie-breaker)
    for the result to be deterministic. Equivalent to
    ``row_number() OVER (PARTITION BY group_cols ORDER BY order_cols) - 1 + start``.
    """
    group_cols = list(group_cols)
    gnames = [c for c in group_cols]
    keys = _cols(group_cols) + _cols(order_cols)
    tagged = (df.orderBy(*keys)
                .withColumn("_mid", F.monotonically_increasing_id())
                .withColumn("_part", F.spark_partition_id()))
    tagged = materialize(tagged)
    seg = tagged.groupBy("_part", *gnames).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*gnames).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) \
        if gnames else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    joined = tagged.join(seg.drop("_n"), on=["_part", *gnames], how="inner") if gnames else \
        tagged.join(F.broadcast(seg.drop("_n")), on=["_part"], how="inner")  # one row per partition
    return joined.withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first") + F.lit(start)) \
                 .drop("_mid", "_part", "_first", "_off")


def portable_random_key(id_col, seed: int) -> "F.Column":
    """Deterministic pseudo-random sort key: md5 of 'seed:id' (same in Spark and SQL).

    Depends only on the id and the seed, never on partitioning or task order.
    SQL twin: ``md5(CAST(seed AS VARCHAR) || ':' || CAST(id AS VARCHAR))``.
    """
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def random_key_sql(id_expr: str, seed: int) -> str:
    return f"md5('{seed}:' || CAST({id_expr} AS VARCHAR))"


def unit_uniform(id_col, seed: int, salt: str = "u") -> "F.Column":
    """Deterministic U[0,1) from the id: first 13 hex digits of md5 / 16^13."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:{salt}:"), c.cast("string"))), 1, 13)
    return F.conv(h, 16, 10).cast("double") / float(16 ** 13)


def unit_uniform_sql(id_expr: str, seed: int, salt: str = "u") -> str:
    return (f"(CAST(('0x' || substr(md5('{seed}:{salt}:' || CAST({id_expr} AS VARCHAR)), 1, 13)) AS BIGINT)"
            f" / {float(16 ** 13)!r})")


def cumulative(df: DataFrame, group_cols, order_cols, value_cols, op: str = "sum",
               suffix: str = "_cum", before: bool = False) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value_cols`` within each group in ``order_cols`` order
    (rows up to and including the current one), without a window that holds a whole group.
    ``before`` adds ``<col>_before``, the same without the current row (null for the first).

    Same idea as ``dense_index``: a range-partitioned sort spreads a hot group over many
    partitions; each partition computes its running values in one vectorised pass
    (``mapInPandas`` keeps the partitioning, no shuffle); a table of per-(partition, group)
    totals — at most #partitions + #groups rows — turns into offsets that are added back.
    """
    import pandas as pd
    from pyspark.sql import types as Ty

    group_cols, value_cols = list(group_cols), list(value_cols)
    keys = _cols(group_cols) + _cols(order_cols)
    ends = [suffix, "_before"] if before else [suffix]
    tagged = materialize(df.orderBy(*keys).withColumn("_part", F.spark_partition_id()))
    out_fields = list(tagged.schema.fields) + [Ty.StructField(v + x, Ty.DoubleType()) for v in value_cols for x in ends]
    schema = Ty.StructType(out_fields)

    def run(batches):
        # rows arrive sorted by (group, order), so groups are contiguous runs; only the last
        # group of a batch can continue into the next batch of the same partition
        last_key, last_val = None, {}
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(**{v + x: pd.Series(dtype="float64") for v in value_cols for x in ends})
                continue
            cont = pd.Series(last_key is not None, index=pdf.index)
            if last_key is not None:
                for c, k in zip(group_cols, last_key):
                    col = pdf[c]
                    cont &= col.isna() if k is None else col.eq(k).fillna(False)
            out = {}
            for v in value_cols:
                vals = pdf[v].astype("float64")
                if group_cols:
                    g = vals.groupby([pdf[c] for c in group_cols], sort=False, dropna=False)
                    run_v = g.cumsum() if op == "sum" else g.cummax()
                else:
                    run_v = vals.cumsum() if op == "sum" else vals.cummax()
                if last_key is not None and cont.any():
                    prev = last_val[v]
                    run_v = run_v.where(~cont, run_v + prev if op == "sum" else run_v.clip(lower=prev))
                out[v + suffix] = run_v.values
                if before:
                    prev_v = run_v.groupby([pdf[c] for c in group_cols], sort=False, dropna=False).shift(1) \
                        if group_cols else run_v.shift(1)
                    if bool(cont.iloc[0]):  # the batch goes on with the last group of the one before
                        prev_v.iloc[0] = last_val[v]
                    out[v + "_before"] = prev_v.values
                last_val[v] = float(run_v.iloc[-1])
            tail = pdf.iloc[-1]
            last_key = tuple(None if pd.isna(tail[c]) else tail[c] for c in group_cols)
            yield pdf.assign(**out)

    within = tagged.mapInPandas(run, schema)
    agg = F.sum if op == "sum" else F.max
    seg = tagged.groupBy("_part", *group_cols).agg(*[agg(F.col(v).cast("double")).alias(v + "_seg") for v in value_cols])
    w = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()).orderBy("_part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.select("_part", *group_cols, *[agg(v + "_seg").over(w).alias(v + "_off") for v in value_cols])
    j = within.join(seg, ["_part", *group_cols], "left")
    for v in value_cols:
        off = F.col(v + "_off")
        j = j.withColumn(v + suffix, F.when(off.isNull(), F.col(v + suffix)).otherwise(
            off + F.col(v + suffix) if op == "sum" else F.greatest(off, F.col(v + suffix))))
        if before:  # pandas' missing value arrives as NaN or null
            own = F.nanvl(v + "_before", F.lit(None).cast("double"))
            j = j.withColumn(v + "_before", F.coalesce(off + own, off, own) if op == "sum" else F.greatest(off, own))
    return j.drop("_part", *[v + "_off" for v in value_cols])
