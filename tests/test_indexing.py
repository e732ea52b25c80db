"""Scalable positions and running values equal the window-function definitions, whatever
the partitioning (metamorphic: repartition(1) vs repartition(7))."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.indexing import cumulative, dense_index


def _data(spark, parts):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), ((F.col("id") * 7) % 11).alias("v"))
    return df.repartition(parts)


def test_dense_index_matches_row_number(spark):
    for parts in (1, 7):
        df = _data(spark, parts)
        got = dense_index(df, ["o"], "i", group_cols=["g"])
        ref = df.withColumn("i", F.row_number().over(W.partitionBy("g").orderBy("o")) - 1)
        assert got.select("g", "o", "i").exceptAll(ref.select("g", "o", "i")).count() == 0
        glob = dense_index(df, ["o"], "i")
        assert sorted(r.i for r in glob.collect()) == list(range(300))


def test_cumulative_sum_and_max(spark):
    for parts in (1, 7):
        df = _data(spark, parts)
        for op, fn in (("sum", F.sum), ("max", F.max)):
            got = cumulative(df, ["g"], ["o"], ["v"], op)
            ref = df.withColumn("v_cum", fn("v").over(W.partitionBy("g").orderBy("o")).cast("double"))
            assert got.select("g", "o", "v_cum").exceptAll(ref.select("g", "o", "v_cum")).count() == 0
