"""Hot groups: a group holding a third of all rows is spread over many tasks by the
range-partitioned sort behind dense_index / cumulative, and results stay exact."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.dedup import dedup_keep_first, find_polarity_conflicts
from tessera.operators.indexing import cumulative, dense_index


def _skewed(spark):
    # group "hot" has 1/3 of the rows; the rest are spread over 200 small groups
    n = 3000
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 200).cast("string"))).alias("g"),
        F.col("id").alias("o"), (F.col("id") % 5).cast("double").alias("v")).repartition(8)


def test_hot_group_spans_partitions(spark):
    # AQE merges partitions smaller than a few MB, so this tiny table would end in one
    # partition; with coalescing off it is split the way a large table is
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        df = _skewed(spark)
        parts = (df.orderBy("g", "o").withColumn("p", F.spark_partition_id())
                   .where("g = 'hot'").select("p").distinct().count())
    finally:
        spark.conf.set(key, old)
    assert parts > 1   # the sort behind dense_index / cumulative splits the hot group


def test_exact_under_skew(spark):
    df = _skewed(spark)
    idx = dense_index(df, ["o"], "i", group_cols=["g"])
    ref = df.withColumn("i", F.row_number().over(W.partitionBy("g").orderBy("o")) - 1)
    assert idx.select("g", "o", "i").exceptAll(ref.select("g", "o", "i")).count() == 0
    cum = cumulative(df, ["g"], ["o"], ["v"], "sum")
    ref = df.withColumn("v_cum", F.sum("v").over(W.partitionBy("g").orderBy("o")))
    assert cum.select("g", "o", "v_cum").exceptAll(ref.select("g", "o", "v_cum")).count() == 0


def test_duplicate_heavy_text(spark):
    # one text copied across a third of the rows with both polarities
    rows = [(i, "same text" if i % 3 == 0 else f"t{i}", "en", i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sentiment string, polarity int").repartition(8)
    assert [r.text for r in find_polarity_conflicts(df).collect()] == ["same text"]
    kept = dedup_keep_first(df)
    assert kept.count() == 401 and kept.where("text = 'same text'").first().doc_id == 0
