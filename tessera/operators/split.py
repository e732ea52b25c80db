"""Exact stratified splits, k folds, random under-sampling and the leak audit.

Randomness is a hash of (seed, id) — the same rows are chosen whatever the partitioning
or the number of executors, and the SQL oracle can reproduce it. Positions within a class
come from ``dense_index`` (range-partitioned), because a majority class may hold a third
of all rows. Only (class, hash, id) is sorted: a split by quota needs just the last chosen
row of each class, which filters the payload where it lies. ``id_col`` must be unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.indexing import dense_index, materialize, portable_random_key


def _mark_first(df: DataFrame, quotas: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    """Add ``_first``: whether the row is among the first ``quota`` of its class in hash order
    (null for classes without a quota). The k-row ``quotas`` table gets the key of each class's
    last chosen row; the payload is neither sorted nor shuffled."""
    key = portable_random_key(id_col, seed)
    ranked = dense_index(df.select(label, id_col, key.alias("_key")), ["_key", id_col], "_rank", group_cols=[label])
    last = (ranked.join(F.broadcast(quotas), label).where(F.col("_rank") == F.col("quota") - 1)
                  .select(label, F.col("_key").alias("_last_key"), F.col(id_col).alias("_last_id")))
    bounds = quotas.join(F.broadcast(last), label, "left")  # k rows on both sides
    up_to = (key < F.col("_last_key")) | ((key == F.col("_last_key")) & (F.col(id_col) <= F.col("_last_id")))
    return (df.join(F.broadcast(bounds), label, "left")
              .withColumn("_first", (F.col("quota") > 0) & F.coalesce(up_to, F.lit(True)))  # no last row: quota >= class
              .select(*df.columns, "_first"))


def test_quota(df: DataFrame, label: str, test_size: float) -> DataFrame:
    """Per-class test counts: n_test = ceil(test_size * n) in total, floor(n_c * f) per class,
    the remainder to the classes with the largest fractional parts (ties: lower label).
    Operates on the k-row class table."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w_all = Window.partitionBy()
    c = (c.withColumn("n", F.sum("n_c").over(w_all))
          .withColumn("exact", F.col("n_c") * F.lit(float(test_size)))
          .withColumn("base", F.floor("exact").cast("long"))
          .withColumn("n_test", F.ceil(F.col("n") * F.lit(float(test_size))).cast("long"))
          .withColumn("rest", F.col("n_test") - F.sum("base").over(w_all))
          .withColumn("_order", F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("base")), F.col(label)))))
    return c.select(label, "n_c", (F.col("base") + F.when(F.col("_order") <= F.col("rest"), 1).otherwise(0)).alias("quota"))


# X1
def stratified_split(df: DataFrame, label: str, test_size: float, seed: int, id_col: str,
                     out: str = "split", names=("train", "test")) -> DataFrame:
    """Exact per-class proportions: in each class the ``quota`` rows first in hash order go
    to the test side."""
    q = materialize(test_quota(df, label, test_size).select(label, "quota"))  # k rows, read twice
    r = _mark_first(df, q, label, id_col, seed)
    return r.withColumn(out, F.when(F.col("_first"), names[1]).otherwise(names[0])).drop("_first")


# X2
def train_test_val_split(df: DataFrame, label: str, test_size: float, val_size: float, seed: int,
                         id_col: str, out: str = "split") -> DataFrame:
    """Two stratified steps as in the reference: train vs. a held-out share test + val, then
    the held-out rows split into test and validation, validation taking the fraction
    val / (test + val)."""
    s1 = stratified_split(df, label, test_size + val_size, seed, id_col, "_s1", ("train", "held"))
    train = s1.where(F.col("_s1") == "train").withColumn(out, F.lit("train")).drop("_s1")
    held = s1.where(F.col("_s1") == "held").drop("_s1")
    s2 = stratified_split(held, label, val_size / (test_size + val_size), seed + 1, id_col, out, ("test", "validation"))
    return train.unionByName(s2)


# X3
def stratified_kfold(df: DataFrame, label: str, k: int, seed: int, id_col: str, out: str = "fold") -> DataFrame:
    """Fold = position in (class, hash) order mod k: every class is spread evenly over the folds
    and starts where the one before it ended, so the folds' sizes differ by at most one too."""
    narrow = df.select(label, id_col, portable_random_key(id_col, seed).alias("_key"))
    r = dense_index(narrow, [label, "_key", id_col], "_rank")
    folds = r.select(id_col, F.pmod(F.col("_rank"), F.lit(k)).cast("int").alias(out))
    return df.join(folds, id_col).select(*df.columns, out)


# X4
def random_undersample(df: DataFrame, label: str, targets: dict, seed: int, id_col: str) -> DataFrame:
    """Keep ``targets[c]`` random rows of each listed class, all rows of other classes."""
    spark = df.sparkSession
    t = spark.createDataFrame([(k, int(v)) for k, v in targets.items()], f"{label} {dict(df.dtypes)[label]}, quota long")
    return _mark_first(df, t, label, id_col, seed).where(F.coalesce("_first", F.lit(True))).drop("_first")


# X10
def leak_audit(train: DataFrame, test: DataFrame, id_col: str, source_col: str = "source_id") -> DataFrame:
    """Rows of ``train`` derived from (or equal to) a test row: (n_leaked_rows,
    n_test_sources). Synthetic rows carry the id of the row they were made from."""
    src = train.select(F.coalesce(F.col(source_col), F.col(id_col)).alias("_src"))
    leaked = src.join(test.select(F.col(id_col).alias("_src")).distinct(), "_src", "left_semi")
    return leaked.agg(F.count(F.lit(1)).alias("n_leaked_rows"), F.count_distinct("_src").alias("n_test_sources"))
