"""Scans and sinks (S1-S10): CSV corpora, split datasets, word-vector text files,
vectoriser / model persistence, trial logs and appended run metrics.

Every writer is a distributed write (one file per task); nothing is funnelled through
one task or the driver.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

# Nulls are written as NULL_MARK, so that empty texts, outer blanks and nulls all come back;
# a row that does not fit its schema fails the read.
NULL_MARK = "\\N"
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "nullValue": NULL_MARK,
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _csv_options(multi_line: bool, null: str = NULL_MARK, **more) -> dict:
    return CSV_OPTIONS | {"multiLine": str(multi_line).lower(), "mode": "FAILFAST", "nullValue": null} | more


# S1
def read_corpus_csv(spark: SparkSession, path: str, schema: Ty.StructType | str, multi_line: bool = True,
                    null: str = NULL_MARK) -> DataFrame:
    """CSV with a header; explicit schema, no inference pass. ``multi_line`` lets quoted fields
    span lines, at the price of one task per file; without it files are split. ``null`` is the
    text that stands for null (files of other writers often use the empty string)."""
    return spark.read.schema(schema).options(**_csv_options(multi_line, null)).csv(path)


# S2
def read_headerless_csv(spark: SparkSession, path: str, names, order=None, schema=None, multi_line: bool = False,
                        null: str = NULL_MARK) -> DataFrame:
    """A CSV whose first data row must not be taken as a header: read with header=false,
    name the columns, optionally reorder them."""
    r = spark.read.options(**_csv_options(multi_line, null, header="false"))
    df = (r.schema(schema) if schema is not None else r).csv(path)
    df = df.toDF(*names)
    return df.select(*(order or names))


# S3
def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if fmt == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        w.format(fmt).save(path)
    return path


# S4
def write_splits(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> str:
    """One directory per split (``split=train/``...), so reading one split prunes the rest."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)
    return path


def read_splits(spark: SparkSession, path: str, split: str | None = None, split_col: str = "split") -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col(split_col) == split) if split is not None else df


# S5
def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word2vec / GloVe text: ``word v1 ... vd`` per line, optional ``V D`` header line
    (recognised as a line of exactly two integer fields). -> (word, vector array<float>)."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("f"))
    is_header = (F.size("f") == 2) & F.col("f")[0].rlike("^[0-9]+$") & F.col("f")[1].rlike("^[0-9]+$")
    body = lines.where((F.size("f") > 1) & ~is_header)
    return body.select(F.col("f")[0].alias("word"),
                       F.transform(F.slice("f", 2, F.size("f") - 1), lambda x: x.cast("float")).alias("vector"))


# S6
def write_word_vectors(df: DataFrame, path: str, word: str = "word", vector: str = "vector") -> str:
    """Header ``V D`` then one ``word v1 ... vd`` line per word with 6 decimals.

    V and D are counted (not hard-coded). The header sorts first and the lines are
    range-partitioned by word, so the part files concatenated in name order form one
    valid file — without funnelling all vectors through one task.
    """
    stats = df.agg(F.count(F.lit(1)).alias("v"), F.max(F.size(vector)).alias("d")).first()
    spark = df.sparkSession
    header = spark.createDataFrame([(0, "", f"{stats['v']} {stats['d']}")], "k int, word string, line string")
    lines = df.select(F.lit(1).alias("k"), F.col(word).alias("word"),
                      F.concat_ws(" ", F.col(word), F.array_join(F.transform(vector, lambda x: F.format_string("%.6f", x)), " "))
                      .alias("line"))
    out = header.unionByName(lines).orderBy("k", "word").select("line")
    out.write.mode("overwrite").text(path)
    return path


# S7
def save_vectorizer(model: DataFrame, path: str) -> str:
    model.write.mode("overwrite").parquet(path)
    return path


def load_vectorizer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# S8
def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


# S9
TRIAL_LOG_SCHEMA = Ty.StructType([
    Ty.StructField("index", Ty.LongType()), Ty.StructField("f1", Ty.DoubleType()),
    Ty.StructField("timestamp", Ty.LongType()), Ty.StructField("checkpoint_dir_name", Ty.StringType()),
    Ty.StructField("done", Ty.BooleanType()), Ty.StructField("training_iteration", Ty.IntegerType()),
    Ty.StructField("trial_id", Ty.StringType()), Ty.StructField("date", Ty.StringType()),
    Ty.StructField("time_this_iter_s", Ty.DoubleType()), Ty.StructField("time_total_s", Ty.DoubleType()),
    Ty.StructField("pid", Ty.IntegerType()), Ty.StructField("hostname", Ty.StringType()),
    Ty.StructField("node_ip", Ty.StringType()), Ty.StructField("time_since_restore", Ty.DoubleType()),
    Ty.StructField("iterations_since_restore", Ty.IntegerType()),
    Ty.StructField("config/batch_size", Ty.IntegerType()), Ty.StructField("config/hidden_dim", Ty.IntegerType()),
    Ty.StructField("config/optimizer", Ty.StringType()), Ty.StructField("config/lr", Ty.DoubleType()),
    Ty.StructField("config/epochs", Ty.IntegerType()), Ty.StructField("config/activation", Ty.StringType()),
    Ty.StructField("config/dropout", Ty.DoubleType()), Ty.StructField("logdir", Ty.StringType()),
])


def read_trial_log(spark: SparkSession, path: str) -> DataFrame:
    """23-column trial CSV -> typed table: ``config/x`` -> ``config_x``, ``date`` parsed from
    ``yyyy-MM-dd_HH-mm-ss``, ``timestamp`` (epoch seconds) -> ``ts``."""
    df = spark.read.schema(TRIAL_LOG_SCHEMA).options(**_csv_options(False)).csv(path)
    df = df.withColumnsRenamed({c: re.sub("[^0-9A-Za-z_]", "_", c) for c in df.columns if "/" in c})
    return (df.withColumn("date_ts", F.to_timestamp("date", "yyyy-MM-dd_HH-mm-ss"))
              .withColumn("ts", F.timestamp_seconds("timestamp")))


# S10
def append_run_metrics(df: DataFrame, path: str, append_id: str | None = None) -> str:
    """Add long-form metrics (run, level, fold, metric, value, ...) to the log at ``path``.

    Every append is a folder of its own that nothing overwrites; it counts from its commit marker
    (``_SUCCESS``) on, so a job that died half way leaves nothing to be read. Names rise, and
    ``read_run_metrics`` takes each (run, level, fold) from the last append that holds it: a
    repeated append counts once, and appending fold 2 leaves fold 1 alone. ``append_id`` names an
    append, so that a driver that repeats it after losing the answer adds none (it is skipped).
    """
    spark = df.sparkSession
    done = _appends(spark, path)
    if append_id is not None and any(name.endswith(f"-{append_id}") for name in done):
        return path
    number = max((int(name.split("=")[1].split("-")[0]) for name in done), default=-1) + 1
    df.write.mode("error").parquet(f"{path.rstrip('/')}/append={number:09d}-{append_id or uuid.uuid4().hex[:12]}")
    return path


def _appends(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed appends, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(n for n in names if n.startswith("append=") and fs.exists(hadoop(f"{path.rstrip('/')}/{n}/_SUCCESS")))


def read_run_metrics(spark: SparkSession, path: str, keys=("run", "level", "fold")) -> DataFrame:
    """The log's rows: of each (run, level, fold) those of the last append that holds it. Columns that
    some appends lack are null there. Fails on a log without a committed append."""
    names = _appends(spark, path)
    if not names:
        raise FileNotFoundError(f"no committed append below {path}")
    rows = None
    for n in names:  # one plan; appends may differ in their columns
        part = spark.read.parquet(f"{path.rstrip('/')}/{n}").withColumn("_append", F.lit(n))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    held = [k for k in keys if k in rows.columns]
    last = rows.groupBy(*held).agg(F.max("_append").alias("_last"))
    same = F.col("r._append") == F.col("l._last")
    for k in held:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}"))
    return rows.alias("r").join(last.alias("l"), same).select("r.*").drop("_append")


def parent_metrics(folds: DataFrame, by=("run", "metric")) -> DataFrame:
    """Parent level of fold-level metrics: the mean over a run's folds, and how many there were."""
    return folds.groupBy(*by).agg(F.avg("value").alias("value"), F.countDistinct("fold").cast("int").alias("folds")) \
        .withColumn("level", F.lit("parent"))
