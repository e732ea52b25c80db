"""Driver test tables and the labelled-text roles derived from them.

Each role has a Spark builder and the equivalent SQL common-table expression, so a
registered query and its DuckDB oracle start from the same derived table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# Text-heavy tables whose per-row work (regex cleaning, tokenising) is CPU-bound.
TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")
# A Parquet file of one row group is one scan task, whatever the split size. A session may name
# here into how many partitions such text tables are spread after the scan; unset (the
# default, at any input size) the scan's own splits are used.
SPREAD_CONF = "spark.tessera.spreadText"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    spread = spark.conf.get(SPREAD_CONF, None) if name in TEXT_TABLES else None
    return df.repartition(int(spread)) if spread else df


# -- annotated corpus: sentiment := lang, polarity := doc_id % 2, order := doc_id --------
def annotated(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", F.col("lang").alias("sentiment"),
                    F.pmod(F.col("doc_id"), F.lit(2)).cast("int").alias("polarity"))


ANNOTATED_SQL = """annotated AS (
  SELECT doc_id, text, lang AS sentiment, CAST(doc_id % 2 AS INTEGER) AS polarity FROM documents)"""


# -- texts as they come: some documents get odd white space, Devanagari with a danda, outer
# blanks, an empty or a null text, by doc_id
ODD_TEXT_SQL = """CASE doc_id % 11 WHEN 1 THEN replace(text, ' ', chr(160)) WHEN 2 THEN '  ' || text || chr(9)
  WHEN 3 THEN 'नमस्ते। दुनिया ' || text WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN replace(text, ' ', chr(8195)) ELSE text END"""
ODD_DOCUMENTS_SQL = f"""odd AS (SELECT doc_id, {ODD_TEXT_SQL} AS text, lang, source, n_chars FROM documents)"""


def odd_documents(spark, sf_dir) -> DataFrame:
    n, t = F.pmod(F.col("doc_id"), F.lit(11)), F.col("text")
    text = (F.when(n == 1, F.replace(t, F.lit(" "), F.lit("\u00a0"))).when(n == 2, F.concat(F.lit("  "), t, F.lit("\t")))
             .when(n == 3, F.concat(F.lit("नमस्ते। दुनिया "), t)).when(n == 4, F.lit("")).when(n == 5, F.lit(None).cast("string"))
             .when(n == 6, F.replace(t, F.lit(" "), F.lit("\u2003"))).otherwise(t))
    return table(spark, sf_dir, "documents").withColumn("text", text)


# -- two raters: A := quality, B := 1 - toxic --------------------------------------------
def raters(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    return l.select("doc_id", F.col("quality").alias("rater_a"), (F.lit(1) - F.col("toxic")).alias("rater_b"))


RATERS_SQL = """raters AS (SELECT doc_id, quality AS rater_a, 1 - toxic AS rater_b FROM labels)"""


# -- labelled corpus: documents joined with labels, target := quality_toxic -------------
def labelled(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    l = table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select(
        "doc_id", "text", "lang", F.concat_ws("_", F.col("quality").cast("string"),
                                             F.col("toxic").cast("string")).alias("target"))


LABELLED_SQL = """labelled AS (
  SELECT d.doc_id, d.text, d.lang, CAST(l.quality AS VARCHAR) || '_' || CAST(l.toxic AS VARCHAR) AS target
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


# -- vectors: embeddings (64-d, labels 0..9) ---------------------------------------------
def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


# -- imbalanced vectors: labels 0-5 -> 0, 6-7 -> 1, 8 -> 2, 9 -> 3 -----------------------
def merge_label(c):
    return (F.when(c <= 5, 0).when(c <= 7, 1).when(c == 8, 2).otherwise(3)).cast("int")


def imbalanced(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", merge_label(F.col("label")).alias("label"))


IMBALANCED_SQL = """imbalanced AS (
  SELECT vec_id, embedding,
         CAST(CASE WHEN label <= 5 THEN 0 WHEN label <= 7 THEN 1 WHEN label = 8 THEN 2 ELSE 3 END AS INTEGER) AS label
  FROM embeddings)"""


# -- predictions: prediction := (label+1)%10 when vec_id%3=0 else label,
#    probability := softmax of the first 10 embedding components ------------------------
def predictions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    m = F.array_max(logits)
    ex = F.transform(logits, lambda x: F.exp(x - m))
    tot = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return e.select(
        F.col("vec_id").alias("id"), F.col("label"),
        F.when(F.pmod("vec_id", F.lit(3)) == 0, F.pmod(F.col("label") + 1, F.lit(10)))
         .otherwise(F.col("label")).cast("int").alias("prediction"),
        F.transform(ex, lambda x: x / tot).alias("probability"))


PREDICTIONS_SQL = """pred_logits AS (
  SELECT vec_id, label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS lg FROM embeddings),
pred_exp AS (
  SELECT vec_id, label, list_transform(lg, lambda x: exp(x - list_max(lg))) AS ex FROM pred_logits),
predictions AS (
  SELECT vec_id AS id, label,
         CAST(CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS prediction,
         list_transform(ex, lambda x: x / list_sum(ex)) AS probability
  FROM pred_exp)"""


# -- second corpus for union: benchmark(item_id, text) -> (doc_id, text) -----------------
def second_corpus(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


# -- run log: run := event_type, epoch := row_number by event_id, metric := value -------
def run_log(spark, sf_dir) -> DataFrame:
    """Epoch = 1-based position of the event within its run by event_id.

    A run (event type) holds about a fifth of all events, so the numbering uses the
    range-partitioned ``dense_index`` rather than a window partitioned by run.
    """
    from tessera.operators.indexing import dense_index
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.col("value").alias("metric"), "event_id", "ts", "user_id")
    return dense_index(ev, ["event_id"], name="epoch", group_cols=["run"], start=1)


RUN_LOG_SQL = """run_log AS (
  SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS epoch,
         value AS metric, event_id, ts, user_id FROM events)"""


# -- trial log (23 columns) derived from events: one trial per event --------------------
def trial_log_raw(spark, sf_dir) -> DataFrame:
    """Columns named as in the trial CSV (``config/...``); f1 := value / 100,
    optimiser := event type, batch / hidden sizes and epochs from user and event ids."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("index"), (F.col("value") / 100.0).alias("f1"),
        F.unix_timestamp("ts").alias("timestamp"),
        F.concat(F.lit("checkpoint_"), F.col("event_id").cast("string")).alias("checkpoint_dir_name"),
        (F.col("event_type") == "purchase").alias("done"),
        (F.pmod("user_id", F.lit(7)) + 1).cast("int").alias("training_iteration"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("trial_id"),
        F.date_format("ts", "yyyy-MM-dd_HH-mm-ss").alias("date"),
        F.col("value").alias("time_this_iter_s"), (F.col("value") * 2).alias("time_total_s"),
        (F.col("user_id") + 1000).cast("int").alias("pid"), F.lit("worker").alias("hostname"),
        F.lit("10.0.0.1").alias("node_ip"), F.col("value").alias("time_since_restore"),
        F.lit(1).alias("iterations_since_restore"),
        (F.lit(8) * (F.pmod("user_id", F.lit(4)) + 1)).cast("int").alias("config/batch_size"),
        (F.lit(16) * (F.pmod("user_id", F.lit(20)) + 1)).cast("int").alias("config/hidden_dim"),
        F.col("event_type").alias("config/optimizer"), (F.col("value") / 1000.0).alias("config/lr"),
        (F.pmod("event_id", F.lit(50)) + 1).cast("int").alias("config/epochs"),
        F.when(F.pmod("user_id", F.lit(3)) == 0, "relu").when(F.pmod("user_id", F.lit(3)) == 1, "gelu")
         .otherwise("tanh").alias("config/activation"),
        F.lit(0.1).alias("config/dropout"),
        F.concat(F.lit("trial_"), F.col("event_id").cast("string")).alias("logdir"))


def trial_log(spark, sf_dir) -> DataFrame:
    """Trial log with ``config_*`` names (as ``read_trial_log`` returns it)."""
    t = trial_log_raw(spark, sf_dir)
    return t.withColumnsRenamed({c: c.replace("/", "_") for c in t.columns if "/" in c})


TRIAL_LOG_SQL = """trials AS (
  SELECT event_id AS "index", value / 100.0 AS f1, CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp",
         'checkpoint_' || CAST(event_id AS VARCHAR) AS checkpoint_dir_name, event_type = 'purchase' AS done,
         CAST(user_id % 7 + 1 AS INTEGER) AS training_iteration, 't' || CAST(event_id AS VARCHAR) AS trial_id,
         strftime(ts, '%Y-%m-%d_%H-%M-%S') AS date, value AS time_this_iter_s, value * 2 AS time_total_s,
         CAST(8 * (user_id % 4 + 1) AS INTEGER) AS config_batch_size,
         CAST(16 * (user_id % 20 + 1) AS INTEGER) AS config_hidden_dim, event_type AS config_optimizer,
         value / 1000.0 AS config_lr, CAST(event_id % 50 + 1 AS INTEGER) AS config_epochs,
         CASE user_id % 3 WHEN 0 THEN 'relu' WHEN 1 THEN 'gelu' ELSE 'tanh' END AS config_activation,
         0.1 AS config_dropout
  FROM events)"""
