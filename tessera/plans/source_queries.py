"""Registered queries for scans and sinks (S1-S3, S5, S6, S9, S10): each writes data that
Spark derives from the test tables into the shared scratch folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.metrics import per_class_scores
from tessera.plans.params import DIGITS
from tessera.plans.registry import query
from tessera.session import scratch_path
from tessera.sources import files
from tessera.sources.tables import ODD_DOCUMENTS_SQL, PREDICTIONS_SQL, TRIAL_LOG_SQL, odd_documents, predictions, table, trial_log_raw

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _through_csv(spark, docs):
    path = files.write_table(docs, scratch_path(spark, "corpus_csv"), "csv")
    d = files.read_corpus_csv(spark, path, DOC_SCHEMA)
    return d.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query("read_corpus_csv", sql=f"""WITH {ODD_DOCUMENTS_SQL}
SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM odd""")
def read_corpus_csv(spark, sf_dir):
    """S3 CSV sink + S1 CSV scan with an explicit schema (multi-line quoted text), odd texts."""
    return _through_csv(spark, odd_documents(spark, sf_dir))


@query("read_corpus_csv_original", sql="SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def read_corpus_csv_original(spark, sf_dir):
    """S3 + S1 with every text as it is."""
    return _through_csv(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


@query("read_headerless_csv", sql="SELECT doc_id, quality, toxic FROM labels")
def read_headerless_csv(spark, sf_dir):
    """A header-less CSV (columns toxic, quality, doc_id) read, named and reordered."""
    lab = table(spark, sf_dir, "labels").select("toxic", "quality", "doc_id")
    path = scratch_path(spark, "headerless")
    lab.write.mode("overwrite").options(header="false").csv(path)
    return files.read_headerless_csv(spark, path, ["toxic", "quality", "doc_id"], ["doc_id", "quality", "toxic"],
                                     schema="toxic int, quality int, doc_id bigint")


@query("write_table_parquet", sql="""SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 1000""")
def write_table_parquet(spark, sf_dir):
    """S3 Parquet sink; the read back prunes columns and pushes the filter into the scan."""
    path = files.write_table(table(spark, sf_dir, "documents"), scratch_path(spark, "docs_parquet"))
    return spark.read.parquet(path).where(F.col("n_chars") > 1000).select("doc_id", "lang", "n_chars")


@query("word_vectors_text", sql="""SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, CAST(len(embedding) AS INTEGER) AS dim,
  CAST(list_sum(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT))) AS BIGINT) AS vsum_micro
FROM embeddings""")
def word_vectors_text(spark, sf_dir):
    """S6 writer (header 'V D', 6 decimals) and S5 reader of the word-vector text format."""
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"),
                                                  F.col("embedding").alias("vector"))
    path = files.write_word_vectors(e, scratch_path(spark, "vectors_txt"))
    v = files.read_word_vectors(spark, path)
    return v.select("word", F.size("vector").alias("dim"),
                    F.aggregate("vector", F.lit(0).cast("bigint"),
                                lambda a, x: a + F.round(x.cast("double") * 1000000).cast("bigint")).alias("vsum_micro"))


@query("read_trial_log", sql=f"""WITH {TRIAL_LOG_SQL}
SELECT "index", round(f1, {DIGITS}) AS f1, strftime(date_trunc('second', make_timestamp(CAST("timestamp" AS BIGINT) * 1000000)), '%Y-%m-%d %H:%M:%S') AS ts,
       strftime(strptime(date, '%Y-%m-%d_%H-%M-%S'), '%Y-%m-%d %H:%M:%S') AS date_ts,
       config_optimizer, config_batch_size, config_epochs, config_activation
FROM trials""")
def read_trial_log(spark, sf_dir):
    """Trial CSV with config/* columns -> typed, renamed, timestamps parsed."""
    path = scratch_path(spark, "trial_log")
    files.write_table(trial_log_raw(spark, sf_dir), path, "csv")
    t = files.read_trial_log(spark, path)
    return t.select("index", F.round("f1", DIGITS).alias("f1"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                    F.date_format("date_ts", "yyyy-MM-dd HH:mm:ss").alias("date_ts"),
                    "config_optimizer", "config_batch_size", "config_epochs", "config_activation")


@query("append_run_metrics", sql=f"""WITH {PREDICTIONS_SQL},
p AS (SELECT id % 5 AS fold, label, prediction FROM predictions),
cl AS (SELECT fold, label AS class FROM p UNION SELECT fold, prediction FROM p),
s AS (SELECT cl.fold, cl.class, count_if(p.label = cl.class AND p.prediction = cl.class) AS tp, count_if(p.label = cl.class) AS sup, count_if(p.prediction = cl.class) AS npred
      FROM cl JOIN p USING (fold) GROUP BY cl.fold, cl.class),
m AS (SELECT fold, class, unnest(['precision', 'recall']) AS metric, unnest([CASE WHEN npred = 0 THEN 0.0 ELSE tp / npred END, CASE WHEN sup = 0 THEN 0.0 ELSE tp / sup END]) AS value FROM s),
f AS (SELECT fold, metric || '_' || class AS metric, value FROM m)
SELECT 'run' AS run, 'fold' AS level, CAST(fold AS INTEGER) AS fold, metric, round(value, {DIGITS}) AS value, CAST(NULL AS INTEGER) AS folds FROM f
UNION ALL SELECT 'run', 'parent', NULL, metric, round(avg(value), {DIGITS}), CAST(count(DISTINCT fold) AS INTEGER) FROM f GROUP BY metric""")
def append_run_metrics(spark, sf_dir):
    """The per-class scores of five folds appended one by one (the third twice), then the run's
    parent level (means over the folds), read back as one log."""
    p = predictions(spark, sf_dir).withColumn("fold", (F.col("id") % 5).cast("int"))
    path = scratch_path(spark, "run_metrics")
    for fold in [0, 1, 2, 2, 3, 4]:
        scores = per_class_scores(p.where(F.col("fold") == fold), by=["fold"])
        long = scores.select(F.lit("run").alias("run"), F.lit("fold").alias("level"), "fold", F.explode(F.create_map(
            F.concat(F.lit("precision_"), F.col("class").cast("string")), F.col("precision"),
            F.concat(F.lit("recall_"), F.col("class").cast("string")), F.col("recall"))).alias("metric", "value"))
        files.append_run_metrics(long, path)
    files.append_run_metrics(files.parent_metrics(files.read_run_metrics(spark, path)), path, "parent")
    out = files.read_run_metrics(spark, path)
    return out.select("run", "level", "fold", "metric", F.round("value", DIGITS).alias("value"), "folds")
