"""Stateless reuse of the batch operators on Structured Streaming sources.

The reference has no streaming, watermarks or state. Cleaning (T7/T8) is a per-row column
expression and applies to a ``readStream`` DataFrame unchanged. Scoring with a fitted model
(M16) pools each document's vectors, so it runs per micro-batch through ``foreachBatch``;
documents are single rows, so no state crosses micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import text as T

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def read_documents_stream(spark: SparkSession, path: str, schema: str = DOC_SCHEMA,
                          max_files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def clean_stream(stream: DataFrame, stopwords=(), suffixes=(), min_stem: int = 2) -> DataFrame:
    """(doc_id, clean, tokens) for each arriving document — the batch expressions."""
    c = T.clean_text("text", stopwords, suffixes, min_stem)
    return stream.select("doc_id", c.alias("clean")).withColumn("tokens", T.tokenize_whitespace("clean"))


def start_scoring(stream: DataFrame, model, vectors: DataFrame, out_path: str, checkpoint: str,
                  stopwords=(), suffixes=(), min_stem: int = 2, dim: int | None = None, trigger=None):
    """M16 on a stream, one micro-batch at a time (``foreachBatch``).

    Scoring pools each document's word vectors — a per-document aggregation — so it is not a
    streaming projection; but a document is one row and therefore whole inside one
    micro-batch, so the batch scorer runs on each micro-batch with no state across batches.
    Each batch is written to its own ``batch_id=<n>`` folder in overwrite mode: a retried
    batch replaces its own output (idempotent sink).
    """
    from tessera.operators.models import score_texts

    def write_batch(batch_df: DataFrame, batch_id: int) -> None:
        scored = score_texts(batch_df, "text", vectors, model, stopwords, suffixes, min_stem, dim=dim)
        scored.drop("probability").write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
