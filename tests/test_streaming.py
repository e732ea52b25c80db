"""The batch cleaning expressions run unchanged on a file stream (availableNow trigger)."""

import os
import shutil
import tempfile

from tessera.streaming.text_stream import clean_stream, read_documents_stream


def test_clean_stream_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="tessera-stream-src-", dir="/tmp")  # stream sources are folders
    shutil.copy("/root/testdata/sf0.001/documents.parquet", os.path.join(src, "part-0.parquet"))
    out = tempfile.mkdtemp(prefix="tessera-stream-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="tessera-stream-ck-", dir="/tmp")
    stream = clean_stream(read_documents_stream(spark, src), stopwords=["the"])
    q = stream.writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    batch = clean_stream(spark.read.parquet(src), stopwords=["the"])
    assert got.count() == batch.count()
    assert got.select("doc_id", "clean").exceptAll(batch.select("doc_id", "clean")).count() == 0


def test_score_stream_matches_batch(spark):
    from pyspark.sql import functions as F

    from tessera.operators import models as MD
    from tessera.operators.embed import mean_pool
    from tessera.streaming.text_stream import start_scoring

    src = tempfile.mkdtemp(prefix="tessera-stream-src-", dir="/tmp")
    shutil.copy("/root/testdata/sf0.001/documents.parquet", os.path.join(src, "part-0.parquet"))
    vectors = spark.createDataFrame([("the", [1.0, 0.0]), ("and", [0.0, 1.0]), ("of", [0.5, 0.5])],
                                    "word string, vector array<float>")
    docs = spark.read.parquet(src)
    from tessera.functions.text import clean_tokens
    toks = docs.select("doc_id", clean_tokens("text").alias("tokens"), (F.col("doc_id") % 2).cast("int").alias("label"))
    train = MD.with_features(mean_pool(toks, vectors, dim=2), "embedding").join(toks.select("doc_id", "label"), "doc_id")
    model = MD.train_logreg(train, max_iter=10)
    out = tempfile.mkdtemp(prefix="tessera-stream-out-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="tessera-stream-ck-", dir="/tmp")
    q = start_scoring(read_documents_stream(spark, src, max_files_per_trigger=1), model, vectors, out, ck, dim=2)
    q.awaitTermination(180)
    batch = MD.score_texts(docs, "text", vectors, model, dim=2).drop("probability")
    got = spark.read.parquet(out).drop("batch_id")
    assert got.count() == batch.count()
    assert got.exceptAll(batch.select(*got.columns)).count() == 0
