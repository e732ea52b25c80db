"""Stupid-backoff language-model scores, with n-gram tables partitioned by hash.

The corpus is dealt into chunks of whole documents. Each chunk explodes its n-grams of all
orders and sends, per hash bucket, its distinct ones with their counts: a bucket is one
partition of the count table. The bucket sums the counts of all chunks and joins the totals
back to the chunk's n-grams; the chunk then scores every word and sums per document.

One row carries the n-grams of one chunk in one bucket, sorted, as differences in byte
planes, and texts travel compressed; this takes about a quarter of the bytes of one row per
n-gram. An n-gram that every document holds arrives at its bucket once per chunk, so no
bucket has a hot key.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import RUN_BYTES, range_hashes, runs_of, string_buffers, word_hashes, word_spans

ORDER, BACKOFF, LEAST = 3, 0.4, 2
#: Bytes of text in a chunk, on average. Its arrays take about 30 times that in a worker.
CHUNK_BYTES = 8 << 20
#: N-grams are told apart by hashes of so many bits.
HASH_BITS = 56


def planes(values: np.ndarray) -> bytes:
    """The values' bytes, all first bytes first: small values leave planes of zeros."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)


def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row per chunk with all its (doc_id, text, chunk) rows of the batch."""
    raw, offsets = string_buffers(batch.column(1))
    chunk = batch.column(2).to_numpy()
    by = np.argsort(chunk, kind="stable")
    coder, rows = zstandard.ZstdCompressor(level=3), ([], [], [], [])
    for part in np.split(by, np.flatnonzero(np.diff(chunk[by])) + 1):
        blob = b"".join(raw[offsets[i]:offsets[i + 1]].tobytes() for i in part)
        for col, v in zip(rows, (chunk[part[0]], batch.column(0).take(pa.array(part)).to_pylist(), (offsets[part + 1] - offsets[part]).tolist(), coder.compress(blob))):
            col.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], names=["chunk", "ids", "sizes", "texts"])


def grams(group: pa.Table, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(first word of each text, hashes by order, by order the word index where each ends)."""
    coder = zstandard.ZstdDecompressor()
    raw = lower_ascii(np.frombuffer(b"".join(coder.decompress(x.as_py()) for x in group.column("texts")), np.uint8))
    sizes = group.column("sizes").combine_chunks().flatten().to_numpy()
    starts, ends, first = word_spans(raw, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
    h = word_hashes(raw, starts, ends)
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    hashes, at = [], []
    for k in range(1, order + 1):
        last = np.flatnonzero(place >= k - 1)
        out = np.empty(len(last), np.uint64)
        for i in range(0, len(last), RUN_BYTES):  # prefix sums over a bounded stretch
            e = last[i:i + RUN_BYTES] + 1
            lo = int(e[0]) - k
            out[i:i + RUN_BYTES] = range_hashes(h[lo:int(e[-1])], e - k - lo, e - lo)
        hashes.append(out >> np.uint64(64 - HASH_BITS))
        at.append(last)
    return first, hashes, at


def bounds(distinct: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's hashes begin in a sorted array; bucket = hash * buckets / 2**HASH_BITS."""
    edges = [-(-(b << HASH_BITS) // buckets) for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(distinct, np.array(edges, np.uint64)), [len(distinct)]]).astype(np.int64)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(bytes, words) of all texts."""
    def run(batches):
        for batch in batches:
            for part in runs_of(batch, "text"):
                raw, offsets = string_buffers(part.column(0))
                yield pa.RecordBatch.from_pydict({"bytes": pa.array([len(raw)], pa.int64()), "words": pa.array([len(word_spans(raw, offsets)[0])], pa.int64())})
    size = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bytes long, words long").agg(F.sum("bytes"), F.sum("words")).first()
    return size[0] or 0, size[1] or 0


def backoff_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, score, mean_score of every row of ``docs`` under its own corpus.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. S(w | context) is
    count(context w) / count(context) if the n-gram occurs ``least`` times or more in the
    corpus, else ``backoff`` times S with the context's first word left out; S(w) is
    count(w) / all words. ``score`` sums the natural logarithms over the document, shorter
    contexts at its start, and ``mean_score`` divides by ``n_words``. N-grams are told apart
    by 56-bit hashes.

    Null and empty texts have no words, score 0 and no mean. Rows without ``doc_id`` and
    repeated rows count and are scored like others. Extra columns are ignored.
    """
    spark = docs.sparkSession
    size, words = corpus_size(docs)
    chunks = max(1, -(-size // chunk_bytes))
    buckets = chunks
    asked = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("k", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
    told = pa.schema([("chunk", pa.int32()), ("k", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary())])
    scored = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()), ("mean_score", pa.float64())])

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield packed(batch)

    def explode(group: pa.Table) -> pa.Table:
        _, hashes, _ = grams(group, order)
        chunk, rows = group.column("chunk")[0].as_py(), ([], [], [], [], [])
        for k, h in enumerate(hashes):
            distinct, counts = np.unique(h, return_counts=True)
            cut = bounds(distinct, buckets)
            for b, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                if hi > lo:
                    for col, v in zip(rows, (b, chunk, k, planes(np.diff(distinct[lo:hi], prepend=np.uint64(0))), planes(counts[lo:hi].astype(np.uint32)))):
                        col.append(v)
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(rows, asked)], schema=asked)

    def count(group: pa.Table) -> pa.Table:
        out = []
        for k in range(order):
            some = group.filter(pc.equal(group.column("k"), k))
            if not some.num_rows:
                continue
            parts = [np.cumsum(unplanes(x.as_py(), np.uint64)) for x in some.column("grams")]
            own = np.concatenate([unplanes(x.as_py(), np.uint32) for x in some.column("counts")])
            ends = np.cumsum([len(x) for x in parts]).tolist()
            at = np.argsort(parts := np.concatenate(parts))
            new = np.flatnonzero(np.r_[True, np.diff(parts[at]) > 0])
            totals = np.empty(len(at), np.uint64)
            totals[at] = np.repeat(np.add.reduceat(own[at].astype(np.uint64), new), np.diff(np.r_[new, len(at)]))
            blobs = [planes(totals[lo:hi]) for lo, hi in zip([0, *ends], ends)]
            out.append(pa.Table.from_arrays([some.column("chunk"), some.column("k"), some.column("bucket"), pa.array(blobs, pa.binary())], schema=told))
        return pa.concat_tables(out)

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        first, hashes, ends = grams(group, order)
        n = int(first[-1])
        log_s, before = np.zeros(n), np.zeros(n)
        answers = answers.sort_by([("k", "ascending"), ("bucket", "ascending")])
        for k in range(order):
            h, last, hashes[k] = hashes[k], ends[k], None
            if not len(h):
                break
            totals = np.concatenate([unplanes(x.as_py(), np.uint64) for x in answers.filter(pc.equal(answers.column("k"), k)).column("totals")])
            at = np.argsort(h)
            c = np.empty(len(h))
            c[at] = totals[np.cumsum(np.r_[False, np.diff(h[at]) > 0])]
            if not k:
                log_s[last] = np.log(c / words)
            else:
                hit = c >= least
                log_s[last] += math.log(backoff)
                log_s[last[hit]] = np.log(c[hit] / before[last[hit] - 1])
            before = np.zeros(n)
            before[last] = c
        n_words = np.diff(first)
        sums = np.zeros(len(n_words))
        some = np.flatnonzero(n_words)
        if len(some):
            sums[some] = np.add.reduceat(log_s, first[:-1][some])
        mean = pa.array(sums / np.maximum(n_words, 1), mask=n_words == 0)
        return pa.Table.from_arrays([group.column("ids").combine_chunks().flatten(), pa.array(n_words, pa.int64()), pa.array(sums), mean], schema=scored)

    key = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    home = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    home = home.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int"))
    home = home.mapInArrow(pack, "chunk int, ids array<long>, sizes array<long>, texts binary")
    asks = home.groupBy("chunk").applyInArrow(explode, "bucket int, chunk int, k int, grams binary, counts binary")
    tells = asks.groupBy("bucket").applyInArrow(count, "chunk int, k int, bucket int, totals binary")
    return home.groupBy("chunk").cogroup(tells.groupBy("chunk")).applyInArrow(score, "doc_id long, n_words long, score double, mean_score double")
