"""Substring de-duplication by relative Lempel-Ziv parsing, on Spark.

A document is factored relative to an index of the blocks of all documents:

1. *Reference blocks.* Every run of 50-word windows that share their minimiser (the leftmost
   smallest hash among a window's word ``ANCHOR_WORDS``-grams) is one block: the words those
   windows cover. The cut depends on the words alone, so equal passages are cut alike, and a
   document of n words has about n / 21 blocks. The index keeps, per block content, the
   smallest and the largest ``doc_id``; whole documents are the longest blocks and go first.
2. *Whole blocks.* A block whose content an earlier document has matches it with all its windows.
3. *Ends of matches.* Where a block is new but its minimiser also occurs in another block, a
   passage may begin or end inside it. Only there every window is hashed and looked up.
4. *Greedy factors.* Matches that go on in the same reference join into runs, and a document is
   parsed from left to right: at the first word not yet covered, the run that covers it and reaches
   furthest is the next factor (reference document, position, length). Where a factor ends, runs that
   began inside it are looked at as well, so a passage across the border of two factors is not lost.

The result is exact (up to 128-bit hashes of the words): a window that starts in a smaller
document has the same minimiser there, so it is found in step 2 or 3, and the factors cover
exactly the words of such windows.

Skew: copies of whole documents collapse to one before blocks are compared, blocks before
windows; both look-ups are aggregates with map-side combining followed by a join whose
sides come from written tables, so adaptive execution can split a hot key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import materialize, range_hashes, runs_of, string_buffers, word_hashes, word_spans

ANCHOR_WORDS = 10
#: Windows are looked at in steps of so many words (bounds the memory for one long text).
STEP = 1 << 19

_BLOCKS = "doc_id long, n_words long, d1 long, d2 long, sha string, a array<long>, b array<long>, s array<int>, c array<int>"


def blocks_of(h: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, block hash, first window, number of windows) of one document's word hashes."""
    k = min(ANCHOR_WORDS, window)
    out: list[tuple[np.ndarray, ...]] = []
    i, n = 0, len(h) - window + 1
    while i < n:
        j = min(n, i + STEP)
        part = h[i:j + window - 1]
        at = np.arange(len(part) - k + 1)
        grams = range_hashes(part, at, at + k)
        least = np.arange(j - i) + np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).argmin(axis=1)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        count = np.diff(np.r_[first, j - i])
        out.append((grams[least[first]], range_hashes(part, first, first + count - 1 + window, 0xA24BAED4963EE407), first + i, count))
        i = j
    if not out:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    return tuple(np.concatenate(x) for x in zip(*out))


def window_hashes(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window of one document's word hashes."""
    at = np.arange(max(0, len(h) - window + 1))
    return range_hashes(h, at, at + window), range_hashes(h, at, at + window, 0x9FB21C651E98DF25)


def _factor(window: int, texts: bool):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sha", pa.string()),
                            ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("s", pa.list_(pa.int32())), ("c", pa.list_(pa.int32()))] + [("whole", pa.string())] * texts)
        for batch in batches:
            for part in runs_of(batch, "text"):
                raw, offsets = string_buffers(part.column(1))
                starts, ends, first = word_spans(raw, offsets)
                h = word_hashes(raw, starts, ends)
                d1 = range_hashes(h, first[:-1], first[1:])
                d2 = range_hashes(h, first[:-1], first[1:], 0x9FB21C651E98DF25)
                cols: list[list] = [[], [], [], []]
                whole = [b" ".join(raw[a:z].tobytes().split()) for a, z in zip(offsets[:-1], offsets[1:])]
                for lo, hi in zip(first[:-1], first[1:]):
                    for col, v, kind in zip(cols, blocks_of(h[lo:hi], window), (np.int64, np.int64, np.int32, np.int32)):
                        col.append(v.view(kind) if v.dtype == np.uint64 else v.astype(kind))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(np.diff(first)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                                                  pa.array([hashlib.sha256(w).hexdigest() for w in whole]),
                                                  *(pa.array(c, t.type) for c, t in zip(cols, list(schema)[5:9])), *[pa.array([w.decode() for w in whole], pa.string())] * texts], schema=schema)
    return run


def parse(ref: np.ndarray, pos: np.ndarray, known: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, length, reference, position there) of one document, whose window i is
    also the window ``pos[i]`` of document ``ref[i]`` where ``known[i]``."""
    at = np.flatnonzero(known)
    if not len(at):
        return []
    r, q = ref[at], pos[at]
    new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(r) != 0) | (np.diff(q) != 1)])
    begin, end = at[new], at[np.r_[new[1:], len(at)] - 1] + window
    r, q = r[new], q[new]
    out, word = [], int(begin[0])
    while True:
        i = int(np.searchsorted(begin, word, "right")) - 1  # ends rise with begins: the run that reaches furthest
        out.append((word, int(end[i]) - word, int(r[i]), int(q[i]) + word - int(begin[i])))
        if i + 1 == len(begin):
            return out
        word = max(int(end[i]), int(begin[i + 1]))


def _hashed(batch: pa.RecordBatch):
    """(part, raw, offsets, first word of each row, word hashes, text hashes) of runs of rows."""
    for part in runs_of(batch, "text"):
        raw, offsets = string_buffers(part.column("text"))
        starts, ends, first = word_spans(raw, offsets)
        h = word_hashes(raw, starts, ends)
        yield part, raw, offsets, first, h, range_hashes(h, first[:-1], first[1:]).view(np.int64)


def _edge_windows(window: int):
    """Hashes of the windows of the listed boundary blocks; ``tag`` tells texts of one doc_id apart."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("at", pa.int32())])

    def run(batches):
        for batch in batches:
            for part, _, _, first, h, own in _hashed(batch):
                ids, spans, d1 = (part.column(c).to_pylist() for c in ("doc_id", "spans", "d1"))
                for lo, hi, doc, blocks, d, o in zip(first[:-1], first[1:], ids, spans, d1, own.tolist()):
                    blocks = [x for x in blocks if x["edge"]]
                    if not blocks or d != o:  # another text of this doc_id
                        continue
                    at = np.unique(np.concatenate([np.arange(x["s"], x["s"] + x["c"]) for x in blocks]))
                    w1 = range_hashes(h[lo:hi], at, at + window)
                    w2 = range_hashes(h[lo:hi], at, at + window, 0x9FB21C651E98DF25)
                    same = (np.full(len(at), doc, np.int64), np.full(len(at), d & 0x7FFFFFFF, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), *map(pa.array, same), pa.array(at.astype(np.int32))], schema=schema)
    return run


_FACTORS = "array<struct<start:int,length:int,ref_doc:bigint,ref_start:int>>"


def _cut(window: int, texts: bool, factors: bool):
    piece = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
                       + [("kept_text", pa.string())] * texts + [("factors", pa.list_(piece))] * factors)

    def run(batches):
        for batch in batches:
            for part, raw, offsets, first, _, own in _hashed(batch):
                out = []
                for i, row in enumerate(part.drop_columns(["text"]).to_pylist()):
                    if row["d1"] != own[i]:  # another text of this doc_id
                        continue
                    n = int(first[i + 1] - first[i])
                    ref, pos, known = (np.zeros(max(0, n - window + 1), t) for t in (np.int64, np.int64, bool))
                    for x in row["spans"]:
                        if not x["edge"]:
                            s, e = x["s"], x["s"] + x["c"]
                            ref[s:e], pos[s:e], known[s:e] = x["ref"], np.arange(x["pos"], x["pos"] + x["c"]), True
                    for x in row["found"] or ():
                        at = np.array(x["at"])
                        ref[at], pos[at], known[at] = x["ref"], at + x["shift"], True
                    found, gone = parse(ref, pos, known, window), np.zeros(n, bool)
                    for s, c, _, _ in found:
                        gone[s:s + c] = True
                    words = raw[offsets[i]:offsets[i + 1]].tobytes().split()
                    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                    out.append({"doc_id": row["doc_id"], "d1": row["d1"], "d2": row["d2"], "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()}
                               | ({"kept_text": kept.decode()} if texts else {}) | ({"factors": [dict(zip(piece.names, f)) for f in found]} if factors else {}))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


def substring_dedup(docs: DataFrame, window: int = 50, texts: bool = False, factors: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256.

    A word is removed if a ``window`` of consecutive words covers it whose sequence also
    starts in a document with a smaller ``doc_id``. ``texts`` adds ``kept_text`` (kept words
    joined by one space), ``factors`` the greedy parse: (start, length, ref_doc, ref_start) of stretches
    of words that together are the removed ones, each found word by word in a document with a smaller
    ``doc_id`` (of several places in it, any).

    Null and empty texts have no words. A row without ``doc_id`` is kept whole and is no
    reference. Rows that repeat a ``doc_id`` are one document: they never remove each other's
    words. Extra columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = materialize(docs.mapInArrow(_factor(window, texts), _BLOCKS + ", whole string" * texts), "rlz-blocks")
    # whole documents: only the smallest doc_id of each word sequence is factored further
    firsts = (facts.filter("doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id")))
    firsts = materialize(firsts, "rlz-firsts")
    blocks = (facts.filter("size(a) > 0").join(firsts, ["doc_id", "d1", "d2"], "left_semi")
              .select("doc_id", "d1", "d2", F.explode(F.arrays_zip("a", "b", "s", "c")).alias("x")).select("doc_id", "d1", "d2", "x.*"))
    index = blocks.groupBy("a", "b").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("last"), F.min_by("s", "doc_id").alias("pos"))
    index = materialize(index, "rlz-index")
    shared = index.groupBy("a").agg(F.min("ref").alias("lo"), F.max("ref").alias("hi")).filter("lo < hi").select("a", F.lit(True).alias("edge"))
    index = materialize(index.join(shared, "a", "left").filter("ref < last or edge").select("a", "b", "ref", "pos", F.coalesce("edge", F.lit(False)).alias("edge")), "rlz-live")
    spans = (blocks.join(index, ["a", "b"]).filter("doc_id > ref or edge")
             .select("doc_id", "d1", "d2", F.struct("s", "c", "ref", "pos", F.expr("doc_id = ref").alias("edge")).alias("x")))
    spans = spans.groupBy("doc_id", "d1", "d2").agg(F.collect_list("x").alias("spans"))
    # the texts of the documents that have a factor or a boundary
    dirty = docs.join(materialize(spans, "rlz-spans"), "doc_id").select("doc_id", "text", "spans", "d1", "d2")
    dirty = materialize(dirty, "rlz-dirty")
    edges = materialize(dirty.mapInArrow(_edge_windows(window), "w1 long, w2 long, doc_id long, tag int, at int"), "rlz-edges")
    seen = edges.groupBy("w1", "w2").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("last"), F.min_by("at", "doc_id").alias("pos")).filter("ref < last").drop("last")
    found = edges.join(materialize(seen, "rlz-windows"), ["w1", "w2"]).filter("doc_id > ref")
    found = found.select("doc_id", "tag", "ref", (F.col("pos") - F.col("at")).alias("shift"), "at").repartition("doc_id", "tag")
    found = found.groupBy("doc_id", "tag", "ref", "shift").agg(F.collect_set("at").alias("at"))
    found = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("ref", "shift", "at")).alias("found"))
    kind = "doc_id long, d1 long, d2 long, n_removed long, kept_sha256 string" + ", kept_text string" * texts + f", factors {_FACTORS}" * factors
    cut = dirty.withColumn("tag", F.col("d1").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).join(found, ["doc_id", "tag"], "left")
    cut = cut.mapInArrow(_cut(window, texts, factors), kind).dropDuplicates(["doc_id", "d1", "d2"])
    whole = facts.select("doc_id", "n_words", "d1", "d2", "sha", *["whole"] * texts)
    out = (whole.join(firsts.withColumn("original", F.lit(True)), ["doc_id", "d1", "d2"], "left").join(cut, ["doc_id", "d1", "d2"], "left"))
    gone = F.expr(f"doc_id is not null and original is null and n_words >= {window}")
    empty = F.sha2(F.lit(""), 256)
    cols = [F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(gone, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")]
    if texts:
        cols.append(F.when(gone, F.lit("")).otherwise(F.coalesce("kept_text", "whole")).alias("kept_text"))
    if factors:  # a copy is one factor: the first document with its words
        out = out.join(firsts.withColumnRenamed("doc_id", "_first"), ["d1", "d2"], "left")
        copy = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("length"), F.col("_first").alias("ref_doc"), F.lit(0).alias("ref_start")))
        cols.append(F.when(gone, copy).otherwise(F.coalesce("factors", F.array().cast(_FACTORS))).alias("factors"))
    return out.select("doc_id", "n_words", *cols)
