"""Sharding: a uniform random shuffle into shards of exactly equal size (law ``rows``).

1. The rows are written once, numbered by written partition and position; counted by partition.
   Stretches of about sqrt(n) rows of one partition are the *sources*; every shard is cut into
   stretches of about sqrt(n) slots, the *targets*.
2. Communication matrix: entry (source, target) says how many rows of the source go to the target.
   Under a uniform shuffle its rows are a multivariate hypergeometric draw with the sources' and
   targets' sizes as margins. It is drawn by a binary tree over the sources: a node splits its
   targets' totals between its halves, seeded by its own borders, so every task draws the rows it
   needs (and, summing what goes to the left, where they begin in each target) without the others.
3. Each source permutes its rows and deals them out by its row of the matrix; one exchange by target;
   each target puts its rows in a random order (a sort by a keyed hash, about sqrt(n) rows).

All draws depend on the seed and the written numbering only: a task that is run again, on any
executor, repeats its result. Sizes of shards and targets are exact, so no group of rows, however
many copies it holds, makes a task larger than another.

The driver holds one count per written partition, of which there are at most ``MAX_PARTITIONS``
(partitions are merged, without a shuffle, before the write).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import materialize

SHARDS = 16
SEED = 42
MAX_PARTITIONS = 1 << 20
NUMPY_MOST = 10 ** 9      # numpy draws from populations below this only
_BITS = 33                # monotonically_increasing_id: position below, partition above


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good ones among ``sample`` of ``good + bad``; any size (inverse transform, 12 deviations around the mode)."""
    total = good + bad
    if total < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, sample))
    mode = (sample + 1) * (good + 1) // (total + 2)
    width = 10 + int(12 * math.sqrt(sample * (good / total) * (bad / total) * max(0.0, (total - sample) / (total - 1))))
    lo, hi = max(0, sample - bad, mode - width), min(good, sample, mode + width)
    k = np.arange(lo, hi, dtype=float)
    steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    cdf = np.cumsum(np.exp(logs - logs.max()))
    return lo + min(int(np.searchsorted(cdf, rng.random() * cdf[-1], "right")), hi - lo)


def split(rng: np.random.Generator, totals: np.ndarray, sample: int) -> np.ndarray:
    """How many of ``sample`` items drawn from classes of sizes ``totals`` are of each class."""
    whole = int(totals.sum())
    if sample == whole:
        return totals.copy()
    if whole < NUMPY_MOST:
        return rng.multivariate_hypergeometric(totals, sample, method="marginals")
    if len(totals) == 1:
        return np.array([sample], np.int64)
    half = len(totals) // 2
    left = hypergeometric(rng, int(totals[:half].sum()), int(totals[half:].sum()), sample)
    return np.concatenate([split(rng, totals[:half], left), split(rng, totals[half:], sample - left)])


class Matrix:
    """Rows of the communication matrix, drawn where they are needed."""

    def __init__(self, parts: list[tuple[int, int]], shards: int, seed: int):
        """``parts``: (number, rows) of each written partition."""
        self.ids = np.array([p for p, _ in parts], np.int64)
        self.rows = np.array([n for _, n in parts], np.int64)
        self.n, self.shards, self.seed = int(self.rows.sum()), shards, seed
        self.step = max(1, math.isqrt(self.n))
        blocks = -(-self.rows // self.step)
        self.first = np.cumsum(blocks) - blocks
        self.before = np.cumsum(self.rows) - self.rows
        self.sources = int(blocks.sum())
        self.per_shard = max(1, -(-(-(-self.n // shards)) // self.step))
        cuts = [m * np.arange(self.per_shard + 1) // self.per_shard for m in (self.n // shards + (np.arange(shards) < self.n % shards)).tolist()]
        self.targets = np.concatenate([np.diff(c) for c in cuts]).astype(np.int64)
        self._path: list = []

    def rows_before(self, source: int) -> int:
        if source >= self.sources:
            return self.n
        i = int(np.searchsorted(self.first, source, "right")) - 1
        return int(self.before[i] + min((source - self.first[i]) * self.step, self.rows[i]))

    def row(self, source: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows to each target, rows that sources before send there)."""
        path = self._path or [(0, self.sources, self.targets, np.zeros_like(self.targets))]
        while not path[-1][0] <= source < path[-1][1]:
            path.pop()
        lo, hi, totals, sent = path[-1]
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = split(np.random.default_rng([self.seed, 1, lo, hi]), totals, self.rows_before(mid) - self.rows_before(lo))
            if source < mid:
                hi, totals = mid, left
            else:
                lo, totals, sent = mid, totals - left, sent + left
            path.append((lo, hi, totals, sent))
        self._path = path
        return totals, sent

    def deal(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(target, arrival there) of rows by their written numbers."""
        part = np.searchsorted(self.ids, number >> _BITS)
        at = number & ((1 << _BITS) - 1)
        source, at = self.first[part] + at // self.step, at % self.step
        target, arrival = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
        for s in np.unique(source).tolist():
            here = source == s
            counts, sent = self.row(s)
            ends = np.cumsum(counts)
            moved = np.random.default_rng([self.seed, 2, s]).permutation(int(ends[-1]))[at[here]]
            t = np.searchsorted(ends, moved, "right")
            target[here], arrival[here] = t, sent[t] + moved - (ends[t] - counts[t])
        return target, arrival


def shuffled(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(row struct, shard int, slot long): every row of ``df`` once, uniformly shuffled.

    Shards hold n div ``shards`` rows or one more; slots run from 0 without a gap. ``row`` holds all
    columns of ``df`` under their own names, so none can clash. Repeated rows and nulls are rows
    like any other; an empty table gives an empty result.
    """
    rows = materialize(df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")).coalesce(MAX_PARTITIONS)
                       .withColumn("number", F.monotonically_increasing_id()), "shuffle")
    parts = rows.groupBy(F.shiftright("number", _BITS).alias("part")).count().orderBy("part").collect()  # at most MAX_PARTITIONS
    matrix = Matrix([(r.part, r["count"]) for r in parts], shards, seed)

    @F.pandas_udf("target long, arrival long")
    def deal(number: pd.Series) -> pd.DataFrame:
        target, arrival = matrix.deal(number.to_numpy())
        return pd.DataFrame({"target": target, "arrival": arrival})

    dealt = rows.select("row", deal("number").alias("to")).select("row", "to.*")
    order = Window.partitionBy("target").orderBy(F.xxhash64(F.lit(seed), F.col("target"), F.col("arrival")), F.col("arrival"))
    return dealt.withColumn("rank", F.row_number().over(order) - 1).select("row", *place(matrix))


def place(matrix: Matrix) -> list[Column]:
    """shard and slot from the target and the rank inside it."""
    k, base, more = matrix.per_shard, matrix.n // matrix.shards, matrix.n % matrix.shards
    shard = F.expr(f"target div {k}")
    size = F.lit(base) + F.when(shard < more, 1).otherwise(0)
    cut = (F.col("target") % k) * size
    start = ((cut - cut % k) / k).cast("long")  # whole numbers far below 2**53
    return [shard.cast("int").alias("shard"), (start + F.col("rank")).cast("long").alias("slot")]


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per document.

    size: UTF-8 bytes of the text (null: none) plus 1; text_crc32 of a null text is 0, as of an
    empty one. Other columns are not read.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    out = shuffled(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32")), shards, seed)
    return out.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(rows: DataFrame, folder: str) -> None:
    """Write a result of ``shuffled`` as one Parquet folder per shard, files in slot order."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
