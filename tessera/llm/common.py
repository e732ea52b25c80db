"""Shared helpers: written tables in the shared folder, and word hashing over Arrow batches.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere: runs of bytes other than the six ASCII white
space bytes, which in UTF-8 never occur inside another character.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.session import ensure_checkpoint_dir

#: The six ASCII white space characters that separate words, for Spark's trim / translate.
SPACE_CHARS = " \t\n\x0b\f\r"
#: The same as a Java regular expression.
SPACE_RE = r"[\x20\x09-\x0D]+"
#: Documents are hashed in runs of about this many bytes (bounds a worker's memory).
RUN_BYTES = 1 << 20

M64 = (1 << 64) - 1
_MUL = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``, shared by all executors."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage (a lost executor costs no recomputation) and gives later joins a plain scan
    whose exchanges adaptive execution can split where a key is hot.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def range_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, mul: int = _MUL) -> np.ndarray:
    """Hash of values[lo:hi] for many ranges: a polynomial modulo 2**64 from prefix sums."""
    p = powers(mul, len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:-1], out=prefix[1:])
    inverse = powers(pow(mul, -1, 1 << 64), len(values))
    lengths = (hi - lo).astype(np.uint64)
    return splitmix((prefix[hi] - prefix[lo]) * inverse[lo] + lengths * np.uint64(0xD6E8FEB86659FD93))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1] if off is not None and n else np.zeros(n + 1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    return raw, offsets - lo


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) bytes of every word and, per document, the index of its first word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[offsets < len(raw)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[offsets > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of every word, RUN_BYTES of text at a time."""
    with np.errstate(over="ignore"):
        letters = splitmix((np.arange(256, dtype=np.uint64) + np.uint64(256 * seed)) * np.uint64(_MUL))
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + RUN_BYTES, "right")))
        block = letters[raw[base:int(ends[j - 1])]]
        out[i:j] = range_hashes(block, starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def runs_of(batch: pa.RecordBatch, text: str, most: int = RUN_BYTES):
    """Slices of a batch of about ``most`` bytes of text each; at least one row in each."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = string_buffers(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
