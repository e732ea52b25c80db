"""Packing token sequences into windows: best-fit decreasing with a segment tree.

Documents are tokenised where they are scanned; from then on only (doc_id, start, length,
checksum) rows move. Overlong documents are first cut into full windows. The remaining
pieces are dealt by a hash into groups of about ``group_pieces`` and each group is packed on
its own: longest piece first, into the open window with the least sufficient room.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import RUN_BYTES, materialize, runs_of, string_buffers, word_spans

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
SPECIAL = "<|endoftext|>"
#: Pieces per packing group, on average: a task's memory, whatever the input's size.
GROUP_PIECES = 50_000
#: A worker forgets its words after so many (bounds the cache at about 80 MB).
CACHE_WORDS = 400_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


#: Punctuation that never joins a letter or digit before it in one of the tokenizer's words.
_TAIL = np.zeros(256, bool)
_TAIL[list(b",.;:!?$%&#*")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[c for c in range(128) if chr(c).isalpha()]] = True


def cache_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words as bytes, index of each text's first word) such that a text's token ids are those
    of its words in turn.

    Words end at ASCII white space, and between a letter or digit and the punctuation that
    ends a word: the tokenizer splits there too. Words of ASCII letters alone are put in
    lower case, as the tokenizer does. Both only make equal words meet.
    """
    starts, ends, first = word_spans(raw, offsets)
    cut = ends.copy()
    for _ in range(8):
        more = (cut > starts) & _TAIL[raw[cut - 1]]
        if not more.any():
            break
        cut -= more
    before, lead = raw[np.maximum(cut - 1, 0)], raw[np.maximum(cut - 2, 0)]
    latin = (lead == 0xC3) & (before != 0x97) & (before != 0xB7) & (cut - 2 >= starts)
    split = (cut < ends) & (cut > starts) & (_ALNUM[before] | latin)
    count = 1 + split.astype(np.int64)
    at = np.cumsum(count) - count
    edges = np.empty(int(count.sum()) + 1, np.int64)
    lengths = ends - starts
    base = np.cumsum(lengths) - lengths
    edges[at] = base
    edges[at[split] + 1] = (base + cut - starts)[split]
    edges[-1] = lengths.sum()
    data = raw[(raw != 32) & ((raw < 9) | (raw > 13))]
    other = np.concatenate([[0], np.cumsum(~_ALPHA[data])])
    plain = np.repeat(other[edges[1:]] == other[edges[:-1]], np.diff(edges))
    data = np.where(plain, data | 32, data).astype(np.uint8)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    return words, np.concatenate([at, [len(edges) - 1]])[first]


class WordTokenizer:
    """Token ids of whole texts through a cache of words.

    A Python worker keeps its cache over its tasks, see :meth:`of_worker`.
    """

    @classmethod
    def of_worker(cls, path: str) -> WordTokenizer:
        """The process's tokenizer for ``path``, kept by the library's module (this module is
        unpickled anew in every task)."""
        import tokenizers
        kept = vars(tokenizers).setdefault("_word_tokenizers", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = SPECIAL
        self.mark_id = self.tokenizer.token_to_id(SPECIAL)
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def add(self, words: list[bytes]) -> None:
        # many words make one call, with a special token between them that no word holds
        names = [w.decode() for w in words]
        odd = [i for i, w in enumerate(names) if "<|" in w]
        single = {i: x.ids for i, x in zip(odd, self.tokenizer.encode_batch_fast([names[i] for i in odd], add_special_tokens=False))}
        for i in odd:
            names[i] = ""
        joined = [self.mark.join(names[i:i + 50]) + self.mark for i in range(0, len(names), 50)]
        flat = np.concatenate([np.array(x.ids, np.uint32) for i in range(0, len(joined), 100) for x in self.tokenizer.encode_batch_fast(joined[i:i + 100], add_special_tokens=False)])
        marks = flat == self.mark_id
        lengths = np.diff(np.flatnonzero(marks), prepend=-1) - 1
        flat = flat[~marks]
        if odd:
            at = np.cumsum(lengths)[odd]
            flat = np.insert(flat, np.repeat(at, [len(single[i]) for i in odd]), list(chain.from_iterable(single[i] for i in odd))).astype(np.uint32)
            lengths[odd] = [len(single[i]) for i in odd]
        used, need = int(self.ends[-1]), int(lengths.sum())
        while used + need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used:used + need] = flat
        self.ends = np.concatenate([self.ends, used + np.cumsum(lengths)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text)."""
        words, first = cache_words(*string_buffers(texts))
        words = words.dictionary_encode()
        names = words.dictionary.to_pylist()
        if len(self.words) > CACHE_WORDS:
            self.clear()
        n = len(self.words)
        code = np.fromiter([self.words.setdefault(w, len(self.words)) for w in names], np.int64, len(names))
        if len(self.words) > n:
            self.add([names[i] for i in np.flatnonzero(code >= n)])
        at = code[words.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
        lo, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(lo - (ends - n), n) + np.arange(int(n.sum()))]
        return flat, np.concatenate([[0], ends])[first]


def tokenised(docs: DataFrame, path: str | None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``window`` tokens: doc_id, start, length, ids_crc32, doc_tokens.

    All pieces but the last of a document are full windows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches):
        tok = None
        for batch in batches:
            tok = tok or WordTokenizer.of_worker(path or tokenizer_path())
            for part in runs_of(batch, "text", 2 * RUN_BYTES):
                flat, offsets = tok.encode(part.column(1))
                out: list[list] = [[], [], [], [], []]
                for doc, lo, hi in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    ids = np.append(flat[lo:hi], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), window):
                        piece = ids[s:s + window]
                        for col, v in zip(out, (doc, s, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class Rooms:
    """Open windows by remaining capacity: a segment tree over 0..window."""

    def __init__(self, window: int):
        self.leaves = 1
        while self.leaves <= window:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        i = self.leaves + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest window with at least ``least`` left, or None."""
        count, i = self.count, self.leaves + least
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up to the first right sibling with an open window
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i *= 2
                i += not count[i]
        room = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each piece; ``lengths`` must be in decreasing order."""
    rooms, sequence, offset, n = Rooms(window), [], [], 0
    for length in lengths:
        got = rooms.take(length)
        if got is None:
            got, n = (window, n), n + 1
        room, seq = got
        sequence.append(seq)
        offset.append(window - room)
        if room > length:
            rooms.put(room - length, seq)
    return sequence, offset


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every token id of every document (its ids, then ``end_id``) lies in exactly one piece; the
    pieces of a sequence follow each other from offset 0 without gaps and hold at most
    ``window`` ids. Null and empty texts are one piece of the end id. Equal lengths go by
    doc_id and start; repeated rows are packed each; a null doc_id stays null. Extra columns
    are ignored and an empty table has no piece.
    """
    pieces = materialize(tokenised(docs, path, window, end_id), "pack-pieces")
    short = pieces.filter(F.col("length") < window)
    groups = max(1, -(-short.count() // group_pieces))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        pdf["sequence_id"], pdf["offset"] = best_fit_decreasing(pdf["length"].tolist(), window)
        pdf["sequence_id"] = pdf["sequence_id"] * (2 * groups) + 2 * pdf["bin"]
        return pdf.drop(columns="bin")

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    dealt = short.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "length", F.monotonically_increasing_id()), F.lit(groups)))
    packed = dealt.groupBy("bin").applyInPandas(run, kind)
    full = pieces.filter(F.col("length") == window).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)
