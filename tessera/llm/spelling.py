"""Spelling variant grouping: words one edit apart, found through a variable-length gram index.

1. ``word_counts``: letter runs of every whole text, lower-cased in A-Z, damaged by the fixed
   rule of ``word_counts``, counted inside the tasks and summed by word.
2. ``gram_dictionary``: grams of 3 letters and up over ``^word$``, level by level. A gram that
   more than ``LIMIT`` words hold is *frequent* and is replaced by its one letter longer
   extensions, up to ``qmax``; a rarer one is a leaf and is never extended (frequency pruning).
3. ``decompose``: the variable gram at a position is the shortest rare one, or the one that
   reaches ``qmax`` or the word's end. Which gram stands at a position depends on the gram's own
   letters only, so one edit leaves every gram alone that it does not touch.
4. Affected-gram bound: one edit touches at most ``b`` grams of a set when no letter lies in more
   than ``b`` of them, so a near word shares at least (size of the set - b) of them. Only lists of
   a set for which that is 1 or more need merging, and the cheapest such set is two disjoint grams
   (b = 1): of these the pair with the shortest lists is taken, the long lists are never read.
   Untouched grams keep their distance from the word's start (edit behind) or end (edit before), so
   the lists are kept by (gram, position, word length) and a word reads three of each gram:
   same length, one letter longer with the edit behind, and one longer with the edit before it.
5. What the merged lists hold is verified by edit distance.

``qmax`` is below ``min_length``, so that the grams at a word's two ends are always disjoint:
every word has such a pair and no word needs another way.

The dictionary is the only broadcast table: at most ``MAX_FREQUENT`` grams a level (the limit is
doubled until that holds), 12 bytes each. It only steers which lists are read; results do not
depend on it. Lists join as plain tables, so adaptive execution can split a hot one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import materialize, splitmix, string_buffers

LETTERS = "a-zÀ-ÿ"
DAMAGE = 31           # one of so many (document, word) pairs loses a letter
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10            # a form is at least so many times as frequent as its variant
QMIN, QMAX = 3, 6
LIMIT = 32            # a gram in more words than this is extended
MAX_FREQUENT = 1 << 19
SLICE = 1 << 20       # bytes of a text handled at once
DISTINCT = 200_000    # words a task holds before it hands their counts on
BATCH = 1 << 14       # words decomposed at once
_MUL = np.uint64(0x9E3779B97F4A7C15)
_POS = np.uint64(0xC2B2AE3D27D4EB4F)
_LEN = np.uint64(0x165667B19E3779F9)


def slices(data: bytes, most: int):
    """``data`` (lower-cased UTF-8) in parts of about ``most`` bytes, cut where no letter run is."""
    gap = re.compile(rb"[^a-z\x80-\xff]")
    lo = 0
    while lo < len(data):
        cut = gap.search(data, lo + most) if lo + most < len(data) else None
        hi = cut.end() if cut else len(data)
        yield data[lo:hi].decode("utf-8", "replace")
        lo = hi


def words_of(doc_id, data: bytes, min_length: int = MIN_LENGTH, damage: int = DAMAGE):
    """(word, occurrences) of one text in parts; ``data`` is its UTF-8."""
    run = re.compile(f"[{LETTERS}]{{{min_length},}}")
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for part in slices(data.lower(), SLICE):
        for word, n in Counter(run.findall(part)).items():
            h = zlib.crc32(word.encode(), seed)
            if h % damage == 0:
                i = h % len(word)
                word = word[:i] + word[i + 1:]
                if len(word) < min_length:
                    continue
            yield word, n


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n) over all whole texts. A null text has no words; a null doc_id counts as empty in the damage rule."""
    def count(batches):
        held: dict[str, int] = {}

        def hand_on():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            for doc_id, lo, hi in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:]):
                for word, n in words_of(doc_id, raw[lo:hi].tobytes(), min_length, damage):
                    held[word] = held.get(word, 0) + n
                    if len(held) >= DISTINCT:
                        yield hand_on()
        if held:
            yield hand_on()

    rows = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Padded:
    """The letters of many words as one array, each word between ``^`` and ``$``."""

    def __init__(self, words: list[str]):
        self.letters = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.word = np.repeat(np.arange(len(words)), self.lengths)
        self.at = np.arange(len(self.letters)) - self.starts[self.word]
        self.left = self.lengths[self.word] - self.at  # letters from here to the word's end

    def hashes(self, qmax: int):
        """(q, hash of the q letters from each position); right where ``left`` is q or more."""
        h = np.zeros(len(self.letters), np.uint64)
        for q in range(1, qmax + 1):
            part = np.zeros_like(h)
            part[:len(h) - q + 1] = self.letters[q - 1:]
            h = h * _MUL + part + np.uint64(1)
            yield q, splitmix(h + np.uint64(q))


def look_up(level: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Number of words that hold each gram if it is frequent, else 0."""
    keys, counts = level
    if not len(keys):
        return np.zeros(len(hashes), np.int64)
    i = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[i] == hashes, counts[i], 0)


def _batched(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH):
            yield batch.slice(lo, BATCH)


def gram_dictionary(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, limit: int = LIMIT, most: int = MAX_FREQUENT) -> dict:
    """level -> (sorted hashes, counts) of the frequent grams; a level's grams extend frequent ones of the level before."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sc = words.sparkSession.sparkContext
    for level in range(qmin, qmax + 1):
        known = sc.broadcast(found)

        def count(batches, level=level, known=known):
            for batch in _batched(batches):
                p = Padded(batch.column(0).to_pylist())
                alive = p.left >= level
                for q, h in p.hashes(level):
                    if qmin <= q < level:
                        alive &= look_up(known.value[q], h) > 0
                grams, n = np.unique(h[alive], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], ["gram", "n"])

        counts = words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
        counts = materialize(counts, f"grams-{level}")
        least = limit
        while counts.where(F.col("n") > least).count() > most:
            least *= 2
        rows = counts.where(F.col("n") > least).toPandas()  # at most ``most`` rows
        keys = rows["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        found = found | {level: (keys[order], rows["n"].to_numpy(np.int32)[order])}
    return found


def variable_grams(words: list[str], dictionary: dict, qmin: int = QMIN, qmax: int = QMAX, limit: int = LIMIT):
    """(Padded, gram length per position (0: none), gram hash, words that hold it at most)."""
    p = Padded(words)
    size = np.where(p.left >= qmin, qmin, 0)
    hashes = np.zeros(len(size), np.uint64)
    cost = np.full(len(size), limit, np.int64)
    for q, h in p.hashes(qmax):
        if q < qmin:
            continue
        here = size == q
        hashes[here] = h[here]
        held = np.zeros(len(size), np.int64)
        held[here] = look_up(dictionary[q], h[here])
        longer = here & (held > 0) & (p.left > q) & (q < qmax)
        cost[here & (held > 0)] = held[here & (held > 0)]
        cost[longer] = limit
        size[longer] = q + 1
    return p, size, hashes, cost


def signature(p: Padded, size: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in ``p``) of the two disjoint grams with the shortest lists, per word."""
    big = np.int64(1) << 30
    price = np.where(size > 0, np.minimum(cost, big), big)
    # the cheapest gram at or behind a position of the same word: (word, price, position) packed
    packed = (p.word << 47) | (np.minimum(price, (1 << 23) - 1) << 24) | p.at
    best = np.minimum.accumulate(packed[::-1])[::-1]
    behind = np.arange(len(size)) + size
    valid = (size > 0) & (behind < p.starts[p.word] + p.lengths[p.word])
    there = best[np.where(valid, behind, 0)]
    second_price, second = (there >> 24) & ((1 << 23) - 1), p.starts[p.word] + (there & ((1 << 24) - 1))
    valid &= size[np.where(valid, second, 0)] > 0
    total = np.where(valid, np.minimum(price, (1 << 23) - 1) + second_price, big)
    first = np.minimum.reduceat((total << 24) | p.at, p.starts) & ((1 << 24) - 1)
    a = p.starts + first
    return a, second[a]


def list_keys(hashes: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Keys of the lists of (gram, position, word length)."""
    return splitmix(hashes + at.astype(np.uint64) * _POS + length.astype(np.uint64) * _LEN).view(np.int64)


def _lists(words: DataFrame, dictionary, limit: int, query: bool) -> DataFrame:
    """(key, word, n): the lists every word stands in, or those it has to read."""
    known = words.sparkSession.sparkContext.broadcast(dictionary)

    def emit(batches):
        for batch in _batched(batches):
            if not batch.num_rows:
                continue
            p, size, hashes, cost = variable_grams(batch.column(0).to_pylist(), known.value, limit=limit)
            if query:
                a, b = signature(p, size, cost)
                keys, row = [], []
                for g in (a, b):
                    at, length = p.at[g], p.lengths
                    keys += [list_keys(hashes[g], at, length), list_keys(hashes[g], at, length + 1), list_keys(hashes[g], at + 1, length + 1)]
                    row += [np.arange(len(length))] * 3
                keys, row = np.concatenate(keys), np.concatenate(row)
            else:
                g = np.flatnonzero(size)
                keys, row = list_keys(hashes[g], p.at[g], p.lengths[p.word[g]]), p.word[g]
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["key", "word", "n"])

    return words.select("word", "n").mapInArrow(emit, "key long, word string, n long")


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n, near, near_n): each pair of words one edit apart once, in one direction.

    ``words`` (word, n) holds each word once, of MIN_LENGTH letters or more, and is a written table.
    """
    dictionary = gram_dictionary(words, limit=limit)
    reads = _lists(words, dictionary, limit, True)
    held = _lists(words, dictionary, limit, False).withColumnsRenamed({"word": "near", "n": "near_n"})
    longer = F.char_length("near") - F.char_length("word")
    once = (longer == 1) | ((longer == 0) & (F.col("word") < F.col("near")))
    pairs = reads.join(held, "key").where(once & (F.levenshtein("word", "near", 1) == 1))
    return pairs.select("word", "n", "near", "near_n").distinct()


def spelling_groups(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text).

    form: the near word of largest n (ties: smallest in code-point order) if its n is at least
    ``ratio`` times the word's; root: the end of the chain of forms. Null and empty texts have no
    words, repeated rows count again, other columns are not read, a text of any length is read whole
    in slices, an empty table gives no rows.
    """
    words = materialize(word_counts(docs), "words")
    pairs = materialize(near_words(words), "near")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("b"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "b")
    is_form = -F.col("b.m") >= ratio * F.col("n")
    rows = materialize(rows.select("word", F.when(is_form, F.col("b.near")).alias("form"), "n", "n_near", F.when(is_form, -F.col("b.m")).alias("form_n")), "forms")
    return rows.join(roots(rows.where("form IS NOT NULL").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form, by pointer doubling.

    A form is RATIO times as frequent as its word, so chains end and are at most 19 long (n is a
    64-bit number): five doublings at the most.
    """
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialize(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")
