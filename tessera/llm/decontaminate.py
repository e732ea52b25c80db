"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Fixed masks choose ``weight`` of the tokens in a short span and ignore the others, so a seed
still matches where ignored tokens were substituted. The masks are such that every pair of
``window`` tokens with at most ``substitutions`` substituted ones shares a seed (see
:func:`lossless`), so no overlap that the verification accepts is missed.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import materialize

#: An overlap is this many tokens in a row of which at most so many are substituted.
WINDOW, SUBSTITUTIONS = 13, 2
#: Token offsets that each mask keeps.
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 2, 4, 7, 8))
#: The test side's seeds are broadcast up to this many rows (about 100 bytes each).
BROADCAST_ROWS = 500_000

TOKENS = r"[\p{L}\p{N}]+"


def lossless(masks=MASKS, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> bool:
    """True if however ``substitutions`` of ``window`` tokens change, some mask fits between."""
    placed = [{o + at for o in m} for m in masks for at in range(window - max(m))]
    return all(any(not p & set(bad) for p in placed) for bad in combinations(range(window), substitutions))


def token_hashes(text: str | Column) -> Column:
    """Hashes of the lower-case letter and digit runs of a text; null has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(TOKENS), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, masks=MASKS) -> DataFrame:
    """``rows`` (with token hashes ``h``) once per position ``at`` (from 1) and mask: ``seed``.

    A mask is only placed where all of its span lies inside the text.
    """
    shortest = min(max(m) for m in masks) + 1
    at = rows.filter(F.size("h") >= shortest).select("*", F.explode(F.sequence(F.lit(1), F.size("h") - (shortest - 1))).alias("at"))
    keys = [F.xxhash64(F.lit(k), *[F.get("h", F.col("at") + (o - 1)) for o in m]) for k, m in enumerate(masks)]
    fits = [F.col("at") + max(m) <= F.size("h") for m in masks]
    return at.select("*", F.explode(F.array(*[F.when(f, k) for f, k in zip(fits, keys)])).alias("seed")).filter("seed is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS,
                 masks=MASKS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, n_matched
    (equal tokens at the best alignment), n_window (most equal tokens in a window), n_tokens
    (of the item).

    They overlap if at some alignment ``window`` tokens in a row of the item have at most
    ``substitutions`` that differ, tokens beyond the document's ends included; an item shorter
    than ``window`` must occur whole, however short (items that no mask fits into get a mask of
    all their tokens). Tokens are runs of letters and digits in lower case. Null and empty texts
    have no tokens and match nothing; a null doc_id or item_id is reported as null; repeated rows
    give the row once. Extra columns are ignored, an empty table on either side gives no row.

    Up to ``broadcast_rows`` seeds of the items are broadcast; beyond that seeds are joined by a
    shuffle of (document, position, seed) alone, and the tokens of documents with a hit rejoin.
    """
    if not lossless(masks, window, substitutions):
        raise ValueError("these masks can miss an overlap")
    test = benchmark.select(F.col("item_id").cast("long").alias("item_id"), token_hashes("text").alias("item")).distinct()
    test = materialize(test.filter(F.size("item") > 0), "spaced-items")
    fits = min(max(m) for m in masks) + 1
    lengths = [r.n for r in test.filter(F.size("item") < fits).select(F.size("item").alias("n")).distinct().collect()]  # fewer than a mask's span
    masks = (*masks, *(tuple(range(n)) for n in sorted(lengths)))
    keys = materialize(seeds(test.withColumnRenamed("item", "h"), masks).select("seed", "item_id", F.col("at").alias("item_at"), F.xxhash64("h").alias("item_key")), "spaced-seeds")
    small = keys.count() <= broadcast_rows
    hint = F.broadcast if small else (lambda df: df)
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_hashes("text").alias("h"))
    reach = F.col("at") - F.col("item_at")
    train = train.withColumn("doc_key", F.xxhash64("h"))
    if small:
        hits = seeds(train, masks).join(hint(keys), "seed").select("doc_id", "item_id", "item_key", reach.alias("shift"), "h", "doc_key")
    else:
        found = seeds(train, masks).select("doc_id", "doc_key", "at", "seed").join(keys, "seed")
        found = materialize(found.select("doc_id", "doc_key", "item_id", "item_key", reach.alias("shift")).distinct(), "spaced-hits").alias("f")
        mine = (F.col("f.doc_key") == F.col("d.doc_key")) & F.col("f.doc_id").eqNullSafe(F.col("d.doc_id"))
        hits = found.join(train.alias("d"), mine).select("f.doc_id", "item_id", "item_key", "shift", "h", "f.doc_key")
    # the document's tokens that face the item (items are short, so this is a short array)
    length = test.select(F.col("item_id").alias("id"), F.xxhash64("item").alias("item_key"), "item", F.size("item").alias("n"))
    hits = hits.join(hint(length), (F.col("item_id").eqNullSafe(F.col("id"))) & (hits["item_key"] == length["item_key"])).select(
        "doc_id", "item_id", "doc_key", "shift", "item", "n",
        F.slice("h", F.greatest(F.col("shift"), F.lit(0)) + 1, F.col("n") + F.least(F.col("shift"), F.lit(0))).alias("part"))
    hits = hits.dropDuplicates(["doc_id", "item_id", "doc_key", "shift", "item"])
    lead = F.greatest(-F.col("shift"), F.lit(0))
    same = F.transform(F.sequence(F.lit(0), F.size("part") - 1), lambda i: (F.get("part", i) == F.get("item", i + lead)).cast("int"))
    hits = hits.withColumn("same", same)
    width = F.least(F.lit(window), F.col("n"))
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.size("same") - width + 1, F.lit(1))), lambda i: F.aggregate(F.slice("same", i, width), F.lit(0), lambda a, x: a + x))
    hits = hits.select("doc_id", "item_id", F.aggregate("same", F.lit(0), lambda a, x: a + x).cast("long").alias("n_matched"),
                       F.array_max(sums).cast("long").alias("n_window"), F.col("n").cast("long").alias("n_tokens"))
    hits = hits.filter(F.col("n_window") >= F.when(F.col("n_tokens") < window, F.col("n_tokens")).otherwise(window - substitutions))
    return hits.groupBy("doc_id", "item_id").agg(F.max("n_matched").alias("n_matched"), F.max("n_window").alias("n_window"), F.max("n_tokens").alias("n_tokens"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id overlaps no benchmark item; null ids stay. Other columns
    pass through unread, whatever their names; an empty table stays empty."""
    bad = contaminated(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(materialize(bad, "spaced-bad"), "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
