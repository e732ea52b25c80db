"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into ``segments`` parts. Two fingerprints that differ in at most
``bits`` bits differ in at most ``bits // segments`` bits in some part, so each fingerprint
looks up, part by part, every value of that small Hamming ball in the table of parts, and
the matches' whole distance is then verified. With two parts of 32 bits and 3 bits the ball
has 33 values and a part is shared by chance by one in 2**32 fingerprints.

Equal fingerprints are one node (exact copies never pair up), so a node has at most
sum(C(64, k), k <= bits) links. Components come from alternating large-star and small-star
rounds over the link table, each round written to the shared folder.

Joins of data-sized tables are merge joins: before an explode a table's files may be small enough
for Spark to broadcast what comes out of it, through the driver.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import materialize

SEED = 42


def fingerprint(data: bytes, size: int = 3) -> int:
    """64-bit SimHash of a text: bit i is set if it is set in over half of the shingle hashes.

    Lower-cases A-Z, takes words ``[^\\x20\\x09-\\x0D]+`` and shingles of ``size`` words joined
    by a space, repeats included; fewer words make one shingle, no word gives 0.
    """
    words = data.lower().split()
    if not words:
        return 0
    digest, half = xxhash.xxh64_intdigest, min(size, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    lo, hi = starts[:len(words) - half + 1].tolist(), ends[half - 1:].tolist()
    ones, n = np.zeros(64, np.int64), len(lo)
    for k in range(0, n, 1 << 15):
        hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(lo[k:k + (1 << 15)], hi[k:k + (1 << 15)])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for every row of ``docs``; null text counts as empty."""
    def run(batches):
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(x.as_py() or b"", size) for x in text), np.uint64, len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def ball(width: int, radius: int) -> list[int]:
    """All bit patterns of ``width`` bits with at most ``radius`` ones."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def links(nodes: DataFrame, bits: int = 3, segments: int = 2) -> DataFrame:
    """Pairs (u, v), u < v, of the ``id`` of nodes whose ``fp`` differ in at most ``bits`` bits."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    mask = [(1 << (hi - lo)) - 1 for lo, hi in zip(cuts, cuts[1:])]
    part = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(m)) for lo, m in zip(cuts, mask)]
    rows = nodes.select("id", "fp", F.posexplode(F.array(*part)).alias("part", "value"))
    balls = F.lit(None)
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        balls = F.when(F.col("part") == k, F.array(*[F.lit(x).cast("long") for x in ball(hi - lo, bits // segments)])).otherwise(balls)
    probes = rows.select("id", "fp", "part", F.explode(balls).alias("flip"), "value")
    probes = probes.select(F.col("id").alias("u"), F.col("fp").alias("fp_u"), "part", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    stored = rows.select(F.col("id").alias("v"), F.col("fp").alias("fp_v"), "part", "value")
    near = F.bit_count(F.col("fp_u").bitwiseXOR(F.col("fp_v"))) <= bits
    return probes.join(stored.hint("merge"), ["part", "value"]).filter((F.col("u") < F.col("v")) & near).select("u", "v").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Large-star links every larger neighbour of a node to its smallest neighbour, small-star
    every smaller one; when a double round changes nothing each component is a star.
    """
    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(edges, large):
        both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(materialize(least, "star-least").hint("merge"), "u")
        if large:
            moved = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = moved.select("v", "m").union(moved.select("u", "m")).toDF("u", "v")
        return materialize(moved.filter("u <> v").distinct(), "star")

    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "star")
    before = state(edges)
    for _ in range(rounds):
        edges = star(star(edges, True), False)
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def simhash_groups(docs: DataFrame, size: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_links, one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most ``bits`` differing
    bits; ``n_links`` counts the other fingerprints a document's fingerprint links to. Null
    and empty texts have fingerprint zero. Rows without ``doc_id`` link nothing; they get the
    component of their fingerprint, if any row with an id has it. Rows that repeat a
    ``doc_id`` with other texts count as one document with several fingerprints. Extra columns
    are ignored, an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, size), "simhash")
    nodes = materialize(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    pairs = materialize(links(nodes, bits), "simhash-links")
    label = components(pairs)
    degree = pairs.select("u").union(pairs.select("v")).groupBy("u").agg(F.count("*").alias("n_links")).withColumnRenamed("u", "id")
    named = (nodes.join(label.withColumnRenamed("node", "id").hint("merge"), "id", "left").join(degree.hint("merge"), "id", "left")
             .select("fp", F.coalesce("component", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    out = fps.join(materialize(named, "simhash-named").hint("merge"), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def drop_near_copies(docs: DataFrame, size: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` but for those of a group that are not its smallest doc_id.

    Rows without ``doc_id`` stay; rows that repeat a doc_id stay or go together. Other columns
    pass through unread, whatever their names; an empty table stays empty.
    """
    groups = simhash_groups(docs, size, bits)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(materialize(gone, "simhash-gone"), "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
