"""Sharding: margins and law of the matrix, uniformity, exact sizes, odd tables."""

import zlib
from collections import Counter
from itertools import permutations

import numpy as np

from tessera.llm import sharding
from tessera.llm.sharding import Matrix, hypergeometric, shard_documents, shuffled, split, write_shards


def numbers(parts):
    return np.concatenate([(p << 33) + np.arange(n) for p, n in parts]) if parts else np.zeros(0, np.int64)


def test_matrix_margins_and_arrivals():
    parts = [(0, 700), (3, 1), (4, 333), (9, 2000)]
    m = Matrix(parts, 7, 5)
    rows = [m.row(s) for s in range(m.sources)]
    assert (sum(c for c, _ in rows) == m.targets).all() and m.targets.sum() == m.n == 3034
    assert [int(c.sum()) for c, _ in rows] == [m.rows_before(s + 1) - m.rows_before(s) for s in range(m.sources)]
    assert (np.cumsum([c for c, _ in rows], axis=0)[:-1] == [sent for _, sent in rows[1:]]).all()
    sizes = m.targets.reshape(7, -1).sum(axis=1)
    assert sizes.max() - sizes.min() <= 1
    target, arrival = m.deal(numbers(parts))
    for t, size in enumerate(m.targets):
        assert sorted(arrival[target == t]) == list(range(size))
    again = Matrix(parts, 7, 5)  # any order of asking, any task: the same rows
    some = numbers(parts)[::-3]
    assert (np.stack(again.deal(some)) == np.stack([target, arrival])[:, ::-3]).all()


def test_every_order_is_equally_likely():
    """4 rows of two partitions into 2 shards: brute force over seeds, all 24 orders about equally often."""
    seen = Counter()
    for seed in range(6000):
        m = Matrix([(0, 3), (1, 1)], 2, seed)
        target, arrival = m.deal(numbers([(0, 3), (1, 1)]))
        place = {}
        for t in range(len(m.targets)):
            rows = np.flatnonzero(target == t)
            keys = np.random.default_rng([seed, 9, t]).permutation(len(rows))
            for r, k in zip(rows[np.argsort(arrival[rows])], keys):
                place[r] = (t, k)
        seen[tuple(sorted(place, key=place.get))] += 1
    assert set(seen) == set(permutations(range(4)))
    assert sum((n - 250) ** 2 / 250 for n in seen.values()) < 60  # chi-square, 23 degrees of freedom


def test_large_populations_follow_the_same_law(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(sharding, "NUMPY_MOST", 1)
    mine = np.array([hypergeometric(rng, 30, 50, 20) for _ in range(20000)])
    theirs = np.random.default_rng(2).hypergeometric(30, 50, 20, 20000)
    a, b = np.bincount(mine, minlength=21), np.bincount(theirs, minlength=21)
    assert abs(a - b).max() < 450 and abs(mine.mean() - 7.5) < 0.06
    got = split(rng, np.array([5, 0, 7, 9]), 11)
    assert got.sum() == 11 and (got <= [5, 0, 7, 9]).all() and (got >= 0).all()
    x = hypergeometric(rng, 10 ** 12, 3 * 10 ** 12, 10 ** 10)
    assert abs(x - 2.5e9) < 12 * 5e4


def test_shards_of_documents(spark):
    texts = ["a", None, "", "é\x00 ", "hot"] + ["hot"] * 400 + [f"t{i}" for i in range(300)]
    rows = [(i if i % 50 else None, t, i) for i, t in enumerate(texts)] + [(7, "x", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    got = shard_documents(df, shards=6).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(6)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    hot = Counter(r.shard for r in got if r["size"] == 4 and r.text_crc32 == zlib.crc32(b"hot"))
    assert min(hot.values()) > 40  # copies spread evenly
    empty = shard_documents(df.limit(0))
    assert empty.count() == 0 and [f.name for f in empty.schema] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_fewer_rows_than_shards_clashing_names_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3), (1, 2, 3), (4, 5, 6)], "number int, target int, `a.b` int")
    out = shuffled(df, 8)
    assert sorted((tuple(r.row), r.slot) for r in out.collect()) == [((1, 2, 3), 0), ((1, 2, 3), 0), ((4, 5, 6), 0)]
    write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3
