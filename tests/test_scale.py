"""Steps that once held a table in the driver, shuffled a vector per occurrence or left work out."""

import numpy as np
import pyspark.ml.feature
import pytest
from pyspark.sql import functions as F

from tessera.llm import simhash as SH
from tessera.llm.common import materialize
from tessera.operators import embed as EM
from tessera.operators import knn as KN
from tessera.operators import models as MD
from tessera.plans import embed_queries as E
from tessera.plans import model_queries as Q
from tessera.plans import resample_queries as RQ


def test_pooling_in_blocks_equals_the_sums(spark, monkeypatch):
    """Several blocks, repeated words and documents, words without a vector, empty and null texts; no row per occurrence is shuffled with its vector."""
    monkeypatch.setattr(EM, "POOL_WORDS", 40)
    monkeypatch.setattr(EM, "_mean_per_doc", None)
    rng = np.random.default_rng(3)
    vec = {f"w{i}": rng.normal(size=4).astype(np.float32) for i in range(20)}
    docs = [(i, [f"w{j}" for j in rng.integers(0, 25, 12)]) for i in range(40)] + [(7, ["w1", "w1"]), (100, []), (101, None), (102, ["zz"]), (None, ["w1"])]
    words = {}
    for i, t in docs:
        words.setdefault(i, []).extend(t or [])
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    table = spark.createDataFrame([(w, v.tolist()) for w, v in vec.items()] + [("w20", None)], "word string, vector array<float>")
    got = EM.mean_pool(df, table, dim=4).collect()
    assert len(got) == len(docs)
    for r in got:
        hit = [vec[w] for w in words[r.doc_id] if w in vec] if r.doc_id is not None else []
        assert r.embedding == pytest.approx(np.mean(hit, axis=0).tolist() if hit else [0.0] * 4, abs=1e-6)
    masked = {r.doc_id: r.embedding for r in EM.masked_mean_pool(df.where("doc_id <> 7"), table, max_len=5, dim=4).collect()}
    for i, t in docs:
        if i is not None and i != 7:
            want = np.sum([vec.get(w, np.zeros(4)) for w in (t or [])[:5]], axis=0) / len(t[:5]) if t else None
            assert (masked[i] is None) if want is None else masked[i] == pytest.approx(want.tolist(), abs=1e-6)


def test_corpus_is_cleaned_once(spark, monkeypatch):
    rows = [(i, [f"t{j}" for j in range(1 + i % 5)]) for i in range(10)]
    seen = []
    toks = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    monkeypatch.setattr(E, "clean_tokens", lambda *a: seen.append(1) or toks)
    monkeypatch.setattr(E, "table", lambda *a: spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<float>"))
    assert [r.word for r in E.most_similar(spark, "").collect()] == ["t1", "t2", "t3"]
    assert len(seen) == 1
    assert {r.word for r in E.merge_pretrained(spark, "").collect()} == {"t0", "t1", "t2", "t3"} and len(seen) == 2
    assert E.word_similarity(spark, "").count() == 3 and len(seen) == 3


def test_skip_gram_does_not_fit_in_the_driver(spark, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("MLlib's Word2Vec holds its matrices in the driver")
    monkeypatch.setattr(pyspark.ml.feature.Word2Vec, "fit", refuse)
    toks = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"])], "doc_id long, tokens array<string>")
    got = {r.word: np.array(r.vector) for r in MD.train_word2vec(toks, size=6, min_count=2, epochs=2).collect()}
    assert set(got) == {"a", "b"} and all(v.shape == (6,) and np.isfinite(v).all() for v in got.values())


@pytest.mark.parametrize("flip", [False, True])
def test_fits_are_judged_on_the_whole_train_split(spark, flip):
    rng = np.random.default_rng(1)
    df = MD.with_features(spark.createDataFrame([(i, i % 2, (rng.normal(size=3) + 6 * (i % 2)).tolist()) for i in range(60)], "vec_id long, label int, v array<double>"), "v")
    tr, te = df.where("vec_id < 40"), df.where("vec_id >= 40")
    model = MD.train_gaussian_nb(tr)
    out = Q._scored(model, tr.withColumn("label", 1 - F.col("label")) if flip else tr, te).collect()
    assert len(out) == 20 and all(r.known_class and r.proper_probability and r.above_chance != flip for r in out)


def test_a_query_visits_few_cells(spark, monkeypatch):
    """One pivot per CELL_ROWS rows, so a query is not shipped to a cell for every few rows."""
    seen = []
    monkeypatch.setattr(KN, "_pivot_distances", lambda p, make=KN._pivot_distances: seen.append(len(p)) or make(p))
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(4000)], "id long, v array<double>")
    got = {(r.id, r.nn_id) for r in KN.knn_join(df.where("id < 20"), df, 2, "id", "id", "v", "v", exclude_self=True).collect()}
    x = np.array([r.v for r in df.orderBy("id").collect()])
    d = ((x[:20, None] - x[None]) ** 2).sum(-1)
    d[np.arange(20), np.arange(20)] = np.inf
    assert got == {(i, int(j)) for i in range(20) for j in np.argsort(d[i])[:2]}
    assert seen == [16]


def test_subword_vectors_in_blocks_equal_the_means(spark, monkeypatch):
    """Several blocks, repeated n-grams and words, a word and an n-gram without a vector; no vector goes along with a (word, n-gram) row."""
    monkeypatch.setattr(EM, "GRAM_WORDS", 30)
    monkeypatch.setattr(EM, "_mean_per_doc", None)
    known = {"abab": [1.0, 2.0], "abcd": [3.0, 5.0], "xyz": [0.5, -1.0]}
    words = [*known, "ababab", "abz", "qqq", "ababab"]

    def grams(w):
        return [f"<{w}>"[i:i + n] for n in (2, 3) for i in range(len(w) + 3 - n)]
    table = {}
    for w, v in known.items():
        for g in set(grams(w)):
            table.setdefault(g, []).append(v)
    got = EM.subword_vectors(spark.createDataFrame([(w,) for w in words], "word string"),
                             spark.createDataFrame(list(known.items()), "word string, vector array<float>"), 2, 3).collect()
    assert sorted(r.word for r in got) == sorted(set(words))
    for r in got:
        hits = [np.mean(table[g], axis=0) for g in grams(r.word) if g in table]
        want = known[r.word] if r.word in known else np.mean(hits, axis=0).tolist() if hits else None
        assert r.vector == (want if want is None else pytest.approx(want)) and r.n_ngrams == (0 if r.word in known else len(hits))


def test_sequences_are_written_in_blocks(spark, monkeypatch):
    """Several blocks, words twice in the table or with a null vector, documents twice, without tokens or id; a position's vector is not shuffled."""
    monkeypatch.setattr(EM, "SEQUENCE_DOCS", 2)
    docs = [(1, ["a", "b", "a", "c"]), (2, []), (3, None), (2 ** 53 + 1, ["zz", "b"]), (4, ["a"]), (4, ["b"]), (None, ["b"])]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    table = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("c", None), ("<pad>", [9.0, 9.0])], "word string, vector array<float>")
    out = EM.sequence_embed(df, table, max_len=3, dim=2)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    a, b, p = [1.0, 2.0], [3.0, 4.0], [9.0, 9.0]
    got = {r.doc_id: (r.sequence, r.mask) for r in out.collect()}
    assert got == {1: ([a, b, a], [True] * 3), 2: ([p] * 3, [False] * 3), 3: ([p] * 3, [False] * 3), 2 ** 53 + 1: ([p, b, p], [True, True, False]),
                   4: ([a, b, p, p, p, p], [True, True] + [False] * 4), None: ([b, p, p], [True, False, False])}
    twice = {r.doc_id: r.sequence for r in EM.sequence_embed(df, table.union(table.where("word = 'b'")), max_len=3, dim=2).collect()}
    assert twice[1] == [a, b, b, a] and twice[None] == [b, b, p, p]


def test_a_query_is_shipped_once_per_block(spark, monkeypatch):
    """Several blocks, groups and tiles, a hot bin of copies, vectors that are not finite: the same neighbours as by all pairs."""
    for name, value in {"LEAST_ROWS": 8, "BLOCK_ROWS": 40, "TILE": (16, 8)}.items():
        monkeypatch.setattr(KN, name, value)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(150, 3)), 1)
    x[:60] = x[0]  # one bin of copies: ties by id
    x[149] = np.nan
    q = spark.createDataFrame([(i, v.tolist(), [1, 2, 3, 4], float("inf")) for i, v in enumerate(x)], "_lid long, _lvec array<float>, _bins array<long>, _w double")
    r = spark.createDataFrame([(i, v.tolist(), 1 if i < 60 else 2 + i % 3) for i, v in enumerate(x)], "_rid long, _rvec array<float>, _bin long")
    out = KN._best(KN._block_pairs(q, r, 4, True), 4).collect()
    y = x.astype(np.float32).astype(float)
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    d[np.arange(150), np.arange(150)] = np.inf
    want = {(i, int(j)) for i in range(149) for j in sorted(range(149), key=lambda j: (d[i, j], j))[:4]}
    assert {(p["_lid"], p["_rid"]) for p in out} == want


def test_a_row_of_several_buckets_counts_once(spark):
    """Buckets of one block hold the same rows: the k best are different ones."""
    x = np.arange(30, dtype=float)
    q = spark.createDataFrame([(0, [0.0], [5, 6, 7], float("inf"))], "_lid long, _lvec array<double>, _bins array<long>, _w double")
    r = spark.createDataFrame([(i, [float(v)], b) for b in (5, 6, 7) for i, v in enumerate(x)], "_rid long, _rvec array<double>, _bin long")
    out = KN._block_pairs(q, r, 4, True, sieve=lambda a, b: np.ones((len(a), len(b)), bool)).collect()
    assert sorted((p["_rid"], p["dist"]) for p in out) == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)]


def test_balancing_cleans_two_classes_against_each_other(spark, monkeypatch):
    """Rows of class 0 amid class 1 go before the under-sampling; with one class alone nothing could go."""
    rng = np.random.default_rng(2)
    rows = [(i, 0, rng.normal(size=2) * 0.1) for i in range(20)] + [(20 + i, 1, 5 + rng.normal(size=2) * 0.1) for i in range(12)]
    rows += [(40, 0, np.array([5.0, 5.0]))] + [(50 + i, 2 + i % 2, np.array([-5.0, 5.0 * (i % 2)]) + rng.normal(size=2) * 0.1) for i in range(12)]
    df = spark.createDataFrame([(i, y, v.tolist()) for i, y, v in rows], "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(RQ, "imbalanced", lambda *a: df)
    out = RQ.balance_classes(spark, "").collect()
    kept = {r.vec_id for r in out if r.vec_id is not None}
    assert kept == {i for i, _, _ in rows} - {40}
    assert {y: sum(r.label == y for r in out) for y in range(4)} == dict.fromkeys(range(4), 20)


def test_near_copies_broadcast_no_exploded_table(spark):
    """The fingerprints' file is far below the threshold, what is exploded from it need not be."""
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(-2 ** 62, 2 ** 62, 300)]
    rows = [(i, fp) for i, fp in enumerate(fps)] + [(300 + i, fps[i] ^ (1 << i) ^ (1 << 40)) for i in range(30)] + [(400, fps[0] ^ 15)]
    nodes = materialize(spark.createDataFrame(rows, "id long, fp long"), "nodes")
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        assert spark.conf.get(key) in ("-1", "10MB")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        out = SH.links(nodes)
        got = {(r.u, r.v) for r in out.collect()}
        assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert got == {(i, 300 + i) for i in range(30)}  # 400 differs in four bits
