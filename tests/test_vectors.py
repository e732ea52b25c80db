"""Pooling (FIXTURES C5), exact k-NN against brute force, SMOTE invariants, splits."""

import numpy as np

from tessera.operators import embed as EM
from tessera.operators import knn as K
from tessera.operators import resample as RS
from tessera.operators import split as X


def test_pooling_edge_cases(spark):
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "word string, vector array<float>")
    docs = spark.createDataFrame([(1, ["x", "y"]), (2, ["a", "a", "b"]), (3, [])], "doc_id int, tokens array<string>")
    mp = {r.doc_id: r.embedding for r in EM.mean_pool(docs, vec).collect()}
    assert mp[1] == [0.0, 0.0]                        # all unknown -> zeros
    assert np.allclose(mp[2], [2 / 3, 2 / 3])         # repeats count
    mm = {r.doc_id: r.embedding for r in EM.masked_mean_pool(docs, vec, max_len=4).collect()}
    assert mm[3] is None                              # all padding -> null
    assert np.allclose(mm[1], [0.0, 0.0])             # OOV rows count as zeros


def test_knn_exact(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, v array<double>")
    got = K.knn_join(df, df, 3, "id", "id", "v", "v", exclude_self=True, n_pivots=6)
    got = {(r.id, r.nn_rank): r.nn_id for r in got.collect()}
    d = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for i in range(60):
        order = sorted(range(60), key=lambda j: (d[i, j], j))[:3]
        assert [got[(i, r)] for r in (1, 2, 3)] == order


def _brute(pts, k):
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return {(i, r + 1): j for i in range(len(pts)) for r, j in enumerate(sorted(range(len(pts)), key=lambda j: (d[i, j], j))[:k])}


def test_knn_prunes_clustered_vectors(spark):
    """Exact on clusters, ties across cells included, with far fewer pairs than all."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 4)) * 100
    pts = np.round(centres[np.arange(600) % 20] + rng.normal(size=(600, 4)))  # whole numbers: many ties
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, v array<double>")
    args = (df, df, 4, "id", "id", "v", "v")
    got = {(r.id, r.nn_rank): r.nn_id for r in K.knn_join(*args, exclude_self=True, r_block=16).collect()}
    assert got == _brute(pts, 4)
    assert K.pairs_compared(*args, exclude_self=True, r_block=16) < 600 * 600 / 5


def test_knn_line_of_ties_and_small_groups(spark):
    """Grid points on a line: every neighbour is tied with the one on the other side."""
    pts = np.array([[float(i), 0.0] for i in range(120)])
    df = spark.createDataFrame([(i, [float(x) for x in p], "a" if i else "b") for i, p in enumerate(pts)],
                               "id long, v array<double>, g string")
    got = {(r.id, r.nn_rank): r.nn_id for r in K.knn_join(df, df, 3, "id", "id", "v", "v", exclude_self=True, r_block=4).collect()}
    assert got == _brute(pts, 3)
    alone = K.knn_join(df, df, 3, "id", "id", "v", "v", exclude_self=True, same="g", r_block=4).collect()
    assert not [r for r in alone if r.id == 0 or r.nn_id == 0] and len(alone) == 119 * 3


def test_smote_rows_on_segments(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, [float(x) for x in rng.normal(size=3)]) for i in range(20)] + \
           [(100 + i, 1, [float(x) for x in rng.normal(size=3) + 5]) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    out = RS.smote(df, "label", "id", "v", k=3, seed=7)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 20, 1: 20}
    vecs = {r.id: np.array(r.v) for r in df.collect()}
    labels = {r.id: r.label for r in df.collect()}
    syn = out.where("source_id IS NOT NULL").join(
        RS._generate(df, spark.createDataFrame([(1, 14)], "label int, need long"), "label", "id", "v", 3, 7, False)
        .select("syn_index", "nn_id"), "syn_index").collect()
    for r in syn:
        a, b = vecs[r.source_id], vecs[r.nn_id]
        assert labels[r.nn_id] == 1
        t = np.dot(np.array(r.v) - a, b - a) / np.dot(b - a, b - a)
        assert -1e-9 <= t <= 1 + 1e-9 and np.allclose(a + t * (b - a), r.v)


def test_stratified_split_exact(spark):
    df = spark.createDataFrame([(i, 0 if i < 70 else 1) for i in range(100)], "id long, label int")
    s = X.stratified_split(df, "label", 0.2, 42, "id")
    c = {(r.split, r.label): r["count"] for r in s.groupBy("split", "label").count().collect()}
    assert c == {("test", 0): 14, ("test", 1): 6, ("train", 0): 56, ("train", 1): 24}
    s7 = X.stratified_split(df.repartition(7), "label", 0.2, 42, "id")
    assert s.select("id", "split").exceptAll(s7.select("id", "split")).count() == 0
    f = X.stratified_kfold(df, "label", 5, 42, "id")
    assert sorted(r["count"] for r in f.groupBy("fold").count().collect()) == [20] * 5
    odd = X.stratified_kfold(df.where("id % 4 != 1"), "label", 4, 42, "id").groupBy("fold").count().collect()
    assert max(r["count"] for r in odd) - min(r["count"] for r in odd) <= 1
    kept = X.random_undersample(df, "label", {0: 10, 1: 500}, 42, "id").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in kept} == {0: 10, 1: 30}


def test_leak_audit(spark):
    train = spark.createDataFrame([(None, 1), (5, None)], "id long, source_id long")
    test = spark.createDataFrame([(1,), (2,)], "id long")
    r = X.leak_audit(train, test, "id").first()
    assert r.n_leaked_rows == 1 and r.n_test_sources == 1


def test_knn_empty_right(spark):
    left = spark.createDataFrame([(1, [0.0, 1.0])], "id long, v array<double>")
    right = spark.createDataFrame([], "id long, v array<double>")
    assert K.knn_join(left, right, 3, "id", "id", "v", "v").count() == 0


def test_condensed_nn_runs_until_nothing_is_added(spark):
    """A line of points whose classes alternate in ever wider bands takes many rounds."""
    from tessera.operators.resample import condensed_nn
    rows = [(i, i // 3 % 2, [float(i) ** 1.5, 0.0]) for i in range(90)] + [(1000 + i, 1, [-5.0 - i, 0.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    store = {r.vec_id for r in condensed_nn(df, "label", "vec_id", "embedding").collect()}
    pts = {i: (c, v[0]) for i, c, v in rows}
    for i, (c, x) in pts.items():
        if i not in store:
            near = min(store, key=lambda j: (abs(pts[j][1] - x), j))
            assert pts[near][0] == c


def test_sequence_embed_gives_unknown_words_the_pad_vector(spark):
    from tessera.operators.embed import sequence_embed
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("<pad>", [9.0, 8.0])], "word string, vector array<float>")
    docs = spark.createDataFrame([(1, ["a", "unknown"])], "doc_id long, tokens array<string>")
    row = sequence_embed(docs, vectors, max_len=3, dim=2).first()
    assert row.sequence == [[1.0, 2.0], [9.0, 8.0], [9.0, 8.0]] and row.mask == [True, True, False]
