"""Softmax boosting: bins, split gains against a brute-force search, weights, partitioning."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from tessera.operators import boosting as B


def frame(spark, x, y, w=None, parts=3):
    rows = [(i, int(c), [float(v) for v in r], float(w[i]) if w is not None else 1.0) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, label int, x array<double>, w double").repartition(parts)


def data(n=150, d=4, k=3, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % k
    return np.round(rng.normal(size=(n, d)) + y[:, None] * [1.0, 0, -1, 0][:d], 2), y


def test_bins_and_cuts(spark):
    x, y = data(400)
    x[3, 1] = np.nan
    cuts = B.cuts_of(frame(spark, x, y), "x", 4, 16)
    b = B.binned(x, cuts)
    assert all(len(c) == 15 for c in cuts) and b[3, 1] == 0 and b.max() == 15
    for j in range(4):
        for v in range(15):
            assert ((b[:, j] <= v) == (np.where(np.isnan(x[:, j]), -np.inf, x[:, j]) <= cuts[j][v])).all()
        assert np.bincount(b[:, j], minlength=16).min() >= 10


def brute_gains(bins, g, h, lam, min_child):
    """{(feature, bin): gain} by trying every split."""
    out = {}
    for j in range(bins.shape[1]):
        for v in sorted(set(bins[:, j]))[:-1]:
            left = bins[:, j] <= v
            gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
            if hl >= min_child and hr >= min_child:
                out[j, int(v)] = 0.5 * (gl * gl / (hl + lam) + gr * gr / (hr + lam) - (gl + gr) ** 2 / (hl + hr + lam))
    return out


def test_split_gains_equal_a_brute_force_search(spark):
    x, y = data()
    w = np.random.default_rng(1).uniform(0.5, 2, len(y))
    cuts = B.cuts_of(frame(spark, x, y), "x", 4, 8)
    bins = B.binned(x, cuts)
    margins = np.random.default_rng(2).normal(size=(len(y), 3))
    table = spark.createDataFrame([(bins[i].tobytes(), int(y[i]), float(w[i]), margins[i].tolist()) for i in range(len(y))],
                                  "bins binary, label int, weight double, margins array<double>").repartition(4)
    g, h = B.derivatives(margins, y, w)
    trees = [B.Tree() for _ in range(3)]
    trees[1].split(0, 2, 3)
    cells = B.histograms(table, 4, 8, 3, [], trees, [[0], [1, 2], [0]], 3)
    sums, got = {}, {}
    for r in cells.collect():
        assert r.part == r.feature % 3
        sums.setdefault((r["class"], r.node, r.feature), []).append([np.frombuffer(r.g), np.frombuffer(r.h)])
    for (k, v, f), parts in sums.items():
        for b, gain in enumerate(B.split_gains(*np.sum(parts, axis=0), 1.0, 0.0, 1.0)):
            if gain > -np.inf:
                got.setdefault((k, v), {})[f, b] = gain
    best = {}
    for r in B.best_splits(cells, 1.0, 0.0, 1.0).collect():
        best[r["class"], r.node] = max(best.get((r["class"], r.node), (-np.inf,)), (r.gain, -r.feature, -r.bin, r.gl, r.g))
    left = bins[:, 2] <= 3
    for (k, v), rows in {(0, 0): left | True, (1, 1): left, (1, 2): ~left, (2, 0): left | True}.items():
        want = brute_gains(bins[rows], g[rows, k], h[rows, k], 1.0, 1.0)
        assert got[k, v].keys() == want.keys()
        assert all(got[k, v][s] == pytest.approx(want[s], abs=1e-9) for s in want)
        f, b = max(want, key=lambda s: (round(want[s], 10), -s[0], -s[1]))
        assert best[k, v][:3] == (pytest.approx(want[f, b], abs=1e-9), -f, -b)
        assert best[k, v][3:] == (pytest.approx(g[rows & (bins[:, f] <= b), k].sum()), pytest.approx(g[rows, k].sum()))


def brute_tree(bins, g, h, depth, lam=1.0, min_child=1.0, eta=0.3):
    """Leaf value of every row of one greedily grown tree."""
    gains = brute_gains(bins, g, h, lam, min_child) if depth else {}
    best = max(gains, key=lambda s: (round(gains[s], 10), -s[0], -s[1]), default=None)
    if best is None or gains[best] <= 1e-12:
        return np.full(len(g), -eta * g.sum() / (h.sum() + lam))
    left, out = bins[:, best[0]] <= best[1], np.empty(len(g))
    for side in (left, ~left):
        out[side] = brute_tree(bins[side], g[side], h[side], depth - 1, lam, min_child, eta)
    return out


def test_fit_equals_brute_force_boosting(spark, monkeypatch):
    monkeypatch.setattr(B, "REFRESH", 2)
    x, y = data(90)
    w = np.random.default_rng(3).uniform(0.5, 2, len(y))
    model = B.train_softmax_boosted(frame(spark, x, y, w), "x", "label", "w", rounds=4, depth=3, bins=8)
    bins, margins = B.binned(x, model.cuts), np.zeros((90, 3))
    for _ in range(4):
        g, h = B.derivatives(margins, y, w)
        margins += np.stack([brute_tree(bins, g[:, k], h[:, k], 3) for k in range(3)], axis=1)
    assert model.probabilities(x) == pytest.approx(B.softmax(margins), abs=1e-9)


def test_weights_equal_repeated_rows_and_partitioning_is_free(spark):
    x, y = data(60, d=3)
    x = np.round(x)  # few values: the quantiles of repeated rows are the same
    w = np.where(y == 1, 3.0, 1.0)
    cuts = B.train_softmax_boosted(frame(spark, x, y, w), "x", "label", "w", rounds=2, depth=2, bins=256)
    again = np.repeat(np.arange(60), w.astype(int))
    one = B.train_softmax_boosted(frame(spark, x[again], y[again], parts=7), "x", "label", rounds=2, depth=2, bins=256)
    assert cuts.probabilities(x) == pytest.approx(one.probabilities(x), abs=1e-6)
    same = B.train_softmax_boosted(frame(spark, x, y, w, parts=1), "x", "label", "w", rounds=2, depth=2, bins=256)
    assert same.probabilities(x) == pytest.approx(cuts.probabilities(x), abs=1e-9)
    flat = B.train_softmax_boosted(frame(spark, x, y), "x", "label", rounds=2, depth=2, bins=256)
    assert cuts.probabilities(x)[:, 1].mean() > flat.probabilities(x)[:, 1].mean() + 0.05  # weight counts


def test_scores_and_odd_rows(spark):
    x, y = data(240)
    df = frame(spark, x, y + 5)
    df = df.unionByName(spark.createDataFrame([(900, None, [0.0] * 4, 1.0)], df.schema))
    model = B.train_softmax_boosted(df, "x", "label", rounds=10, depth=4, bins=32, min_child=0.1)
    test = df.unionByName(spark.createDataFrame([(901, 5, None, 1.0), (902, 6, [float("nan")] * 4, 1.0)], df.schema))
    out = model.transform(test).select("id", "label", "prediction", vector_to_array("probability").alias("p")).collect()
    assert len(out) == 243 and {r.prediction for r in out} <= {5, 6, 7}
    assert all(sum(r.p) == pytest.approx(1) and r.prediction - 5 == int(np.argmax(r.p)) for r in out)
    assert np.mean([r.prediction == r.label for r in out if r.id < 240]) > 0.85
    with pytest.raises(ValueError):
        B.train_softmax_boosted(df.limit(0), "x")
    one = B.train_softmax_boosted(df.where("label = 5"), "x", rounds=3)
    assert {r.prediction for r in one.transform(df).collect()} == {5}
