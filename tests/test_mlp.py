"""Weighted net: gradients, weights, dropout, early stopping, partitioning."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from tessera.operators import mlp


def frame(spark, n=90, parts=3, weights=None, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, i % 3 + 4, (rng.normal(size=5) + 2 * (i % 3)).tolist(), float(weights[i % 3]) if weights else 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, label int, x array<double>, w double").repartition(parts)


@pytest.mark.parametrize("masked", [False, True])
def test_gradients_equal_finite_differences(masked):
    rng = np.random.default_rng(1)
    sizes = [4, 6, 5, 3]
    layers = mlp.start_layers(sizes, 2)
    x, y, w = rng.normal(size=(8, 4)), rng.integers(0, 3, 8), rng.uniform(0.2, 3, 8)
    masks = mlp.dropout_masks(np.arange(8), sizes, 0.4, 7, 3) if masked else None
    g, _ = mlp.gradients(layers, x, y, w, masks)
    for a, da in zip(layers, g):
        for at in list(np.ndindex(a.shape))[::3]:
            old, e = a[at], 1e-6
            a[at] = old + e
            up = mlp.gradients(layers, x, y, w, masks)[1]
            a[at] = old - e
            down = mlp.gradients(layers, x, y, w, masks)[1]
            a[at] = old
            assert da[at] == pytest.approx((up - down) / (2 * e), abs=1e-5)


def test_dropout_masks_are_fair_and_keyed():
    a, b = mlp.dropout_masks(np.arange(4000), [3, 50, 2], 0.3, 1, 0), mlp.dropout_masks(np.arange(4000), [3, 50, 2], 0.3, 1, 1)
    assert a[0].shape == (4000, 50) and set(np.unique(a[0]).round(6)) == {0, round(1 / 0.7, 6)}
    assert abs((a[0] > 0).mean() - 0.7) < 0.01 and abs(np.corrcoef(a[0].ravel(), b[0].ravel())[0, 1]) < 0.02
    assert (mlp.dropout_masks(np.array([17]), [3, 50, 2], 0.3, 1, 0)[0] == a[0][17]).all()


def test_unit_weights_are_no_weights_on_any_partitioning(spark):
    kw = dict(hidden=[6], features="x", epochs=2, batches=2, dropout=0.2)
    a = mlp.train_weighted_mlp(frame(spark, parts=1), **kw)
    b = mlp.train_weighted_mlp(frame(spark, parts=5, weights=[1, 1, 1]), weight="w", **kw)
    assert all(np.allclose(u, v, atol=1e-9) for u, v in zip(a.layers, b.layers)) and a.history == pytest.approx(b.history)
    heavy = mlp.train_weighted_mlp(frame(spark, weights=[1, 1, 9]), weight="w", **kw)
    assert not np.allclose(heavy.layers[0], a.layers[0], atol=1e-3)


def test_weights_equal_repeated_rows(spark):
    df = frame(spark, 40, weights=[1, 2, 3])
    again = df.selectExpr("vec_id", "label", "x", "explode(sequence(1, CAST(w AS INT))) AS k")
    kw = dict(hidden=[4], features="x", epochs=2, batches=1, validation=0.0)
    a, b = mlp.train_weighted_mlp(df, weight="w", **kw), mlp.train_weighted_mlp(again, **kw)
    assert all(np.allclose(u, v, atol=1e-9) for u, v in zip(a.layers, b.layers))


def test_learns_stops_early_and_scores_odd_rows(spark):
    df = frame(spark)
    model = mlp.train_weighted_mlp(df.unionByName(df.selectExpr("vec_id", "CAST(NULL AS INT) AS label", "x", "w").limit(3)), [8], "x", epochs=40, batches=1, rate=0.1, patience=6, validation=0.2)
    assert len(model.history) <= 40 and model.history[-1] >= min(model.history)
    if len(model.history) < 40:
        assert int(np.argmin(model.history)) == len(model.history) - 7
    odd = df.unionByName(spark.createDataFrame([(900, 4, None, 1.0), (901, None, [float("nan")] * 5, None)], df.schema))
    out = model.transform(odd).select("vec_id", "label", "prediction", vector_to_array("probability").alias("p")).collect()
    assert len(out) == 92 and all(sum(r.p) == pytest.approx(1) and r.prediction in (4, 5, 6) for r in out)
    assert np.mean([r.label == r.prediction for r in out if r.vec_id < 900]) > 0.9
    with pytest.raises(ValueError):
        mlp.train_weighted_mlp(df.limit(0), [4], "x")
