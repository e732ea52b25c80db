"""TensorSketch against the kernel it estimates, class weights, mergeable length sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models as MD
from tessera.operators import vocab as V


def test_tensor_sketch_inner_products():
    """Unbiased over seeds, and within the stated variance."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 8)) * 0.4
    kernel = (0.7 * x @ x.T + 0.5) ** 5
    size = (0.7 * (x ** 2).sum(1) + 0.5) ** 5
    bound = np.sqrt((3 ** 5 - 1) / 2048 * np.outer(size, size))
    got = np.stack([(lambda z: z @ z.T)(MD.tensor_sketch(8, 5, 2048, 0.7, 0.5, seed)(x)) for seed in range(60)])
    assert (np.sqrt(((got - kernel) ** 2).mean(axis=0)) <= 1.3 * bound).all()
    assert (np.abs(got.mean(axis=0) - kernel) <= 4 * bound / np.sqrt(60)).all()
    one = MD.tensor_sketch(8, 1, 4096, 1.0, 0.0, 3)(x)
    assert one @ one.T == pytest.approx(x @ x.T, abs=0.2)


def test_poly_svm_learns_what_a_line_cannot_and_weights_count(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (300, 2))
    y = ((x[:, 0] * x[:, 1] > 0.03) ^ (rng.random(300) < 0.1)).astype(int)  # quadrants, a tenth of the labels wrong
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist(), 4.0 if y[i] else 1.0) for i in range(300)], "vec_id long, label int, v array<double>, w double")
    f = MD.poly_features(df, "v", 2, degree=2, n_features=64, gamma=1.0, coef0=1.0).coalesce(1).cache()

    def predicted(d, **kw):
        return [(r.label, r.prediction) for r in MD.predict(MD.train_poly_svm(d, max_iter=25, **kw), d).collect()]
    plain, line, heavy = predicted(f), predicted(MD.with_features(df, "v").coalesce(1).cache()), predicted(f, weight="w")
    right = [np.mean([a == b for a, b in p]) for p in (plain, line)]
    assert right[0] > 0.85 and right[0] > right[1] + 0.1
    assert sum(p == (1, 0) for p in heavy) < sum(p == (1, 0) for p in plain)
    assert sum(b for _, b in heavy) > sum(b for _, b in plain)
    none = MD.poly_features(spark.createDataFrame([(1, None)], "vec_id long, v array<double>"), "v", 2)
    assert none.first().features is None


def test_merged_sketches_equal_one_pass_within_the_rank_error(spark):
    n, k = 60_000, 200
    df = spark.range(n).select(F.col("id"), (F.col("id") % 97).alias("part"), ((F.col("id") * 7919) % n).alias("length"))
    parts = V.length_sketches(df, ["part"], k=k)
    assert parts.count() == 97
    one = V.merged_length_stats(V.length_sketches(df, [], k=k), k=k).first()
    merged = V.merged_length_stats(parts, k=k).first()
    error = 2.3 / k ** 0.9 * 1.5
    for name, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)):
        assert abs(merged[name] / n - p) < error and abs(one[name] / n - p) < error
    assert merged.n_rows == one.n_rows == n


def test_small_sketches_are_exact_and_empty_ones_null(spark):
    df = spark.createDataFrame([(s, v) for s, v in [("a", 3), ("a", 1), ("b", 9), ("b", None), ("c", 4)]], "part string, length int")
    r = V.merged_length_stats(V.length_sketches(df, ["part"])).first()
    assert (r.n_rows, r.p50, r.p99) == (4, 3, 9)
    assert [x.n_rows for x in V.merged_length_stats(V.length_sketches(df, ["part"]), ["part"]).orderBy("part").collect()] == [2, 1, 1]
    empty = V.merged_length_stats(V.length_sketches(df.limit(0), [])).collect()
    assert all(x.p50 is None for x in empty)
