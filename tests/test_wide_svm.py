"""The SVM in blocks of columns against MLlib's."""

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as Ty

from tessera.operators import models as MD
from tessera.operators import wide_svm as WS


def sparse(spark, n=240, d=400, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rng.integers(0, 3))
        at = np.unique(np.r_[rng.integers(0, d, 12), y * 5 + rng.integers(0, 8, 3)])
        rows.append((i % 200, y, Vectors.sparse(d, at.tolist(), rng.random(len(at)).tolist()), float(1 + i % 3)))
    schema = Ty.StructType([Ty.StructField("vec_id", Ty.LongType()), Ty.StructField("label", Ty.IntegerType()),
                            Ty.StructField("features", VectorUDT()), Ty.StructField("w", Ty.DoubleType())])
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def test_blocks_of_columns_find_mllibs_classes_and_keep_no_vector_in_the_driver(spark, monkeypatch):
    df = sparse(spark)
    want = MD.train_linear_svm(df, weight="w")
    expected = sorted((r.vec_id, r.label, r.prediction) for r in MD.predict(want, df).collect())
    for module, name, value in ((MD, "WIDE", 100), (WS, "BLOCK_COLUMNS", 90), (WS, "CHUNK_BITS", 6), (WS, "CUT", 2), (LinearSVC, "fit", None)):
        monkeypatch.setattr(module, name, value)
    model = MD.train_linear_svm(df, max_iter=6, weight="w")
    assert model.blocks == 5 and not isinstance(model.coefficients, np.ndarray)
    out = model.transform(df).collect()
    assert len(out) == 240 and all(r.prediction == int(np.argmax(r.rawPrediction.toArray())) for r in out)
    got = sorted((r.vec_id, r.label, int(r.prediction)) for r in out)
    assert sum(a == b for a, b in zip(got, expected)) >= 230
    assert MD.predict(model, df.where("vec_id < 10")).count() == df.where("vec_id < 10").count()


def test_direction_is_that_of_the_two_loops():
    rng = np.random.default_rng(0)
    s, y, g = rng.normal(size=(3, 6)), None, rng.normal(size=6)
    y = s @ (np.eye(6) * 2 + 0.1) + 0.01 * rng.normal(size=(3, 6))
    d, used = g.copy(), []
    for a, b in zip(s, y):
        used.append(a @ d / (a @ b))
        d -= used[-1] * b
    d *= s[0] @ y[0] / (y[0] @ y[0])
    for a, b, u in reversed(list(zip(s, y, used))):
        d += (u - b @ d / (a @ b)) * a
    base = np.vstack([s, y, g])
    assert np.allclose(WS._direction(base @ base.T, 3) @ base, -d)


def test_wide_rows_are_fitted_class_by_class(spark, monkeypatch):
    """Below WIDE columns MLlib fits as many classes at a time as the driver holds; the blocks of columns are for wider rows."""
    seen = []
    whole = MD.OneVsRest
    monkeypatch.setattr(MD, "OneVsRest", lambda **k: seen.append(k["parallelism"]) or whole(**k))
    for columns in (1000, 200_000, 600_000):
        df = spark.createDataFrame([(Vectors.sparse(columns, {i % 3: 1.0, columns - 1: 0.5}), i % 3) for i in range(12)], ["features", "label"])
        model = MD.train_linear_svm(df, max_iter=3)
        assert [r.prediction for r in model.transform(df).collect()] == [r.label for r in df.collect()]
    assert seen == [4, 2, 1]
