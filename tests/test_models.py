"""Invariants of the model jobs (rows-only in the oracle check)."""

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import models as MD


def _data(spark, n=120, d=6, k=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = i % k
        rows.append((i, y, [float(x) for x in rng.normal(size=d) + 2.5 * y]))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return MD.with_features(df, "embedding")


def test_logreg_probabilities_and_labels(spark):
    df = MD.with_class_weights(_data(spark))
    p = MD.predict(MD.train_logreg(df, weight="weight", max_iter=50), df)
    for r in p.collect():
        assert math.isclose(sum(r.probability), 1.0, rel_tol=1e-9) and r.prediction in (0, 1, 2)
    acc = p.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert acc > 0.8                                   # well separated classes


def test_aggregate_naive_bayes_agrees_with_mllib(spark):
    df = _data(spark)
    mine = MD.gaussian_nb_predict(MD.gaussian_nb_fit(df, "embedding"), df, "embedding")
    ml = MD.predict(MD.train_gaussian_nb(df), df)
    j = mine.select("vec_id", F.col("prediction").alias("a")).join(ml.select("vec_id", F.col("prediction").alias("b")), "vec_id")
    agree = j.agg(F.avg((F.col("a") == F.col("b")).cast("double"))).first()[0]
    assert agree > 0.95


def test_samme_and_one_vs_one(spark):
    df = _data(spark)
    m = MD.train_adaboost(df, rounds=5, depth=2)
    out = m.transform(df.withColumn("_row", F.col("vec_id")))
    assert out.count() == 120 and {r.prediction for r in out.select("prediction").distinct().collect()} <= {0, 1, 2}
    o = MD.one_vs_one(df, lambda: LogisticRegression(maxIter=20)).transform(df)
    assert o.count() == 120


def test_rff_and_pca_shapes(spark):
    df = _data(spark)
    r = MD.rff_features(df.drop("features"), "embedding", 6, n_features=32, gamma=0.5)
    assert r.select(F.size(vector_to_array("features"))).first()[0] == 32
    tr, te, _ = MD.pca(df, df, k=2)
    assert te.select(F.size(vector_to_array("pca"))).first()[0] == 2


def test_replicate_by_weight(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0)], "id int, weight double")
    assert sorted(r.id for r in MD.replicate_by_weight(df).collect()) == [1, 2, 2, 2]


def test_glove_gives_every_word_a_vector_over_all_passes(spark, monkeypatch):
    from tessera.plans import model_queries as Q
    seen = []
    fit = MD.train_word2vec
    monkeypatch.setattr(MD, "train_word2vec", lambda *a, **k: seen.append(k) or fit(*a, **k))
    toks = spark.createDataFrame([(1, ["once", "many", "many"]), (2, ["many", "twice", "twice"])], "doc_id int, tokens array<string>")
    monkeypatch.setattr(Q, "clean_tokens", lambda *a: toks)
    got = {r.word: r.dim for r in Q.train_glove_surveyed(spark, "").collect()}
    assert got == {"once": 100, "twice": 100, "many": 100}
    assert {r.word: r.dim for r in Q.train_glove_like(spark, "").collect()} == {"many": 300}
    assert [(k["size"], k["window"], k["min_count"], k["epochs"]) for k in seen] == [(100, 5, 1, 15), (300, 5, 3, 15)]


def test_boosted_has_the_reference_rounds_and_depth(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(MD.OneVsRest, "fit", lambda self, df: seen.append((self.getClassifier().getMaxIter(), self.getClassifier().getMaxDepth())))
    MD.train_boosted(None)
    assert seen == [(100, 6)]


def test_long_search_and_all_estimators(spark, monkeypatch):
    from tessera.plans import model_queries as Q
    assert Q._LONG_GRID["maxIter"] == [20, 50, 100]
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, i % 3, [float(x) for x in rng.normal(size=64) + 2.5 * (i % 3)]) for i in range(90)],
                               "vec_id long, label int, embedding array<double>")
    df = MD.with_features(df, "embedding")
    kinds = {"logreg": Q._ESTIMATORS["logreg"], "knn": Q._fit_knn, "svm": Q._fit_rbf_svm}
    got = {(r.model, r.split): r for r in MD.compare_estimators(df.where("vec_id < 60"), df.where("vec_id >= 60"), kinds).collect()}
    assert set(got) == {(m, s) for m in kinds for s in ("train", "test")}
    best = got["logreg", "test"]
    assert best.accuracy == best.macro_precision == best.macro_recall == best.macro_f1 == best.kappa == best.macro_auc == 1.0
    assert got["knn", "test"].macro_recall == 1.0 and got["knn", "test"].macro_auc is None
