"""The registered fits on planted data: a fit that does not learn fails the held-out bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models as MD
from tessera.plans import model_queries as Q

BOUND = 0.85
FITS = ["train_logreg", "train_gaussian_nb", "train_tree", "train_forest", "train_adaboost", "train_rff_svm", "one_vs_one", "train_mlp"]


@pytest.fixture(scope="module")
def planted(spark):
    """Four classes around far corners of 64 dimensions, two thirds to train on, of unequal sizes."""
    rng = np.random.default_rng(4)
    middle = rng.choice([-1.0, 1.0], (4, 64)) * 0.25
    rows = []
    for i in range(240):
        y = (0, 1, 2, 3, 0, 1, 0, 2)[i % 8]
        rows.append((i, y, [float(v) for v in middle[y] + rng.normal(size=64) * 0.08], "test" if i // 8 % 3 == 0 else "train"))
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, split string").coalesce(2).cache()


def held_out(out):
    """(accuracy, mean recall) of a query's rows."""
    rows = out.collect()
    hit = {}
    for r in rows:
        hit.setdefault(r.label, []).append(r.prediction == r.label)
        if "probability" in out.columns:
            assert sum(r.probability) == pytest.approx(1) and min(r.probability) >= 0
            assert r.prediction == int(np.argmax(r.probability))
    assert len(rows) == 80 and set(hit) == {0, 1, 2, 3}
    return np.mean([np.mean(v) for v in hit.values()])


@pytest.mark.parametrize("name", FITS)
def test_fits_learn_what_is_planted(spark, planted, monkeypatch, name):
    monkeypatch.setattr(Q, "_split", lambda *a: planted)
    boost = MD.train_adaboost
    monkeypatch.setattr(MD, "train_adaboost", lambda df, rounds, **k: boost(df, rounds=8, **k))  # of 100: the rest repeats them
    out = getattr(Q, name)(spark, "")
    assert out.columns[:3] == ["vec_id", "label", "prediction"]
    assert held_out(out) > BOUND


def test_a_broken_fit_misses_the_bound(spark, planted, monkeypatch):
    broken = planted.withColumn("label", F.when(F.col("split") == "train", (F.col("label") + 1) % 4).otherwise(F.col("label")).cast("int"))
    monkeypatch.setattr(Q, "_split", lambda *a: broken)
    assert held_out(Q.train_logreg(spark, "")) < 0.2
    constant = planted.withColumn("embedding", F.array_repeat(F.lit(0.0), 64))
    monkeypatch.setattr(Q, "_split", lambda *a: constant)
    assert held_out(Q.train_tree(spark, "")) < 0.5


def test_searches_return_their_scores(spark, planted, monkeypatch):
    monkeypatch.setattr(Q, "_split", lambda *a: planted)
    monkeypatch.setattr(Q, "_GRID", {"regParam": [0.01, 1e6]})
    got = {r.params: r.mean_f1 for r in Q.grid_search(spark, "").collect()}
    assert len(got) == 2 and got[Q._params({"regParam": 0.01})] > BOUND > 0.5 > got[Q._params({"regParam": 1e6})]
    folds = Q.cross_val_score(spark, "").collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2, 3, 4] and min(r.macro_f1 for r in folds) > BOUND


@pytest.mark.parametrize("k", [50, 64])
def test_pca_equals_the_covariance_eigenvectors(spark, planted, k):
    rows = planted.collect()
    x = {s: np.array([r.embedding for r in rows if r.split == s]) for s in ("train", "test")}
    values, vectors = np.linalg.eigh(np.cov(x["train"].T))
    want = ((x["test"] - x["train"].mean(axis=0)) @ vectors[:, ::-1][:, :k])
    df = MD.with_features(planted, "embedding")
    _, out, model = MD.pca(df.where("split = 'train'"), df.where("split = 'test'"), k=k)
    got = np.array([r.pca.toArray() for r in out.orderBy("vec_id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-6)
    assert model.stages[-1].explainedVariance.toArray().sum() == pytest.approx(values[::-1][:k].sum() / values.sum())


def test_pca_query_keeps_fifty_components(spark, planted, monkeypatch):
    monkeypatch.setattr(Q, "_split", lambda *a: planted)
    rows = Q.pca(spark, "").collect()
    assert len(rows) == 80 and {r.k for r in rows} == {50} and 0.9 < rows[0].explained < 1


def test_naive_bayes_equals_its_sql(spark, tmp_path):
    """The whole result: predictions, probabilities and facts, on a table of its own."""
    duckdb = pytest.importorskip("duckdb")
    from tessera.plans import catalog
    rng = np.random.default_rng(9)
    rows = [(i, i % 10, (rng.normal(size=5) + i % 10 / 4).tolist()) for i in range(150)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = catalog.QUERIES["train_gaussian_nb"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    cur = con.execute(catalog.ORACLES["train_gaussian_nb"])
    names = [c[0] for c in cur.description]
    want = {r["vec_id"]: r for r in (dict(zip(names, x)) for x in cur.fetchall())}
    assert out.columns == names and len(want) == 30
    for r in out.collect():
        one = want.pop(r.vec_id)
        assert r.probability == pytest.approx(one.pop("probability"), abs=1e-9)
        assert {k: r[k] for k in one} == one
    assert not want


@pytest.mark.parametrize("name", ["train_boosted", "train_mlp"])
def test_fits_return_the_facts_of_the_first_sql_beside_their_predictions(spark, planted, monkeypatch, name):
    monkeypatch.setattr(Q, "_split", lambda *a: planted)
    boost, mlp = MD.train_boosted, MD.train_mlp
    monkeypatch.setattr(MD, "train_boosted", lambda df, **k: boost(df, max_iter=3, max_depth=3, **k))
    monkeypatch.setattr(MD, "train_mlp", lambda df, layers, **k: mlp(df, layers, max_iter=20, **k))
    out = getattr(Q, name)(spark, "").cache()
    assert held_out(out) > BOUND
    assert {(r.known_class, r.proper_probability, r.above_chance) for r in out.collect()} == {(True, True, True)}
