"""Evolution of cost weights: rises, resumes, feeds the run-log operators."""

import numpy as np
import pytest

from tessera.operators import evolution as EV
from tessera.operators.metrics import search_cost_weights
from tessera.operators.runs import resume_population


@pytest.fixture(scope="module")
def preds(spark):
    """Class 2 is rare and its probability is systematically too low: weights can mend that."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        y = 2 if i % 15 == 0 else i % 2
        p = rng.dirichlet([1, 1, 1]) * 0.6
        p[y] += 0.4
        p[2] *= 0.4
        rows.append((i, y, (p / p.sum()).tolist()))
    return spark.createDataFrame(rows, "id long, label int, probability array<double>").cache()


def rows_of(df):
    return {(r.generation, r.member): (tuple(r.weights), r.f1, r.accepted) for r in df.collect()}


def test_trials_follow_the_law():
    pop = np.random.default_rng(0).random((6, 4))
    f1 = np.arange(6) / 10
    t = EV.trials(pop, f1, 3, 1)
    assert (t == EV.trials(pop, f1, 3, 1)).all() and not (t == EV.trials(pop, f1, 3, 2)).all()
    assert ((t >= 0) & (t <= 1)).all() and (t != pop).any(axis=1).all()
    kept = EV.trials(pop, f1, 3, 1, crossover=0.0) != pop
    assert (kept.sum(axis=1) == 1).all()  # one entry always comes from the mutant


def test_best_never_falls_and_scores_are_true(spark, preds, tmp_path):
    out = EV.evolve_cost_weights(preds, str(tmp_path / "a"), members=6, most=5, seed=2)
    got = rows_of(out)
    best = [max(got[g, m][1] for m in range(6)) for g in range(6)]
    assert best == sorted(best)
    assert sum(got[5, m][1] for m in range(6)) > sum(got[0, m][1] for m in range(6))
    for m in range(6):
        each = [got[g, m][1] for g in range(6)]
        assert each == sorted(each)
    last = [list(got[5, m][0]) for m in range(6)]
    again = {r.candidate: r.macro_f1 for r in search_cost_weights(preds, last, 6).collect()}
    assert all(again[m] == pytest.approx(got[5, m][1], abs=1e-11) for m in range(6))


def test_stopped_and_resumed_equals_unbroken(spark, preds, tmp_path):
    whole = rows_of(EV.evolve_cost_weights(preds, str(tmp_path / "w"), members=5, most=4, seed=9, tol=0))
    path = str(tmp_path / "p")
    EV.evolve_cost_weights(preds, path, members=5, most=1, seed=9, tol=0)
    torn = tmp_path / "p" / "generation=000002"  # a generation whose job died before its marker
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"half")
    assert EV.last_generation(spark, path) == 1
    assert rows_of(EV.evolve_cost_weights(preds, path, members=5, most=4, seed=9, tol=0)) == whole


def test_best_members_start_a_new_search(spark, preds, tmp_path):
    first = EV.evolve_cost_weights(preds, str(tmp_path / "1"), members=5, most=2, seed=1, tol=0)
    top = resume_population([first], 4).collect()
    second = EV.evolve_cost_weights(preds, str(tmp_path / "2"), most=1, seed=5, tol=0, population=[list(r.weights) for r in top])
    start = {r.member: r.f1 for r in second.where("generation = 0").collect()}
    assert [start[i] for i in range(4)] == [r.f1 for r in top]
    with pytest.raises(ValueError):
        EV.evolve_cost_weights(preds, str(tmp_path / "3"), members=2)
