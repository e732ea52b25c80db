"""Differential evolution of class cost weights (M18): best/1/bin with dithered mutation.

A generation is one Spark job: every trial vector is scored on all stored probabilities at once.
The population (members x classes numbers) is a parameter table of bounded size; every generation is written as its own folder of ``path`` and counts once its
commit marker (``_SUCCESS``) is there. A search that was stopped goes on from the last one and ends
as an unbroken search would: all draws depend on (seed, generation) only.

The written table has the columns of a trial log (``index``, ``f1``), so ``runs.best_so_far`` and
``runs.resume_population`` read it; the best members of earlier searches start a new one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.indexing import materialize
from tessera.operators.metrics import cost_weight_candidates

SCHEMA = "index long, member int, weights array<double>, f1 double, accepted boolean"


def scores(preds: DataFrame, candidates: list[list[float]], label: str, prob: str) -> list[float]:
    """Macro-F1 of every candidate's argmax(weight * probability), one job: tasks count (candidate,
    label, prediction) with one matrix product per batch, and only those counts are shuffled."""
    w = np.array(candidates, float)
    m, k = w.shape

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            y, p = pdf[label].to_numpy(), np.stack(pdf[prob]).astype(float) if len(pdf) else np.zeros((0, k))
            for c in range(m):
                won = np.argmax(p * w[c], axis=1)
                for v in np.unique(y).tolist():
                    cells = held.setdefault(v, np.zeros((m, k), np.int64))
                    cells[c] += np.bincount(won[y == v], minlength=k)
        for v, cells in held.items():
            c, g = np.nonzero(cells)
            yield pd.DataFrame({"candidate": c, "label": v, "prediction": g, "n": cells[c, g]})

    rows = preds.where(F.col(label).isNotNull()).select(label, prob).mapInPandas(count, "candidate int, label int, prediction int, n long")
    rows = rows.groupBy("candidate", "label", "prediction").agg(F.sum("n").alias("n")).collect()  # candidates * classes**2 at most
    counts: dict[int, dict] = {c: {} for c in range(m)}
    for r in rows:
        counts[r.candidate][r.label, r.prediction] = r.n
    return [macro_f1(counts[c]) for c in range(m)]


def macro_f1(pairs: dict[tuple[int, int], int]) -> float:
    """Mean F1 over the classes that occur as label or prediction, from pair counts."""
    classes = sorted({c for pair in pairs for c in pair})
    f1 = [2 * pairs.get((c, c), 0) / sum(n * ((a == c) + (b == c)) for (a, b), n in pairs.items()) for c in classes]
    return sum(f1) / len(f1) if f1 else 0.0


def trials(population: np.ndarray, f1: np.ndarray, seed: int, generation: int, mutation=(0.5, 1.0), crossover: float = 0.7) -> np.ndarray:
    """One trial vector per member: the best member plus a scaled difference of two others, crossed
    with the member; entries outside [0, 1] are drawn anew."""
    rng = np.random.default_rng([seed, generation])
    n, k = population.shape
    best = population[int(np.argmax(f1))]
    scale = rng.uniform(*mutation)
    out = population.copy()
    for i in range(n):
        a, b = rng.choice([j for j in range(n) if j != i], 2, replace=False)
        mutant = best + scale * (population[a] - population[b])
        outside = (mutant < 0) | (mutant > 1)
        mutant = np.where(outside, rng.random(k), mutant)
        cross = rng.random(k) < crossover
        cross[rng.integers(k)] = True
        out[i] = np.where(cross, mutant, population[i])
    return out


def _folder(path: str, generation: int) -> str:
    return f"{path.rstrip('/')}/generation={generation:06d}"


def last_generation(spark: SparkSession, path: str) -> int:
    """The last committed generation below ``path``; -1 for none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    g = -1
    while fs.exists(spark._jvm.org.apache.hadoop.fs.Path(_folder(path, g + 1) + "/_SUCCESS")):
        g += 1
    return g


def _write(spark, path, generation, population, f1, accepted) -> None:
    n = len(population)
    rows = [(generation * n + i, i, [float(x) for x in population[i]], float(f1[i]), bool(accepted[i])) for i in range(n)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(_folder(path, generation))


def generations(spark: SparkSession, path: str) -> DataFrame:
    """(generation, index, member, weights, f1, accepted) of all committed generations."""
    last = last_generation(spark, path)
    if last < 0:
        return spark.createDataFrame([], "generation int, " + SCHEMA)
    folders = [_folder(path, g) for g in range(last + 1)]
    return spark.read.option("basePath", path).schema(SCHEMA + ", generation int").parquet(*folders).select("generation", "index", "member", "weights", "f1", "accepted")


def evolve_cost_weights(preds: DataFrame, path: str, members: int = 12, most: int = 50, seed: int = 42, label: str = "label", prob: str = "probability",
                        tol: float = 1e-4, mutation=(0.5, 1.0), crossover: float = 0.7, population: list[list[float]] | None = None) -> DataFrame:
    """Search until ``most`` generations are written or the members' scores agree (deviation <= tol * mean).

    Generation 0 is ``population`` (e.g. the best of earlier searches), else the balanced-weight
    candidates of M18. A member is replaced by its trial if that scores no worse, so the best F1 never
    falls. Needs 3 members or more. Returns ``generations``; rows with a null label score nothing.
    """
    if (len(population) if population else members) < 3:
        raise ValueError("differential evolution needs at least 3 members")
    spark = preds.sparkSession
    at = last_generation(spark, path)
    preds = materialize(preds.select(label, prob))  # every generation reads it
    if at < 0:
        start = np.array(population or cost_weight_candidates(preds, members, seed, label), float)
        _write(spark, path, 0, start, scores(preds, start.tolist(), label, prob), [True] * len(start))
        at = 0
    rows = generations(spark, path).where(F.col("generation") == at).orderBy("member").collect()
    now, f1 = np.array([r.weights for r in rows], float), np.array([r.f1 for r in rows])
    while at < most and not f1.std() <= tol * abs(f1.mean()):
        at += 1
        tried = trials(now, f1, seed, at, mutation, crossover)
        got = np.array(scores(preds, tried.tolist(), label, prob))
        better = got >= f1
        now, f1 = np.where(better[:, None], tried, now), np.where(better, got, f1)
        _write(spark, path, at, now, f1, better)
    return generations(spark, path)
