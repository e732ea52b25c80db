"""Feed-forward net with a class-weighted loss, dropout and early stopping.

Data-parallel: the rows stay where they are, each step is one job in which tasks add up the
gradients of their rows of one batch in numpy, and one sum per parameter comes to the driver (the
net's size, whatever the number of rows). The loss is sum(w * cross-entropy) / sum(w), so weights
scale gradients; no row is repeated.

Batches, the validation part and the dropout masks are hashes of (seed, row id, step), so a fit is
the same on any partitioning and after any retry, up to the order of summation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.boosting import _array, matrix
from tessera.operators.indexing import materialize, unit_uniform


def start_layers(sizes: list[int], seed: int) -> list[np.ndarray]:
    """[W1, b1, W2, b2, ...], uniform weights scaled by fan-in and fan-out, zero biases."""
    rng = np.random.default_rng([seed, 5])
    out = []
    for a, b in zip(sizes, sizes[1:]):
        limit = np.sqrt(6 / (a + b))
        out += [rng.uniform(-limit, limit, (a, b)), np.zeros(b)]
    return out


def uniform(ids: np.ndarray, units: int, key: int) -> np.ndarray:
    """(rows, units) numbers in [0, 1) that depend on row id, unit and ``key`` only."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, units + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        x += np.uint64(key) * np.uint64(0x165667B19E3779F9)
        for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    return (x >> np.uint64(11)) / float(1 << 53)


def forward(layers: list[np.ndarray], x: np.ndarray, masks=None) -> tuple[np.ndarray, list[np.ndarray]]:
    """(probabilities, inputs of every layer). Hidden layers are rectified, then multiplied by ``masks``."""
    seen = [x]
    depth = len(layers) // 2
    for i in range(depth):
        x = x @ layers[2 * i] + layers[2 * i + 1]
        if i < depth - 1:
            x = np.maximum(x, 0)
            if masks is not None:
                x = x * masks[i]
            seen.append(x)
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True), seen


def gradients(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray, w: np.ndarray, masks=None) -> tuple[list[np.ndarray], float]:
    """Sums over rows: gradient of w * cross-entropy by every parameter, and the loss itself."""
    p, seen = forward(layers, x, masks)
    at = np.arange(len(y))
    loss = float(-(w * np.log(np.maximum(p[at, y], 1e-300))).sum())
    delta = p * w[:, None]
    delta[at, y] -= w
    out: list[np.ndarray] = []
    for i in reversed(range(len(layers) // 2)):
        out = [seen[i].T @ delta, delta.sum(axis=0)] + out
        if i:
            delta = delta @ layers[2 * i].T * (seen[i] > 0)
            if masks is not None:
                delta = delta * masks[i - 1]
    return out, loss


def dropout_masks(ids: np.ndarray, sizes: list[int], dropout: float, seed: int, step: int) -> list[np.ndarray]:
    """Which hidden units stay, scaled so that the expected activation is unchanged."""
    return [(uniform(ids, n, (seed * 1_000_003 + step) * 64 + i) >= dropout) / (1 - dropout) for i, n in enumerate(sizes[1:-1])]


def _sums(rows: DataFrame, layers, sizes, dropout: float, seed: int, step: int, want_gradient: bool) -> tuple[np.ndarray, float, float]:
    """(flat gradient sum, loss sum, weight sum) over ``rows`` (id, x, y, w): one job."""
    count = sum(v.size for v in layers) if want_gradient else 0
    shared = rows.sparkSession.sparkContext.broadcast(layers)  # the net

    def part(batches):
        total = np.zeros(count + 2)
        some = False
        for pdf in batches:
            if not len(pdf):
                continue
            some = True
            x, y, w = np.nan_to_num(matrix(pdf["x"], sizes[0])), pdf["y"].to_numpy(), pdf["w"].to_numpy(float)
            masks = dropout_masks(pdf["id"].to_numpy(np.int64), sizes, dropout, seed, step) if dropout and want_gradient else None
            g, loss = gradients(shared.value, x, y, w, masks)
            if want_gradient:
                total[:count] += np.concatenate([v.ravel() for v in g])
            total[count:] += loss, w.sum()
        if some:
            yield pd.DataFrame({"cell": np.arange(count + 2), "v": total})

    out = np.zeros(count + 2)
    for r in rows.mapInPandas(part, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # one row a parameter
        out[r.cell] = r.v
    return out[:count], out[count], out[count + 1]


class WeightedMlp:
    """The fitted net; ``transform`` adds ``prediction`` (class) and ``probability``. ``history`` has the
    loss on the validation part after every pass."""

    def __init__(self, layers, classes, features, sizes, history):
        self.layers, self.classes, self.features, self.sizes, self.history = layers, classes, features, sizes, history

    def transform(self, df: DataFrame) -> DataFrame:
        m = self  # the net goes with the task
        classes = F.array(*[F.lit(int(c)) for c in self.classes])

        @F.pandas_udf("array<double>")
        def score(v: pd.Series) -> pd.Series:
            return pd.Series(list(forward(m.layers, np.nan_to_num(matrix(v, m.sizes[0])))[0]))

        out = df.withColumn("_p", score(_array(df, self.features)))
        best = F.array_position("_p", F.array_max("_p")).cast("int")
        return out.withColumn("prediction", F.element_at(classes, best)).withColumn("probability", array_to_vector("_p")).drop("_p")


def train_weighted_mlp(df: DataFrame, hidden: list[int], features: str = "features", label: str = "label", id_col: str = "vec_id", weight: str | None = None,
                       epochs: int = 50, batches: int = 4, rate: float = 1e-2, dropout: float = 0.0, validation: float = 0.1, patience: int = 5,
                       seed: int = 42) -> WeightedMlp:
    """Adam on the weighted loss, ``batches`` steps a pass. A share of the rows (``validation``) is held out;
    the net of the pass with the least loss there is kept, and ``patience`` passes without a better one
    end the fit. Without held-out rows all passes run.

    Missing feature entries count as 0; null weights as 1; rows with a null label take no part; ids need
    not be unique (equal ids share their batch and dropout mask). Fails on a table without rows.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = df.where(F.col(label).isNotNull()).select(F.xxhash64(id_col).alias("id"), _array(df, features).alias("x"), F.col(label).alias("label"), w.alias("w"))
    classes = sorted(r.label for r in rows.select("label").distinct().collect())  # the label set: k values
    if not classes:
        raise ValueError("no rows to train on")
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")).cast("int") - 1
    held = unit_uniform("id", seed, "held-out") < validation
    rows = materialize(rows.select("id", "x", code.alias("y"), "w", held.alias("held"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(batches)).alias("batch")))
    sizes = [rows.agg(F.max(F.size("x"))).first()[0], *hidden, len(classes)]
    layers = start_layers(sizes, seed)
    shapes = [v.shape for v in layers]
    ends = np.cumsum([v.size for v in layers])[:-1]
    m, v = np.zeros(sum(x.size for x in layers)), np.zeros(sum(x.size for x in layers))
    best, history, step = (np.inf, layers), [], 0
    for _ in range(epochs):
        for b in range(batches):
            g, _, total = _sums(rows.where(~F.col("held") & (F.col("batch") == b)).select("id", "x", "y", "w"), layers, sizes, dropout, seed, step, True)
            step += 1
            if not total:
                continue
            g = g / total
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            layers = [a - d.reshape(s) for a, d, s in zip(layers, np.split(move, ends), shapes)]
        _, loss, total = _sums(rows.where("held").select("id", "x", "y", "w"), layers, sizes, 0.0, seed, step, False)
        if not total:
            best = (best[0], layers)
            continue
        history.append(loss / total)
        if history[-1] < best[0]:
            best = (history[-1], layers)
        if len(history) - 1 - int(np.argmin(history)) >= patience:
            break
    return WeightedMlp(best[1], classes, features, sizes, history)
