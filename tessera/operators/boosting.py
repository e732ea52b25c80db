"""Gradient-boosted trees with the softmax loss (M5): all classes' trees of a round grow together.

* Bins: each feature is cut at approximate quantiles (Spark's mergeable percentile sketch, one pass
  over the rows); a row keeps one byte per feature. The binned table is written once.
* A level is one job. Tasks add up gradient and hessian per (class, node, feature, bin) of their
  rows in numpy and send one row of sums per (class, node, feature) to the part of its feature; there
  running sums over the bins give the gain of every split. The best split of each node in each part is
  all that comes to the driver (at most ``MOST_PARTS`` a node). K trees of a round share the job.
* Rows are never moved: a task recomputes its rows' margins from the trees grown since the margins
  were last written (every ``REFRESH`` rounds) and walks the unfinished trees.

Second-order gain as in the published method (Chen and Guestrin 2016):
1/2 (GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)) - gamma, leaf value -eta G/(H+l).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.indexing import materialize

REFRESH = 10
ACCURACY = 10_000        # of the quantile sketch: rank error n / ACCURACY
AT_ONCE = 256            # features whose sketches one pass holds
MOST_PARTS = 1024        # groups of features a level's sums are dealt into


def cuts_of(df: DataFrame, features: str, d: int, bins: int) -> list[np.ndarray]:
    """Upper borders of each feature's bins but the last, rising. NaN and null count as smaller than all."""
    probs = [i / bins for i in range(1, bins)]
    out = []
    for lo in range(0, d, AT_ONCE):
        some = range(lo, min(lo + AT_ONCE, d))
        values = [F.nanvl(F.element_at(features, i + 1).cast("double"), F.lit(None).cast("double")) for i in some]
        row = df.agg(*[F.percentile_approx(v, probs, ACCURACY).alias(f"c{i}") for i, v in zip(some, values)]).first()
        out += [np.unique(np.array(row[f"c{i}"] or [], float)) for i in some]
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers (rows, features) as bytes: how many cuts lie below the value."""
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, np.where(np.isnan(x[:, j]), -np.inf, x[:, j]), "left")
    return out


def matrix(column: pd.Series, d: int) -> np.ndarray:
    """Rows of doubles; a missing entry or row is NaN."""
    out = np.full((len(column), d), np.nan)
    for i, v in enumerate(column):
        if v is not None:
            out[i, :] = np.asarray(v, float)[:d]
    return out


class Tree:
    """Nodes as arrays; ``feature`` -1 marks a leaf."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.value = [-1], [0], [0], [0], [0.0]

    def split(self, node: int, feature: int, b: int) -> tuple[int, int]:
        self.feature[node], self.bin[node] = feature, b
        made = len(self.feature), len(self.feature) + 1
        self.left[node], self.right[node] = made
        for part, v in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            part += [v, v]
        return made

    def at(self, x: np.ndarray) -> np.ndarray:
        """Leaf or unfinished node of every binned row."""
        feature, b, left, right = (np.array(v) for v in (self.feature, self.bin, self.left, self.right))
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(feature[node] >= 0)
            if not len(inner):
                return node
            n = node[inner]
            node[inner] = np.where(x[inner, feature[n]] <= b[n], left[n], right[n])


def add_margins(margins: np.ndarray, x: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    for trees in rounds:
        for k, t in enumerate(trees):
            margins[:, k] += np.array(t.value)[t.at(x)]
    return margins


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def derivatives(margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and (doubled diagonal) hessian of the weighted softmax loss, per row and class."""
    p = softmax(margins)
    g = p.copy()
    g[np.arange(len(label)), label] -= 1
    return g * weight[:, None], np.maximum(2 * p * (1 - p), 1e-16) * weight[:, None]


def histograms(table: DataFrame, d: int, bins: int, classes: int, since: list[list[Tree]], growing: list[Tree], active: list[list[int]], parts: int) -> DataFrame:
    """(part, class, node, feature, g, h): one row a task, ``active`` node and feature with the sums
    over the task's rows, ``bins`` doubles each. ``part`` deals out features, at most ``parts`` of them."""
    slots = []
    for k in range(classes):
        slot = np.full(len(growing[k].feature), -1, np.int64)
        slot[active[k]] = np.arange(len(active[k]))
        slots.append(slot)
    schema = pa.schema([("part", pa.int32()), ("class", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("g", pa.binary()), ("h", pa.binary())])

    def sums(batches):
        held = [np.zeros((2, len(active[k]), d, bins)) for k in range(classes)]
        for batch in batches:
            if not batch.num_rows:
                continue
            pdf = batch.to_pandas()
            x = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(-1, d)
            margins = add_margins(np.stack(pdf["margins"]).astype(float), x, since)
            g, h = derivatives(margins, pdf["label"].to_numpy(), pdf["weight"].to_numpy(float))
            for k in range(classes):
                slot = slots[k][growing[k].at(x)]
                rows = np.flatnonzero(slot >= 0)
                if len(rows):
                    cell = ((slot[rows, None] * d + np.arange(d)) * bins + x[rows]).ravel()
                    for total, w in zip(held[k], (g, h)):
                        total += np.bincount(cell, np.repeat(w[rows, k], d), total.size).reshape(total.shape)
        for k in range(classes):
            node, feature = np.nonzero(held[k][1].any(axis=2))
            if len(node):
                g, h = (held[k][i][node, feature] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip((
                    (feature % parts).astype(np.int32), np.full(len(node), k, np.int32), np.array(active[k], np.int32)[node],
                    feature.astype(np.int32), [v.tobytes() for v in g], [v.tobytes() for v in h]), schema)], schema=schema)

    return table.select("bins", "margins", "label", "weight").mapInArrow(sums, "part int, class int, node int, feature int, g binary, h binary")


def split_gains(g: np.ndarray, h: np.ndarray, reg_lambda: float, gamma: float, min_child: float) -> np.ndarray:
    """Gain of each split ``bin <= b`` of histograms (.., bins); -inf where it is not allowed: a bin
    without rows or with none behind it, or a side whose hessian is below ``min_child``."""
    gl, hl = g.cumsum(axis=-1), h.cumsum(axis=-1)
    gt, ht = g.sum(axis=-1, keepdims=True), h.sum(axis=-1, keepdims=True)
    gr, hr = gt - gl, ht - hl
    behind = np.flip(np.flip(h > 0, -1).cumsum(axis=-1), -1) > 1

    def score(a, b):
        return a * a / np.maximum(b + reg_lambda, 1e-300)
    gain = 0.5 * (score(gl, hl) + score(gr, hr) - score(gt, ht)) - gamma
    return np.where((h > 0) & behind & (hl >= min_child) & (hr >= min_child), gain, -np.inf)


def best_splits(cells: DataFrame, reg_lambda: float, gamma: float, min_child: float) -> DataFrame:
    """(class, node, gain, feature, bin, gl, hl, g, h): the best split of each node in each part;
    gain -inf if the part has none. A part holds a row a task of its nodes and features."""
    by = ["class", "node", "feature"]
    schema = pa.schema([("class", pa.int32()), ("node", pa.int32()), ("gain", pa.float64()), ("feature", pa.int32()), ("bin", pa.int32())]
                       + [(c, pa.float64()) for c in ("gl", "hl", "g", "h")])

    def best(group: pa.Table) -> pa.Table:
        keys = np.stack([group.column(c).to_numpy() for c in by])
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        first = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        g, h = (np.add.reduceat(np.frombuffer(b"".join(group.column(c).to_pylist())).reshape(len(order), -1)[order], first, axis=0) for c in "gh")
        gain = np.round(split_gains(g, h, reg_lambda, gamma, min_child), 10)
        at = gain.argmax(axis=1)  # the smallest bin of the largest gain
        one = np.arange(len(at))
        rows = pd.DataFrame(keys[:, first].T, columns=by).assign(gain=gain[one, at], bin=at, gl=g.cumsum(axis=1)[one, at], hl=h.cumsum(axis=1)[one, at], g=g.sum(axis=1), h=h.sum(axis=1))
        rows = rows.sort_values(["class", "node", "gain", "feature"], ascending=[True, True, False, True]).drop_duplicates(["class", "node"])
        return pa.Table.from_arrays([pa.array(rows[f.name].to_numpy(), f.type) for f in schema], schema=schema)

    return cells.groupBy("part").applyInArrow(best, "class int, node int, gain double, feature int, bin int, gl double, hl double, g double, h double")


class SoftmaxBoosted:
    """The fitted trees; ``transform`` adds ``prediction`` (class code) and ``probability``."""

    def __init__(self, rounds, cuts, classes, base, features):
        self.rounds, self.cuts, self.classes, self.base, self.features = rounds, cuts, classes, base, features

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.cuts)
        return softmax(add_margins(np.tile(np.array(self.base, float), (len(b), 1)), b, self.rounds))

    def transform(self, df: DataFrame) -> DataFrame:
        m = self  # goes with the task: at most rounds * classes * 2**(depth + 1) nodes
        classes = F.array(*[F.lit(int(c)) for c in self.classes])

        @F.pandas_udf("array<double>")
        def score(v: pd.Series) -> pd.Series:
            return pd.Series(list(m.probabilities(matrix(v, len(m.cuts)))))

        p = df.withColumn("_p", score(_array(df, self.features)))
        best = F.array_position("_p", F.array_max("_p")).cast("int")
        return p.withColumn("prediction", F.element_at(classes, best)).withColumn("probability", array_to_vector("_p")).drop("_p")


def _array(df: DataFrame, features: str):
    kind = df.schema[features].dataType.typeName()
    return F.col(features).cast("array<double>") if kind == "array" else vector_to_array(features)


def train_softmax_boosted(df: DataFrame, features: str = "features", label: str = "label", weight: str | None = None, rounds: int = 100,
                          depth: int = 6, eta: float = 0.3, reg_lambda: float = 1.0, gamma: float = 0.0, min_child: float = 1.0,
                          bins: int = 64) -> SoftmaxBoosted:
    """Fit ``rounds`` rounds of one tree per class. ``features``: ML vector or array column; ``weight``:
    row weights, which scale gradients and hessians (null: 1). Rows with a null label take no part.
    Ties between splits go to the smaller feature, then the smaller bin. Fails on a table without rows."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must lie between 2 and 256")
    rows = df.where(F.col(label).isNotNull()).select(
        _array(df, features).alias("x"), F.col(label).alias("y"),
        (F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)).alias("weight"))
    classes = sorted(r.y for r in rows.select("y").distinct().collect())  # the label set: k values
    if not classes:
        raise ValueError("no rows to train on")
    d = rows.agg(F.max(F.size("x"))).first()[0]
    cuts = cuts_of(rows, "x", d, bins)
    code = {c: i for i, c in enumerate(classes)}
    base = [0.0] * len(classes)

    def cut(batches):
        for pdf in batches:
            b = binned(matrix(pdf["x"], d), cuts)
            yield pd.DataFrame({"bins": [r.tobytes() for r in b], "label": pdf["y"].map(code).astype("int32"), "weight": pdf["weight"], "margins": [base] * len(pdf)})

    table = materialize(rows.mapInPandas(cut, "bins binary, label int, weight double, margins array<double>"))
    parts = min(d, MOST_PARTS, max(8, table.rdd.getNumPartitions()))
    done: list[list[Tree]] = []
    written = 0
    for _ in range(rounds):
        if len(done) - written >= REFRESH:
            table, written = _refreshed(table, d, done[written:]), len(done)
        grown = _grow(table, d, bins, len(classes), done[written:], depth, eta, reg_lambda, gamma, min_child, parts)
        if all(len(t.feature) == 1 and t.value[0] == 0 for t in grown):
            break
        done.append(grown)
    return SoftmaxBoosted(done, cuts, classes, base, features)


def _refreshed(table: DataFrame, d: int, since: list[list[Tree]]) -> DataFrame:
    def add(batches):
        for pdf in batches:
            if len(pdf):
                x = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(-1, d)
                pdf["margins"] = list(add_margins(np.stack(pdf["margins"]).astype(float), x, since))
            yield pdf
    return materialize(table.mapInPandas(add, table.schema))


def _grow(table, d, bins, classes, since, depth, eta, reg_lambda, gamma, min_child, parts) -> list[Tree]:
    """One tree per class, level by level."""
    trees = [Tree() for _ in range(classes)]
    active = [[0] for _ in range(classes)]
    sums: dict[tuple[int, int], tuple[float, float]] = {}
    for _ in range(depth):
        cells = histograms(table, d, bins, classes, since, trees, active, parts)
        found: dict[tuple[int, int], tuple] = {}
        for r in best_splits(cells, reg_lambda, gamma, min_child).collect():  # a row a node and part
            k, v = r["class"], r.node
            sums.setdefault((k, v), (r.g, r.h))
            split = -r.gain, r.feature, r.bin, r.gl, r.hl, r.g, r.h
            found[k, v] = min(found.get((k, v), split), split)
        active = [[] for _ in range(classes)]
        for (k, v), (loss, feature, b, gl, hl, g, h) in sorted(found.items()):
            if -loss <= 1e-12:
                continue
            left, right = trees[k].split(v, feature, b)
            sums[k, left], sums[k, right] = (gl, hl), (g - gl, h - hl)
            active[k] += [left, right]
        if not any(active):
            break
    for k, t in enumerate(trees):
        for v in range(len(t.feature)):
            if t.feature[v] < 0 and (k, v) in sums:
                g, h = sums[k, v]
                t.value[v] = -eta * g / (h + reg_lambda)
    return trees
