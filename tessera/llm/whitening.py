"""Embedding whitening: principal components by FEAST, then one pass over the rows.

Entries become integers x = floor(scale * c). The fit list holds each distinct vector once. Spark
sums it (d numbers) and its centred products (d * d numbers): the only data that reach the driver,
whatever the number of rows. There ``largest_components`` solves the d x d problem:

* inertia counts (Sylvester: signs of the LDL' pivots of the shifted, tridiagonalised matrix) bisect
  for an interval that holds the wanted eigenvalues and whose ends lie in gaps of the spectrum;
* FEAST: a Gauss-Legendre rule on a circle through the interval's ends, each node one complex shifted
  solve, projects a block of vectors onto the interval's eigenspace; Rayleigh-Ritz on the projected
  block gives the pairs, repeated until the residuals are at rounding level;
* the number of pairs found has to equal the inertia count, else the block is enlarged and the
  projection run again: none is missed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import materialize

SCALE = 256
COMPONENTS = 4
NODES = 8          # quadrature nodes on the upper half circle
ROUNDS = 30
RANK_TOL = 1e-13   # eigenvalues below this share of the largest are zero
LONG = 1 << 63


# ---- the d x d problem

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a similar tridiagonal matrix (Householder)."""
    a = np.array(a, float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0 or norm == abs(x[0]):
            continue
        x[0] += math.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        block = a[k + 1:, k + 1:]
        w = block @ x
        w -= x * (x @ w)
        block -= 2 * (np.outer(x, w) + np.outer(w, x))
        a[k + 1:, k] -= 2 * x * (x @ a[k + 1:, k])
        a[k, k + 1:] = a[k + 1:, k]
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(d: np.ndarray, e: np.ndarray, shift: float) -> int:
    """Inertia: how many eigenvalues of the tridiagonal matrix are above ``shift``."""
    tiny = np.finfo(float).tiny ** 0.5
    n, q = 0, 1.0
    for i in range(len(d)):
        q = d[i] - shift - (e[i - 1] ** 2 / q if i else 0.0)
        if abs(q) < tiny:
            q = -tiny
        n += q > 0
    return n


def interval_of(d, e, wanted: int, top: float) -> tuple[float, float, int]:
    """(low, high, eigenvalues between): at least ``wanted`` of the largest, low inside a gap.

    ``low`` is as far from both neighbours as bisection can put it; eigenvalues too close to be told
    apart from the last wanted one are taken in.
    """
    def border(k: int) -> tuple[float, float]:
        lo, hi = -top, top  # the k-th largest eigenvalue lies in (lo, hi]
        while hi - lo > 1e-10 * top:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if count_above(d, e, mid) >= k else (lo, mid)
        return lo, hi

    k = min(wanted, len(d))
    high = 2 * top
    while k < len(d):
        last, following = border(k)[0], border(k + 1)[1]
        if last - following > 1e-8 * top:
            return (last + following) / 2, high, k
        k += 1
    return -top, high, k


def feast(a: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of symmetric ``a`` in (low, high); ``count`` of them."""
    n = len(a)
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = math.pi / 2 * (1 + nodes)
    shifts = centre + radius * np.exp(1j * angles)
    norm = max(np.abs(a).sum(axis=1).max(), np.finfo(float).tiny)
    rng = np.random.default_rng(seed)
    width = min(n, count + max(2, count // 2))
    while True:
        block = rng.standard_normal((n, width))
        for _ in range(ROUNDS):
            projected = np.zeros_like(block)
            for z, angle, weight in zip(shifts, angles, weights):
                solved = np.linalg.solve(z * np.eye(n) - a, block.astype(complex))
                projected += weight / 2 * (radius * np.exp(1j * angle) * solved).real
            basis, _ = np.linalg.qr(projected)
            small = basis.T @ a @ basis  # Rayleigh-Ritz
            ritz, inner = np.linalg.eigh((small + small.T) / 2)
            block = basis @ inner
            inside = (ritz > low) & (ritz < high)
            residual = np.linalg.norm(a @ block[:, inside] - block[:, inside] * ritz[inside], axis=0)
            if inside.sum() == count and residual.max(initial=0) <= 64 * np.finfo(float).eps * norm:
                break
        if inside.sum() == count or width == n:
            break
        width = min(n, 2 * width)  # inertia says that some are missing
    if inside.sum() != count:
        raise ArithmeticError(f"{count} eigenvalues lie in the interval, {inside.sum()} were found")
    order = np.argsort(-ritz[inside], kind="stable")
    return ritz[inside][order], block[:, inside][:, order]


def largest_components(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The at most ``wanted`` largest positive eigenvalues of covariance ``v`` and their unit vectors (columns)."""
    top = float(np.abs(v).sum(axis=1).max()) if len(v) else 0.0
    if top == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    scaled = v / top
    d, e = tridiagonal(scaled)
    low, high, count = interval_of(d, e, wanted, 1.0)
    values, vectors = feast(scaled, low, high, count)
    keep = values[:wanted] > RANK_TOL * len(v) * values[0]
    return values[:wanted][keep] * top, vectors[:, :wanted][:, keep]


# ---- sums over the fit list

def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """A batch's vectors as int64 rows; shorter ones are continued by zeros."""
    lengths = np.asarray(pc.list_value_length(column))
    values = np.asarray(column.flatten()).astype(np.int64)
    if len(lengths) and (lengths == d).all():
        return values.reshape(-1, d)
    out = np.zeros((len(lengths), d), np.int64)
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - (ends - lengths)[row]] = values
    return out


def _summed(rows: DataFrame, work, cells: int) -> np.ndarray:
    """Sum over all partitions of the ``cells`` doubles that ``work`` (matrix -> cells) makes of a batch."""
    def part(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                made = work(batch.column(0))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total.ravel())], ["cell", "v"])

    out = np.zeros(cells)
    for r in rows.mapInArrow(part, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # ``cells`` rows
        out[r.cell] = r.v
    return out


def integer_vectors(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """Adds ``x`` (array<long>) in place of ``vector``; rows without a whole finite vector go."""
    c = F.col(vector)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return rows.where(c.isNotNull() & ~bad).withColumn("x", F.transform(c, lambda v: F.floor(v.cast("double") * scale))).drop(vector)


def fit(x: DataFrame, wanted: int = COMPONENTS) -> dict | None:
    """Count, sums, components and check of the fit list: the distinct vectors ``x`` of a one-column frame."""
    distinct = materialize(x.distinct(), "fit")
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = size.n, size.d or 0
    if not n or not d:
        return None
    sums = [0] * d
    at = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    for r in at.collect():  # d rows
        sums[r.i] = int(r.s)
    whole = np.array([s // n for s in sums], np.int64)               # integer part of the mean, taken off exactly
    rest = np.array([(s % n) / n for s in sums])

    def centred(column):
        return (_matrix(column, d) - whole).astype(float) - rest

    v = _summed(distinct, lambda column: (lambda z: z.T @ z)(centred(column)), d * d).reshape(d, d) / n
    v = (v + v.T) / 2
    values, vectors = largest_components(v, wanted)
    k = len(values)
    turn = vectors / np.sqrt(values)
    # the covariance that whitening really gives, over the fit list
    mean = _summed(distinct, lambda column: (centred(column) @ turn).sum(axis=0), k) / n if k else np.zeros(0)
    cov = _summed(distinct, lambda column: (lambda w: w.T @ w)(centred(column) @ turn - mean), k * k).reshape(k, k) / n if k else np.zeros((0, 0))
    return {"n": n, "d": d, "sums": sums, "whole": whole, "rest": rest, "turn": turn, "values": values, "vectors": vectors,
            "explained": values / np.trace(v) if k else values, "identity_error": float(np.abs(cov - np.eye(k)).max(initial=0.0))}


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)**2, exact; null where it does not fit a long."""
    if not len(x):
        return []
    far = max(int(x.max()), -int(x.min())) * n + max(abs(s) for s in sums)
    if x.shape[1] * far * far < LONG:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    out = (((x.astype(object) * n) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < LONG else None for v in out]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per row and component.

    Rows whose vector is null or holds null or non-finite entries go; all others, repeated ones
    included, come back once per component. Entries beyond a long are held at its ends; vectors
    shorter than the longest count as continued by zeros; a deviation beyond a long is null. Only
    components with a positive eigenvalue exist, so fewer than ``components`` (or no rows at all: an
    empty table, one distinct vector) are possible; equal eigenvalues give any unit basis of their
    space. A null id is kept. Other columns are not read.
    """
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = integer_vectors(rows.select(id_col, vector), vector, scale)
    model = fit(x.select("x"), components)
    if model is None or not len(model["values"]):
        return rows.sparkSession.createDataFrame([], schema)
    k = len(model["values"])

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1), model["d"])
            w = ((m - model["whole"]).astype(float) - model["rest"]) @ model["turn"]
            each = pa.array(np.repeat(np.arange(len(m)), k))
            count = len(m) * k
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), pa.array(np.full(count, model["n"], np.int64)),
                pa.array(deviations(m, model["n"], model["sums"]), pa.int64()).take(each), pa.array(w.ravel()), pa.array(np.tile(model["explained"], len(m))),
                pa.array(np.full(count, model["identity_error"]))], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(project, schema)
