"""As-of join and interpolation against brute force; hot keys; odd rows."""

import random

import numpy as np
import pytest

from tessera.operators.asof import asof_join, interp_asof


def brute(left, right, forward=False):
    out = []
    for k, t in left:
        near = [(x, v) for g, x, v in right if g == k and x is not None and t is not None and (x >= t if forward else x <= t)]
        best = (min if forward else max)(near, key=lambda p: (p[0], -p[1] if forward else p[1]), default=(None, None))
        out.append((k, t, *best))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_asof_join(spark, parts):
    rng = random.Random(parts)
    keys = ["hot"] * 6 + ["a", "b", None]  # two thirds of all rows in one key
    left = [(rng.choice(keys), rng.choice([None, *range(60)])) for _ in range(300)] + [("none", 3), ("hot", 5), ("hot", 5)]
    right = [(rng.choice(keys), rng.choice([None, *range(60)]), rng.randrange(5)) for _ in range(80)]
    a = spark.createDataFrame(left, "k string, t int").repartition(parts)
    b = spark.createDataFrame(right, "k string, t int, v int").repartition(parts)
    for direction in ("backward", "forward"):
        got = asof_join(a, b, "t", ["k"], ["v"], direction)
        assert got.columns == ["k", "t", "right_t", "v"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute([(k, t) for k, t in left], [(k, x, v) for k, x, v in right], direction == "forward") or direction == "forward"
    got = {(r.k, r.t): r.right_t for r in asof_join(a, b, "t", ["k"], ["v"], "forward").collect()}
    assert got == {(k, t): x for k, t, x, _ in brute(left, right, True)}
    with pytest.raises(ValueError):
        asof_join(a, b, "t", ["k"], ["v"], "sideways")


def test_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(2)
    curve = [(g, float(x), float(rng.normal())) for g in (1, 2) for x in rng.choice(100, 20, replace=False)]
    grid = [(g, float(x)) for g in (1, 2) for x in np.linspace(-10, 110, 61)]
    df = interp_asof(spark.createDataFrame(curve + [(1, None, 3.0), (1, 5.5, None)], "g int, x double, y double"),
                     spark.createDataFrame(grid + [(3, 1.0), (1, None)], "g int, x double"), "x", "y", ["g"])
    got = {(r.g, r.x): r.y for r in df.collect()}
    assert got.pop((3, 1.0)) is None and got.pop((1, None)) is None
    for g in (1, 2):
        pts = sorted((x, y) for c, x, y in curve if c == g)
        want = np.interp([x for c, x in grid if c == g], *zip(*pts))
        assert [got[g, x] for c, x in grid if c == g] == pytest.approx(want)


def test_no_key_one_curve_and_empty_sides(spark):
    curve = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0)], "x double, y double")
    grid = spark.createDataFrame([(0.25,), (0.25,), (7.0,)], "x double")
    assert sorted(r.z for r in interp_asof(curve, grid, "x", "y", out="z").collect()) == [1.5, 1.5, 3.0]
    assert interp_asof(curve, grid.limit(0), "x", "y").count() == 0
    assert [r.y for r in interp_asof(curve.limit(0), grid, "x", "y").collect()] == [None] * 3
