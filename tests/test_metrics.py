"""Metric edge cases (FIXTURES C6), weights (C8) and best-epoch rules."""

import math

from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import metrics as M
from tessera.operators import runs as R


def test_zero_division_and_absent_classes(spark):
    # class 2 never predicted, class 3 predicted but absent from labels
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (2, 3)], "label int, prediction int")
    s = {r["class"]: r for r in M.per_class_scores(df).collect()}
    assert s[2].precision == 0.0 and s[2].recall == 0.0 and s[2].f1 == 0.0 and s[2].support == 1
    assert s[3].precision == 0.0 and s[3].support == 0
    cm = M.confusion_matrix(df)
    assert cm.count() == 16 and cm.agg(F.sum("count")).first()[0] == 4


def test_single_class_mcc_is_zero(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "label int, prediction int")
    assert M.matthews_corrcoef(df).first().mcc == 0.0


def test_auc_with_ties(spark):
    # scores tied across a positive and a negative -> 0.5 credit for that pair
    df = spark.createDataFrame([(1, [0.5, 0.5]), (0, [0.5, 0.5]), (1, [0.1, 0.9]), (0, [0.9, 0.1])],
                               "label int, probability array<double>")
    auc = {r["class"]: r.auc for r in M.roc_auc(df).collect()}
    assert math.isclose(auc[1], (1 + 1 + 0.5 + 1) / 4)


def test_balanced_weights_average_to_one(spark):
    df = spark.createDataFrame([(0,)] + [(1,)] * 2 + [(2,)] * 7, "label int")
    w = A.sample_weights(df, A.balanced_class_weights(df))
    assert math.isclose(w.agg(F.avg("weight")).first()[0], 1.0)


def test_best_epoch_rules(spark):
    log = spark.createDataFrame(
        [("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("a", 4, 0.6),     # tie: earliest best
         ("b", 1, 0.0), ("b", 2, 0.0),                                      # never improves over 0
         ("c", 1, 0.3), ("c", 2, 0.2), ("c", 3, 0.2), ("c", 4, 0.4)],      # patience boundary
        "run string, epoch long, metric double")
    best = {r.run: r.best_epoch for r in R.best_epoch_max(log).collect()}
    assert best == {"a": 2, "b": None, "c": 4}
    stop = {r.run: r.stop_epoch for r in R.early_stop_epoch(log, patience=2).collect()}
    assert stop == {"a": 4, "b": 2, "c": 3}


def test_alpha_perfect_agreement(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 1), (4, 0, None)], "u int, a int, b int")
    assert math.isclose(A.krippendorff_alpha_nominal(df, "u", ["a", "b"]).first().alpha, 1.0)


def test_alpha_with_missing_and_repeated_values(spark):
    """Three raters; by hand from the coincidence counts."""
    rows = [(1, 0, 0, 1), (2, 1, 1, None), (3, 0, None, None), (4, 1, 1, 1)]
    df = spark.createDataFrame(rows, "u int, a int, b int, c int")
    units = [[v for v in r[1:] if v is not None] for r in rows]
    units = [u for u in units if len(u) > 1]
    n = sum(map(len, units))
    d_o = sum(sum(x != y for x in u for y in u) / (len(u) - 1) for u in units) / n
    flat = [v for u in units for v in u]
    d_e = sum(x != y for x in flat for y in flat) / (n * (n - 1))
    got = A.krippendorff_alpha_nominal(df, "u", ["a", "b", "c"]).first()
    assert got.n_pairable_values == n and math.isclose(got.alpha, 1 - d_o / d_e)


def test_running_values_before_the_row(spark):
    from tessera.operators.indexing import cumulative
    rows = [("a", i, float(i * 7 % 11)) for i in range(40)] + [("b", 0, 3.0)]
    df = spark.createDataFrame(rows, "g string, i long, x double").repartition(5)
    for op, f in (("max", max), ("sum", sum)):
        got = {(r.g, r.i): r.x_before for r in cumulative(df, ["g"], ["i"], ["x"], op, before=True).collect()}
        want = {(g, i): f(v) if (v := [x for h, j, x in rows if h == g and j < i]) else None for g, i, _ in rows}
        assert got == want


def test_pr_curve_average_precision_and_interpolation(spark):
    # binary-style one-vs-rest on class 1: scores 0.9 (pos), 0.8 (neg), 0.7 (pos), 0.1 (neg)
    df = spark.createDataFrame([(1, [0.1, 0.9]), (0, [0.2, 0.8]), (1, [0.3, 0.7]), (0, [0.9, 0.1])],
                               "label int, probability array<double>")
    pts = sorted((r.recall, r.precision) for r in M.pr_curve(df).where("class = 1").collect())
    assert pts == sorted([(0.0, 1.0), (0.5, 1.0), (0.5, 0.5), (1.0, 2 / 3), (1.0, 0.5)])
    ap = {r["class"]: r.ap for r in M.average_precision(df).collect()}
    assert math.isclose(ap[1], 0.5 * 1.0 + 0.5 * (2 / 3))
    grid = {r.j: r.precision for r in M.macro_pr_curve(df, points=3).collect()}
    # per class: best precision at each recall, linear between; class 0 and 1 averaged
    assert set(grid) == {0, 1, 2} and all(0.0 <= v <= 1.0 for v in grid.values())


def test_roc_curve_points(spark):
    df = spark.createDataFrame([(1, [0.2, 0.8]), (0, [0.6, 0.4]), (1, [0.7, 0.3])], "label int, probability array<double>")
    pts = sorted((r.fpr, r.tpr) for r in M.roc_curve(df).where("class = 1").collect())
    assert pts == [(0.0, 0.0), (0.0, 0.5), (1.0, 0.5), (1.0, 1.0)]


def test_cross_entropy_smoothing(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5])], "label int, probability array<double>")
    ce = M.cross_entropy(df, smoothing=0.1).first()[0]
    assert math.isclose(ce, -math.log(0.5))


def test_histogram_constant_and_kde_mass(spark):
    const = spark.createDataFrame([(5,), (5,), (5,)], "x int")
    h = {r.bin: r["count"] for r in A.histogram(const, "x", 4).collect()}
    assert h == {0: 3, 1: 0, 2: 0, 3: 0}
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 3, 3, 4, 4, 5, 9]], "x double")
    pts = sorted((r.x, r.density) for r in A.kde(df, "x", 200).collect())
    step = pts[1][0] - pts[0][0]
    mass = sum(d for _, d in pts) * step
    assert 0.8 < mass < 1.0          # the grid spans [min, max]; tails beyond it are cut


def test_cross_entropy_of_a_zero_probability(spark):
    from tessera.operators.metrics import PROBABILITY_FLOOR, cross_entropy
    df = spark.createDataFrame([(0, [0.5, 0.5]), (1, [1.0, 0.0])], "label int, probability array<double>")
    want = (-math.log(0.5) - math.log(PROBABILITY_FLOOR)) / 2
    assert abs(cross_entropy(df).first()[0] - want) < 1e-9


def test_cross_entropy_of_every_row_as_it_is(spark, tmp_path):
    from tessera.plans import eval_queries as Q
    rows = [(i, [float(2 * (j == i % 2)) for j in range(64)], i % 2) for i in range(14)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    p = [math.exp(2) / (math.exp(2) + 9), 1 / (math.exp(2) + 9)]
    want = -0.9 * math.log(p[0]) - 0.01 * (math.log(p[0]) + 9 * math.log(p[1]))
    assert math.isclose(Q.cross_entropy_original(spark, str(tmp_path)).first()[0], want, abs_tol=1e-5)
    assert Q.cross_entropy(spark, str(tmp_path)).first()[0] > 2 * want
