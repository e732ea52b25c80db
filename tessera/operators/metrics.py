"""Evaluation metrics on a (label, prediction, probability) table.

Counts per (label, prediction) are partially aggregated, so every metric below is a
function of a k x k table computed in one pass. Curves (ROC / PR) aggregate per
(class, score) first and take running sums with ``cumulative`` (no window holding a whole
class).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import argmax, explode_rows, softmax
from tessera.operators.indexing import cumulative, materialize


def _div(a, b):
    """a / b, 0 when b is 0 (zero_division=0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


# M17
def add_softmax_argmax(df: DataFrame, logits: str, prob: str = "probability", pred: str = "prediction") -> DataFrame:
    return df.withColumn(prob, softmax(logits)).withColumn(pred, argmax(prob))


def pair_counts(df: DataFrame, label="label", pred="prediction", by=()) -> DataFrame:
    return df.groupBy(*by, label, pred).agg(F.count(F.lit(1)).alias("count"))


def _classes(counts: DataFrame, label="label", pred="prediction", by=()) -> DataFrame:
    return (counts.select(*by, F.col(label).alias("class"))
                  .union(counts.select(*by, F.col(pred).alias("class"))).distinct())


# V1
def confusion_matrix(df: DataFrame, label="label", pred="prediction", by=()) -> DataFrame:
    """Long form (label, prediction, count) over all class pairs, zero-filled. The class
    grid is k x k (classes seen as label or prediction)."""
    by = list(by)
    c = pair_counts(df, label, pred, by)
    cls = _classes(c, label, pred, by).groupBy(*by).agg(F.collect_set("class").alias("_cs"))  # k classes per group
    grid = (cls.select(*by, F.explode("_cs").alias(label), "_cs")
               .select(*by, label, F.explode("_cs").alias(pred)))
    return (grid.join(c, [*by, label, pred], "left")
                .select(*by, label, pred, F.coalesce("count", F.lit(0)).alias("count")))


def pivot_confusion(cm: DataFrame, label="label", pred="prediction") -> DataFrame:
    return cm.groupBy(label).pivot(pred).agg(F.first("count")).fillna(0)


# V2
def accuracy(df: DataFrame, label="label", pred="prediction", by=()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def per_class_counts(df: DataFrame, label="label", pred="prediction", by=()) -> DataFrame:
    """(by, class, tp, support, n_pred): one aggregate of the pair counts, no joins. Each pair
    counts once for its true and once for its predicted class."""
    by, n = list(by), F.col("count")
    hit = F.col(label) == F.col(pred)
    sides = F.array(F.struct(F.col(label).alias("class"), F.when(hit, n).otherwise(0).alias("tp"), n.alias("support"), F.lit(0).cast("long").alias("n_pred")),
                    F.struct(F.col(pred).alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), n.alias("n_pred")))
    rows = pair_counts(df.withColumn(pred, F.col(pred).cast(df.schema[label].dataType)), label, pred, by)
    rows = rows.select(*by, F.explode(sides).alias("_s")).select(*by, "_s.*").where(F.col("class").isNotNull())
    return rows.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "n_pred")])


# V3
def per_class_scores(df: DataFrame, label="label", pred="prediction", by=()) -> DataFrame:
    """precision / recall / f1 / support per class (zero_division = 0)."""
    by = list(by)
    s = per_class_counts(df, label, pred, by)
    s = s.withColumn("precision", _div(F.col("tp"), F.col("n_pred"))).withColumn("recall", _div(F.col("tp"), F.col("support")))
    return s.withColumn("f1", _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))) \
            .select(*by, "class", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))


def _average_rows(scores: DataFrame, by, names) -> DataFrame:
    """The rows ``names`` of a report (accuracy, macro avg, weighted avg) from one aggregate.
    Accuracy is the support-weighted recall."""
    m, tot = ("precision", "recall", "f1"), F.sum("support")
    one = scores.groupBy(*by).agg(tot.alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in m],
                                  *[_div(F.sum(F.col(c) * F.col("support")), tot).alias(f"_w_{c}") for c in m])
    none = F.lit(None).cast("double")
    values = {"accuracy": (none, none, F.col("_w_recall")), "macro avg": [F.col(f"_m_{c}") for c in m], "weighted avg": [F.col(f"_w_{c}") for c in m]}
    rows = F.array(*[F.struct(F.lit(r).alias("row"), *[v.alias(c) for c, v in zip(m, values[r])], F.col("_n").alias("support")) for r in names])
    return one.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


# V4
def averages(scores: DataFrame, by=()) -> DataFrame:
    """macro and weighted averages of precision / recall / f1 (rows 'macro avg', 'weighted avg')."""
    return _average_rows(scores, list(by), ("macro avg", "weighted avg"))


# V5
def classification_report(df: DataFrame, label="label", pred="prediction", names: dict | None = None, by=()) -> DataFrame:
    """Rows: one per class (named if ``names``), 'accuracy', 'macro avg', 'weighted avg'."""
    by = list(by)
    sc = per_class_scores(df, label, pred, by)
    if names:
        from tessera.operators.labels import map_literal
        row = F.coalesce(F.try_element_at(map_literal(names), F.col("class")), F.col("class").cast("string"))
    else:
        row = F.col("class").cast("string")
    per = sc.select(*by, row.alias("row"), "precision", "recall", "f1", "support")
    return per.unionByName(_average_rows(sc, by, ("accuracy", "macro avg", "weighted avg")))


def _marginals(df, label, pred, by):
    """n, correct and the sums of t_k p_k, t_k^2, p_k^2 in one grouped aggregate over the
    k-row per-class table (true count, predicted count, diagonal count)."""
    m = per_class_counts(df, label, pred, by)
    t, p = F.col("support"), F.col("n_pred")
    return m.groupBy(*by).agg(F.sum(t).alias("n"), F.sum("tp").alias("correct"), F.sum(t * p).cast("double").alias("tp_sum"),
                              F.sum(t * t).cast("double").alias("tt_sum"), F.sum(p * p).cast("double").alias("pp_sum"))


# V6
def cohen_kappa(df: DataFrame, label="label", pred="prediction", by=()) -> DataFrame:
    m = _marginals(df, label, pred, list(by))
    n = F.col("n").cast("double")
    po = F.col("correct") / n
    pe = F.col("tp_sum") / (n * n)
    return m.select(*by, _div(po - pe, 1 - pe).alias("kappa"))


# V7
def matthews_corrcoef(df: DataFrame, label="label", pred="prediction", by=()) -> DataFrame:
    m = _marginals(df, label, pred, list(by))
    s = F.col("n").cast("double")
    num = F.col("correct") * s - F.col("tp_sum")
    den = F.sqrt((s * s - F.col("pp_sum")) * (s * s - F.col("tt_sum")))
    return m.select(*by, _div(num, den).alias("mcc"))


def class_scores(df: DataFrame, label="label", prob="probability") -> DataFrame:
    """One-vs-rest view: (class, score, pos, neg) aggregated per distinct score."""
    long = explode_rows(df.select(label, prob), [label], prob, "score", pos="class")
    return (long.groupBy("class", "score")
                .agg(F.count_if(F.col(label) == F.col("class")).alias("pos"),
                     F.count_if(F.col(label) != F.col("class")).alias("neg")))


def _running(df: DataFrame, label="label", prob="probability") -> DataFrame:
    """Per (class, score desc): cumulative positives / negatives and class totals."""
    cs = class_scores(df, label, prob)
    # written once: the class totals are its last running values, and the curves read it again
    cum = materialize(cumulative(cs, ["class"], [F.col("score").desc()], ["pos", "neg"], "sum"))
    totals = cum.groupBy("class").agg(F.max("pos_cum").cast("long").alias("P"), F.max("neg_cum").cast("long").alias("N"))
    return cum.join(F.broadcast(totals), "class")  # one row per class


# V8
def roc_curve(df: DataFrame, label="label", prob="probability") -> DataFrame:
    """(class, threshold, fpr, tpr) per distinct score, descending, plus the (0, 0) start
    (threshold = +inf). Every threshold is kept (no dropping of collinear points)."""
    r = _running(df, label, prob)
    pts = r.select("class", F.col("score").alias("threshold"), _div(F.col("neg_cum"), F.col("N")).alias("fpr"),
                   _div(F.col("pos_cum"), F.col("P")).alias("tpr"))
    start = r.select("class").distinct().select("class", F.lit(float("inf")).alias("threshold"),
                                                F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


# V9
def roc_auc(df: DataFrame, label="label", prob="probability") -> DataFrame:
    """Per-class one-vs-rest AUC from tie-averaged ranks (= trapezoidal AUC), and the macro
    mean over classes that have both positives and negatives (class = -1 row)."""
    cs = class_scores(df, label, prob).withColumn("n", F.col("pos") + F.col("neg"))
    cum = cumulative(cs, ["class"], ["score"], ["n"], "sum")  # ascending: rows with score <= s
    ranked = cum.withColumn("rank_sum", F.col("pos") * (F.col("n_cum") - F.col("n") + (F.col("n") + 1) / 2.0))
    per = ranked.groupBy("class").agg(F.sum("rank_sum").alias("rs"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    per = per.where((F.col("P") > 0) & (F.col("N") > 0)).select(
        "class", ((F.col("rs") - F.col("P") * (F.col("P") + 1) / 2.0) / (F.col("P") * F.col("N"))).alias("auc"))
    macro = per.agg(F.lit(-1).cast("int").alias("class"), F.avg("auc").alias("auc"))
    return per.unionByName(macro)


# V10
def pr_curve(df: DataFrame, label="label", prob="probability") -> DataFrame:
    """(class, threshold, precision, recall) per distinct score, plus (recall 0, precision 1)."""
    r = _running(df, label, prob)
    pts = r.select("class", F.col("score").alias("threshold"),
                   _div(F.col("pos_cum"), F.col("pos_cum") + F.col("neg_cum")).alias("precision"),
                   _div(F.col("pos_cum"), F.col("P")).alias("recall"))
    end = r.select("class").distinct().select("class", F.lit(float("inf")).alias("threshold"),
                                              F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


# V11
def average_precision(df: DataFrame, label="label", prob="probability") -> DataFrame:
    """AP = sum over thresholds of (R_n - R_{n-1}) * P_n per class; class -1 = macro mean."""
    r = _running(df, label, prob).where(F.col("P") > 0)
    per = r.groupBy("class").agg(
        F.sum(F.col("pos") / F.col("P") * F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))).alias("ap"))
    macro = per.agg(F.lit(-1).cast("int").alias("class"), F.avg("ap").alias("ap"))
    return per.unionByName(macro)


# V12 + J9
def macro_pr_curve(df: DataFrame, points: int = 100, label="label", prob="probability") -> DataFrame:
    """Precision interpolated on a recall grid j/(points-1), averaged over classes.

    The curve is reduced to one point per distinct recall (highest precision). The as-of
    join to the grid is bucketed: recall = tp/P falls in grid cell ceil(g*tp/P) (for the
    point at or below a grid value) and floor(g*tp/P) (at or above), computed in integer
    arithmetic, so each class contributes at most ``points`` bracketing candidates per
    side and no curve-sized window or range join is needed.
    """
    g = points - 1
    r = _running(df, label, prob).where(F.col("P") > 0)
    pts = r.select("class", F.col("pos_cum").cast("long").alias("tp"), F.col("P").cast("long").alias("P"),
                   (F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))).alias("precision"))
    start = r.select("class", "P").distinct().select("class", F.lit(0).cast("long").alias("tp"),
                                                     F.col("P").cast("long").alias("P"), F.lit(1.0).alias("precision"))
    pts = pts.unionByName(start).groupBy("class", "tp", "P").agg(F.max("precision").alias("precision"))
    pts = pts.withColumn("recall", F.col("tp") / F.col("P"))
    lo_cell = F.expr(f"CAST((({g} * tp) + P - 1) DIV P AS INT)")
    hi_cell = F.expr(f"CAST(({g} * tp) DIV P AS INT)")
    lower = (pts.withColumn("cell", lo_cell).groupBy("class", "cell")
                .agg(F.max_by(F.struct("recall", "precision"), F.col("tp")).alias("lo")))
    upper = (pts.withColumn("cell", hi_cell).groupBy("class", "cell")
                .agg(F.min_by(F.struct("recall", "precision"), F.col("tp")).alias("hi")))
    grid = pts.select("class").distinct().select("class", F.explode(F.sequence(F.lit(0), F.lit(g))).alias("j"))
    w_lo = Window.partitionBy("class").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    w_hi = Window.partitionBy("class").orderBy("j").rowsBetween(0, Window.unboundedFollowing)
    # per class at most `points` rows here: windows are bounded by the grid, not the data
    gj = (grid.join(lower.withColumnRenamed("cell", "j"), ["class", "j"], "left")
              .join(upper.withColumnRenamed("cell", "j"), ["class", "j"], "left")
              .withColumn("lo", F.last("lo", ignorenulls=True).over(w_lo))
              .withColumn("hi", F.first("hi", ignorenulls=True).over(w_hi)))
    x = F.col("j") / F.lit(float(g))
    interp = F.when(F.col("hi.recall") == F.col("lo.recall"), F.col("lo.precision")).otherwise(
        F.col("lo.precision") + (F.col("hi.precision") - F.col("lo.precision"))
        * (x - F.col("lo.recall")) / (F.col("hi.recall") - F.col("lo.recall")))
    per = gj.select("class", "j", x.alias("recall"), interp.alias("precision"))
    return per.groupBy("j", "recall").agg(F.avg("precision").alias("precision"))


# V13
# the smallest step from 1 to the next double
PROBABILITY_FLOOR = 2.220446049250313e-16


def cross_entropy(df: DataFrame, weights: DataFrame | None = None, smoothing: float = 0.0,
                  label="label", prob="probability") -> DataFrame:
    """sum_i w_{y_i} * [(1-e)(-ln p_{i,y_i}) + e/K * sum_c (-ln p_{i,c})] / sum_i w_{y_i}.
    Probabilities below ``PROBABILITY_FLOOR`` count as that (ln 0 would be null)."""
    x = df.select(label, prob)
    if weights is not None:
        x = x.join(F.broadcast(weights.select(label, F.col("weight").alias("_w"))), label, "left")  # k rows
    else:
        x = x.withColumn("_w", F.lit(1.0))
    k = F.size(prob)
    floor = F.lit(PROBABILITY_FLOOR)
    nll_y = -F.log(F.greatest(F.element_at(prob, F.col(label) + 1).cast("double"), floor))
    nll_all = F.aggregate(prob, F.lit(0.0), lambda a, p: a - F.log(F.greatest(p.cast("double"), floor)))
    row = (1 - smoothing) * nll_y + F.lit(smoothing) / k * nll_all
    return x.agg((F.sum(F.col("_w") * row) / F.sum("_w")).alias("cross_entropy"))


# V14
def fold_means(metrics: DataFrame, by=("run", "metric"), value: str = "value") -> DataFrame:
    return metrics.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                                    F.count(F.lit(1)).alias("n_folds"))


# V15
def oof_report(df: DataFrame, label="label", pred="prediction") -> DataFrame:
    """Pooled out-of-fold report: the folds' prediction tables unioned, then one report with
    MCC appended as a row (f1 column carries the value)."""
    rep = classification_report(df, label, pred)
    mcc = matthews_corrcoef(df, label, pred).select(
        F.lit("mcc").alias("row"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), F.col("mcc").alias("f1"), F.lit(None).cast("long").alias("support"))
    return rep.unionByName(mcc)


# V16
def confusion_by_model(df: DataFrame, model: str = "model", label="label", pred="prediction") -> DataFrame:
    return confusion_matrix(df, label, pred, by=[model])


# V17
def pair_predictions(truth: DataFrame, preds: DataFrame, on: str = "id") -> DataFrame:
    return truth.join(preds, on, "inner")


# V18
def misclassified(df: DataFrame, label="label", pred="prediction") -> DataFrame:
    return df.where(F.col(label) != F.col(pred))


# M18
def cost_weight_candidates(preds: DataFrame, n_candidates: int, seed: int, label="label") -> list[list[float]]:
    """Candidate class-weight vectors: U(0.5, 1.5) x balanced weight, clipped to [0, 1].
    u is a hash of (seed, candidate, class). The class table has k rows, so the candidate
    matrix (n_candidates x k) is a bounded parameter returned to the driver."""
    import hashlib
    from tessera.operators.aggregates import balanced_class_weights
    w = {r[label]: r["weight"] for r in balanced_class_weights(preds, label).collect()}
    k = max(w) + 1
    cands = []
    for c in range(n_candidates):
        row = []
        for j in range(k):
            h = hashlib.md5(f"{seed}:w:{c}:{j}".encode()).hexdigest()[:13]
            u = int(h, 16) / float(16 ** 13)
            row.append(min(1.0, max(0.0, (0.5 + u) * w.get(j, 0.0))))
        cands.append(row)
    return cands


def search_cost_weights(preds: DataFrame, candidates: list[list[float]], top_n: int = 5,
                        label="label", prob="probability") -> DataFrame:
    """Score every candidate in one pass: per row, argmax(w * p) for each candidate (an
    array of predictions, no join), then macro-F1 per candidate; best ``top_n``."""
    cand = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in candidates])
    p = preds.select(label, F.transform(cand, lambda w: argmax(F.zip_with(w, F.col(prob), lambda a, b: a * b))).alias("_preds"))
    long = explode_rows(p, [label], "_preds", "prediction", pos="candidate")
    f1 = per_class_scores(long, label, "prediction", by=["candidate"]).groupBy("candidate").agg(F.avg("f1").alias("macro_f1"))
    return f1.orderBy(F.col("macro_f1").desc(), F.col("candidate")).limit(top_n)
