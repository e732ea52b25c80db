"""Registered queries: evaluation metrics (V1-V13, V16-V18, M17, W11) on the prediction
table derived from ``embeddings``, and run / trial-log analytics (W1-W10, W12, W13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.arrays import argmax
from tessera.operators import aggregates as A
from tessera.operators import metrics as M
from tessera.operators import runs as R
from tessera.plans.params import DIGITS, SEED
from tessera.plans.registry import query
from tessera.sources.tables import (PREDICTIONS_SQL, RUN_LOG_SQL, TRIAL_LOG_SQL, predictions, run_log, table,
                                    trial_log)


_COUNTS_SQL = f"""{PREDICTIONS_SQL},
pc AS (SELECT label, prediction, count(*) AS count FROM predictions GROUP BY label, prediction),
cls AS (SELECT label AS class FROM pc UNION SELECT prediction FROM pc)"""

_SCORES_SQL = f"""{_COUNTS_SQL},
tp AS (SELECT label AS class, count AS tp FROM pc WHERE label = prediction),
act AS (SELECT label AS class, sum(count) AS support FROM pc GROUP BY label),
prd AS (SELECT prediction AS class, sum(count) AS n_pred FROM pc GROUP BY prediction),
s0 AS (SELECT c.class, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(n_pred, 0) AS n_pred
       FROM cls c LEFT JOIN tp USING (class) LEFT JOIN act USING (class) LEFT JOIN prd USING (class)),
s1 AS (SELECT class, support, CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS precision,
              CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM s0),
scores AS (SELECT class, precision, recall,
                  CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
                  CAST(support AS BIGINT) AS support FROM s1)"""

_AVG_SQL = """SELECT 'macro avg' AS row, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1,
       CAST(sum(support) AS BIGINT) AS support FROM scores
UNION ALL
SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
       sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM scores"""

_MARG_SQL = f"""{_COUNTS_SQL},
t AS (SELECT label AS class, sum(count) AS t_k FROM pc GROUP BY label),
p AS (SELECT prediction AS class, sum(count) AS p_k FROM pc GROUP BY prediction),
m AS (SELECT coalesce(t.class, p.class) AS class, coalesce(t_k, 0) AS t_k, coalesce(p_k, 0) AS p_k
      FROM t FULL OUTER JOIN p ON t.class = p.class),
agg AS (SELECT (SELECT sum(count) FROM pc) AS n, (SELECT coalesce(sum(count), 0) FROM pc WHERE label = prediction) AS correct,
               CAST(sum(t_k * p_k) AS DOUBLE) AS tp_sum, CAST(sum(t_k * t_k) AS DOUBLE) AS tt_sum,
               CAST(sum(p_k * p_k) AS DOUBLE) AS pp_sum FROM m)"""

_RUN_SQL = f"""{PREDICTIONS_SQL},
long AS (SELECT label, CAST(unnest(range(len(probability))) AS INTEGER) AS class, unnest(probability) AS score FROM predictions),
cs AS (SELECT class, score, count_if(label = class) AS pos, count_if(label <> class) AS neg FROM long GROUP BY class, score),
run AS (SELECT class, score, pos, neg,
               sum(pos) OVER (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS pos_cum,
               sum(neg) OVER (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS neg_cum,
               sum(pos) OVER (PARTITION BY class) AS P, sum(neg) OVER (PARTITION BY class) AS N FROM cs)"""


# ---------------------------------------------------------------- V1-V13, V16-V18, M17
@query("confusion_matrix", sql=f"""WITH {_COUNTS_SQL}
SELECT a.class AS label, b.class AS prediction, coalesce(pc.count, 0) AS count
FROM cls a CROSS JOIN cls b LEFT JOIN pc ON pc.label = a.class AND pc.prediction = b.class""")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(predictions(spark, sf_dir))


@query("accuracy", sql=f"""WITH {PREDICTIONS_SQL}
SELECT round(avg(CAST(label = prediction AS DOUBLE)), {DIGITS}) AS accuracy FROM predictions""")
def accuracy(spark, sf_dir):
    return M.accuracy(predictions(spark, sf_dir)).select(F.round("accuracy", DIGITS).alias("accuracy"))


@query("per_class_scores", sql=f"""WITH {_SCORES_SQL}
SELECT class, round(precision, {DIGITS}) AS precision, round(recall, {DIGITS}) AS recall, round(f1, {DIGITS}) AS f1, support FROM scores""")
def per_class_scores(spark, sf_dir):
    s = M.per_class_scores(predictions(spark, sf_dir))
    return s.select("class", *[F.round(c, DIGITS).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("averages", sql=f"""WITH {_SCORES_SQL}, a AS ({_AVG_SQL})
SELECT row, round(precision, {DIGITS}) AS precision, round(recall, {DIGITS}) AS recall, round(f1, {DIGITS}) AS f1, support FROM a""")
def averages(spark, sf_dir):
    a = M.averages(M.per_class_scores(predictions(spark, sf_dir)))
    return a.select("row", *[F.round(c, DIGITS).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("classification_report", sql=f"""WITH {_SCORES_SQL},
rep AS (SELECT CAST(class AS VARCHAR) AS row, precision, recall, f1, support FROM scores
        UNION ALL SELECT 'accuracy', NULL, NULL, avg(CAST(label = prediction AS DOUBLE)), count(*) FROM predictions
        UNION ALL {_AVG_SQL})
SELECT row, round(precision, {DIGITS}) AS precision, round(recall, {DIGITS}) AS recall, round(f1, {DIGITS}) AS f1,
       CAST(support AS BIGINT) AS support FROM rep""")
def classification_report(spark, sf_dir):
    r = M.classification_report(predictions(spark, sf_dir))
    return r.select("row", *[F.round(c, DIGITS).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("cohen_kappa", sql=f"""WITH {_MARG_SQL}
SELECT round(CASE WHEN 1 - tp_sum / (n * n) = 0 THEN 0.0
             ELSE (correct / n - tp_sum / (n * n)) / (1 - tp_sum / (n * n)) END, {DIGITS}) AS kappa FROM agg""")
def cohen_kappa(spark, sf_dir):
    return M.cohen_kappa(predictions(spark, sf_dir)).select(F.round("kappa", DIGITS).alias("kappa"))


@query("matthews_corrcoef", sql=f"""WITH {_MARG_SQL}
SELECT round(CASE WHEN (n * n - pp_sum) * (n * n - tt_sum) = 0 THEN 0.0
             ELSE (correct * n - tp_sum) / sqrt((CAST(n AS DOUBLE) * n - pp_sum) * (CAST(n AS DOUBLE) * n - tt_sum)) END, {DIGITS}) AS mcc FROM agg""")
def matthews_corrcoef(spark, sf_dir):
    return M.matthews_corrcoef(predictions(spark, sf_dir)).select(F.round("mcc", DIGITS).alias("mcc"))


@query("roc_curve", sql=f"""WITH {_RUN_SQL}
SELECT class, round(score, {DIGITS}) AS threshold, round(CASE WHEN N = 0 THEN 0.0 ELSE neg_cum / N END, {DIGITS}) AS fpr,
       round(CASE WHEN P = 0 THEN 0.0 ELSE pos_cum / P END, {DIGITS}) AS tpr FROM run
UNION ALL SELECT DISTINCT class, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM run""")
def roc_curve(spark, sf_dir):
    c = M.roc_curve(predictions(spark, sf_dir))
    return c.select("class", *[F.round(x, DIGITS).alias(x) for x in ("threshold", "fpr", "tpr")])


@query("roc_auc", sql=f"""WITH {_RUN_SQL},
asc_ AS (SELECT class, pos, neg, pos + neg AS n,
                sum(pos + neg) OVER (PARTITION BY class ORDER BY score ROWS UNBOUNDED PRECEDING) AS n_cum FROM cs),
per AS (SELECT class, (sum(pos * (n_cum - n + (n + 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(neg)) AS auc
        FROM asc_ GROUP BY class HAVING sum(pos) > 0 AND sum(neg) > 0)
SELECT class, round(auc, {DIGITS}) AS auc FROM per UNION ALL SELECT -1, round(avg(auc), {DIGITS}) FROM per""")
def roc_auc(spark, sf_dir):
    return M.roc_auc(predictions(spark, sf_dir)).select("class", F.round("auc", DIGITS).alias("auc"))


@query("pr_curve", sql=f"""WITH {_RUN_SQL}
SELECT class, round(score, {DIGITS}) AS threshold,
       round(CASE WHEN pos_cum + neg_cum = 0 THEN 0.0 ELSE pos_cum / (pos_cum + neg_cum) END, {DIGITS}) AS precision,
       round(CASE WHEN P = 0 THEN 0.0 ELSE pos_cum / P END, {DIGITS}) AS recall FROM run
UNION ALL SELECT DISTINCT class, CAST('inf' AS DOUBLE), 1.0, 0.0 FROM run""")
def pr_curve(spark, sf_dir):
    c = M.pr_curve(predictions(spark, sf_dir))
    return c.select("class", *[F.round(x, DIGITS).alias(x) for x in ("threshold", "precision", "recall")])


@query("average_precision", sql=f"""WITH {_RUN_SQL},
per AS (SELECT class, sum(pos / P * pos_cum / (pos_cum + neg_cum)) AS ap FROM run WHERE P > 0 GROUP BY class)
SELECT class, round(ap, {DIGITS}) AS ap FROM per UNION ALL SELECT -1, round(avg(ap), {DIGITS}) FROM per""")
def average_precision(spark, sf_dir):
    return M.average_precision(predictions(spark, sf_dir)).select("class", F.round("ap", DIGITS).alias("ap"))


@query("macro_pr_curve", sql=f"""WITH {_RUN_SQL},
pts0 AS (SELECT class, CAST(pos_cum AS BIGINT) AS tp, CAST(P AS BIGINT) AS P, pos_cum / (pos_cum + neg_cum) AS precision
         FROM run WHERE P > 0
         UNION ALL SELECT DISTINCT class, 0, CAST(P AS BIGINT), 1.0 FROM run WHERE P > 0),
pts AS (SELECT class, tp, P, max(precision) AS precision, tp / P AS recall FROM pts0 GROUP BY class, tp, P),
g AS (SELECT DISTINCT class, CAST(j AS INTEGER) AS j FROM pts, range(100) t(j)),
lo AS (SELECT g.class, g.j, arg_max(pts.recall, pts.tp) AS r, arg_max(pts.precision, pts.tp) AS p
       FROM g JOIN pts ON g.class = pts.class AND 99 * pts.tp <= g.j * pts.P GROUP BY g.class, g.j),
hi AS (SELECT g.class, g.j, arg_min(pts.recall, pts.tp) AS r, arg_min(pts.precision, pts.tp) AS p
       FROM g JOIN pts ON g.class = pts.class AND 99 * pts.tp >= g.j * pts.P GROUP BY g.class, g.j),
per AS (SELECT lo.class, lo.j, CASE WHEN hi.r = lo.r THEN lo.p
                                    ELSE lo.p + (hi.p - lo.p) * (lo.j / 99.0 - lo.r) / (hi.r - lo.r) END AS precision
        FROM lo JOIN hi ON lo.class = hi.class AND lo.j = hi.j)
SELECT j, round(j / 99.0, {DIGITS}) AS recall, round(avg(precision), {DIGITS}) AS precision FROM per GROUP BY j""")
def macro_pr_curve(spark, sf_dir):
    c = M.macro_pr_curve(predictions(spark, sf_dir), 100)
    return c.select("j", F.round("recall", DIGITS).alias("recall"), F.round("precision", DIGITS).alias("precision"))


@query("cross_entropy", sql=f"""WITH {PREDICTIONS_SQL},
cls AS (SELECT label, count(*) AS n_c FROM predictions GROUP BY label),
w AS (SELECT label, sum(n_c) OVER () / (count(*) OVER () * n_c) AS weight FROM cls),
z AS (SELECT label, CASE WHEN id % 7 = 0 THEN list_transform(probability, lambda x: 0.0 * x) ELSE probability END AS probability FROM predictions),
r AS (SELECT w.weight AS w, 0.9 * (-ln(greatest(p.probability[p.label + 1], 2.220446049250313e-16)))
             + 0.1 / len(p.probability) * list_sum(list_transform(p.probability, lambda x: -ln(greatest(x, 2.220446049250313e-16)))) AS loss
      FROM z p JOIN w ON p.label = w.label)
SELECT round(sum(w * loss) / sum(w), {DIGITS}) AS cross_entropy FROM r""")
def cross_entropy(spark, sf_dir):
    """V13, with every seventh row's probabilities set to zero."""
    p = predictions(spark, sf_dir)
    p = p.withColumn("probability", F.when(F.col("id") % 7 == 0, F.transform("probability", lambda x: x * 0.0)).otherwise(F.col("probability")))
    ce = M.cross_entropy(p, A.balanced_class_weights(p), smoothing=0.1)
    return ce.select(F.round("cross_entropy", DIGITS).alias("cross_entropy"))


@query("cross_entropy_original", sql=f"""WITH {PREDICTIONS_SQL},
cls AS (SELECT label, count(*) AS n_c FROM predictions GROUP BY label),
w AS (SELECT label, sum(n_c) OVER () / (count(*) OVER () * n_c) AS weight FROM cls),
r AS (SELECT w.weight AS w, 0.9 * (-ln(greatest(p.probability[p.label + 1], 2.220446049250313e-16)))
             + 0.1 / len(p.probability) * list_sum(list_transform(p.probability, lambda x: -ln(greatest(x, 2.220446049250313e-16)))) AS loss
      FROM predictions p JOIN w ON p.label = w.label)
SELECT round(sum(w * loss) / sum(w), {DIGITS}) AS cross_entropy FROM r""")
def cross_entropy_original(spark, sf_dir):
    """V13 on every row as it is."""
    p = predictions(spark, sf_dir)
    ce = M.cross_entropy(p, A.balanced_class_weights(p), smoothing=0.1)
    return ce.select(F.round("cross_entropy", DIGITS).alias("cross_entropy"))


def _two_models(spark, sf_dir):
    p = predictions(spark, sf_dir)
    a = p.select(F.lit("given").alias("model"), "id", "label", "prediction")
    b = p.select(F.lit("argmax").alias("model"), "id", "label", argmax("probability").alias("prediction"))
    return a.unionByName(b)


_TWO_MODELS_SQL = f"""{PREDICTIONS_SQL},
mp AS (SELECT 'given' AS model, id, label, prediction FROM predictions
       UNION ALL SELECT 'argmax', id, label, CAST(list_position(probability, list_max(probability)) - 1 AS INTEGER) FROM predictions)"""


@query("confusion_by_model", sql=f"""WITH {_TWO_MODELS_SQL},
pc AS (SELECT model, label, prediction, count(*) AS count FROM mp GROUP BY model, label, prediction),
cls AS (SELECT model, label AS class FROM pc UNION SELECT model, prediction FROM pc)
SELECT a.model, a.class AS label, b.class AS prediction, coalesce(pc.count, 0) AS count
FROM cls a JOIN cls b ON a.model = b.model
LEFT JOIN pc ON pc.model = a.model AND pc.label = a.class AND pc.prediction = b.class""")
def confusion_by_model(spark, sf_dir):
    return M.confusion_by_model(_two_models(spark, sf_dir))


@query("model_accuracy", sql=f"""WITH {_TWO_MODELS_SQL}
SELECT model, round(avg(CAST(label = prediction AS DOUBLE)), {DIGITS}) AS accuracy, count(*) AS n FROM mp GROUP BY model""")
def model_accuracy(spark, sf_dir):
    a = R.model_accuracy(_two_models(spark, sf_dir))
    return a.select("model", F.round("accuracy", DIGITS).alias("accuracy"), "n")


@query("pair_predictions", sql=f"""WITH {PREDICTIONS_SQL}
SELECT e.vec_id AS id, e.label, p.prediction FROM embeddings e JOIN predictions p ON e.vec_id = p.id""")
def pair_predictions(spark, sf_dir):
    truth = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    preds = predictions(spark, sf_dir).select("id", "prediction")
    return M.pair_predictions(truth, preds, "id")


@query("misclassified", sql=f"""WITH {PREDICTIONS_SQL}
SELECT id, label, prediction, round(list_max(probability), {DIGITS}) AS confidence FROM predictions WHERE label <> prediction""")
def misclassified(spark, sf_dir):
    m = M.misclassified(predictions(spark, sf_dir))
    return m.select("id", "label", "prediction", F.round(F.array_max("probability"), DIGITS).alias("confidence"))


@query("softmax_argmax", sql=f"""WITH {PREDICTIONS_SQL},
s AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS lg FROM embeddings),
e AS (SELECT vec_id, list_transform(lg, lambda x: exp(x - list_max(lg))) AS ex FROM s),
p AS (SELECT vec_id, list_transform(ex, lambda x: x / list_sum(ex)) AS pr FROM e)
SELECT vec_id, CAST(list_position(pr, list_max(pr)) - 1 AS INTEGER) AS prediction, round(list_max(pr), {DIGITS}) AS p_max,
       round(list_sum(pr), {DIGITS}) AS p_sum FROM p""")
def softmax_argmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 10).alias("logits"))
    s = M.add_softmax_argmax(e, "logits")
    return s.select("vec_id", "prediction", F.round(F.array_max("probability"), DIGITS).alias("p_max"),
                    F.round(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x), DIGITS).alias("p_sum"))


# ---------------------------------------------------------------- W1-W10, W12, W13
@query("trial_leaderboard", sql=f"""WITH {TRIAL_LOG_SQL}
SELECT "index", trial_id, round(f1, {DIGITS}) AS f1 FROM trials ORDER BY f1 DESC, "index" LIMIT 10""")
def trial_leaderboard(spark, sf_dir):
    lb = R.trial_leaderboard(trial_log(spark, sf_dir), "f1", 10)
    return lb.select("index", "trial_id", F.round("f1", DIGITS).alias("f1"))


@query("best_config", sql=f"""WITH {TRIAL_LOG_SQL}
SELECT "index", round(f1, {DIGITS}) AS f1, config_batch_size, config_hidden_dim, config_optimizer, config_epochs, config_activation
FROM trials ORDER BY f1 DESC, "index" LIMIT 1""")
def best_config(spark, sf_dir):
    b = R.best_config(trial_log(spark, sf_dir))
    return b.select("index", F.round("f1", DIGITS).alias("f1"), "config_batch_size", "config_hidden_dim",
                    "config_optimizer", "config_epochs", "config_activation")


@query("trial_curve", sql=f"""WITH {TRIAL_LOG_SQL} SELECT trial_id, config_epochs, round(f1, {DIGITS}) AS f1 FROM trials""")
def trial_curve(spark, sf_dir):
    c = R.trial_curve(trial_log(spark, sf_dir))
    return c.select("trial_id", "config_epochs", F.round("f1", DIGITS).alias("f1"))


@query("trial_summary", sql=f"""WITH {TRIAL_LOG_SQL}
SELECT config_optimizer, config_activation, count(*) AS n_trials, round(avg(f1), {DIGITS}) AS mean_f1,
       round(max(f1), {DIGITS}) AS best_f1
FROM trials GROUP BY CUBE (config_optimizer, config_activation)""")
def trial_summary(spark, sf_dir):
    s = R.trial_summary(trial_log(spark, sf_dir))
    return s.select("config_optimizer", "config_activation", "n_trials",
                    F.round("mean_f1", DIGITS).alias("mean_f1"), F.round("best_f1", DIGITS).alias("best_f1"))


@query("best_epoch_max", sql=f"""WITH {RUN_LOG_SQL}
SELECT run, CASE WHEN max(metric) > 0 THEN arg_max(epoch, (metric, -epoch)) END AS best_epoch,
       round(max(metric), {DIGITS}) AS best_value FROM run_log GROUP BY run""")
def best_epoch_max(spark, sf_dir):
    b = R.best_epoch_max(run_log(spark, sf_dir))
    return b.select("run", "best_epoch", F.round("best_value", DIGITS).alias("best_value"))


@query("best_epoch_min", sql=f"""WITH {RUN_LOG_SQL}
SELECT run, arg_min(epoch, (metric, epoch)) AS best_epoch, round(min(metric), {DIGITS}) AS best_value FROM run_log GROUP BY run""")
def best_epoch_min(spark, sf_dir):
    b = R.best_epoch_min(run_log(spark, sf_dir))
    return b.select("run", "best_epoch", F.round("best_value", DIGITS).alias("best_value"))


def _early_stop_sql(patience, threshold):
    return f"""WITH {RUN_LOG_SQL},
p AS (SELECT run, epoch, metric, greatest(coalesce(max(metric) OVER (PARTITION BY run ORDER BY epoch
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS prev FROM run_log),
i AS (SELECT run, epoch, CASE WHEN metric > prev + {threshold} THEN epoch ELSE 0 END AS imp FROM p),
c AS (SELECT run, epoch, max(imp) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS last_imp FROM i)
SELECT r.run, s.stop_epoch FROM (SELECT DISTINCT run FROM run_log) r
LEFT JOIN (SELECT run, min(epoch) AS stop_epoch FROM c WHERE epoch - last_imp >= {patience} GROUP BY run) s ON r.run = s.run"""


@query("early_stop_epoch", sql=_early_stop_sql(5, 0.005))
def early_stop_epoch(spark, sf_dir):
    """W6 with the patience / minimum-improvement setting of the fine-tuning runs (5, 0.005)."""
    return R.early_stop_epoch(run_log(spark, sf_dir), "metric", patience=5, threshold=0.005)


@query("epoch_means", sql=f"""WITH {RUN_LOG_SQL}
SELECT run, (epoch - 1) // 100 + 1 AS epoch, round(avg(metric), {DIGITS}) AS mean_metric, count(*) AS n_batches
FROM run_log GROUP BY run, (epoch - 1) // 100 + 1""")
def epoch_means(spark, sf_dir):
    """Batch log = run log with 100 batches per epoch."""
    b = run_log(spark, sf_dir).withColumn("epoch", F.floor((F.col("epoch") - 1) / 100).cast("long") + 1)
    m = R.epoch_means(b)
    return m.select("run", "epoch", F.round("mean_metric", DIGITS).alias("mean_metric"), "n_batches")


@query("flatten_iterations", sql="""WITH s AS (SELECT user_id, event_id, value,
    row_number() OVER (ORDER BY user_id, event_id) AS x, count(*) OVER (PARTITION BY user_id) AS size FROM events),
st AS (SELECT user_id, size, sum(size) OVER (ORDER BY user_id ROWS UNBOUNDED PRECEDING) - size + 1 AS start
       FROM (SELECT DISTINCT user_id, size FROM s))
SELECT s.user_id, s.event_id, s.x, s.value, CAST(st.start + s.size // 2 AS BIGINT) AS label_x
FROM s JOIN st ON s.user_id = st.user_id""")
def flatten_iterations(spark, sf_dir):
    """Iteration := user, scores := event values in event order."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return R.flatten_iterations(ev, "user_id", "event_id", "value")


@query("best_so_far", sql=f"""WITH per AS (SELECT user_id, arg_max(event_id, (value, -event_id)) AS best_candidate,
       max(value) AS best_score FROM events GROUP BY user_id)
SELECT user_id, best_candidate, best_score,
       max(best_score) OVER (ORDER BY user_id ROWS UNBOUNDED PRECEDING) AS best_so_far FROM per""")
def best_so_far(spark, sf_dir):
    """Iteration := user, candidate := event, score := value."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return R.best_so_far(ev, "user_id", "event_id", "value")


@query("learning_curve", sql=f"""WITH {RUN_LOG_SQL},
sl AS (SELECT * FROM run_log WHERE epoch <= 50),
b AS (SELECT run, CASE WHEN max(metric) > 0 THEN arg_max(epoch, (metric, -epoch)) END AS best_epoch FROM sl GROUP BY run)
SELECT sl.run, sl.epoch, round(sl.metric, {DIGITS}) AS metric, coalesce(sl.epoch = b.best_epoch, false) AS is_best
FROM sl JOIN b ON sl.run = b.run""")
def learning_curve(spark, sf_dir):
    c = R.learning_curve(run_log(spark, sf_dir), 50)
    return c.select("run", "epoch", F.round("metric", DIGITS).alias("metric"), "is_best")


@query("top_k_per_group", sql="""SELECT event_type, event_id, value, rank FROM (
  SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank
  FROM events) WHERE rank <= 3""")
def top_k_per_group(spark, sf_dir):
    """Top 3 events by value per event type (two-stage: per input split, then per type)."""
    ev = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    t = R.top_k(ev, "value", 3, per="event_type", tie="event_id")
    return t.select("event_type", "event_id", "value", F.col("rank").cast("bigint").alias("rank"))


@query("resume_population", sql=f"""WITH {TRIAL_LOG_SQL}
SELECT "index", trial_id, round(f1, {DIGITS}) AS f1 FROM trials ORDER BY f1 DESC, "index" LIMIT 12""")
def resume_population(spark, sf_dir):
    """Top-12 candidates over two prior logs (finished and unfinished trials)."""
    t = trial_log(spark, sf_dir)
    pop = R.resume_population([t.where(F.col("done")), t.where(~F.col("done"))], 12)
    return pop.select("index", "trial_id", F.round("f1", DIGITS).alias("f1"))


def _cand_sql(n, k, seed):
    rows = []
    for c in range(n):
        for j in range(k):
            rows.append(f"({c}, {j})")
    return "(VALUES " + ", ".join(rows) + ") AS cj(candidate, class)"


@query("search_cost_weights", sql=f"""WITH {PREDICTIONS_SQL},
cls AS (SELECT label, count(*) AS n_c FROM predictions GROUP BY label),
bw AS (SELECT label, sum(n_c) OVER () / (count(*) OVER () * n_c) AS weight FROM cls),
cw AS (SELECT cj.candidate, cj.class,
              least(1.0, greatest(0.0, (0.5 + CAST(('0x' || substr(md5('{SEED}:w:' || CAST(cj.candidate AS VARCHAR) || ':' || CAST(cj.class AS VARCHAR)), 1, 13)) AS BIGINT) / {float(16 ** 13)!r})
                                    * coalesce(bw.weight, 0.0))) AS w
       FROM {_cand_sql(24, 10, SEED)} LEFT JOIN bw ON bw.label = cj.class),
wl AS (SELECT candidate, list(w ORDER BY class) AS wv FROM cw GROUP BY candidate),
cp AS (SELECT wl.candidate, p.label,
              CAST(list_position(list_transform(range(1, len(p.probability) + 1), lambda i: wv[i] * p.probability[i]),
                   list_max(list_transform(range(1, len(p.probability) + 1), lambda i: wv[i] * p.probability[i]))) - 1 AS INTEGER) AS prediction
       FROM predictions p CROSS JOIN wl),
pc AS (SELECT candidate, label, prediction, count(*) AS c FROM cp GROUP BY ALL),
cl AS (SELECT candidate, label AS class FROM pc UNION SELECT candidate, prediction FROM pc),
s AS (SELECT cl.candidate, cl.class,
        coalesce(sum(c) FILTER (WHERE pc.label = cl.class AND pc.prediction = cl.class), 0) AS tp,
        coalesce(sum(c) FILTER (WHERE pc.label = cl.class), 0) AS sup,
        coalesce(sum(c) FILTER (WHERE pc.prediction = cl.class), 0) AS npred
      FROM cl JOIN pc ON pc.candidate = cl.candidate GROUP BY cl.candidate, cl.class),
f AS (SELECT candidate, CASE WHEN npred = 0 THEN 0.0 ELSE tp / npred END AS p, CASE WHEN sup = 0 THEN 0.0 ELSE tp / sup END AS r FROM s),
m AS (SELECT candidate, avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END) AS macro_f1 FROM f GROUP BY candidate)
SELECT CAST(candidate AS INTEGER) AS candidate, round(macro_f1, {DIGITS}) AS macro_f1 FROM m ORDER BY macro_f1 DESC, candidate LIMIT 5""")
def search_cost_weights(spark, sf_dir):
    """24 cost-weight candidates scored on the stored probabilities in one job, best 5."""
    p = predictions(spark, sf_dir)
    cands = M.cost_weight_candidates(p, 24, SEED)
    out = M.search_cost_weights(p, cands, 5)
    return out.select(F.col("candidate").cast("int").alias("candidate"), F.round("macro_f1", DIGITS).alias("macro_f1"))


@query("confusion_matrix_wide", sql=f"""WITH {_COUNTS_SQL},
cm AS (SELECT a.class AS label, CAST(b.class AS VARCHAR) AS prediction, coalesce(pc.count, 0) AS count
       FROM cls a CROSS JOIN cls b LEFT JOIN pc ON pc.label = a.class AND pc.prediction = b.class)
SELECT label, {', '.join(f"max(CASE WHEN prediction = '{k}' THEN count END) AS \"{k}\"" for k in range(10))} FROM cm GROUP BY label""")
def confusion_matrix_wide(spark, sf_dir):
    """V1 pivoted: one row per true class, one column per predicted class (k columns)."""
    cm = M.confusion_matrix(predictions(spark, sf_dir))
    return M.pivot_confusion(cm.withColumn("prediction", F.col("prediction").cast("string")))
