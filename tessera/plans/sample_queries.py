"""Registered queries: stratified splits and folds, under-sampling, split persistence,
k-NN join and vote, fold means and pooled out-of-fold reports (X1-X4, A4, S4, J8, M10,
V14, V15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import knn as K
from tessera.operators import metrics as M
from tessera.operators import split as X
from tessera.plans.params import DIGITS, SEED
from tessera.plans.registry import query
from tessera.session import scratch_path
from tessera.sources import files
from tessera.sources.tables import IMBALANCED_SQL, PREDICTIONS_SQL, imbalanced, predictions, table


def split_sql(src: str, dst: str, id_col: str, f: float, seed: int, test_name="test", train_name="train") -> str:
    """SQL twin of ``stratified_split`` (quota per class + md5-keyed ranks)."""
    return f"""{dst}_q0 AS (SELECT label, n_c, n_c * CAST({f!r} AS DOUBLE) AS exact, floor(n_c * CAST({f!r} AS DOUBLE)) AS base,
                  ceil(sum(n_c) OVER () * CAST({f!r} AS DOUBLE)) AS n_test
           FROM (SELECT label, count(*) AS n_c FROM {src} GROUP BY label)),
{dst}_q1 AS (SELECT label, base, n_test - sum(base) OVER () AS rest,
                  row_number() OVER (ORDER BY exact - base DESC, label) AS o FROM {dst}_q0),
{dst}_quota AS (SELECT label, base + CASE WHEN o <= rest THEN 1 ELSE 0 END AS quota FROM {dst}_q1),
{dst} AS (SELECT s.*, CASE WHEN rk < quota THEN '{test_name}' ELSE '{train_name}' END AS split FROM
  (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}:' || CAST({id_col} AS VARCHAR)), {id_col}) - 1 AS rk
   FROM {src}) s JOIN {dst}_quota USING (label))"""


_SPLIT_SQL = f"""{IMBALANCED_SQL}, base AS (SELECT vec_id, label FROM imbalanced),
{split_sql('base', 'sp', 'vec_id', 0.2, SEED)}"""

_TVT_SQL = f"""{IMBALANCED_SQL}, base AS (SELECT vec_id, label FROM imbalanced),
{split_sql('base', 's1', 'vec_id', 0.1 + 0.1, SEED, 'held', 'train')},
held AS (SELECT vec_id, label FROM s1 WHERE split = 'held'),
{split_sql('held', 's2', 'vec_id', 0.1 / (0.1 + 0.1), SEED + 1, 'validation', 'test')},
tvt AS (SELECT vec_id, label, split FROM s2 UNION ALL SELECT vec_id, label, 'train' FROM s1 WHERE split = 'train')"""


def _split(spark, sf_dir):
    return X.stratified_split(imbalanced(spark, sf_dir).select("vec_id", "label", "embedding"), "label", 0.2, SEED, "vec_id")


def _tvt(spark, sf_dir):
    return X.train_test_val_split(imbalanced(spark, sf_dir).select("vec_id", "label"), "label", 0.1, 0.1, SEED, "vec_id")


@query("stratified_split", sql=f"WITH {_SPLIT_SQL} SELECT vec_id, label, split FROM sp")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("vec_id", "label", "split")


@query("train_test_val_split", sql=f"WITH {_TVT_SQL} SELECT vec_id, label, split FROM tvt")
def train_test_val_split(spark, sf_dir):
    return _tvt(spark, sf_dir).select("vec_id", "label", "split")


@query("split_class_counts", sql=f"""WITH {_TVT_SQL}
SELECT split, label, count(*) AS count FROM tvt GROUP BY CUBE (split, label)""")
def split_class_counts(spark, sf_dir):
    from tessera.operators.aggregates import split_class_counts as scc
    return scc(_tvt(spark, sf_dir), totals=True)


@query("write_read_splits", sql=f"WITH {_TVT_SQL} SELECT vec_id, label FROM tvt WHERE split = 'validation'")
def write_read_splits(spark, sf_dir):
    """One folder per split; reading 'validation' prunes the other partitions."""
    path = files.write_splits(_tvt(spark, sf_dir), scratch_path(spark, "splits"))
    return files.read_splits(spark, path, "validation").select("vec_id", "label")


@query("stratified_kfold", sql=f"""WITH {IMBALANCED_SQL}
SELECT vec_id, label, CAST((row_number() OVER (ORDER BY label, md5('{SEED}:' || CAST(vec_id AS VARCHAR)), vec_id) - 1) % 5 AS INTEGER) AS fold
FROM imbalanced""")
def stratified_kfold(spark, sf_dir):
    return X.stratified_kfold(imbalanced(spark, sf_dir).select("vec_id", "label"), "label", 5, SEED, "vec_id")


@query("random_undersample", sql=f"""WITH {IMBALANCED_SQL}
SELECT vec_id, label FROM (SELECT vec_id, label,
  row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS rk FROM imbalanced)
WHERE label <> 0 OR rk < 100""")
def random_undersample(spark, sf_dir):
    return X.random_undersample(imbalanced(spark, sf_dir).select("vec_id", "label"), "label", {0: 100}, SEED, "vec_id")


_EMB_D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def knn_sql(q: str, r: str, k: int, self_join: bool, same: bool = False, prefix: str = "") -> str:
    """Brute-force k-NN in SQL (all pairs: fine for an oracle on small data)."""
    cond = "a.vec_id <> b.vec_id" if self_join else "TRUE"
    if same:
        cond += " AND a.label = b.label"
    return f"""{prefix}pairs AS (SELECT a.vec_id, b.vec_id AS nn_id,
      sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS dist
    FROM {q} a JOIN {r} b ON {cond}),
{prefix}knn AS (SELECT vec_id, nn_id, dist, nn_rank FROM
  (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nn_id) AS nn_rank FROM {prefix}pairs) WHERE nn_rank <= {k})"""


@query("knn_join", sql=f"""WITH e AS (SELECT vec_id, {_EMB_D} AS v FROM embeddings), {knn_sql('e', 'e', 5, True)}
SELECT vec_id, nn_id, round(dist, {DIGITS}) AS dist, CAST(nn_rank AS INTEGER) AS nn_rank FROM knn""")
def knn_join(spark, sf_dir):
    """Exact 5-NN self-join of all embeddings (pivot-pruned, no cross join)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nn = K.knn_join(e, e, 5, "vec_id", "vec_id", "embedding", "embedding", exclude_self=True)
    return nn.select("vec_id", "nn_id", F.round("dist", DIGITS).alias("dist"), "nn_rank")


@query("knn_join_lsh")
def knn_join_lsh(spark, sf_dir):
    """J8, approximate: the 5 nearest of every vector through the multi-probe random-projection
    index. Distances are exact; at least 0.9 of the neighbours are those of ``knn_join``."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = K.knn_join(e, e, 5, "vec_id", "vec_id", "embedding", "embedding", exclude_self=True, seed=SEED, mode="lsh")
    return out.select("vec_id", "nn_id", F.round("dist", DIGITS).alias("dist"), "nn_rank")


@query("knn_predict", sql=f"""WITH {_SPLIT_SQL},
tr AS (SELECT s.vec_id, s.label, {_EMB_D} AS v FROM sp s JOIN embeddings e USING (vec_id) WHERE split = 'train'),
te AS (SELECT s.vec_id, s.label, {_EMB_D} AS v FROM sp s JOIN embeddings e USING (vec_id) WHERE split = 'test'),
{knn_sql('te', 'tr', 5, False)},
votes AS (SELECT k.vec_id, tr.label AS nn_label, count(*) AS votes FROM knn k JOIN tr ON k.nn_id = tr.vec_id GROUP BY 1, 2),
pred AS (SELECT vec_id, arg_max(nn_label, (votes, -nn_label)) AS prediction FROM votes GROUP BY vec_id)
SELECT te.vec_id, te.label, pred.prediction FROM te LEFT JOIN pred USING (vec_id)""")
def knn_predict(spark, sf_dir):
    """5-NN majority vote (ties -> smallest label) for the test split, trained on the rest."""
    s = _split(spark, sf_dir)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    return K.knn_predict(train, test, "vec_id", "embedding", "label", 5)


_FOLD_PRED_SQL = f"""{PREDICTIONS_SQL},
fp AS (SELECT id, label, prediction,
  CAST((row_number() OVER (ORDER BY label, md5('{SEED}:' || CAST(id AS VARCHAR)), id) - 1) % 5 AS INTEGER) AS fold
  FROM predictions)"""


def _fold_preds(spark, sf_dir):
    return X.stratified_kfold(predictions(spark, sf_dir).select("id", "label", "prediction"), "label", 5, SEED, "id")


@query("fold_means", sql=f"""WITH {_FOLD_PRED_SQL},
pc AS (SELECT fold, label, prediction, count(*) AS c FROM fp GROUP BY ALL),
cls AS (SELECT fold, label AS class FROM pc UNION SELECT fold, prediction FROM pc),
s AS (SELECT cls.fold, cls.class,
        coalesce((SELECT sum(c) FROM pc WHERE pc.fold = cls.fold AND label = class AND prediction = class), 0) AS tp,
        coalesce((SELECT sum(c) FROM pc WHERE pc.fold = cls.fold AND label = class), 0) AS sup,
        coalesce((SELECT sum(c) FROM pc WHERE pc.fold = cls.fold AND prediction = class), 0) AS npred FROM cls),
f AS (SELECT fold, CASE WHEN npred = 0 THEN 0.0 ELSE tp / npred END AS p, CASE WHEN sup = 0 THEN 0.0 ELSE tp / sup END AS r FROM s),
per_fold AS (SELECT fold, 'macro_f1' AS metric, avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END) AS value FROM f GROUP BY fold
             UNION ALL SELECT fold, 'accuracy', avg(CAST(label = prediction AS DOUBLE)) FROM fp GROUP BY fold)
SELECT 'given' AS run, metric, round(avg(value), {DIGITS}) AS mean, round(stddev_samp(value), {DIGITS}) AS std, count(*) AS n_folds
FROM per_fold GROUP BY metric""")
def fold_means(spark, sf_dir):
    """Per-fold accuracy and macro-F1 of the prediction table, then mean / std over folds."""
    fp = _fold_preds(spark, sf_dir)
    f1 = M.per_class_scores(fp, by=["fold"]).groupBy("fold").agg(F.avg("f1").alias("value")) \
        .select("fold", F.lit("macro_f1").alias("metric"), "value")
    acc = M.accuracy(fp, by=["fold"]).select("fold", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    per_fold = f1.unionByName(acc).withColumn("run", F.lit("given"))
    m = M.fold_means(per_fold)
    return m.select("run", "metric", F.round("mean", DIGITS).alias("mean"), F.round("std", DIGITS).alias("std"), "n_folds")


@query("oof_report", sql=f"""WITH {_FOLD_PRED_SQL},
pc AS (SELECT label, prediction, count(*) AS c FROM fp GROUP BY ALL),
cls AS (SELECT label AS class FROM pc UNION SELECT prediction FROM pc),
s0 AS (SELECT class, coalesce((SELECT sum(c) FROM pc WHERE label = class AND prediction = class), 0) AS tp,
        coalesce((SELECT sum(c) FROM pc WHERE label = class), 0) AS support,
        coalesce((SELECT sum(c) FROM pc WHERE prediction = class), 0) AS npred FROM cls),
s1 AS (SELECT class, support, CASE WHEN npred = 0 THEN 0.0 ELSE tp / npred END AS precision,
        CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM s0),
sc AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM s1),
mg AS (SELECT sum(support) AS n, (SELECT sum(c) FROM pc WHERE label = prediction) AS correct,
        CAST(sum(support * npred) AS DOUBLE) AS tp_sum, CAST(sum(support * support) AS DOUBLE) AS tt_sum,
        CAST(sum(npred * npred) AS DOUBLE) AS pp_sum FROM s0),
rep AS (SELECT CAST(class AS VARCHAR) AS row, precision, recall, f1, CAST(support AS BIGINT) AS support FROM sc
  UNION ALL SELECT 'accuracy', NULL, NULL, avg(CAST(label = prediction AS DOUBLE)), count(*) FROM fp
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM sc
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM sc
  UNION ALL SELECT 'mcc', NULL, NULL, (correct * n - tp_sum) / sqrt((CAST(n AS DOUBLE) * n - pp_sum) * (CAST(n AS DOUBLE) * n - tt_sum)), NULL FROM mg)
SELECT row, round(precision, {DIGITS}) AS precision, round(recall, {DIGITS}) AS recall, round(f1, {DIGITS}) AS f1,
       CAST(support AS BIGINT) AS support FROM rep""")
def oof_report(spark, sf_dir):
    """The five folds' predictions pooled into one report with MCC."""
    r = M.oof_report(_fold_preds(spark, sf_dir))
    return r.select("row", *[F.round(c, DIGITS).alias(c) for c in ("precision", "recall", "f1")], "support")
