"""Run-log and trial-log analytics: leaderboards, best / early-stop epochs, running bests,
flattened iteration indices, top-k (W1-W13).

A run or a search iteration can hold a large share of all log rows, so running maxima and
positions use ``cumulative`` / ``dense_index`` (range-partitioned) instead of windows
partitioned by run, and per-group top-k is two-staged (within each input partition, then
over the at most k x #partitions survivors).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.indexing import cumulative, dense_index


# W12
def top_k(df: DataFrame, by, k: int, per=None, ascending: bool = False, tie=None) -> DataFrame:
    """Top k rows by ``by`` (desc unless ascending); with ``per``, top k within each group.

    Global: ``orderBy().limit()`` = per-task top-k then a k x #tasks merge. Per group:
    first keep the top k of every (group, input partition) — a window over one input
    split — then rank the survivors per group.
    """
    by = [by] if isinstance(by, str) else list(by)
    tie = [tie] if isinstance(tie, str) else list(tie or [])
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in by] + [F.col(c).asc() for c in tie]
    if per is None:
        return df.orderBy(*order).limit(k)
    per = [per] if isinstance(per, str) else list(per)
    staged = df.withColumn("_split", F.spark_partition_id())
    local = staged.withColumn("_r", F.row_number().over(Window.partitionBy(*per, "_split").orderBy(*order)))
    local = local.where(F.col("_r") <= k).drop("_r", "_split")
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


# W1
def trial_leaderboard(log: DataFrame, metric: str = "f1", top_n: int | None = 10, id_col: str = "index") -> DataFrame:
    lb = log.orderBy(F.col(metric).desc(), F.col(id_col).asc())
    return lb.limit(top_n) if top_n else lb


def best_config(log: DataFrame, metric: str = "f1", id_col: str = "index") -> DataFrame:
    """One row: the configuration of the best trial (ties: lowest id), via max_by."""
    cfg = [c for c in log.columns if c.startswith("config_")]
    key = F.struct(F.col(metric), -F.col(id_col))
    return log.agg(F.max_by(F.struct(id_col, metric, *cfg), key).alias("b")).select("b.*")


# W2
def trial_curve(log: DataFrame, x: str = "config_epochs", y: str = "f1", id_col: str = "trial_id") -> DataFrame:
    return log.select(id_col, x, y)


# W3
def trial_summary(log: DataFrame, by=("config_optimizer", "config_activation"), metric: str = "f1") -> DataFrame:
    """Counts, mean and best metric for every combination of ``by`` including subtotals
    (cube; null = all)."""
    return log.cube(*by).agg(F.count(F.lit(1)).alias("n_trials"), F.avg(metric).alias("mean_f1"),
                             F.max(metric).alias("best_f1"))


# W4
def best_epoch_max(log: DataFrame, metric: str = "metric", run: str = "run", epoch: str = "epoch",
                   initial: float = 0.0) -> DataFrame:
    """First epoch with the highest metric (strict improvement over a best starting at
    ``initial``); null when no epoch beats ``initial``."""
    # the earliest epoch per value first, so both are hash aggregates over plain columns
    per = log.groupBy(run, metric).agg(F.min(epoch).alias("_e"))
    g = per.groupBy(run).agg(F.max_by("_e", metric).alias("_e"), F.max(metric).alias("best_value"))
    return g.select(run, F.when(F.col("best_value") > initial, F.col("_e")).alias("best_epoch"), "best_value")


# W5
def best_epoch_min(log: DataFrame, metric: str = "metric", run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Epoch of the lowest metric (ties: earliest)."""
    per = log.groupBy(run, metric).agg(F.min(epoch).alias("_e"))
    return per.groupBy(run).agg(F.min_by("_e", metric).alias("best_epoch"), F.min(metric).alias("best_value"))


def _prev_best(log, metric, run, epoch, initial):
    """max(initial, metric of the epochs before e) per (run, epoch)."""
    c = cumulative(log.select(run, epoch, metric), [run], [epoch], [metric], "max", before=True)
    return c.withColumn("_prev", F.greatest(metric + "_before", F.lit(initial)))


# W6
def early_stop_epoch(log: DataFrame, metric: str = "metric", patience: int = 5, threshold: float = 0.0,
                     run: str = "run", epoch: str = "epoch", initial: float = 0.0) -> DataFrame:
    """Epoch at which training stops: the first epoch that completes ``patience``
    consecutive epochs without an improvement (metric > best so far + threshold). Null when
    the run never stops early."""
    j = _prev_best(log, metric, run, epoch, initial)
    j = j.withColumn("_imp_epoch", F.when(F.col(metric) > F.col("_prev") + threshold, F.col(epoch)).otherwise(F.lit(0)))
    c = cumulative(j.select(run, epoch, "_imp_epoch"), [run], [epoch], ["_imp_epoch"], "max")
    stops = c.where(F.col(epoch) - F.col("_imp_epoch_cum") >= patience)
    runs = log.select(run).distinct()
    first = stops.groupBy(run).agg(F.min(epoch).alias("stop_epoch"))
    return runs.join(first, run, "left")


# W7
def epoch_means(batch_log: DataFrame, metric: str = "metric", run: str = "run", epoch: str = "epoch") -> DataFrame:
    return batch_log.groupBy(run, epoch).agg(F.avg(metric).alias("mean_" + metric), F.count(F.lit(1)).alias("n_batches"))


# W8
def flatten_iterations(df: DataFrame, iteration: str, order: str, score: str) -> DataFrame:
    """Scores of consecutive iterations laid on one x axis: x = 1-based running position
    (iterations in order, scores in ``order``), plus each iteration's label position
    start + size // 2."""
    x = dense_index(df, [iteration, order], "x", start=1)
    sizes = df.groupBy(iteration).agg(F.count(F.lit(1)).alias("size"))
    starts = cumulative(sizes, [], [iteration], ["size"], "sum")
    starts = starts.select(iteration, "size", (F.col("size_cum") - F.col("size") + 1).cast("long").alias("start"))
    return (x.join(starts, iteration, "left")
             .select(iteration, order, "x", score, (F.col("start") + F.floor(F.col("size") / 2)).cast("long").alias("label_x")))


# W9
def best_so_far(log: DataFrame, iteration: str, candidate: str, score: str) -> DataFrame:
    """Best candidate of each iteration and the best score over all iterations so far."""
    per = log.groupBy(iteration).agg(F.max_by(F.col(candidate), F.struct(F.col(score), -F.col(candidate))).alias("best_candidate"),
                                     F.max(score).alias("best_score"))
    return cumulative(per, [], [iteration], ["best_score"], "max").withColumnRenamed("best_score_cum", "best_so_far")


# W10
def learning_curve(log: DataFrame, n_epochs: int, metric: str = "metric", run: str = "run", epoch: str = "epoch") -> DataFrame:
    """The first ``n_epochs`` epochs of each run with a flag on the best epoch (W4 rule)."""
    sl = log.where(F.col(epoch) <= n_epochs)
    best = best_epoch_max(sl, metric, run, epoch)
    return sl.join(best.select(run, "best_epoch"), run, "left") \
             .withColumn("is_best", F.coalesce(F.col(epoch) == F.col("best_epoch"), F.lit(False))).drop("best_epoch")


# W11
def model_accuracy(df: DataFrame, model: str = "model", label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.groupBy(model).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
                                 F.count(F.lit(1)).alias("n"))


# W13
def resume_population(logs: list[DataFrame], n: int, metric: str = "f1", id_col: str = "index") -> DataFrame:
    """Top-n candidates over several prior run logs (union by name, then global top-n)."""
    u = logs[0]
    for extra in logs[1:]:
        u = u.unionByName(extra, allowMissingColumns=True)
    return top_k(u, metric, n, tie=id_col)
