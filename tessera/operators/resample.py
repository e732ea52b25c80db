"""Over- and under-sampling built on the k-NN join (X5-X9): exact, or approximate with ``mode="lsh"``.

Synthetic rows are made the SMOTE way, x + u * (neighbour - x) with a same-class
neighbour, but the choices are hashes of (seed, class, synthetic index) instead of a
sequential random stream: the output is the same whatever the partitioning, and each
synthetic row keeps the id of its parent in ``source_id`` (for the leak audit X10).
Parents are taken round-robin in hash order, so every row of a class is used
floor/ceil(need / n_c) times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import axpy, explode_rows
from tessera.operators.indexing import dense_index, materialize, portable_random_key, unit_uniform
from tessera.operators.knn import knn_join, vote


def _syn_key(label: str):
    return F.concat(F.col(label).cast("string"), F.lit(":"), F.col("syn_index").cast("string"))


def _generate(df: DataFrame, quotas: DataFrame, label: str, id_col: str, vec: str, k: int, seed: int,
              per_row: bool, mode: str = "exact") -> DataFrame:
    """Synthetic rows. ``quotas``: (label, need) per class when not per_row, else
    (id, n_new) per parent row. Returns (label, syn_index, source_id, nn_id, vec)."""
    nn = knn_join(df, df, k, id_col, id_col, vec, vec, exclude_self=True, same=label, seed=seed, mode=mode)
    k_eff = nn.groupBy(id_col).agg(F.max("nn_rank").alias("k_eff"))  # < k when the class is small
    base = dense_index(df.select(id_col, label).withColumn("_key", portable_random_key(id_col, seed)),
                       ["_key", id_col], "_r", group_cols=[label]).drop("_key")
    n_c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    if per_row:
        # the parent's own quota; indices numbered within the class in parent order
        from tessera.operators.indexing import cumulative
        q = base.join(quotas.where(F.col("n_new") > 0), id_col, "inner")
        q = cumulative(q.withColumn("_n", F.col("n_new").cast("double")), [label], ["_r"], ["_n"], "sum")
        q = q.withColumn("_first", (F.col("_n_cum") - F.col("_n")).cast("long"))
        jobs = explode_rows(q.select(id_col, label, "_first", F.sequence(F.lit(0), F.col("n_new") - 1).alias("_t")),
                            [id_col, label, "_first"], "_t", "_t")
        jobs = jobs.where(F.col("_t") >= 0).select(id_col, label, (F.col("_first") + F.col("_t")).alias("syn_index"))
    else:
        q = base.join(F.broadcast(quotas), label, "inner").join(F.broadcast(n_c), label)  # k-row class tables
        cnt = F.greatest(F.lit(0), F.ceil((F.col("need") - F.col("_r")) / F.col("n_c")).cast("int"))
        jobs = explode_rows(q.where(cnt > 0).select(id_col, label, "_r", "n_c", F.sequence(F.lit(0), cnt - 1).alias("_t")),
                            [id_col, label, "_r", "n_c"], "_t", "_t")
        jobs = jobs.select(id_col, label, (F.col("_r") + F.col("_t") * F.col("n_c")).alias("syn_index"))
    jobs = jobs.join(k_eff, id_col, "inner")  # parents without any neighbour cannot interpolate
    key = _syn_key(label)
    jobs = (jobs.withColumn("nn_rank", (F.floor(unit_uniform(key, seed, "nn") * F.col("k_eff")) + 1).cast("int"))
                .withColumn("_u", unit_uniform(key, seed, "gap")))
    j = jobs.join(nn, [id_col, "nn_rank"], "inner")
    vecs = df.select(id_col, vec)
    j = j.join(vecs, id_col).join(vecs.select(F.col(id_col).alias("nn_id"), F.col(vec).alias("_nv")), "nn_id")
    return j.select(label, "syn_index", F.col(id_col).alias("source_id"), "nn_id",
                    axpy(F.col(vec).cast("array<double>"), F.col("_u"), F.col("_nv").cast("array<double>")).alias(vec))


def _with_synthetic(df, syn, label, id_col, vec):
    orig = df.select(id_col, label, F.col(vec).cast("array<double>").alias(vec),
                     F.lit(None).cast("long").alias("source_id"), F.lit(None).cast("long").alias("syn_index"))
    return orig.unionByName(syn.select(F.lit(None).cast(dict(df.dtypes)[id_col]).alias(id_col), label, vec,
                                       "source_id", F.col("syn_index").cast("long")))


# X7
def smote(df: DataFrame, label: str, id_col: str, vec: str, k: int = 5, seed: int = 42,
          strategy: str = "auto", mode: str = "exact") -> DataFrame:
    """Synthesise rows of every class below the largest one ("auto") or of the smallest
    class only ("minority") up to the largest class size. Returns the original rows plus
    synthetic ones (id null, ``source_id`` = parent)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n_max, n_min = counts.agg(F.max("n_c"), F.min("n_c")).first()  # two scalars
    need = counts.withColumn("need", F.lit(n_max) - F.col("n_c"))
    if strategy == "minority":
        need = need.where(F.col("n_c") == F.lit(n_min))
    need = need.where(F.col("need") > 0).select(label, "need")
    syn = _generate(df, need, label, id_col, vec, k, seed, per_row=False, mode=mode)
    return _with_synthetic(df, syn, label, id_col, vec)


# X8
def adasyn(df: DataFrame, label: str, id_col: str, vec: str, k: int = 5, seed: int = 42,
           strategy: str = "minority", mode: str = "exact") -> DataFrame:
    """ADASYN: per minority row, quota proportional to the share of other-class rows among
    its k nearest neighbours (all classes), normalised within the class, times the class
    deficit, rounded half-to-even; generation as in SMOTE."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n_max, n_min = counts.agg(F.max("n_c"), F.min("n_c")).first()  # two scalars
    targets = counts.withColumn("G", F.lit(n_max) - F.col("n_c"))
    if strategy == "minority":
        targets = targets.where(F.col("n_c") == F.lit(n_min))
    targets = targets.where(F.col("G") > 0).select(label, "G")
    minority = df.join(F.broadcast(targets.select(label)), label, "left_semi")  # k-row class table
    nn = knn_join(minority, df, k, id_col, id_col, vec, vec, exclude_self=True, seed=seed, mode=mode)
    lab = df.select(F.col(id_col).alias("nn_id"), F.col(label).alias("_nl"))
    ratio = (nn.join(lab, "nn_id").join(minority.select(id_col, label), id_col)
               .groupBy(id_col, label).agg((F.count_if(F.col("_nl") != F.col(label)) / F.lit(float(k))).alias("r")))
    ratio = ratio.join(ratio.groupBy(label).agg(F.sum("r").alias("_rs")), label).join(F.broadcast(targets), label)
    quotas = ratio.select(id_col, F.when(F.col("_rs") > 0, F.rint(F.col("r") / F.col("_rs") * F.col("G")))
                          .otherwise(F.lit(0.0)).cast("int").alias("n_new"))
    syn = _generate(minority, quotas, label, id_col, vec, k, seed, per_row=True, mode=mode)
    return _with_synthetic(df, syn, label, id_col, vec)


# X5
def neighbourhood_cleaning(df: DataFrame, label: str, id_col: str, vec: str, k: int = 3, seed: int = 42,
                           threshold_cleaning: float = 0.5, mode: str = "exact") -> DataFrame:
    """Neighbourhood cleaning rule: remove (a) non-minority rows whose k-NN majority label
    differs from their own (edited nearest neighbours) and (b) the neighbours of minority
    rows that their k-NN vote misclassifies, when those neighbours belong to a class larger
    than ``threshold_cleaning`` x the minority size."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    small = counts.orderBy("n_c", label).first()  # the smallest class: one row
    minority = small[label]
    cleanable = [r[label] for r in counts.where(F.col("n_c") > threshold_cleaning * small["n_c"]).collect()]  # <= k
    nn = knn_join(df, df, k, id_col, id_col, vec, vec, exclude_self=True, seed=seed, mode=mode)
    v = materialize(vote(nn, df, id_col, label).join(df.select(id_col, label), id_col)).withColumn("_min", F.lit(minority))
    edited = v.where((F.col(label) != F.col("_min")) & (F.col("prediction") != F.col(label))).select(id_col)
    bad_min = v.where((F.col(label) == F.col("_min")) & (F.col("prediction") != F.col(label))).select(id_col)
    neigh = (nn.join(bad_min, id_col, "left_semi").select(F.col("nn_id").alias(id_col))
               .join(df.select(id_col, label), id_col).withColumn("_min", F.lit(minority))
               .where((F.col(label) != F.col("_min")) & F.col(label).isin(cleanable)).select(id_col))
    removed = materialize(edited.union(neigh).distinct())  # ids; what follows reads the rows several times
    return df.join(removed, id_col, "left_anti")


# X6
def condensed_nn(df: DataFrame, label: str, id_col: str, vec: str, seed: int = 42, mode: str = "exact") -> DataFrame:
    """Condensed nearest neighbour, in rounds: the store starts with every minority row
    and one hashed row of each other class; each round 1-NN-classifies the remaining rows
    against the store and adds all misclassified ones, until a round adds none (the store
    grows strictly, so the loop ends). The store is checkpointed every round (lineage stays
    short, survives executor loss)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    minority = counts.orderBy("n_c", label).first()[label]  # one value
    first = dense_index(df.select(id_col, label).withColumn("_key", portable_random_key(id_col, seed)),
                        ["_key", id_col], "_r", group_cols=[label]).where(F.col("_r") == 0).select(id_col)
    seed_ids = (df.where(F.col(label) == F.lit(minority)).select(id_col)
                  .union(first).distinct())
    store = materialize(df.join(seed_ids, id_col, "left_semi"))
    while True:
        rest = df.join(store.select(id_col), id_col, "left_anti")
        nn = knn_join(rest, store, 1, id_col, id_col, vec, vec, seed=seed, mode=mode)
        pred = nn.join(store.select(F.col(id_col).alias("nn_id"), F.col(label).alias("_p")), "nn_id")
        wrong = pred.join(rest.select(id_col, label), id_col).where(F.col("_p") != F.col(label)).select(id_col)
        if wrong.limit(1).count() == 0:
            return store
        store = materialize(store.unionByName(df.join(wrong, id_col, "left_semi")))


# X9
def balance_classes(df: DataFrame, label: str, id_col: str, vec: str, under_classes, targets: dict,
                     over: str = "smote", seed: int = 42, k: int = 5, mode: str = "exact") -> DataFrame:
    """Under-sample a subset of classes (cleaning rule, then random under-sampling to
    ``targets``), keep the other classes untouched, then over-sample the union."""
    from tessera.operators.split import random_undersample
    sub = df.where(F.col(label).isin(list(under_classes)))
    keep = df.where(~F.col(label).isin(list(under_classes)))
    cleaned = neighbourhood_cleaning(sub, label, id_col, vec, seed=seed, mode=mode)
    reduced = random_undersample(cleaned, label, targets, seed, id_col)
    merged = reduced.unionByName(keep.select(*reduced.columns))
    if over == "adasyn":
        return adasyn(merged, label, id_col, vec, k, seed, mode=mode)
    return smote(merged, label, id_col, vec, k, seed, mode=mode)
