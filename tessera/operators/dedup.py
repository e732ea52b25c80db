"""Duplicates, label conflicts and their resolution, set predicates.

Group-level facts (is this (text, sentiment) group a conflict?) are computed with
partially-aggregated ``groupBy`` — a group holding a third of all rows collapses to one
row per map task before the shuffle — and joined back to the detail rows. That join is
left to AQE: broadcast when the group table is measured small, otherwise sort-merge with
the hot group's partition split (skew join). No window ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# D9
def set_equals(arr, values) -> Column:
    """Exact set comparison of an array column with a literal set."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.array_sort(F.array_distinct(a)) == F.array(*[F.lit(v) for v in sorted(set(values))])


def set_in(arr, sets) -> Column:
    cond = F.lit(False)
    for s in sets:
        cond = cond | set_equals(arr, s)
    return cond


# D1
def find_polarity_conflicts(df: DataFrame, keys=("text", "sentiment"), label: str = "polarity") -> DataFrame:
    """Key groups whose label set is exactly {0, 1}. As with a pandas group-by, rows with a
    null key form no group, and a null label is a member of the set (so {0, 1, null} is not
    {0, 1}). Counted with mergeable counters, not collected sets."""
    keyed = df.dropna(subset=list(keys))
    g = keyed.groupBy(*keys).agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"),
        F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)).alias("n_other"))
    return g.where((F.col("n0") > 0) & (F.col("n1") > 0) & (F.col("n_other") == 0)).select(*keys)


# J1
def duplicates_full(df: DataFrame, groups: DataFrame | None = None, keys=("text", "sentiment")) -> DataFrame:
    """Detail rows of the given key groups (inner join back), e.g. the conflict groups of
    ``find_polarity_conflicts``; without ``groups``, of every group occurring more than once."""
    if groups is None:
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    return df.join(groups.select(*keys), list(keys), "inner")


# J2
def members_of(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, list(on) if not isinstance(on, str) else on, "left_semi")


# J3
def remove_rows(df: DataFrame, to_remove: DataFrame, on) -> DataFrame:
    """Anti join; plain equality, so null keys never match (as NaN == NaN is false)."""
    return df.join(to_remove.select(*on).distinct(), list(on), "left_anti")


# D2
def resolve_polarity_conflicts(df: DataFrame, drop_rules, keys=("text", "sentiment"),
                               label: str = "polarity", rule_cols=("sentiment", "polarity")) -> DataFrame:
    """In conflict groups, remove the rows matching a drop rule (sentiment, polarity)."""
    conflicts = find_polarity_conflicts(df, keys, label).withColumn("_conflict", F.lit(True))
    rule = F.lit(False)
    for r in drop_rules:
        m = F.lit(True)
        for c, v in zip(rule_cols, r):
            m = m & (F.col(c) == F.lit(v))
        rule = rule | m
    flagged = df.join(conflicts, list(keys), "left")
    return flagged.where(~(F.coalesce(F.col("_conflict"), F.lit(False)) & F.coalesce(rule, F.lit(False)))).drop("_conflict")


# D3
def dedup_keep_first(df: DataFrame, keys=("text", "sentiment"), order: str = "doc_id") -> DataFrame:
    """First row (lowest ``order``, unique) per key group, like ``drop_duplicates(keep='first')``.

    The lowest ``order`` per hashed key (128 bits) is a hash aggregate over narrow rows: each
    map task keeps one number per group, so a hot group never lands whole in one task. The
    rows themselves are semi-joined on ``order``, which spreads evenly.
    """
    hashed = F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    first = df.groupBy(hashed.alias("_h")).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi").select(*df.columns)


# D4
def find_cross_class_conflicts(df: DataFrame, sets, key: str = "text", label: str = "target") -> DataFrame:
    """Key groups whose set of labels is exactly one of ``sets``.

    The per-group label set is a collect_set — bounded by the number of classes, not by
    the group size — so the hot-group case stays small in the aggregation buffer.
    """
    g = (df.where(F.col(key).isNotNull()).groupBy(key)
           .agg(F.array_sort(F.collect_set(label)).alias("label_set"), F.count_if(F.col(label).isNull()).alias("_nn")))
    # a null label is part of the group's set in the reference, so such a group never matches
    return g.where(set_in("label_set", sets) & (F.col("_nn") == 0)).drop("_nn")


# D5
def resolve_cross_class_conflicts(df: DataFrame, passes, key: str = "text", label: str = "target") -> DataFrame:
    """Each pass: find groups whose label set is one of ``sets`` and drop the rows of those
    groups labelled with one of ``drop``. Later passes see the reduced table.

    What every pass does to a group follows from its set of labels alone, so one aggregate by the
    key's 128-bit hash works out all labels a group loses, and one join applies them. Rows with a
    null key, and groups with a null label, lose nothing.
    """
    labels = f"array<{df.schema[label].dataType.simpleString()}>"
    hashed = F.md5(F.col(key).cast("string"))
    groups = (df.where(F.col(key).isNotNull()).groupBy(hashed.alias("_h"))
                .agg(F.array_sort(F.collect_set(label)).alias("_left"), F.count_if(F.col(label).isNull()).alias("_nn"))
                .where(F.col("_nn") == 0).select("_h", "_left", F.array().cast(labels).alias("_gone")))
    for sets, drop in passes:
        gone = F.when(set_in("_left", sets), F.array(*[F.lit(v) for v in drop])).otherwise(F.array()).cast(labels)
        groups = groups.select("_h", F.array_except("_left", gone).alias("_left"), F.array_union("_gone", gone).alias("_gone"))
    groups = groups.where(F.size("_gone") > 0).select("_h", "_gone")
    kept = df.withColumn("_h", hashed).join(groups, "_h", "left")
    return kept.where(~F.coalesce(F.array_contains("_gone", F.col(label)), F.lit(False))).select(*df.columns)


# D6
def assert_no_conflicts(df: DataFrame, sets, key: str = "text", label: str = "target",
                        raise_on_fail: bool = False) -> DataFrame:
    """Expectation table: (set_name, n_groups) — must be all zeros after D5."""
    found = find_cross_class_conflicts(df, sets, key, label)
    names = [",".join(str(v) for v in sorted(s)) for s in sets]
    res = found.select(F.array_join(F.col("label_set").cast("array<string>"), ",").alias("set_name"))
    spark = df.sparkSession
    expected = spark.createDataFrame([(n,) for n in names], "set_name string")
    out = (expected.join(res.groupBy("set_name").agg(F.count(F.lit(1)).alias("n_groups")), "set_name", "left")
                   .select("set_name", F.coalesce("n_groups", F.lit(0)).alias("n_groups")))
    if raise_on_fail and out.where("n_groups > 0").limit(1).count() > 0:
        raise AssertionError("label conflicts remain")
    return out


# D7
def union_corpora(a: DataFrame, b: DataFrame, order_col: str = "doc_id", index: str = "idx") -> DataFrame:
    """Append by column name (missing columns null) and give a new 0-based index: rows of
    ``a`` first, then ``b``, each in ``order_col`` order (unique within a corpus). Only the
    order key is sorted; the texts are joined to their number once."""
    from tessera.operators.indexing import dense_index
    u = a.withColumn("_src", F.lit(0)).unionByName(b.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    n = dense_index(u.select("_src", F.col(order_col).alias("_order")), ["_src", "_order"], index)
    n = n.withColumnRenamed("_src", "_n_src")
    j = u.join(n, (F.col("_src") == F.col("_n_src")) & F.col(order_col).eqNullSafe(F.col("_order")))
    return j.drop("_src", "_n_src", "_order")


# D8
def dedup_report(before: DataFrame, after: DataFrame, by) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    b = before.groupBy(*by).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(*by).agg(F.count(F.lit(1)).alias("n_after"))
    return (b.join(a, by, "full_outer")
             .select(*by, F.coalesce("n_before", F.lit(0)).alias("n_before"),
                     F.coalesce("n_after", F.lit(0)).alias("n_after")))
