"""Conflict detection / resolution and de-duplication (FIXTURES C1, C2)."""

from tessera.operators import dedup as D


def test_polarity_conflicts(spark):
    data = [(1, "t1", "S", 0), (2, "t1", "S", 1),            # {0,1} -> conflict
            (3, "t2", "S", 0),                               # {0}
            (4, "t3", "S", 1), (5, "t3", "S", 1),            # {1,1}
            (6, "t4", "S", None), (7, "t4", "S", 0), (8, "t4", "S", 1),  # {0, 1, null} is not {0, 1}
            (9, None, "S", 0), (10, None, "S", 1)]                         # null key: no group
    df = spark.createDataFrame(data, "doc_id int, text string, sentiment string, polarity int")
    got = sorted(r.text for r in D.find_polarity_conflicts(df).collect())
    assert got == ["t1"]
    res = D.resolve_polarity_conflicts(df, [("S", 1)])
    assert sorted(r.doc_id for r in res.collect()) == [1, 3, 4, 5, 6, 7, 8, 9, 10]


def test_cross_class_exact_sets(spark):
    data = [(1, "a", 0), (2, "a", 2), (3, "b", 1), (4, "b", 5), (5, "c", 0), (6, "c", 1), (7, "c", 2),
            (8, "d", 0), (9, "d", 2), (10, "d", 4)]
    df = spark.createDataFrame(data, "doc_id int, text string, target int")
    found = sorted(r.text for r in D.find_cross_class_conflicts(df, [{0, 2}, {1, 5}]).collect())
    assert found == ["a", "b"]                 # {0,1,2} and {0,2,4} are not exact matches
    with_null = df.unionByName(spark.createDataFrame([(11, "a", None)], "doc_id int, text string, target int"))
    assert sorted(r.text for r in D.find_cross_class_conflicts(with_null, [{0, 2}, {1, 5}]).collect()) == ["b"]
    res = D.resolve_cross_class_conflicts(df, [([{0, 2}, {1, 5}], [0, 1])])
    assert sorted(r.doc_id for r in res.collect()) == [2, 4, 5, 6, 7, 8, 9, 10]
    check = D.assert_no_conflicts(res, [{0, 2}, {1, 5}])
    assert all(r.n_groups == 0 for r in check.collect())


def test_keep_first_is_ordered(spark):
    data = [(5, "x", "S", 1), (2, "x", "S", 0), (9, "y", "S", 1)]
    df = spark.createDataFrame(data, "doc_id int, text string, sentiment string, polarity int").repartition(3)
    got = sorted((r.doc_id, r.polarity) for r in D.dedup_keep_first(df).collect())
    assert got == [(2, 0), (9, 1)]


def test_cross_class_passes_equal_one_by_one(spark):
    import random
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *"abcdefghijkl"]), rng.choice([0, 1, 2, 3, 3, None] if i % 5 == 0 else [0, 1, 2, 3])) for i in range(60)]
    passes = [([[0, 1], [0, 1, 2], [1, 3]], [0, 3]), ([[1, 2], [1]], [1, 2]), ([[2]], [2])]
    want = rows
    for sets, drop in passes:
        groups = {}
        for _, k, v in want:
            groups.setdefault(k, set()).add(v)
        want = [r for r in want if r[1] is None or r[2] not in drop or sorted(groups[r[1]], key=lambda v: (v is None, v)) not in sets]
    df = spark.createDataFrame(rows, "doc_id long, text string, target int")
    got = D.resolve_cross_class_conflicts(df, passes)
    assert got.columns == df.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and 0 < len(want) < len(rows)
    assert D.resolve_cross_class_conflicts(df.limit(0), passes).count() == 0
