"""Sources / sinks round trips, label encoding, profiling and run-log helpers."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup as D
from tessera.operators import labels as L
from tessera.operators import profile as P
from tessera.operators import runs as R
from tessera.sources import files


def _tmp(name):
    return os.path.join(tempfile.mkdtemp(prefix="tessera-src-", dir="/tmp"), name)


def test_word_vector_text_round_trip(spark):
    v = spark.createDataFrame([("b", [0.5, -1.25]), ("a", [1.0, 2.0])], "word string, vector array<float>")
    path = files.write_word_vectors(v, _tmp("vec"))
    lines = sorted(spark.read.text(path).collect(), key=lambda r: r.value)
    assert [r.value for r in lines][0] == "2 2"                       # header: count and dimension
    back = {r.word: r.vector for r in files.read_word_vectors(spark, path).collect()}
    assert back == {"a": [1.0, 2.0], "b": [0.5, -1.25]}


def test_headerless_csv_keeps_first_row(spark):
    path = _tmp("csv")
    spark.createDataFrame([("x", 1), ("y", 0)], "t string, p int").coalesce(1).write.csv(path)
    df = files.read_headerless_csv(spark, path, ["text", "polarity"], ["polarity", "text"], schema="t string, p int")
    assert df.columns == ["polarity", "text"] and df.count() == 2


def test_csv_multiline_text(spark):
    path = _tmp("corpus")
    src = spark.createDataFrame([(1, 'line one\nline "two", three')], "doc_id long, text string")
    files.write_table(src, path, "csv")
    back = files.read_corpus_csv(spark, path, "doc_id long, text string").first()
    assert back.text == 'line one\nline "two", three'


def test_create_target_sorted_codes(spark):
    df = spark.createDataFrame([(1, "VIOLENCE", 1), (2, "GENERAL", 0), (3, "GENERAL", 1)],
                               "id int, Sentiment string, Polarity int")
    out, classes = L.create_target(df, "Sentiment", "Polarity")
    assert {r.class_name: r.code for r in classes.collect()} == {"GENERAL_0": 0, "GENERAL_1": 1, "VIOLENCE_1": 2}
    assert {r.id: r.Target for r in out.collect()} == {1: 2, 2: 0, 3: 1}
    assert "Sentiment" not in out.columns


def test_collapse_and_strict_mapping(spark):
    df = spark.createDataFrame([(0,), (3,), (5,), (9,)], "t int")
    got = {r.t: (r.a, r.b) for r in L.collapse_labels(L.collapse_labels(df, "t", L.COLLAPSE_3, "null", "a"),
                                                       "t", L.COLLAPSE_4, "passthrough", "b").collect()}
    assert got == {0: (0, 0), 3: (1, 2), 5: (2, 3), 9: (None, 9)}
    s = spark.createDataFrame([("General_1",), ("Violence_0",)], "lab string")
    assert sorted(r.lab for r in L.map_string_labels(s, ["lab"], L.STRING_LABELS).collect()) == [1, 4]
    bad = spark.createDataFrame([("Feedback_0",)], "lab string")
    try:
        L.map_string_labels(bad, ["lab"], L.STRING_LABELS).collect()
        raise AssertionError("expected failure on an unmapped label")
    except Exception as e:  # noqa: BLE001
        assert "unmapped label" in str(e)


def test_profile_and_drop_class_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "A"), (2, None), (3, "B")], "id int, s string")
    prof = {r.column_name: (r.non_null, r.n_rows) for r in P.profile(df).collect()}
    assert prof == {"id": (3, 3), "s": (2, 3)}
    assert sorted(r.id for r in P.drop_class(df, "s", "A").collect()) == [2, 3]


def test_union_new_index(spark):
    a = spark.createDataFrame([(5, "x"), (1, "y")], "doc_id long, text string")
    b = spark.createDataFrame([(0, "z")], "doc_id long, text string")
    u = D.union_corpora(a.withColumn("lang", F.lit("en")), b)
    assert [(r.idx, r.doc_id, r.lang) for r in u.orderBy("idx").collect()] == [(0, 1, "en"), (1, 5, "en"), (2, 0, None)]


def test_top_k_per_group_two_stage(spark):
    df = spark.createDataFrame([("a", i, float(i % 7)) for i in range(50)] + [("b", 100, 1.0)],
                               "g string, id int, v double").repartition(5)
    t = R.top_k(df, "v", 2, per="g", tie="id")
    got = sorted((r.g, r.id, r.rank) for r in t.collect())
    assert got == [("a", 6, 1), ("a", 13, 2), ("b", 100, 1)]


def test_read_trial_log_types_and_names(spark):
    from tessera.sources.files import TRIAL_LOG_SCHEMA
    names = [f.name for f in TRIAL_LOG_SCHEMA.fields]
    row = [0, 0.6384, 1700000000, "ck", True, 30, "t0", "2024-01-02_03-04-05", 1.0, 31.8, 7, "h", "ip", 31.8, 30,
           8, 64, "Adamax", 0.001, 30, "relu", 0.1, "/logs"]
    path = _tmp("trials.csv")
    with open(path, "w") as f:
        f.write(",".join(names) + "\n" + ",".join("true" if v is True else str(v) for v in row) + "\n")
    t = files.read_trial_log(spark, path).first()
    assert t.config_optimizer == "Adamax" and t.config_batch_size == 8 and t.f1 == 0.6384
    assert t.date_ts.strftime("%Y-%m-%d %H:%M:%S") == "2024-01-02 03:04:05"
    assert t.ts is not None


def test_csv_keeps_blanks_empty_and_null(spark):
    path = _tmp("fidelity")
    rows = [(1, "  lead and trail  "), (2, ""), (3, None), (4, 'a "quoted", one\nand\\N more'), (5, " ")]
    src = spark.createDataFrame(rows, "doc_id long, text string")
    files.write_table(src, path, "csv")
    assert sorted(tuple(r) for r in files.read_corpus_csv(spark, path, "doc_id long, text string").collect()) == rows


def test_appending_a_run_twice_keeps_one(spark):
    path = _tmp("metrics")
    a = spark.createDataFrame([("r1", "f1", 0.5), ("r2", "f1", 0.6)], "run string, metric string, value double")
    files.append_run_metrics(a, path)
    files.append_run_metrics(a.where("run = 'r1'"), path)
    assert sorted(tuple(r) for r in files.read_run_metrics(spark, path).collect()) == [("r1", "f1", 0.5), ("r2", "f1", 0.6)]


def test_folds_appended_one_by_one_all_stay(spark):
    path = _tmp("fold-metrics")
    made = [[("r1", "fold", k, m, k + v) for m, v in (("f1", 0.5), ("recall", 0.25))] for k in range(1, 6)]
    for rows in made:
        files.append_run_metrics(spark.createDataFrame(rows, "run string, level string, fold int, metric string, value double"), path)
    files.append_run_metrics(spark.createDataFrame([("r1", "fold", 3, "f1", 9.0)], "run string, level string, fold int, metric string, value double"), path)
    folds = files.read_run_metrics(spark, path)
    parent = files.parent_metrics(folds)
    files.append_run_metrics(parent, path, "parent")
    files.append_run_metrics(parent, path, "parent")  # repeated after a lost answer
    got = sorted(((r.level, r.fold, r.metric, r.value, r.folds) for r in files.read_run_metrics(spark, path).collect()), key=str)
    want = [("fold", k, m, v, None) for k in (1, 2, 4, 5) for m, v in (("f1", k + 0.5), ("recall", k + 0.25))] + [("fold", 3, "f1", 9.0, None)]
    want += [("parent", None, "f1", (1.5 + 2.5 + 9 + 4.5 + 5.5) / 5, 5), ("parent", None, "recall", (1 + 2 + 4 + 5) / 4 + 0.25, 4)]
    assert got == sorted(want, key=str)


def test_an_append_without_its_marker_does_not_count(spark):
    import os
    path = _tmp("half-metrics")
    a = spark.createDataFrame([("r1", "f1", 0.5)], "run string, metric string, value double")
    files.append_run_metrics(a, path)
    half = f"{path}/append=000000001-dead"
    a.selectExpr("run", "metric", "9.0 AS value").write.parquet(half)
    os.remove(f"{half}/_SUCCESS")
    assert [r.value for r in files.read_run_metrics(spark, path).collect()] == [0.5]
    with pytest.raises(FileNotFoundError):
        files.read_run_metrics(spark, path + "/nothing")
