"""Driver contract: entry smoke, registry shape."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["term", "mean_tfidf"] and 0 < len(rows) <= 20


def test_registry_shape():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) > 100
    assert all(callable(f) for f in qs.values())
