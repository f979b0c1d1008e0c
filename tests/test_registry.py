"""The driver's entry points."""

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1 and df.columns == ["doc_id", "score_raw", "risk", "n_signals"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark):
    q, d = entry.queries(), "/root/testdata/sf0.001"
    rows = lambda name: sorted(map(tuple, q[name](spark, d).collect()))
    assert rows("stream_score_documents") == rows("text_score")
