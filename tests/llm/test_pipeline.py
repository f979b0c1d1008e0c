"""The pipeline stage by stage on small tables."""

import corpus_pipeline as P
from pyspark.sql import functions as F
from scrutix.llm import pii, setsketch
from scrutix.llm.common import materialize

SF = "/root/testdata/sf0.01"  # labels enough to train on


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns, name
        seen.append(docs)
    good, unique, clean, mixed = seen
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lost = spark.read.parquet(f"{SF}/documents.parquet").join(good.select("doc_id"), "doc_id", "left_anti").join(labels, "doc_id")
    kept = good.join(labels, "doc_id")
    assert lost.filter("quality = 1").count() <= 0.03 * kept.count() and kept.filter("quality = 0").count() <= 3
    assert setsketch.near_duplicates(unique, P.SHINGLE, P.PERCENT).filter(~F.col("kept")).isEmpty()
    spans = pii.find_spans(clean)
    assert spans.filter(" OR ".join(f"size(base_{k}) > 0" for k in pii.BASE)).isEmpty()
    assert mixed.select("doc_id").distinct().count() == clean.count() <= mixed.count()
    pieces = P.STAGES[-1][1](spark, mixed, SF)
    assert pieces.agg(F.count_distinct("doc_id")).first()[0] == clean.count()


def test_awkward_documents(spark):
    rows = [(None, "kept without an id", "en", None, 1, 1.0), (1, None, "en", "s", 0, 1.0), (2, "", "en", "s", 0, 1.0), (3, "same words in this text here", "en", "s", 1, 1.0), (3, "same words in this text here", "en", "s", 1, 1.0), (4, "same words in this text here", "en", "t", 1, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept double")
    out = P.near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 2, 3, None]
    assert P.near_duplicates(spark, docs.filter("false"), SF).count() == 0
    pieces = P.pack(spark, P.target_weights(spark, P.personal_data(spark, out, SF), SF), SF)
    assert {r.doc_id for r in pieces.collect()} == {1, 2, 3, None}  # small sources may be read twice


def test_texts_that_share_an_id_both_stay(spark):
    one, other = "the river runs past the old mill and on to the sea", "a quite different story about trains, snow and long winters"
    rows = [(5, one), (5, other), (6, one), (None, other), (None, "only here, without any id at all, but kept")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, SF).collect()), key=str)
    assert out == sorted([(5, one), (5, other), (None, rows[4][1])], key=str)


def test_stages_on_clashing_names_and_empty_tables(spark):
    names = ["_quality", "n", "row", "epoch", "block", "tokens", "ssn_m", "_r", "_row", "_s", "cls", "node", "component_id", "part", "order_key"]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, t, "en", s, 1, *("keep",) * len(names)) for i, t, s in ((1, "plain words for a start", "a"), (2, "mail me at a.b@c.de", "b"), (3, None, None))], schema)
    for name, stage in P.STAGES[:-1]:
        for table in (docs, docs.filter("false")):
            out = stage(spark, table, SF)
            assert out.schema.names == docs.columns, name
            rows = out.collect()
            assert all(r[n] == "keep" for r in rows for n in names) and (rows or table is not docs or name == "quality classifier"), name
    assert P.pack(spark, docs, SF).count() >= 3 and P.pack(spark, docs.filter("false"), SF).count() == 0
    assert {r.text for r in P.personal_data(spark, docs, SF).collect()} == {"plain words for a start", "mail me at [EMAIL]", None}
