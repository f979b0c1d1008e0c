"""The text engine against a row-wise model in plain Python and hand-made cases."""

import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scrutix.functions import lexicons as L
from scrutix.functions import text as T
from scrutix.operators import scoring
from scrutix.plans import text_queries
from scrutix.sources.tables import documents_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"\b[\w'\-]+\b")


def model(raw: str) -> dict:
    """An independent reading of the statistics, for texts without exotic characters."""
    norm = re.sub(r"\s+", " ", raw.replace("—", " - ").replace("–", " - ")).strip()
    words = WORD.findall(norm.lower())
    sents = [s.strip() for s in re.split(r"[.!?]+", norm) if s.strip()]
    lens = [len(WORD.findall(s)) for s in sents]
    content = [w for w in words if w not in L.STOPWORDS]
    longs, longer = [w for w in content if len(w) > 4], [w for w in content if len(w) > 5]
    starts = Counter(" ".join(WORD.findall(s.lower())[:2]) for s in sents if len(WORD.findall(s)) > 1)
    grams = Counter(zip(content, content[1:], content[2:]))
    return {
        "word_count": len(words),
        "sentence_count": len(sents),
        "repetition_count": sum(c >= 4 for c in Counter(longs).values()),
        "trigram_repeats": sum(c >= 3 for c in grams.values()) if len(content) >= 9 else 0,
        "keyword_stuffing": sum(c >= 5 and c / len(longer) >= 0.05 for c in Counter(longer).values()) if len(longer) >= 40 else 0,
        "repeated_starts": sum(c >= 3 for c in starts.values()) if len(sents) >= 4 else 0,
        "burstiness": statistics.pstdev(lens) / statistics.mean(lens) if len(lens) >= 5 and sum(lens) else -1.0,
        "moving_ttr": statistics.mean(len(set(content[i : i + 50])) / 50 for i in range(len(content) - 49)) if len(content) >= 50 else -1.0,
    }


def test_statistics_match_the_model(spark):
    rows = T.with_metrics(T.with_text(documents_of(spark, SF))).select("doc_id", "text", *model("a b.").keys()).collect()
    assert len(rows) >= 200
    for r in rows:
        for k, v in model(r["text"]).items():
            assert r[k] == pytest.approx(v, abs=1e-9), (r["doc_id"], k)


def names(spark, text, profile="general"):
    df = spark.createDataFrame([(text, profile)], "text string, profile string")
    r = scoring.score_text(df, profile_col="profile").select("signals", "score", "risk", "dimensions").first()
    return {s["name"] for s in r["signals"]}, r


def test_empty_and_null_texts(spark):
    for text in ("", None):
        fired, r = names(spark, text)
        assert not fired and r["score"] == 0 and r["risk"] == "low"
        assert {d["name"]: d["score"] for d in r["dimensions"]}["evidence"] == pytest.approx(0.2)


def test_lexical_signals_fire(spark):
    fired, r = names(spark, "It’s worth noting that our seamless, robust ecosystem is guaranteed. Everyone knows this. Click here.")
    assert {"vague_language", "unsupported_claims", "unsupported_claim_phrases", "filler_phrases", "seo_or_clickbait_phrases"} <= fired
    assert r["risk"] == "high"


def test_obfuscation_never_lowers_a_score(spark):
    clean = "This seamless and robust platform is guaranteed."
    hidden = clean.replace("seamless", "sea​mless").replace("robust", "rоbust")
    a, b = names(spark, clean), names(spark, hidden)
    assert "evasion_obfuscation" in b[0] and b[1]["score"] >= a[1]["score"]


def test_profiles_soften(spark):
    text = "A seamless robust holistic dynamic powerful agile bespoke text."
    assert names(spark, text, "marketing")[1]["score"] < names(spark, text)[1]["score"]
    assert names(spark, text, "unknown")[1]["score"] == names(spark, text)[1]["score"]


def test_nfkc_reaches_only_rows_that_need_it(spark):
    df = spark.createDataFrame([("ｒｏｂｕｓｔ",), ("robust",), ("é",)], "text string")
    assert [r[0] for r in df.select(T.nfkc(F.col("text"))).collect()] == ["robust", "robust", "é"]


def test_activation(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (100,)], "n int")
    assert [r[0] for r in df.select(scoring.activation(F.col("n"))).collect()] == [1.0, 1.0, 2.0, 4.0]


def test_plans_stay_small(spark):
    """Texts, statistics and signals are written into a plan once, whatever is asked of the result."""
    out = scoring.score_text(spark.createDataFrame([("a", 1)], "text string, risk_2 int"))
    for df in (out, out.filter("risk = 'high' AND alert"), out.select(F.explode("dimensions").alias("d")).filter("d.status = 'review'"), out.filter("size(signals) > 1").groupBy("risk").count()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 400_000 and plan.count("Generate inline") <= 4


def test_every_signal_fires_on_the_thresholds(spark):
    rows = text_queries.signals_fixture(spark, "").collect()
    assert {r["name"] for r in rows} == set(L.SIGNALS)


def test_guards_cover_what_they_guard():
    import re
    import sys

    usual = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", T.USUAL))
    assert not usual.search(re.sub("[\x00-\x7f]", "", T._FOLD_FROM + T._STRIP + "".join(L.CURLY) + "—–"))
    spans = re.findall(r"\\x\{([0-9A-F]+)\}-\\x\{([0-9A-F]+)\}", T._unstable_class())
    assert not any(usual.match(chr(cp)) for a, b in spans for cp in range(int(a, 16), min(int(b, 16), sys.maxunicode) + 1))
