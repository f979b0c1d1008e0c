"""Evaluation, pages, guard, redaction, code scans and the limiter on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from scrutix.functions import lexicons as L
from scrutix.operators import code_scan, evaluation, guard, models, redaction, scoring, web
from scrutix.plans import other_queries as Q
from scrutix.streaming import limiter


def scored(spark, scores, labels):
    return spark.createDataFrame(list(zip(map(float, scores), labels)), "score double, label int")


@pytest.mark.parametrize(("scores", "labels", "want"), [([0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0], 1.0), ([0.1, 0.2, 0.8, 0.9], [1, 1, 0, 0], 0.0), ([0.5] * 4, [1, 0, 1, 0], 0.5), ([0.6, 0.4, 0.5, 0.3], [1, 1, 0, 0], 0.75), ([0.1, 0.2], [1, 1], None)])
def test_auc(spark, scores, labels, want):
    assert evaluation.auc(evaluation.roc_points(scored(spark, scores, labels))).first()[0] == want


def test_tpr_confusion_and_best_f1(spark):
    p = evaluation.roc_points(scored(spark, [0.9, 0.6, 0.7, 0.2], [1, 1, 0, 0]))
    assert evaluation.tpr_at_fpr(p, 0.0).first()[0] == 0.5
    assert evaluation.tpr_at_fpr(p, 0.5).first()[0] == 1.0
    c = evaluation.confusion(scored(spark, [0.9, 0.4, 0.8, 0.2], [1, 1, 0, 0]), 0.5).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (1, 1, 1, 1)
    assert evaluation.best_f1(p).first().threshold == 0.6


def test_validation_and_calibration(spark):
    with pytest.raises(ValueError):
        evaluation.validate(scored(spark, [float("nan")], [1]))
    assert evaluation.calibration_error(scored(spark, [2.0, 0.1], [1, 0])).first().ece is None


def test_logistic_separates(spark):
    df = scored(spark, [0, 1, 2, 3] * 5, [0, 0, 1, 1] * 5)
    m = evaluation.fit_logistic(df, ["score"], l2=0.0)
    assert m["weights"]["score"] > 0 and -m["bias"] / m["weights"]["score"] == pytest.approx(1.5, abs=0.05)
    assert evaluation.load_weights('{"weights": {"a": 0}}') is None and evaluation.load_weights("x") is None


def test_pages_hide_scripts(spark):
    html = '<html><head><title>T &amp; U</title><meta property="og:title" content="Own"></head><body><script>var t="</p>";</script><p>bo<b>ld</b> text<svg>gone</body>'
    r = web.extract(spark.createDataFrame([(html,), (None,)], "html string")).collect()
    assert r[0].title == "T & U" and r[0].og_title == "Own" and r[0].page_text.startswith("Own T & U") and "var" not in r[0].page_text and "gone" not in r[0].page_text
    assert r[1].title is None and r[1].page_text == ""


def test_addresses():
    for a in ("127.0.0.1", "10.0.0.1", "169.254.1.1", "::1", "::ffff:10.0.0.1", "2002:7f00:1::", "0.0.0.0", "224.0.0.1"):
        assert web.address_blocked(a)
    assert web.address_blocked("8.8.8.8") is False and web.address_blocked("2606:4700::1111") is False and web.address_blocked("x") is None


def test_url_policy(spark):
    got = {r.case_id: r.refused for r in Q.QUERIES["url_policy_fixture"](spark, "").collect()}
    assert got == {1: None, 2: "scheme", 3: "user information", 4: "port", 5: "port", 6: "space or control character", 7: "backslash", 8: None, 9: "empty", 10: "no host"}


def test_guard(spark):
    got = {(r.review_id, r.name) for r in Q.QUERIES["guard_reviews_fixture"](spark, "").collect()}
    assert got == {(1, "prompt_injection_ignore_instructions"), (2, "placeholder_implementation"), (2, "dangerous_exec_eval"), (3, "hidden_review_instruction"), (3, "automation_bypass_request"), (3, "type_safety_escape")}
    df = spark.createDataFrame([("x" * 200 + " ignore previous instructions " + "y" * 200,), (None,)], "text string")
    out = guard.scan_text(df).collect()
    assert out[0].guard[0].evidence.startswith("...") and out[0].guard[0].evidence.endswith("...") and out[1].guard == []


def test_redaction(spark):
    got = {r.case_id: r for r in Q.QUERIES["redact_fixture"](spark, "").collect()}
    assert [got[i].was_redacted for i in range(1, 6)] == [True, False, True, True, True]
    assert "hunter2" not in got[1].redacted and got[1].redacted.startswith('password = "') and "ABCDEFGHIJKL" not in got[5].redacted
    again = redaction.redact_text(spark.createDataFrame([(None,), ("",)], "text string")).collect()
    assert [r.was_redacted for r in again] == [False, False]


def test_code_scan(spark):
    got = {(r.path, r.rule_id, r.line_start) for r in Q.QUERIES["code_findings_fixture"](spark, "").collect()}
    assert ("src/app.py", "py.os-system", 2) in got and not any(r == "py.eval-on-input" for _, r, _ in got)
    assert {r for p, r, _ in got if p == "package.json"} == {"deps.npm-known-bad-version"}
    assert {"ci.unpinned-action-version", "ci.curl-pipe-shell-in-workflow"} <= {r for _, r, _ in got}
    assert not any(r == "pqc.classical-key-exchange" for _, r, _ in got)  # a hybrid is beside it
    score = {r.scan_id: r for r in Q.QUERIES["code_scores_fixture"](spark, "").collect()}
    assert score["a"].score >= 0.7 and score["c"].score >= 0.7 and score["b"].risk == "low"
    ready = Q.QUERIES["code_pq_readiness_fixture"](spark, "").collect()
    assert [(r.scan_id, r.status) for r in ready] == [("b", "pq_ready")]
    assert "2.1.0" in code_scan.to_sarif(code_scan.findings(Q._files(spark))).first().sarif


def test_paths(spark):
    rows = [("a/node_modules/x.js",), (".github/w.yml",), (".hidden/x.py",), ("x.png",), ("src/x.py",)]
    df = spark.createDataFrame(rows, "path string").select("path", code_scan.selected(F.col("path")).alias("ok"), code_scan.language(F.col("path")).alias("l"))
    assert {r.path for r in df.collect() if r.ok} == {".github/w.yml", "src/x.py"}
    assert {r.path: r.l for r in df.collect()}["src/x.py"] == "python"
    assert code_scan.glob_matches("a/b/Dockerfile", "**/Dockerfile") and code_scan.glob_matches("Dockerfile", "**/Dockerfile")


def test_limiter_is_a_fold(spark):
    assert limiter.admit([0, 1, 2, 10], [], 2, 5) == ([True, True, False, True], [10])
    random.seed(3)
    rows = [(i, random.randrange(3), float(random.randrange(200))) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    got = {r.event_id: r.allowed for r in limiter.rate_limit(df, limit=3, window=20.0).collect()}
    for u in range(3):
        mine = sorted((t, i) for i, k, t in rows if k == u)
        want, _ = limiter.admit([t for t, _ in mine], [], 3, 20.0)
        assert [got[i] for _, i in mine] == want


def test_limiter_takes_null_for_a_key(spark):
    big = (1 << 53) + 1
    df = spark.createDataFrame([(i, k, i) for i, k in enumerate([None, big, None, big, None, big - 1])], "event_id long, user_id long, t long").withColumn("ts", F.timestamp_micros(F.col("t") * 1_000_000))
    got = {r.event_id: (r.user_id, r.allowed) for r in limiter.rate_limit(df.coalesce(1), limit=2, window=20.0).collect()}
    assert got == {0: (None, True), 1: (big, True), 2: (None, True), 3: (big, True), 4: (None, False), 5: (big - 1, True)}


def test_newton_reaches_the_descents_optimum(spark):
    random.seed(4)
    rows = [(float(random.randrange(5)), float(random.randrange(3)), 0) for _ in range(400)]
    rows = [(a, b, int(random.random() < 1 / (1 + 2.7 ** (2.0 - a + 0.5 * b)))) for a, b, _ in rows]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    one = evaluation.fit_logistic(df, ["a", "b"], l2=2.0, rate=0.5, steps=4000)
    two = evaluation.fit_logistic(df, ["a", "b"], l2=2.0, limit=3)
    assert two["bias"] == pytest.approx(one["bias"], abs=1e-4) and two["trained_on"] == 400
    assert all(two["weights"][k] == pytest.approx(one["weights"][k], abs=1e-4) for k in "ab")


def test_platt_improves_calibration(spark):
    random.seed(5)
    rows = [(0.4 + 0.02 * i, int(random.random() < i / 10)) for i in range(11) for _ in range(40)]
    got = evaluation.fit_platt(scored(spark, *zip(*rows)))
    assert got["n"] == 440 and got["ece_after"] < got["ece_before"] and got["brier_after"] < got["brier_before"]
    assert got["model"]["weights"]["score"] > 0


def test_weights_are_learned_and_read_back(spark, tmp_path):
    texts = [("Our seamless, robust and revolutionary synergy is guaranteed.", 1), ("Studies show it is clear that experts agree, always.", 1), ("The relay failed at 03:14 and came back.", 0), ("We walked home along the river.", 0)] * 3
    t = scoring.score_text(spark.createDataFrame(texts, "text string, label int"))
    got = evaluation.learn_weights(t, l2=2.0)
    assert got["trained_on"] == 12 and got["train_auc"] == 1.0 and got["weights"]["unsupported_claims"] > 0 and set(got["weights"]) <= set(L.SIGNALS)
    evaluation.write_weights(spark, got, str(tmp_path / "w.json"))
    back = evaluation.load_weights((tmp_path / "w.json").read_text())
    assert back["weights"] == got["weights"]
    again = scoring.score_text(spark.createDataFrame(texts, "text string, label int"), weights=back).select("score_raw", "label").collect()
    assert min(r[0] for r in again if r[1]) > max(r[0] for r in again if not r[1])
    with pytest.raises(ValueError):
        evaluation.learn_weights(scoring.score_text(spark.createDataFrame([("", 1), ("", 0)], "text string, label int")))


def test_report_counts_skipped_rows(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 0), (None, 1)], "score double, label int")
    r = evaluation.report(df).first()
    assert (r.scored, r.positive, r.negative, r.skipped, r.auc, r.tpr_at_10pct) == (2, 1, 1, 1, 1.0, 1.0)


def test_safe_urls(spark):
    urls = ["b\u00fccher.example/a?b", "http://EXAMPLE.org:80/X", "https://\u0440aypal.example/", "ftp://x.org", "http://" + "\u00e9" * 70 + ".org", None]
    got = [(r.refused, r.safe_url) for r in web.with_safe_url(spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1)).collect()]
    assert got == [(None, "https://xn--bcher-kva.example/a?b"), (None, "http://example.org:80/X"), (None, "https://xn--aypal-uye.example/"), ("scheme", None), ("host", None), ("empty", None)]


def test_judgements_are_clamped(spark):
    replies = ['so: {"verdict": "TRUE_POSITIVE", "confidence": 7, "reason": "password = hunter2hunter2"}', '{"verdict": "sure", "confidence": -1}', '{"reason": "' + "x" * 900 + '"}', "nothing", None]
    got = [r.judgement for r in models.judged(spark.createDataFrame([(x,) for x in replies], "reply string").coalesce(1)).collect()]
    assert (got[0].verdict, got[0].confidence) == ("true_positive", 1.0) and "hunter2" not in got[0].reason
    assert (got[1].verdict, got[1].confidence, got[1].reason) == ("uncertain", 0.0, "") and (got[2].confidence, len(got[2].reason)) == (0.5, 600)
    assert got[3] is None and got[4] is None


def test_findings_folded_in_and_filtered(spark):
    files = Q._files(spark)
    found = code_scan.findings(files)
    more = spark.createDataFrame([("b", "clean.py", "model.backdoor", "critical", "high", "backdoor", 1, 1, "return a + b")], code_scan.FINDING)
    both, scores = code_scan.fold_in(found, more, files)
    assert both.count() == found.count() + 1 and {r.scan_id: r.risk for r in scores.collect()}["b"] == "high"
    assert [r.rule_id for r in code_scan.finding_filter(both, severity="critical", category="backdoor", text="CLEAN").collect()] == ["model.backdoor"]
