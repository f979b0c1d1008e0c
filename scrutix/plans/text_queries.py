"""Queries of the text engine and the DuckDB SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrutix.functions import lexicons as L
from scrutix.functions import text as T
from scrutix.operators import scoring
from scrutix.sources.tables import documents_of, table

# --- SQL side ----------------------------------------------------------------

_W = r"[\p{L}\p{N}_]"
_WORD = rf"{_W}(?:[\p{{L}}\p{{N}}_''\-]*{_W})?"
_WS = r"[\s\x0b\x1c-\x1f\p{Z}]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(terms) -> str:
    return "(" + ", ".join(_q(t) for t in terms) + ")"


def _freq(tokens: str, least: str) -> str:
    return f"coalesce(len(list_filter(map_values(list_histogram({tokens})), lambda v: v >= {least})), 0)"


def _phrases(phrases) -> str:
    return "(" + " + ".join(f"(length(low) - length(replace(low, {_q(p)}, ''))) // {len(p)}" for p in phrases) + ")"


def _base(source: str = "documents", keys: str = "doc_id") -> str:
    """CTEs up to ``m``: the statistics of every row of ``source``."""
    curly = "".join(L.CURLY)
    return f"""
t AS (SELECT {keys}, coalesce(text, '') AS raw FROM {source}),
n AS (SELECT *, trim(regexp_replace(regexp_replace(translate(translate(raw, {_q(T._FOLD_FROM + T._STRIP)}, {_q(T._FOLD_TO)}), {_q(curly)}, {_q("".join(L.CURLY.values()))}), '[—–]', ' - ', 'g'), '{_WS}+', ' ', 'g')) AS norm FROM t),
w AS (SELECT *, lower(norm) AS low, regexp_extract_all(norm, '{_WORD}') AS cased,
      list_filter(list_transform(regexp_split_to_array(norm, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS sents FROM n),
v AS (SELECT *, list_transform(cased, lambda x: lower(x)) AS words, list_transform(sents, lambda x: len(regexp_extract_all(x, '{_WORD}'))) AS lens FROM w),
c AS (SELECT *, list_filter(words, lambda x: x NOT IN {_in(L.STOPWORDS)}) AS content,
      list_filter(list_transform(sents, lambda x: regexp_extract_all(lower(x), '{_WORD}')[1:2]), lambda x: len(x) = 2) AS starts FROM v),
d AS (SELECT *, list_filter(content, lambda x: length(x) > 4) AS longs, list_filter(content, lambda x: length(x) > 5) AS longer FROM c),
m AS (SELECT *, len(words) AS word_count, len(sents) AS sentence_count, len(list_distinct(words)) AS distinct_words,
      coalesce(list_avg(lens), 0) AS avg_sentence_length,
      len(regexp_extract_all(raw, '(?i)https?://\\S+|www\\.\\S+')) AS link_count,
      len(regexp_extract_all(raw, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])\\d+(?:[.,:/\\-]\\d+)*(?:%|x|ms|s|m|h|kb|mb|gb|tb)?(?:\\b|%)')) AS number_count,
      len(regexp_extract_all(raw, '(?i)\\[\\d+(?:[\\s,\\-]\\d+)*\\]|\\([A-Z][A-Za-z .\\-]+,\\s*\\d{{4}}\\)|\\bdoi:\\s*\\S+|\\b10\\.\\d{{4,9}}/\\S+')) AS citation_count,
      length(raw) - length(translate(raw, '—–', '')) AS dash_count,
      len(list_filter(words, lambda x: x IN {_in(L.TRANSITIONS)})) AS transition_count,
      len(list_filter(words, lambda x: x IN {_in(L.CLAIM_VERBS + L.UNSUPPORTED_CLAIMS)})) AS claim_count,
      {_freq('longs', '4')} AS repetition_count,
      CASE WHEN len(content) >= 9 THEN {_freq("list_transform(range(1, len(content) - 1), lambda i: content[i] || chr(1) || content[i + 1] || chr(1) || content[i + 2])", '3')} ELSE 0 END AS trigram_repeats,
      CASE WHEN len(longs) > 0 THEN (len(longs) - len(list_distinct(longs))) / len(longs) ELSE 0 END AS repetition_density,
      CASE WHEN len(longer) >= 40 THEN {_freq('longer', 'greatest(5, (len(longer) + 19) // 20)')} ELSE 0 END AS keyword_stuffing,
      CASE WHEN len(sents) >= 4 THEN {_freq("list_transform(starts, lambda x: x[1] || ' ' || x[2])", '3')} ELSE 0 END AS repeated_starts,
      CASE WHEN len(lens) >= 5 AND list_avg(lens) > 0 THEN list_aggregate(lens, 'stddev_pop') / list_avg(lens) ELSE -1 END AS burstiness,
      CASE WHEN len(content) >= 50 THEN list_avg(list_transform(range(1, len(content) - 48), lambda i: len(list_distinct(content[i:i + 49])) / 50)) ELSE -1 END AS moving_ttr,
      len(regexp_extract_all(raw, '(?m)^\\s{{0,3}}#{{1,6}}\\s+\\S')) AS headers,
      len(regexp_extract_all(raw, '\\*\\*[^*\\n]{{1,60}}\\*\\*')) AS bold_runs,
      len(regexp_extract_all(raw, '(?m)^\\s*(?:[-*]\\s+)?(?:✅|❌|✨|•|\\x{{1F449}}|\\x{{1F539}}|\\x{{1F4A1}}|\\x{{1F680}}|➡|⭐)')) AS emoji_bullets
      FROM d)"""


_TRIAD = rf"(?i)({_W}+(?:{_WS}{_W}+){{0,2}}),{_WS}+({_W}+(?:{_WS}{_W}+){{0,2}}),{_WS}+(?:and|or){_WS}+({_W}+(?:{_WS}{_W}+){{0,2}})"
_TECH = r"regexp_matches({x}, '\d') OR (regexp_matches({x}, '^\p{{L}}+$') AND {x} = upper({x}) AND length({x}) <= 6)"
_TRIADS = "len(list_filter(range(1, len(a1) + 1), lambda i: NOT (" + " OR ".join(_TECH.format(x=f"a{k}[i]") for k in (1, 2, 3)) + ")))"
_SPECIFIC_SQL = (
    r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    r"(?i)\b(?:[0-9a-f]{1,4}:){2,7}[0-9a-f]{1,4}\b",
    r"(?i)\b(?:port|tcp|udp)\s*[:#]?\s*\d{1,5}\b",
    r"(?i)\bCVE-\d{4}-\d{4,7}\b",
    r"(?i)\b[0-9a-f]{40}\b|\b[0-9a-f]{64}\b",
    r"\b(?:19|20)\d{2}-\d{2}-\d{2}\b|\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}",
    r"(?i)\b[a-z0-9][a-z0-9\-]+\.(?:com|org|net|io|ai|dev|gov|edu|uk|de|fr|jp|cn|au|ca)\b",
    r"https?://\S+",
    r"(?:^|\s)/[\p{L}\p{N}_\-./]+|\b[A-Za-z]:\\[\w\-\\.]+",
    r"\bv?\d+\.\d+(?:\.\d+){0,2}\b",
    r"\b[A-Z]{2,8}-\d{3,6}\b|\b#\d{3,6}\b",
    r"(?i)\b\d+(?:\.\d+)?\s*(?:ms|s|min|h|hour|hours|day|days|MB|GB|TB|KB|kbps|mbps|gbps|%)\b",
)
_CONCRETE = r"len(list_filter(cased, lambda x: regexp_matches(x, '\p{Nd}') OR regexp_matches(x, '^\p{Lu}.*\p{Lu}')))"
_SPECIFICITY = f"CASE WHEN word_count > 0 THEN least(({_CONCRETE} + " + " + ".join(f"len(regexp_extract_all(raw, '{p}'))" for p in _SPECIFIC_SQL) + ") / word_count, 1.0) ELSE 0 END"


_CONTRAST_SQL = (
    rf"(?i)\b(?:it'?s|that'?s|this is|we'?re|they'?re|you'?re)?{_WS}*not{_WS}+(?:just|only|merely|simply)\b[^.!?]{{1,80}}?(?:,{_WS}*(?:it'?s|it{_WS}+is|that'?s|that{_WS}+is|but rather|but)\b|{_WS}-{_WS}|;{_WS}*(?:it'?s|it{_WS}+is)\b)",
    rf"(?i)\bnot{_WS}+[^.!?,]{{2,40}}{_WS}*-{_WS}*(?:it'?s|but|rather)\b",
)
_CONTRAST = "(" + " + ".join(f"len(regexp_extract_all(norm, {_q(p)}))" for p in _CONTRAST_SQL) + ")"
_CLAIM_SQL = r"(?i)\b(?:" + "|".join(t.replace("-", r"\-") for t in (*L.CLAIM_VERBS, *L.UNSUPPORTED_CLAIMS)) + r")\b"
_EVIDENCE_SQL = rf"\b\p{{Nd}}|https?://|CVE-\p{{Nd}}{{4}}-\p{{Nd}}|doi:|\[\p{{Nd}}+\]|\([A-Z][a-z]+,{_WS}*\p{{Nd}}{{4}}\)|\b[A-Z][a-zA-Z]+(?:{_WS}[A-Z][a-zA-Z]+)*{_WS}(?:Inc|LLC|Ltd|Corp|Co|GmbH|University|Institute|Foundation|Labs?|Agency|Department|Commission|Association|Consortium)\b"
_BARE = f"len(list_filter(range(1, len(sents) + 1), lambda i: regexp_matches(sents[i], {_q(_CLAIM_SQL)}) AND NOT regexp_matches(concat_ws(' ', sents[i], sents[i + 1]), {_q(_EVIDENCE_SQL)})))"
_HAS_SCRIPT = lambda x: f"regexp_matches(x, '{x}')::INT"
_SCRIPTS = rf"{_HAS_SCRIPT('[A-Za-zÀ-ÖØ-öø-ɏ]')} + {_HAS_SCRIPT(r'[\x{370}-\x{3FF}\x{1F00}-\x{1FFF}]')} + {_HAS_SCRIPT(r'[\x{400}-\x{52F}]')} > 1"
_EVASIONS = f"(length(raw) - length(translate(raw, {_q(''.join(map(chr, L.INVISIBLE + L.BIDI)))}, '')) + len(list_filter(regexp_extract_all(raw, '{_W}+'), lambda x: {_SCRIPTS})))"


def _act(n: str) -> str:
    return f"(CASE WHEN {n} <= 1 THEN 1.0 ELSE least(1 + 0.5 * ({n} - 1), 4.0) END)"


def _signals(profile: str = "general") -> dict[str, tuple[str, str, float]]:
    """For each signal: (condition, count, weight)."""
    term = lambda t: f"len(list_filter(words, lambda x: x IN {_in(t)}))"
    lexical = {"vague_language": term(L.VAGUE_TERMS), "unsupported_claims": term(L.UNSUPPORTED_CLAIMS), "unsupported_claim_phrases": _phrases(L.UNSUPPORTED_PHRASES), "filler_phrases": _phrases(L.FILLER_PHRASES), "template_or_ai_scars": _phrases(L.TEMPLATE_PHRASES), "seo_or_clickbait_phrases": _phrases(L.SEO_PHRASES), "frontier_rhetoric": _phrases(L.RHETORIC_PHRASES)}
    conditions = {
        "transition_word_stuffing": ("word_count >= 100 AND transition_count >= 4 AND transition_count / word_count >= 0.015", "transition_count"),
        "em_dash_overuse": ("dash_count >= 4 AND word_count >= 60 AND dash_count / greatest(word_count / 100, 1.0) >= 1", "dash_count"),
        "evasion_obfuscation": ("evasions > 0", "evasions"),
        "contrastive_negation": ("word_count >= 40 AND contrast_count >= 2", "contrast_count"),
        "unsupported_claim_sentences": ("word_count >= 50 AND bare_claims >= greatest(2, sentence_count // 4)", "bare_claims"),
        "rule_of_three": ("word_count >= 60 AND triad_count >= 3", "triad_count"),
        "over_structuring": ("word_count >= 80 AND (headers >= 4)::INT + (bold_runs >= 6)::INT + (emoji_bullets >= 3)::INT >= 2", "headers + bold_runs + emoji_bullets"),
        "repetitive_terms": ("repetition_count > 0", "repetition_count"),
        "repeated_phrases": ("word_count >= 80 AND trigram_repeats > 0", "trigram_repeats"),
        "long_sentences": ("avg_sentence_length > 28", "1"),
        "low_burstiness": ("word_count >= 80 AND burstiness >= 0 AND burstiness < 0.30", "1"),
        "low_specificity": ("word_count >= 40 AND specificity_ratio < 0.10", "1"),
        "evidence_gap": ("word_count >= 60 AND claim_count / word_count >= 0.030 AND (link_count + number_count + citation_count) / word_count < 0.020", "1"),
        "keyword_stuffing": ("keyword_stuffing > 0", "keyword_stuffing"),
        "repeated_sentence_starts": ("repeated_starts > 0", "repeated_starts"),
        "low_vocabulary_diversity": ("word_count >= 80 AND moving_ttr > 0 AND moving_ttr < 0.45", "1"),
    }
    out = {}
    for name, (_, weight) in L.SIGNALS.items():
        if name in lexical:
            out[name] = (f"({lexical[name]}) > 0", f"({lexical[name]})", weight)
        elif name in conditions:
            out[name] = (*conditions[name], weight)
    return {k: (c, n, round(w * L.PROFILES[profile].get(k, 1.0), 4)) for k, (c, n, w) in out.items()}


def _scored(source: str = "documents", keys: str = "doc_id, lang, source", profile: str = "general") -> str:
    """CTEs up to ``scored``: score_raw, score, risk and n_signals."""
    s = _signals(profile)
    total = " + ".join(f"(CASE WHEN {c} THEN {w} * {_act(n)} ELSE 0 END)" for c, n, w in s.values())
    n = " + ".join(f"({c})::INT" for c, _, _ in s.values())
    return f"""{_base(source, keys)},
tri AS (SELECT *, regexp_extract_all(norm, '{_TRIAD}', 1) AS a1, regexp_extract_all(norm, '{_TRIAD}', 2) AS a2, regexp_extract_all(norm, '{_TRIAD}', 3) AS a3 FROM m),
full_m AS (SELECT *, {_TRIADS} AS triad_count, {_SPECIFICITY} AS specificity_ratio, {_CONTRAST} AS contrast_count, {_BARE} AS bare_claims, {_EVASIONS} AS evasions FROM tri),
raw_score AS (SELECT *, CASE WHEN word_count > 0 THEN least({total} + least(word_count / 800, 0.08), 1.0) ELSE 0 END AS score_raw, CAST({n} AS BIGINT) AS n_signals FROM full_m),
scored AS (SELECT *, CASE WHEN round(score_raw, 3) >= 0.6 THEN 'high' WHEN round(score_raw, 3) >= 0.3 THEN 'moderate' ELSE 'low' END AS risk FROM raw_score)"""


# --- Spark side --------------------------------------------------------------


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return T.with_metrics(T.with_text(documents_of(spark, d)))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_text(documents_of(spark, d))


def _r(name: str):
    return (F.round(name, 6) + 0.0).alias(name)


def _columns(*names: str):
    return lambda spark, d: metrics(spark, d).select("doc_id", *(_r(n) if n in _DOUBLES else F.col(n) for n in names))


_DOUBLES = {"avg_sentence_length", "evidence_density", "repetition_density", "burstiness", "moving_ttr", "specificity_ratio"}


def _sql(*items: str) -> str:
    return f"WITH {_base()} SELECT doc_id, {', '.join(items)} FROM m"


def _round(x: str) -> str:
    return f"round({x}, 6) + 0.0 AS {x}"


def tokens_profile(spark: SparkSession, d: str) -> DataFrame:
    m = T.with_metrics(T.with_text(documents_of(spark, d)))
    return m.select("doc_id", "word_count", "sentence_count", F.size(F.array_distinct("_words")).cast("long").alias("distinct_words"), _r("avg_sentence_length"))


#: Own wording, with planted terms: (id, text).
FIXTURE = (
    (1, "Our seamless, robust and cutting-edge ecosystem will leverage synergy. It is guaranteed and proven, always."),
    (2, "Everyone knows this; studies show it. Needless to say, it is important to note the bottom line."),
    (3, "As an AI language model I hope this helps! In conclusion, here's the thing: let's dive in, let's explore."),
    (4, "Click here for the ultimate guide: top tips, must-read. Keep reading, here's why you rank higher."),
    (5, "Moreover it rained. However it stopped. Therefore we left. Indeed we improve, reduce and prevent losses."),
    (6, "The relay failed at 03:14; see https://example.org/a and [12]. Restarted in 40 ms."),
    (7, "It’s worth noting — “game changer” – at its core. Plot twist: buckle up."),
    (8, ""),
)
EVASIVE = (
    (1, "plain words only"),
    (2, "in​vis­ible and ‮bidi⁦ text"),
    (3, "pаypal and Аpple with lοok-alikes"),
    (4, "привет κόσμε hello"),
    (5, "no break　spaces"),
)


_SYLLABLES = ("ba", "de", "fi", "go", "lu", "ma", "ne", "po", "ra", "si")


def _plain(n: int, start: int = 0) -> list[str]:
    """``n`` distinct words of six letters."""
    return ["".join(_SYLLABLES[(start + i) // 10**k % 10] for k in range(3)) for i in range(n)]


def _said(words: list[str], lengths=(7, 13, 9, 17, 5, 11)) -> str:
    """Words as sentences of varied lengths."""
    out, at, k = [], 0, 0
    while at < len(words):
        n = lengths[k % len(lengths)]
        out.append(" ".join(words[at : at + n]) + ".")
        at, k = at + n, k + 1
    return " ".join(out)


def _thresholds() -> list[tuple[int, str]]:
    """Texts just below and at the thresholds of every signal that isn't a mere list of phrases."""
    with_extra = lambda n, extra: _said([*extra, *_plain(n - len(extra))])
    texts = [
        *(with_extra(n, L.TRANSITIONS[:k]) for n, k in ((100, 4), (100, 3), (99, 4))),
        *(_said(_plain(n)) + " —" * k for n, k in ((60, 4), (60, 3), (59, 4))),
        *(_said(_plain(n - 4 * k)) + " Not only lume, but rano." * k for n, k in ((40, 2), (40, 1), (38, 2))),
        *(_said(_plain(n)) + " Lume, rano, and sibo." * k for n, k in ((60, 3), (60, 2))),
        *("\n".join(["# Lume"] * h + ["**rano**"] * b + [_said(_plain(80))]) for h, b in ((4, 6), (3, 6), (4, 5))),
        *(_said(_plain(2 * n), (n,)) for n in (29, 28)),
        *(_said(_plain(84), k) for k in ((12,), (2, 22, 4, 30))),
        *(_said([*_plain(40 - k), *["7"] * k]) for k in (0, 3, 4)),
        _said(_plain(39)),
        *(_said([*L.CLAIM_VERBS[:k], *_plain(60 - k)]) + " www.lume.example" * w for k, w in ((2, 0), (1, 0), (2, 1), (2, 2))),
        *(" ".join(f"{v} {_said(_plain(24, 30 * i))}" for i, v in enumerate(verbs)) for verbs in (L.CLAIM_VERBS[:3], L.CLAIM_VERBS[:1], ("improve 7", "reduce 8", "solve 9"))),
        *(_said([*["fibago"] * k, *_plain(40 - k, 500)]) for k in (5, 4, 3)),
        *(" ".join(["Lume rano " + " ".join(_plain(5, 9 * i)) + "." for i in range(k)] + [" ".join(_plain(6, 100 + 9 * i)) + "." for i in range(5 - k)]) for k in (3, 2)),
        *(_said(_plain(30) * k) for k in (2, 3, 4)),
        *(_said(_plain(v) * 5) for v in (22, 23)),
        *(_said(_plain(80)) + x for x in (" lu\u200bme", " l\u043eme", " \u202elume", "")),
    ]
    return list(enumerate(texts, 100))


def _values(rows) -> str:
    return "(VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in rows) + ") AS f(case_id, text)"


def _fixture(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), "case_id int, text string")


_LEXICAL = {"vague_language": L.VAGUE_TERMS, "unsupported_claims": L.UNSUPPORTED_CLAIMS, "unsupported_claim_phrases": L.UNSUPPORTED_PHRASES, "filler_phrases": L.FILLER_PHRASES, "template_or_ai_scars": L.TEMPLATE_PHRASES, "seo_or_clickbait_phrases": L.SEO_PHRASES, "frontier_rhetoric": L.RHETORIC_PHRASES}


def lexicon_fixture(spark: SparkSession, d: str) -> DataFrame:
    m = T.with_metrics(T.with_text(_fixture(spark, FIXTURE)))
    _, lexical = scoring.conditions()
    return m.select("case_id", *(v.alias(k) for k, v in lexical.items()), "transition_count", "claim_count", "dash_count", "link_count", "number_count", "citation_count")


def evasion_fixture(spark: SparkSession, d: str) -> DataFrame:
    return _fixture(spark, EVASIVE).select("case_id", T.evasion(F.col("text")).alias("e")).select("case_id", "e.*")


def score_fixture(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.score_text(_fixture(spark, FIXTURE))
    return out.select("case_id", (F.round("score_raw", 6) + 0.0).alias("score_raw"), "risk", F.size("signals").cast("long").alias("n_signals"))


def signals_fixture(spark: SparkSession, d: str) -> DataFrame:
    """Every signal that fires on texts at the thresholds, with its count."""
    out = scoring.score_text(_fixture(spark, [*FIXTURE, *_thresholds()])).select("case_id", F.explode_outer("signals").alias("s"))
    return out.filter("s IS NOT NULL").select("case_id", F.col("s.name").alias("name"), F.col("s.count").alias("hits"))


def claims_fixture(spark: SparkSession, d: str) -> DataFrame:
    m = T.with_metrics(T.with_text(_fixture(spark, [*FIXTURE, *_thresholds()])))
    return m.select("case_id", _r("claim_density"), "bare_claims", "contrast_count")


def text_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("doc_id", (F.round("score_raw", 6) + 0.0).alias("score_raw"), "risk", F.size("signals").cast("long").alias("n_signals"))


def text_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("doc_id", F.explode_outer("dimensions").alias("x")).select("doc_id", F.col("x.name").alias("dimension"), F.col("x.score").alias("score"), F.col("x.status").alias("status"))


def signal_rows(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("doc_id", F.explode_outer("signals").alias("s")).filter("s IS NOT NULL").groupBy("s.name").agg(F.count("*").alias("docs"), F.sum("s.count").alias("hits")).select("name", "docs", "hits")


def profile_compare(spark: SparkSession, d: str) -> DataFrame:
    """Every document under each profile: one pass over tokens, five scores."""
    m = T.sealed(T.with_metrics(T.with_text(documents_of(spark, d), seal=True)), T.METRICS)
    m = m.withColumn("profile", F.explode(F.array(*map(F.lit, L.PROFILES))))
    out = scoring.with_signals(m, "profile")
    return out.select("profile", scoring.rule_score(F.col("signals"), F.col("word_count")).alias("s")).groupBy("profile").agg(F.count("*").alias("docs"), F.round(F.avg("s"), 4).alias("mean_score"), F.round(F.max("s"), 6).alias("max_score"))


def risk_rollup(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("lang", "risk").agg(F.count("*").alias("docs"), F.round(F.avg("score_raw"), 4).alias("mean_score"))


def risk_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("docs"), F.count_if(F.col("risk") == "high").alias("high"))


def top_per_lang(spark: SparkSession, d: str) -> DataFrame:
    """The ten highest scores of each language: a partial top-k for each salt first, so no language is sorted in one task."""
    from pyspark.sql import Window

    s = scored(spark, d).select("lang", "doc_id", F.round("score_raw", 6).alias("s"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("salt"))
    near = s.withColumn("k", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(F.desc("s"), "doc_id"))).filter("k <= 10")
    top = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("s"), "doc_id"))).filter("place <= 10")
    return top.select("lang", F.col("place").cast("long").alias("place"), "doc_id", (F.col("s") + 0.0).alias("score_raw"))


def corpus_duplicates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").groupBy("text").agg(F.count("*").alias("n"))
    return t.agg(F.sum("n").alias("rows"), F.count("*").alias("texts"), F.sum(F.col("n") - 1).alias("repeats"))


QUERIES = {
    "text_tokens_profile": tokens_profile,
    "text_evidence_counts": _columns("link_count", "number_count", "citation_count", "evidence_density"),
    "text_repetition": _columns("repetition_count", "repetition_density"),
    "text_trigram_repeats": _columns("trigram_repeats"),
    "text_keyword_stuffing": _columns("keyword_stuffing"),
    "text_sentence_starters": _columns("repeated_starts"),
    "text_burstiness": _columns("burstiness"),
    "text_moving_ttr": _columns("moving_ttr"),
    "text_structure": lambda s, d: metrics(s, d).select("doc_id", "structure.*", "dash_count"),
    "text_triads": _columns("triad_count"),
    "text_specificity": _columns("specificity_ratio"),
    "text_lexicon_fixture": lexicon_fixture,
    "text_evasion_fixture": evasion_fixture,
    "text_score_fixture": score_fixture,
    "text_signals_fixture": signals_fixture,
    "text_claims_fixture": claims_fixture,
    "text_score": text_score,
    "text_dimensions": text_dimensions,
    "text_signals": signal_rows,
    "text_profile_compare": profile_compare,
    "risk_by_lang": risk_rollup,
    "risk_grouping_sets": risk_grouping_sets,
    "risk_top_per_lang": top_per_lang,
    "corpus_duplicates": corpus_duplicates,
}

def _fired(keys: str) -> str:
    """A row for each signal that fires: ``keys``, name, n."""
    items = ", ".join(f"{{'name': '{k}', 'n': CASE WHEN {c} THEN CAST({n} AS BIGINT) END}}" for k, (c, n, _) in _signals().items())
    return f"SELECT {keys}, s.name AS name, s.n AS n FROM (SELECT {keys}, unnest([{items}]) AS s FROM scored) WHERE s.n IS NOT NULL"


def _dimension(name: str) -> str:
    """A category's unrounded sum over its base."""
    base = {
        "evidence": "greatest(0.0, 0.20 - least(round(CASE WHEN word_count > 0 THEN (link_count + number_count + citation_count) / word_count ELSE 0 END, 3), 0.20))",
        "specificity": "greatest(0.0, 0.20 - least(round(specificity_ratio, 3), 0.20))",
        "originality": "least(round(repetition_density, 3) * 1.2, 0.35)",
    }.get(name, "0.0")
    parts = [f"(CASE WHEN {c} THEN {w} * {_act(n)} ELSE 0 END)" for k, (c, n, w) in _signals().items() if L.SIGNALS[k][0] == name]
    return " + ".join([f"CAST({base} AS DOUBLE)", *parts])


_DIMENSIONS = ", ".join(f"{{'name': '{k}', 'raw': round({_dimension(k)}, 9)}}" for k in L.DIMENSIONS)
_FOLDED = {"invisible_chars": "".join(map(chr, L.INVISIBLE)), "bidi_controls": "".join(map(chr, L.BIDI)), "exotic_spaces": "".join(map(chr, L.EXOTIC_SPACES)), "confusable_chars": "".join(chr(x) for x, _ in L.HOMOGLYPHS)}
_HAS = lambda x: f"regexp_matches(x, '{x}')::INT"
_MIXED = rf"CAST(len(list_filter(regexp_extract_all(text, '{_W}+'), lambda x: {_HAS('[A-Za-zÀ-ÖØ-öø-ɏ]')} + {_HAS(r'[\x{370}-\x{3FF}\x{1F00}-\x{1FFF}]')} + {_HAS(r'[\x{400}-\x{52F}]')} > 1)) AS BIGINT)"

ORACLE_SQL = {
    "text_tokens_profile": _sql("word_count", "sentence_count", "distinct_words", _round("avg_sentence_length")),
    "text_evidence_counts": _sql("link_count", "number_count", "citation_count", "round(CASE WHEN word_count > 0 THEN (link_count + number_count + citation_count) / word_count ELSE 0 END, 6) + 0.0 AS evidence_density"),
    "text_repetition": _sql("repetition_count", _round("repetition_density")),
    "text_trigram_repeats": _sql("trigram_repeats"),
    "text_keyword_stuffing": _sql("keyword_stuffing"),
    "text_sentence_starters": _sql("repeated_starts"),
    "text_burstiness": _sql(_round("burstiness")),
    "text_moving_ttr": _sql(_round("moving_ttr")),
    "text_structure": _sql("headers", "bold_runs", "emoji_bullets", "dash_count"),
    "text_triads": f"WITH {_scored()} SELECT doc_id, triad_count FROM scored",
    "text_specificity": f"WITH {_scored()} SELECT doc_id, round(specificity_ratio, 6) + 0.0 AS specificity_ratio FROM scored",
    "text_lexicon_fixture": f"WITH {_base(_values(FIXTURE), 'case_id')} SELECT case_id, " + ", ".join(f"CAST({_signals()[k][1]} AS BIGINT) AS {k}" for k in _LEXICAL) + ", transition_count, claim_count, dash_count, link_count, number_count, citation_count FROM m",
    "text_evasion_fixture": "SELECT case_id, " + ", ".join(f"length(text) - length(translate(text, {_q(v)}, '')) AS {k}" for k, v in _FOLDED.items()) + f", {_MIXED} AS mixed_script_words FROM {_values(EVASIVE)}",
    "text_score_fixture": f"WITH {_scored(_values(FIXTURE), 'case_id')} SELECT case_id, round(score_raw, 6) + 0.0 AS score_raw, risk, n_signals FROM scored",
    "text_score": f"WITH {_scored()} SELECT doc_id, round(score_raw, 6) + 0.0 AS score_raw, risk, n_signals FROM scored",
    "text_signals_fixture": f"WITH {_scored(_values([*FIXTURE, *_thresholds()]), 'case_id')} SELECT case_id, name, n AS hits FROM ({_fired('case_id')})",
    "text_claims_fixture": f"WITH {_scored(_values([*FIXTURE, *_thresholds()]), 'case_id')} SELECT case_id, round(CASE WHEN word_count > 0 THEN claim_count / word_count ELSE 0 END, 6) + 0.0 AS claim_density, bare_claims, contrast_count FROM scored",
    "text_signals": f"WITH {_scored()} SELECT name, count(*) AS docs, CAST(sum(n) AS BIGINT) AS hits FROM ({_fired('doc_id')}) GROUP BY name",
    "text_dimensions": f"WITH {_scored()} SELECT doc_id, x.name AS dimension, round(least(x.raw, 1.0), 3) AS score, CASE WHEN x.raw >= 0.45 THEN 'elevated' WHEN x.raw >= 0.18 THEN 'review' ELSE 'clean' END AS status FROM (SELECT doc_id, unnest([{_DIMENSIONS}]) AS x FROM scored)",
    "text_profile_compare": "WITH all_p AS (" + " UNION ALL ".join(f"SELECT '{p}' AS profile, score_raw FROM (WITH {_scored(profile=p)} SELECT score_raw FROM scored)" for p in L.PROFILES) + ") SELECT profile, count(*) AS docs, round(avg(score_raw), 4) AS mean_score, round(max(score_raw), 6) AS max_score FROM all_p GROUP BY profile",
    "risk_by_lang": f"WITH {_scored()} SELECT lang, risk, count(*) AS docs, round(avg(score_raw), 4) AS mean_score FROM scored GROUP BY ALL",
    "risk_grouping_sets": f"WITH {_scored()} SELECT lang, source, count(*) AS docs, count(*) FILTER (WHERE risk = 'high') AS high FROM scored GROUP BY GROUPING SETS ((lang), (source), ())",
    "risk_top_per_lang": f"WITH {_scored()}, k AS (SELECT lang, doc_id, round(score_raw, 6) + 0.0 AS score_raw, row_number() OVER (PARTITION BY lang ORDER BY round(score_raw, 6) DESC, doc_id) AS place FROM scored) SELECT lang, place, doc_id, score_raw FROM k WHERE place <= 10",
    "corpus_duplicates": "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS texts, CAST(sum(n - 1) AS BIGINT) AS repeats FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)",
}
