"""Signals, composite score, dimensions, risk and recommendation of a text table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrutix.functions import lexicons as L
from scrutix.functions import text as T

VERSION = "scrutix-rules-1"


def activation(n: Column) -> Column:
    """A further hit counts half; four hits' worth at most."""
    return F.when(n <= 1, 1.0).otherwise(F.least(1 + 0.5 * (n - 1), F.lit(4.0)))


def conditions() -> dict[str, tuple[Column, Column]]:
    """For each signal when it fires and its count, over ``with_metrics`` columns."""
    c = F.col
    n = c("word_count")
    term = lambda terms: F.size(T.among("_words", terms)).cast("long")
    phrase = lambda phrases: T.occurrences("_lower", phrases)
    one = F.lit(1).cast("long")
    ev = c("evasion.invisible_chars") + c("evasion.bidi_controls") + c("evasion.mixed_script_words")
    h, b, e = c("structure.headers"), c("structure.bold_runs"), c("structure.emoji_bullets")
    load = F.when(h >= 4, 1).otherwise(0) + F.when(b >= 6, 1).otherwise(0) + F.when(e >= 3, 1).otherwise(0)
    lexical = {
        "vague_language": term(L.VAGUE_TERMS),
        "unsupported_claims": term(L.UNSUPPORTED_CLAIMS),
        "unsupported_claim_phrases": phrase(L.UNSUPPORTED_PHRASES),
        "filler_phrases": phrase(L.FILLER_PHRASES),
        "template_or_ai_scars": phrase(L.TEMPLATE_PHRASES),
        "seo_or_clickbait_phrases": phrase(L.SEO_PHRASES),
        "frontier_rhetoric": phrase(L.RHETORIC_PHRASES),
    }
    other = {
        "transition_word_stuffing": ((n >= 100) & (c("transition_count") >= 4) & (c("transition_count") / F.greatest(n, one) >= 0.015), c("transition_count")),
        "em_dash_overuse": ((c("dash_count") >= 4) & (n >= 60) & (c("dash_count") / F.greatest(n / 100, F.lit(1.0)) >= 1.0), c("dash_count")),
        "evasion_obfuscation": (ev > 0, ev),
        "contrastive_negation": ((n >= 40) & (c("contrast_count") >= 2), c("contrast_count")),
        "rule_of_three": ((n >= 60) & (c("triad_count") >= 3), c("triad_count")),
        "over_structuring": ((n >= 80) & (load >= 2), h + b + e),
        "repetitive_terms": (c("repetition_count") > 0, c("repetition_count")),
        "repeated_phrases": ((n >= 80) & (c("trigram_repeats") > 0), c("trigram_repeats")),
        "long_sentences": (c("avg_sentence_length") > 28, one),
        "low_burstiness": ((n >= 80) & (c("burstiness") >= 0) & (c("burstiness") < 0.30), one),
        "low_specificity": ((n >= 40) & (c("specificity_ratio") < 0.10), one),
        "evidence_gap": ((n >= 60) & (c("claim_density") >= 0.030) & (c("evidence_density") < 0.020), one),
        "unsupported_claim_sentences": ((n >= 50) & (c("bare_claims") >= F.greatest(F.lit(2), F.floor(c("sentence_count") / 4))), c("bare_claims")),
        "keyword_stuffing": (c("keyword_stuffing") > 0, c("keyword_stuffing")),
        "repeated_sentence_starts": (c("repeated_starts") > 0, c("repeated_starts")),
        "low_vocabulary_diversity": ((n >= 80) & (c("moving_ttr") > 0) & (c("moving_ttr") < 0.45), one),
    }
    return {k: (c(f"_n_{k}") > 0, c(f"_n_{k}")) for k in lexical} | other, lexical


def _multiplier(profile: Column, signal: str) -> Column:
    m = F.lit(1.0)
    for name, table in L.PROFILES.items():
        if table.get(signal, 1.0) != 1.0:
            m = F.when(profile == name, table[signal]).otherwise(m)
    return m


def with_signals(df: DataFrame, profile_col: str | None = None) -> DataFrame:
    """Adds ``signals``: array of (name, category, weight, count) that fired, in fixed order."""
    profile = F.col(profile_col) if profile_col else F.lit("general")
    fires, lexical = conditions()
    df = df.withColumns({f"_n_{k}": v for k, v in lexical.items()})
    items = []
    for name, (category, weight) in L.SIGNALS.items():
        when, n = fires[name]
        w = F.round(F.lit(weight) * _multiplier(profile, name), 4)
        items.append(F.when(when, F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), w.cast("double").alias("weight"), n.cast("long").alias("count"))))
    return df.withColumn("signals", F.filter(F.array(*items), lambda s: s.isNotNull())).drop(*(f"_n_{k}" for k in lexical))


def _weighted(signals: Column) -> Column:
    return F.aggregate(signals, F.lit(0.0), lambda a, s: a + s["weight"] * activation(s["count"]))


def rule_score(signals: Column, words: Column) -> Column:
    """Unrounded additive score in [0, 1]."""
    return F.when(words > 0, F.least(_weighted(signals) + F.least(words / 800, F.lit(0.08)), F.lit(1.0))).otherwise(0.0)


def learned_score(signals: Column, words: Column, weights: dict) -> Column:
    """Logistic score from learned weights ``{"bias": b, "weights": {signal: w}}``."""
    z = F.lit(float(weights["bias"]))
    table = F.create_map(*(x for k, v in weights["weights"].items() for x in (F.lit(k), F.lit(float(v)))))
    z = z + F.aggregate(signals, F.lit(0.0), lambda a, s: a + F.coalesce(F.try_element_at(table, s["name"]), F.lit(0.0)) * activation(s["count"]))
    return F.when(words > 0, 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(60.0)), F.lit(-60.0))))).otherwise(0.0)


def risk_band(score: Column, high: float = 0.60, moderate: float = 0.30) -> Column:
    return F.when(score >= high, "high").when(score >= moderate, "moderate").otherwise("low")


def alert(score: Column, threshold: float = 0.60) -> Column:
    """Whether a score asks for attention."""
    return score >= threshold


def profile_of(domain: Column, profile: str = "general") -> Column:
    """The profile that a row's domain names, else ``profile``."""
    own = [p for p in L.PROFILES if p != "general"]
    return F.when(domain.isin(*own), domain).otherwise(profile)


def dimensions(signals: Column) -> Column:
    """Array of (name, score, status): category sums over bases from rounded densities."""
    base = {
        "evidence": F.greatest(F.lit(0.0), 0.20 - F.least(F.round("evidence_density", 3), F.lit(0.20))),
        "specificity": F.greatest(F.lit(0.0), 0.20 - F.least(F.round("specificity_ratio", 3), F.lit(0.20))),
        "originality": F.least(F.round("repetition_density", 3) * 1.2, F.lit(0.35)),
    }
    names = F.array(*map(F.lit, L.DIMENSIONS))
    bases = F.array(*(base.get(name, F.lit(0.0)).cast("double") for name in L.DIMENSIONS))
    # one pass over the signals for all categories
    add = lambda s: lambda x, name: F.when(s["category"] == name, x + s["weight"] * activation(s["count"])).otherwise(x)
    sums = F.aggregate(signals, bases, lambda a, s: F.zip_with(a, names, add(s)))
    status = lambda x: F.when(x >= 0.45, "elevated").when(x >= 0.18, "review").otherwise("clean")
    return F.zip_with(names, sums, lambda name, x: F.struct(name.alias("name"), F.round(F.least(x, F.lit(1.0)), 3).alias("score"), status(x).alias("status")))


def recommendation(risk: Column, dims: Column) -> Column:
    elevated = F.transform(F.filter(dims, lambda d: d["status"] == "elevated"), lambda d: d["name"])
    focus = F.when(F.size(elevated) > 0, F.concat(F.lit(" Look first at "), F.array_join(F.slice(elevated, 1, 3), ", "), F.lit("."))).otherwise("")
    text = F.when(risk == "high", "Have a person review this and ask for evidence, sources or specifics.").when(risk == "moderate", "Review before use; ask for concrete details and cut filler.")
    return F.coalesce(F.concat(text, focus), F.lit("Nothing notable was found; the usual review applies."))


def sample_quality(words: Column) -> Column:
    label = F.when(words < 30, "low").when(words < 150, "medium").otherwise("high")
    return F.struct(label.alias("label"), F.when(words < 30, 0.45).when(words < 150, 0.75).otherwise(1.0).alias("confidence"))


def score_text(df: DataFrame, text_col: str = "text", profile_col: str | None = None, weights: dict | None = None, unicode_forms: bool = True) -> DataFrame:
    """``df`` with metrics, signals, score, risk, dimensions and recommendation.

    One narrow pass without a shuffle.  ``weights`` switches to the learned
    score.  Texts, statistics and signals are sealed, so filters on results
    stay above them; dimensions and advice are pruned unless selected.
    """
    made = {*T.METRICS, "signals", "score_raw", "score", "risk", "dimensions", "sample_quality", "algorithm", "recommendation", "alert"}
    kept = [c for c in df.columns if c not in made]
    # input columns travel in a struct: their names can't meet the engine's
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(f"`{text_col}`").cast("string").alias("_text"), (F.col(f"`{profile_col}`") if profile_col else F.lit("general")).alias("_profile"))
    out = T.sealed(T.with_metrics(T.with_text(rows, "_text", unicode_forms, seal=True)), T.METRICS)
    out = with_signals(out, "_profile")
    raw = learned_score(F.col("signals"), F.col("word_count"), weights) if weights else rule_score(F.col("signals"), F.col("word_count"))
    out = T.sealed(out, ["signals"]).withColumn("score_raw", raw).withColumn("score", F.round("score_raw", 3))
    out = T.sealed(out, ["score_raw", "score"])
    out = out.withColumns({"risk": risk_band(F.col("score")), "alert": alert(F.col("score")), "dimensions": dimensions(F.col("signals")), "sample_quality": sample_quality(F.col("word_count")), "algorithm": F.lit(VERSION + ("+learned" if weights else ""))})
    out = out.withColumn("recommendation", recommendation(F.col("risk"), F.col("dimensions")))
    return out.select(*(F.col("_row").getField(c).alias(c) for c in kept), *T.METRICS, "signals", "score_raw", "score", "risk", "dimensions", "sample_quality", "algorithm", "recommendation", "alert")
