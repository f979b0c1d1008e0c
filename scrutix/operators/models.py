"""Seams for external models: scores and judgements come in as columns or tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: midpoints and steepness of the maps to a likelihood
PERPLEXITY = (60.0, 20.0)
RATIO = (0.9, 0.04)
CLAMP = 60.0

PROVIDERS: dict = {}


def register(name: str, provider) -> None:
    """``provider(df)`` returns ``df`` with a nullable struct column ``model``."""
    PROVIDERS[name] = provider


def with_model(df: DataFrame, name: str | None = None) -> DataFrame:
    """The provider's judgement, or one that says it is unavailable."""
    if name in PROVIDERS:
        return PROVIDERS[name](df)
    return df.withColumn("model", F.struct(F.lit(name or "none").alias("method"), F.lit(False).alias("available"), F.lit(None).cast("double").alias("likelihood")))


def _falling(x: Column, midpoint: float, steepness: float) -> Column:
    z = F.greatest(F.least((x - midpoint) / steepness, F.lit(CLAMP)), F.lit(-CLAMP))
    return 1 / (1 + F.exp(z))


def perplexity(log_probs: Column) -> Column:
    """Perplexity of an array of token log probabilities; null when empty."""
    total = F.aggregate(log_probs, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(log_probs) > 0, F.exp(F.least(-total / F.size(log_probs), F.lit(CLAMP))))


def perplexity_likelihood(c: Column) -> Column:
    return _falling(c, *PERPLEXITY)


def ratio_likelihood(observer: Column, cross: Column) -> Column:
    """Likelihood from the ratio of a model's entropy to a cross entropy; null without one."""
    return F.when(cross > 0, _falling(observer / cross, *RATIO))


def first_json(text: str | None) -> str | None:
    """The first JSON object of a reply, else its first array; null if there is none."""
    decoder = json.JSONDecoder()
    for opening in "{[":
        at = (text or "").find(opening)
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
                return json.dumps(value)
            except ValueError:
                at = text.find(opening, at + 1)
    return None


def with_first_json(df: DataFrame, column: str = "reply") -> DataFrame:
    import pandas as pd

    def pick(s):
        return s.map(first_json)

    pick.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return df.withColumn("json", F.pandas_udf(pick, "string")(F.col(column)))


VERDICTS = ("true_positive", "false_positive", "uncertain")
MAX_REASON = 600


def judgement(reply_json: Column) -> Column:
    """Struct (verdict, confidence, reason) from a judge's JSON.

    A verdict that isn't known is ``uncertain``, confidence lies in [0, 1]
    (0.5 where none is given) and the reason is cut.
    """
    r = F.from_json(reply_json, "verdict string, confidence double, reason string")
    verdict = F.lower(F.trim(r["verdict"]))
    confidence = F.when(F.isnan(r["confidence"]), None).otherwise(r["confidence"])
    return F.when(
        reply_json.isNotNull(),
        F.struct(
            F.when(verdict.isin(*VERDICTS), verdict).otherwise("uncertain").alias("verdict"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.5)))).alias("confidence"),
            F.left(F.coalesce(r["reason"], F.lit("")), F.lit(MAX_REASON)).alias("reason"),
        ),
    )


def judged(df: DataFrame, column: str = "reply") -> DataFrame:
    """``df`` with ``judgement`` from a model's reply, credentials in its reason redacted."""
    from .redaction import redact_text

    out = with_first_json(df, column).withColumn("judgement", judgement(F.col("json")))
    out = redact_text(out.withColumn("_reason", F.col("judgement.reason")), "_reason")
    return out.withColumn("judgement", F.when(F.col("judgement").isNotNull(), F.col("judgement").withField("reason", F.col("redacted")))).drop("json", "_reason", "redacted", "was_redacted")


def verified(findings: DataFrame, judgements: DataFrame) -> DataFrame:
    """Findings with a model's verdict by (path, rule, line); null where it gave none."""
    key = ["path", "rule_id", "line_start"]
    one = judgements.groupBy(*key).agg(F.max(F.struct("verdict", "confidence")).alias("judgement"))
    return findings.join(one, key, "left")
