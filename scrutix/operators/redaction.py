r"""Redaction of credentials: a keyed placeholder for every secret value.

Native: a value's placeholder needs its hash, so matches and the gaps between
them (a split on the same pattern) are joined anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrutix.functions.text import sealed

# --- fixed values: patterns in order of application; group 1 stays, group 2 goes

PEM = r"-----BEGIN (?:RSA |EC |OPENSSH |PGP |DSA )?PRIVATE KEY( BLOCK)?-----[\s\S]*?-----END"
ASSIGNED = r"(?i)((?:password|passwd|pwd|secret|api[_\-]?key|token|access[_\-]?token)[\"' ]*[:=][\"' ]*)([A-Za-z0-9!@#$%^&*()_+=\-/]{6,})"
KEY_VALUE = r"(?md)^([A-Z][A-Z0-9_]{2,}\s*=\s*)([A-Za-z0-9_+/=\-]{10,})\s*$"
VENDOR = (
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"(?<=[\"' :=])[A-Za-z0-9/+=]{40}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    r"\bxox[abprs]-[0-9A-Za-z\-]{10,}\b",
    r"\bsk_(?:live|test)_[A-Za-z0-9]{16,}\b",
    r"\bAIza[0-9A-Za-z\-_]{35}\b",
    r"\bsk-(?:proj-)?[A-Za-z0-9_\-]{20,}\b",
    r"\bsk-ant-[A-Za-z0-9_\-]{20,}\b",
    r"\beyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{16,}\b",
)


def placeholder(value: Column) -> Column:
    """First and last four characters of long values and a short hash."""
    mark = F.concat(F.lit("[REDACTED_SECRET:sha256:"), F.substring(F.sha2(value, 256), 1, 12), F.lit("]"))
    return F.when(F.length(value) >= 12, F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4)), F.lit(" "), mark)).otherwise(mark)


def _replace(df: DataFrame, pattern: str, keep_prefix: bool) -> DataFrame:
    hit = F.col("_t").rlike(pattern)
    none = F.array().cast("array<string>")
    group = lambda k: F.when(hit, F.regexp_extract_all("_t", F.lit(pattern), F.lit(k))).otherwise(none)
    df = df.withColumns({"_m": group(2 if keep_prefix else 0), "_p": group(1) if keep_prefix else none, "_g": F.when(hit, F.split("_t", pattern, -1)).otherwise(none)})
    put = lambda i: F.concat(F.get("_g", i), F.coalesce(F.get("_p", i), F.lit("")), placeholder(F.get("_m", i)))
    new = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size("_m") - 1), put), ""), F.get("_g", F.size("_m")))
    return df.withColumns({"_t": F.when(hit, new).otherwise(F.col("_t")), "_hit": F.col("_hit") | hit}).drop("_m", "_p", "_g")


def redact_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``redacted`` and ``was_redacted``."""
    t = F.coalesce(text_col, F.lit(""))
    df = df.withColumns({"_hit": t.rlike(PEM), "_t": F.regexp_replace(t, PEM, "[REDACTED_PRIVATE_KEY_BLOCK]")})
    for pattern, keep in ((ASSIGNED, True), (KEY_VALUE, True), *((p, False) for p in VENDOR)):
        df = _replace(df, pattern, keep)
    # a filter on the result stays above it
    return sealed(df.withColumnsRenamed({"_t": "redacted", "_hit": "was_redacted"}), ["redacted", "was_redacted"])
