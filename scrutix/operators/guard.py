r"""Steering text in reviews and conversations, and risky changes in patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: (name, category, pattern) ---------------------------------

STEERING = (
    ("prompt_injection_ignore_instructions", "prompt", r"(?i)\b(ignore|disregard|forget)\s+(all\s+)?(previous|prior|above)\s+instructions\b"),
    ("prompt_injection_system_prompt", "prompt", r"(?i)\b(system|developer)\s+prompt\b|\bact\s+as\s+(?:a|an)\b"),
    ("automation_bypass_request", "prompt", r"(?i)\b(do\s+not|don't|dont)\s+(flag|detect|report|scan|review)\b"),
    ("hidden_review_instruction", "prompt", r"(?i)<!--[\s\S]*?(ignore|disregard|do\s+not\s+review|do\s+not\s+flag)[\s\S]*?-->"),
)
CHANGES = (
    ("placeholder_implementation", "slop", r"(?md)^\s*(pass|\.\.\.|raise\s+NotImplementedError\b|return\s+None\s*(?:#.*)?$)"),
    ("silent_exception_swallow", "security", r"(?msd)except\s+(?:Exception\b|BaseException\b|:).*?\n\s*(?:pass|return\s+(?:None|True|False)|continue)\b"),
    ("test_disable_marker", "quality", r"(?i)\b(?:pytest\.mark\.skip|describe\.skip|it\.skip|test\.skip|xtest|xit)\b"),
    ("type_safety_escape", "quality", r"(?i)\b(?:type:\s*ignore|#\s*noqa|pylint:\s*disable|as\s+any|:\s*any\b)"),
    ("dangerous_exec_eval", "security", r"(?i)\b(?:eval|exec)\s*\(|subprocess\.(?:call|run|Popen)\s*\([^\n]*(?:shell\s*=\s*True)"),
)
SEVERITY = {"prompt": "high", "security": "high", "slop": "medium", "quality": "medium"}


def added_lines(patch: Column) -> Column:
    """The added lines of a unified diff; other text as it is."""
    lines = F.split(patch, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    is_diff = F.exists(lines, lambda x: x.startswith("+") | x.startswith("@@"))
    added = F.transform(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substring(x, F.lit(2), F.length(x)))
    return F.when(is_diff, F.array_join(added, "\n")).otherwise(patch)


def evidence(text: Column, pattern: str, radius: int = 80) -> Column:
    """The first match with its surroundings on one line, dots where it is cut."""
    before = F.get(F.split(text, pattern, 2), F.lit(0))
    match = F.regexp_extract(text, pattern, 0)
    start = F.length(before)
    left, right = F.greatest(start - radius, F.lit(0)), F.least(start + F.length(match) + radius, F.length(text))
    part = F.trim(F.regexp_replace(F.substring(text, left + 1, right - left), r"\s+", " "))
    return F.concat(F.when(left > 0, "...").otherwise(""), part, F.when(right < F.length(text), "...").otherwise(""))


def signals(text: Column, patterns) -> Column:
    """Array of (name, category, severity, evidence), the first match of each pattern."""
    items = (F.when(text.rlike(p), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(SEVERITY[c]).alias("severity"), evidence(text, p).alias("evidence"))) for n, c, p in patterns)
    return F.filter(F.array(*items), lambda s: s.isNotNull())


def scan_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("guard", signals(F.coalesce(text_col, F.lit("")), STEERING))


def scan_reviews(df: DataFrame) -> DataFrame:
    """``df`` (title, body, patch) with ``guard``: steering in the text, then risks of the change."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    df = df.withColumns({"_said": text, "_added": added_lines(F.coalesce("patch", F.lit("")))})
    return df.withColumn("guard", F.concat(signals(F.col("_said"), STEERING), signals(F.col("_added"), CHANGES))).drop("_said", "_added")
