"""Source trees: file selection, rule findings, suppression, redaction and roll-ups."""

from __future__ import annotations

import fnmatch
import re
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import code_rules as R
from .redaction import redact_text

MARKER = "scrutix"
CONTEXT, SNIPPET, NEARBY = 60, 240, 240
FINDING = "scan_id string, path string, rule_id string, severity string, confidence string, category string, line_start int, line_end int, snippet string"


def language(path: Column) -> Column:
    """Language tag by suffix; ``text`` if unknown."""
    suffix = F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]+)$", 1))
    table = F.create_map(*(F.lit(x) for lang, suffixes in R.LANGUAGES.items() for s in suffixes.split() for x in (s, lang)))
    return F.coalesce(F.try_element_at(table, suffix), F.lit("text"))


def _pruned(path: Column) -> Column:
    """Whether a walk never descends to a path: skipped and dot folders."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.exists(folders, lambda f: f.isin(*R.SKIP_DIRS) | (f.startswith(".") & ~f.isin(*R.DOT_DIRS)))


def _matches(path: Column, globs: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(path.rlike(fnmatch.translate(g).replace(r"\Z", r"\z")), True) for g in globs), F.lit(False))


def selected(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether a walk would reach a path: skipped and dot folders, suffixes, user globs."""
    suffix = F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]+)$", 1))
    ok = ~_pruned(path) & ~suffix.isin(*R.SKIP_SUFFIXES)
    return ok & (_matches(path, include) if include else F.lit(True)) & ~(_matches(path, exclude) if exclude else F.lit(False))


def is_text(content: Column) -> Column:
    """No zero byte in the first 4096 and at least 70 % printable ASCII."""
    probe = F.hex(F.substring(content, 1, 4096))
    n = F.length(probe) / 2
    bytes_ = F.regexp_replace(probe, "(..)", "$1 ")
    printable = F.regexp_count(bytes_, F.lit("(?:09|0A|0D|[2-6][0-9A-F]|7[0-9A-E]) "))
    return (n == 0) | (~bytes_.rlike("(?:^| )00 ") & (printable / n >= 0.7))


WALK = "path string, reason string"
MAX_FILE, MAX_TOTAL, MAX_FILES = 1 << 20, 256 << 20, 25_000


def _relative(root: str) -> Column:
    """A listed file's path below ``root``; its name if ``root`` is the file itself."""
    if not root:
        return F.col("path")
    base = re.escape(re.sub(r"^[a-z]+:/+(?=/)", "", root).rstrip("/"))
    below = F.regexp_extract("path", f"^.*?{base}/(.*)$", 1)
    return F.when(below != "", below).otherwise(F.regexp_extract("path", "([^/]*)$", 1))


def walk(df: DataFrame, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_file: int = MAX_FILE, max_total: int = MAX_TOTAL, max_files: int = MAX_FILES) -> DataFrame:
    """``(path, reason)`` of a ``binaryFile`` table: why a file is skipped, null if it is taken.

    Files come in order of their paths.  One that would exceed ``max_total``
    bytes is skipped and smaller ones after it may still fit; after
    ``max_files`` the walk halts.  Files outside ``include``, pruned folders
    and empty files aren't listed.  The fold over (path, size) runs in one
    task, row by row; contents stay where they are.
    """
    import pyarrow as pa

    suffix = F.lower(F.regexp_extract("p", r"(?<=[^/])(\.[^./]+)$", 1))
    t = df.select(_relative(root).alias("p"), "length", is_text(F.col("content")).alias("plain")).filter("length > 0")
    t = t.filter(~_pruned(F.col("p")))
    if include:
        t = t.filter(_matches(F.col("p"), include))
    t = t.withColumn("wanted", ~_matches(F.col("p"), exclude) if exclude else F.lit(True))
    why = F.when(suffix.isin(*R.SKIP_SUFFIXES), "binary extension").when(~F.col("wanted"), "exclude_globs").when(F.col("length") > max_file, "too large")
    t = t.select("p", "length", "plain", why.alias("why")).repartition(1).sortWithinPartitions("p")

    def run(batches):
        total = count = 0
        for b in batches:
            rows = []
            for r in b.to_pylist():
                why = r["why"]
                if count >= max_files and why is None:
                    rows.append((r["p"], "max file count reached"))
                    continue
                if why is None and total + r["length"] > max_total:
                    why = "total byte cap reached"
                if why is None and not r["plain"]:
                    why = "binary content"
                if why is None:
                    total, count = total + r["length"], count + 1
                rows.append((r["p"], why))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.string()) for i in range(2)], names=["path", "reason"])

    return t.mapInArrow(run, WALK)


def walk_stats(walked: DataFrame) -> DataFrame:
    """``(reason, files, examples)``: taken files have a null reason; at most 20 example paths each."""
    return walked.groupBy("reason").agg(F.count("*").alias("files"), F.slice(F.array_sort(F.collect_set(F.when(F.col("reason").isNotNull(), F.col("path")))), 1, 20).alias("examples"))


def files_from_binary(df: DataFrame, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_file: int = MAX_FILE, max_total: int = MAX_TOTAL, max_files: int = MAX_FILES) -> DataFrame:
    """Text files that a walk takes: ``(scan_id, path, text, byte_size)``; ``walk`` says what it skips."""
    taken = walk(df, root, include, exclude, max_file, max_total, max_files).filter("reason IS NULL").select("path")
    d = df.withColumn("path", _relative(root)).join(taken, "path", "left_semi")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return d.select(F.lit(root).alias("scan_id"), "path", text.alias("text"), F.col("length").alias("byte_size"))


def contained(path: str, base: str) -> bool:
    """Whether a local path, links resolved, lies in ``base``."""
    return Path(path).resolve().is_relative_to(Path(base).resolve())


def finding_filter(found: DataFrame, severity: str | None = None, category: str | None = None, text: str | None = None) -> DataFrame:
    """Findings of a severity and category that hold a text, whatever its case, in path, rule or snippet."""
    if severity:
        found = found.filter(F.col("severity") == severity)
    if category:
        found = found.filter(F.col("category") == category)
    if text:
        every = F.lower(F.concat_ws(" ", "path", "rule_id", "snippet"))
        found = found.filter(F.contains(every, F.lower(F.lit(text))))
    return found


def fold_in(found: DataFrame, more: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings with a model's findings among them, and the scans' scores anew."""
    columns = [c.split()[0] for c in FINDING.split(", ")]
    both = found.select(*columns).unionByName(more.select(*columns))
    return both, scan_scores(both, files)


def glob_matches(path: str, pattern: str) -> bool:
    """``**/`` stands for any folders, also none; else an ordinary glob of the path or its name."""
    if pattern.startswith("**/"):
        tail, parts = pattern[3:], path.split("/")
        return any(fnmatch.fnmatch("/".join(parts[i:]), tail) for i in range(len(parts)))
    return fnmatch.fnmatch(path, pattern) or fnmatch.fnmatch(PurePosixPath(path).name, pattern)


def _suppressed(lines: list[str], rule: str, line: int) -> bool:
    return any(0 <= i < len(lines) and MARKER in lines[i] and rule in re.findall(rf"{MARKER}\s*:\s*ignore\s+([A-Za-z0-9_.\-]+)", lines[i]) for i in (line - 1, line - 2))


def scan_one(scan_id: str, path: str, text: str, lang: str) -> list[tuple]:
    """All findings of one file that aren't suppressed."""
    out = []
    lines = text.split("\n") if MARKER in text else []

    def add(rule, severity, confidence, category, start, end, snippet):
        first = text.count("\n", 0, start) + 1
        if not (lines and _suppressed(lines, rule, first)):
            out.append((scan_id, path, rule, severity, confidence, category, first, first + text.count("\n", start, end), snippet))

    for rule, severity, confidence, category, langs, globs, pattern, options in R.RULES:
        if (langs and lang not in langs) or (globs and not any(glob_matches(path, g) for g in globs)):
            continue
        seen = set()
        for m in re.finditer(pattern, text, re.M):
            begin = text.rfind("\n", 0, m.start()) + 1
            end = text.find("\n", m.start())
            if "line" in options and not any(w in text[begin : len(text) if end < 0 else end] for w in options["line"]):
                continue
            if options.get("hybrid") and any(w in text[begin : m.start() + NEARBY] for w in R.HYBRID):
                continue
            snippet = " ".join(text[max(0, m.start() - CONTEXT) : m.end() + CONTEXT].split())[:SNIPPET]
            if options.get("u"):
                if snippet in seen:
                    continue
                seen.add(snippet)
            add(rule, severity, confidence, category, m.start(), m.end(), snippet)
    for kind, (rule, globs, pattern) in R.MANIFESTS.items():
        if any(glob_matches(path, g) for g in globs):
            for m in re.finditer(pattern, text, re.M):
                name = m["name"].lower() if kind == "pypi" else m["name"]
                bad = R.KNOWN_BAD[kind].get(name, ())
                if "*" in bad or m["version"] in bad:
                    add(rule, "critical", "high", "dependency", m.start(), m.end(), m.group(0)[:SNIPPET])
    return out


def findings(files: DataFrame) -> DataFrame:
    """A row per finding of ``files`` (scan_id, path, text), secrets in snippets redacted.

    Offsets and lines need Python's ``re``; files pass in Arrow batches, and a
    failing file costs only its own row (``rule_id`` ``error``).
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(FINDING))

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    rows += scan_one(r["scan_id"], r["path"], r["text"] or "", r["lang"])
                except Exception as e:  # noqa: BLE001  one file never fails a scan
                    rows.append((r["scan_id"], r["path"], "error", "info", "low", "error", 1, 1, str(e)[:240]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    found = files.select("scan_id", "path", "text", language(F.col("path")).alias("lang")).mapInArrow(run, FINDING)
    return redact_text(found, "snippet").withColumn("snippet", F.col("redacted")).drop("redacted")


def finding_score(severity: Column, confidence: Column) -> Column:
    pick = lambda table, c: F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)
    return pick(R.SEVERITY_WEIGHT, severity) * pick(R.CONFIDENCE_FACTOR, confidence)


def scan_scores(found: DataFrame, files: DataFrame) -> DataFrame:
    """One row per scan: files, counts by severity, score and risk."""
    c = F.col
    weight = finding_score(c("severity"), c("confidence")) * F.when(c("category") == "pqc", 0.25).otherwise(1.0)
    hard = (c("severity").isin("high", "critical") & (c("confidence") == "high") & c("rule_id").startswith("secret.")) | ((c("severity") == "critical") & c("category").isin("backdoor", "ci"))
    floor = F.when(hard, 0.70).when(c("severity") == "critical", 0.65).otherwise(0.0)
    per = found.filter("rule_id <> 'error'").groupBy("scan_id").agg(F.sum(weight).alias("w"), F.max(floor).alias("floor"), F.count("*").alias("findings"), *(F.count_if(c("severity") == s).alias(s) for s in R.SEVERITY_WEIGHT))
    out = files.groupBy("scan_id").agg(F.count("*").alias("files")).join(per, "scan_id", "left")
    raw = F.greatest(F.coalesce(c("w"), F.lit(0.0)) / F.greatest(F.lit(1.0), F.sqrt("files")), F.coalesce(c("floor"), F.lit(0.0)))
    score = F.round(F.least(raw, F.lit(1.0)), 3)
    counts = [F.coalesce(x, F.lit(0)).alias(x) for x in ("findings", *R.SEVERITY_WEIGHT)]
    return out.select("scan_id", "files", *counts, score.alias("score"), F.when(score >= 0.65, "high").when(score >= 0.30, "moderate").otherwise("low").alias("risk"))


def pq_readiness(found: DataFrame) -> DataFrame:
    """One row per scan with cryptographic findings: families, exposure and status."""
    family = F.try_element_at(F.create_map(*(F.lit(x) for kv in R.FAMILIES.items() for x in kv)), F.col("rule_id"))
    t = found.withColumn("family", family).filter("family IS NOT NULL")
    hndl = F.col("family").isin("rsa", "key_exchange", "key_exchange_config", "weak_keysize")
    adopted = F.col("family").isin("pqc_adopted", "pqc_weak_params")
    g = t.groupBy("scan_id").agg(F.count_if(hndl).alias("hndl_exposure"), F.count_if(hndl | (F.col("family") == "signature")).alias("classical"), F.count_if(F.col("family") == "signature").alias("signatures"), F.count_if(F.col("family") == "pqc_adopted").alias("pqc"), F.count_if(F.col("family") == "pqc_weak_params").alias("weak_parameters"), F.count_if(adopted).alias("_a"), F.count_distinct("path").alias("files_affected"))
    status = F.when((F.col("classical") > 0) & (F.col("_a") > 0), "migration_in_progress").when(F.col("classical") > 0, "quantum_vulnerable").when(F.col("_a") > 0, "pq_ready").otherwise("symmetric_margin_only")
    return g.withColumn("status", status).drop("_a")


def to_sarif(found: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 document per scan as ``(scan_id, sarif)``; a scan's findings form one document."""
    level = F.when(F.col("severity").isin("high", "critical"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_start").alias("startLine"), F.col("line_end").alias("endLine"), F.struct(F.col("snippet").alias("text")).alias("snippet")).alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("rule_id").alias("text")).alias("message"), place.alias("locations"))
    g = found.groupBy("scan_id").agg(F.sort_array(F.collect_list(result)).alias("results"), F.array_sort(F.collect_set("rule_id")).alias("ids"))
    tool = F.struct(F.struct(F.lit("scrutix").alias("name"), F.transform("ids", lambda r: F.struct(r.alias("id"))).alias("rules")).alias("driver"))
    doc = F.struct(F.lit("2.1.0").alias("version"), F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.array(F.struct(tool.alias("tool"), F.col("results").alias("results"))).alias("runs"))
    return g.select("scan_id", F.to_json(doc).alias("sarif"))
