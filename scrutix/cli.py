"""A small command line: score texts, media and source trees; evaluate, calibrate and learn weights."""

from __future__ import annotations

import argparse
import json
import sys


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scrutix", description=__doc__)
    p.add_argument("what", choices=("text", "inline", "media", "scan", "report", "calibrate", "learn-weights"))
    p.add_argument("path", help="a path; for inline the text itself")
    p.add_argument("--out", help="folder for JSON (learn-weights: the weights file); printed without it")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--lenient", action="store_true")
    p.add_argument("--sarif", action="store_true")
    p.add_argument("--profile", default="general")
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--l2", type=float, default=2.0)
    p.add_argument("--skipped", action="store_true", help="scan: what the walk skipped, and why")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from scrutix.operators import code_scan, evaluation, media, scoring
    from scrutix.sources import readers

    spark = SparkSession.builder.appName("scrutix").getOrCreate()
    text_columns = ("word_count", "score", "risk", "alert", "signals", "dimensions", "recommendation")
    if a.what in ("report", "calibrate", "learn-weights"):
        try:
            examples, _ = readers.corpus(spark, a.path, a.lenient)
        except ValueError as e:
            print(f"corpus error: {e}", file=sys.stderr)
            return 2
        examples = examples.withColumn("_profile_used", scoring.profile_of(F.col("domain"), a.profile))
        scored = scoring.score_text(examples, profile_col="_profile_used")
        if a.what == "report":
            return _write(evaluation.report(scored.select("score", "label"), a.threshold), a.out)
        try:
            found = evaluation.fit_platt(scored.select("score", "label")) if a.what == "calibrate" else evaluation.learn_weights(scored, a.l2)
        except ValueError as e:
            print(f"nothing to fit: {e}", file=sys.stderr)
            return 2
        if a.out:
            evaluation.write_weights(spark, found, a.out)
        else:
            print(json.dumps(found, indent=2))
        return 0
    if a.what == "inline":
        texts = spark.range(1).select(F.lit(a.path).alias("text"), F.lit(a.profile).alias("profile"))
        return _write(scoring.score_text(texts, profile_col="profile").select(*text_columns), a.out)
    if a.what == "text":
        texts = readers.text_files(spark, a.path, a.recursive).withColumn("profile", F.lit(a.profile))
        return _write(scoring.score_text(texts, profile_col="profile").select("path", *text_columns), a.out)
    if a.what == "media":
        files = readers.media_files(spark, a.path)
        return _write(media.analyze_media(files.filter("refused IS NULL")).select("path", "format", "tools", "findings", "score", "risk"), a.out)
    kind, listed = readers.open_target(spark, a.path)
    if listed is None:
        print("fetch the repository first and scan its folder", file=sys.stderr)
        return 2
    if kind == "archive":
        broken = listed.filter("error IS NOT NULL").select("error").first()
        if broken:
            print(f"archive error: {broken.error}", file=sys.stderr)
            return 2
        listed = listed.select("path", F.length("content").cast("long").alias("length"), "content")
    root = "" if kind == "archive" else a.path
    if a.skipped:
        return _write(code_scan.walk_stats(code_scan.walk(listed, root)), a.out)
    files = code_scan.files_from_binary(listed, root)
    found = code_scan.findings(files)
    return _write(code_scan.to_sarif(found) if a.sarif else code_scan.scan_scores(found, files), a.out)


def _write(out, folder: str | None) -> int:
    if folder:
        out.write.mode("overwrite").json(folder)
    else:
        for row in out.toJSON().toLocalIterator():
            print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
