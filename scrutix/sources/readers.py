"""Readers: text files, labelled corpora, archives, source trees and weights."""

from __future__ import annotations

import io
import subprocess
import tarfile
import zipfile
from pathlib import PurePosixPath
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------

HUMAN, MACHINE = ("human", "authentic"), ("ai", "machine")
GIT_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "git.sr.ht")
MAX_ENTRIES, MAX_EXTRACTED = 50_000, 512 << 20


def text_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``(path, text)`` of ``*.txt`` files; bytes that aren't UTF-8 become U+FFFD."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def corpus(spark: SparkSession, path: str, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """Examples ``(id, text, label, source, domain, model)`` of a JSONL file, and its bad lines.

    Without ``lenient`` a bad line raises an error.  Duplicate texts stay.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    schema = "id string, text string, label string, source string, domain string, model string"
    rows = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    label = F.when(F.lower(F.trim("r.label")).isin(*HUMAN), 0).when(F.lower(F.trim("r.label")).isin(*MACHINE), 1)
    rows = rows.withColumn("y", label)
    ok = F.col("r.text").isNotNull() & (F.trim("r.text") != "") & F.col("y").isNotNull()
    bad = rows.filter(~F.coalesce(ok, F.lit(False))).select("value")
    if not lenient and not bad.isEmpty():
        raise ValueError(f"bad corpus line: {bad.first()[0][:120]}")
    return rows.filter(ok).select("r.id", "r.text", F.col("y").alias("label"), "r.source", "r.domain", "r.model"), bad


def safe_member(name: str) -> bool:
    """No absolute path, drive, NUL or step upwards."""
    n = name.replace("\\", "/")
    return bool(n) and "\0" not in n and not n.startswith("/") and ":" not in n.split("/")[0] and ".." not in PurePosixPath(n).parts


def archive_members(name: str, data: bytes, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_EXTRACTED):
    """Yield ``(path, content)`` of plain files of a zip or tar archive.

    Links and special members are left out; an unsafe name, too many entries
    or too many extracted bytes (counted as they stream) raise an error.
    """
    budget, entries = max_bytes, 0

    def take(stream) -> bytes:
        nonlocal budget
        parts = []
        while part := stream.read(1 << 16):
            budget -= len(part)
            if budget < 0:
                raise ValueError("the archive extracts to more than the limit")
            parts.append(part)
        return b"".join(parts)

    def check(path: str) -> None:
        nonlocal entries
        entries += 1
        if entries > max_entries:
            raise ValueError("the archive has too many entries")
        if not safe_member(path):
            raise ValueError(f"unsafe name in the archive: {path[:80]!r}")

    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                check(i.filename)
                mode = i.external_attr >> 16
                if not i.is_dir() and (mode & 0o170000) in (0, 0o100000):
                    with z.open(i) as s:
                        yield i.filename, take(s)
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for i in t:
                check(i.name)
                if i.isreg():
                    yield i.name, take(t.extractfile(i))


MAX_MEDIA = 64 << 20


def media_files(spark: SparkSession, path: str, max_bytes: int = MAX_MEDIA) -> DataFrame:
    """``(path, length, content, refused)``: an empty or too large file has its reason and no content.

    Spark's listing of a folder leaves empty files out.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = None if "*" in path else at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
    if status is not None and status.isFile() and status.getLen() == 0:
        return spark.sql("SELECT CAST(NULL AS STRING) AS path, 0L AS length, CAST(NULL AS BINARY) AS content, 'empty file' AS refused").withColumn("path", F.lit(path))
    d = spark.read.format("binaryFile").load(path)
    why = F.when(F.col("length") > max_bytes, "too large")
    return d.select("path", "length", F.when(why.isNull(), F.col("content")).alias("content"), why.alias("refused"))


def open_target(spark: SparkSession, target: str) -> tuple[str, DataFrame | None]:
    """What a target is (``remote``, ``archive``, ``file`` or ``tree``) and its files as a ``binaryFile`` table.

    Remote repositories are judged by their url and not fetched here.
    """
    if "://" in target and urlsplit(target).scheme in ("http", "https", "ssh", "git"):
        if not clone_url_allowed(target):
            raise ValueError(f"this repository may not be fetched: {target[:120]}")
        return "remote", None
    if target.lower().endswith((".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
        return "archive", archive_files(spark.read.format("binaryFile").load(target))
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(target)
    single = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    return "file" if single else "tree", spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target)


def archive_files(archives: DataFrame) -> DataFrame:
    """``(scan_id, path, content, error)`` from a ``binaryFile`` table of archives.

    An archive that breaks a guard gives one row with its error and no files.
    """
    import pyarrow as pa

    schema = pa.schema([("scan_id", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                rows, held = [], 0
                try:
                    rows = [(r["path"], p, c, None) for p, c in archive_members(r["path"], r["content"])]
                except (ValueError, OSError, tarfile.TarError, zipfile.BadZipFile, EOFError, RuntimeError) as e:
                    rows = [(r["path"], None, None, str(e)[:240])]
                part: list[tuple] = []
                for row in rows:
                    part.append(row)
                    held += len(row[2] or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*part), schema)], schema=schema)
                        part, held = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    return archives.select("path", "content").mapInArrow(run, "scan_id string, path string, content binary, error string")


def git_metadata(repo: str) -> dict[str, str]:
    """Branch, commit, author, date, subject and remote of a local repository; unknown ones are left out."""
    asked = {"branch": ("rev-parse", "--abbrev-ref", "HEAD"), "commit": ("rev-parse", "HEAD"), "author": ("log", "-1", "--format=%an"), "date": ("log", "-1", "--format=%cI"), "subject": ("log", "-1", "--format=%s"), "remote": ("config", "--get", "remote.origin.url")}
    out = {}
    for key, args in asked.items():
        try:
            done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=10, check=False)
        except (OSError, subprocess.TimeoutExpired):
            continue
        if done.returncode == 0 and done.stdout.strip():
            out[key] = done.stdout.strip()
    return out


def clone_url_allowed(url: str) -> bool:
    """http(s) urls of known hosts without user information."""
    try:
        u = urlsplit(url)
        return u.scheme in ("http", "https") and (u.hostname or "") in GIT_HOSTS and u.username is None and u.password is None
    except ValueError:
        return False
