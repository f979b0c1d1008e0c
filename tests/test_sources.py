"""Readers, guards of archives, the command line and model seams."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from scrutix import cli
from scrutix.operators import code_scan, models
from scrutix.sources import readers


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k.replace("__", "/"), v)
    return out.getvalue()


def tarred(name, link=False):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        i = tarfile.TarInfo(name)
        i.size = 0 if link else 3
        if link:
            i.type, i.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(i, None if link else io.BytesIO(b"abc"))
    return out.getvalue()


def test_archive_guards():
    assert dict(readers.archive_members("a.zip", zipped(a="1", b__c="2"))) == {"a": b"1", "b/c": b"2"}
    assert dict(readers.archive_members("a.tgz", tarred("x/y"))) == {"x/y": b"abc"}
    assert dict(readers.archive_members("a.tgz", tarred("x", link=True))) == {}
    for bad in ("../x", "/etc/x", "c:/x"):
        with pytest.raises(ValueError):
            dict(readers.archive_members("a.tgz", tarred(bad)))
    with pytest.raises(ValueError):
        dict(readers.archive_members("a.zip", zipped(a="x" * 100), max_bytes=50))
    with pytest.raises(ValueError):
        dict(readers.archive_members("a.zip", zipped(a="1", b="2"), max_entries=1))


def test_archives_and_trees_as_tables(spark, tmp_path):
    (tmp_path / "ok.zip").write_bytes(zipped(**{"src__a.py": "import os\nos.system(x)\n"}))
    (tmp_path / "bad.zip").write_bytes(b"not an archive")
    df = readers.archive_files(spark.read.format("binaryFile").load(str(tmp_path)))
    rows = df.collect()
    assert sum(r.error is not None for r in rows) == 1 and [r.path for r in rows if r.error is None] == ["src/a.py"]
    tree = tmp_path / "tree" / "node_modules"
    tree.mkdir(parents=True)
    (tree / "x.js").write_text("eval(x)")
    (tmp_path / "tree" / "y.js").write_text("eval(x)")
    (tmp_path / "tree" / "z.py").write_bytes(b"\x00binary")
    (tmp_path / "tree" / "l.py").write_bytes("eval('é')  # plain words so that it is text".encode("latin-1"))
    files = code_scan.files_from_binary(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "tree")), str(tmp_path / "tree"))
    assert {r.path: r.text[:8] for r in files.collect()} == {"y.js": "eval(x)", "l.py": "eval('é'"}


def test_corpus(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text('{"id": "1", "text": "a", "label": "AI"}\n{"text": "b", "label": "human"}\nnot json\n{"text": "", "label": "ai"}\n')
    rows, bad = readers.corpus(spark, str(f), lenient=True)
    assert sorted(r.label for r in rows.collect()) == [0, 1] and bad.count() == 2
    with pytest.raises(ValueError):
        readers.corpus(spark, str(f))


def test_urls_and_git(tmp_path):
    assert readers.clone_url_allowed("https://github.com/a/b")
    for u in ("ssh://github.com/a", "https://u:p@github.com/a", "https://example.org/a", "file:///x"):
        assert not readers.clone_url_allowed(u)
    assert readers.git_metadata(str(tmp_path)) == {} or "commit" not in readers.git_metadata(str(tmp_path))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_bytes(b"A seamless robust text. \xff")
    out = tmp_path / "out"
    assert cli.main(["text", str(tmp_path), "--out", str(out)]) == 0
    assert spark.read.json(str(out)).first().word_count == 4


def test_model_seams(spark):
    df = spark.createDataFrame([([-1.0, -3.0], 0.9, 1.0), ([], 0.5, 0.0)], "lp array<double>, o double, c double")
    r = df.select(models.perplexity(F.col("lp")).alias("p"), models.ratio_likelihood(F.col("o"), F.col("c")).alias("l")).collect()
    assert r[0].p == pytest.approx(2.718281828**2) and r[0].l == pytest.approx(0.5) and r[1].p is None and r[1].l is None
    assert spark.range(1).select(models.perplexity_likelihood(F.lit(60.0))).first()[0] == 0.5
    assert models.first_json('text {"a": 1} [2]') == '{"a": 1}' and models.first_json("[1, 2]") == "[1, 2]" and models.first_json("none {") is None
    assert models.with_model(spark.range(1)).first().model.available is False


def _tree(tmp_path):
    for name, body in {"a.py": "x = 1\n" * 10, "b.py": "y = 2\n" * 100, "c.py": "z\n", "d.png": "no", "e.py": "", "f.txt": "t\n", "sub/g.py": "g\n", "node_modules/h.py": "h\n"}.items():
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text(body)
    (tmp_path / "z.py").write_bytes(b"\0\0\0")
    return str(tmp_path)


def walked(spark, root, **options):
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return {r.path: r.reason for r in code_scan.walk(listed, root, **options).collect()}


def test_walk_limits(spark, tmp_path):
    root = _tree(tmp_path)
    plain = {"a.py": None, "b.py": None, "c.py": None, "d.png": "binary extension", "f.txt": None, "sub/g.py": None, "z.py": "binary content"}
    assert walked(spark, root) == plain
    assert walked(spark, root, max_total=70) == plain | {"b.py": "total byte cap reached"}  # smaller ones still fit
    assert walked(spark, root, max_file=100) == plain | {"b.py": "too large"}
    got = walked(spark, root, max_files=2)
    assert [k for k, v in got.items() if v is None] == ["a.py", "b.py"] and got["sub/g.py"] == "max file count reached"
    assert walked(spark, root, include=("*.txt",)) == {"f.txt": None}
    assert walked(spark, root, exclude=("*.py",)) == {"a.py": "exclude_globs", "b.py": "exclude_globs", "c.py": "exclude_globs", "d.png": "binary extension", "f.txt": None, "sub/g.py": "exclude_globs", "z.py": "exclude_globs"}
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    stats = {r.reason: (r.files, r.examples) for r in code_scan.walk_stats(code_scan.walk(listed, root)).collect()}
    assert stats[None] == (5, []) and stats["binary content"] == (1, ["z.py"])
    assert code_scan.contained(root + "/sub", root) and not code_scan.contained(root + "/..", root)


def test_targets(spark, tmp_path):
    root = _tree(tmp_path)
    kind, listed = readers.open_target(spark, root + "/a.py")
    assert kind == "file" and {r.path for r in code_scan.files_from_binary(listed, root + "/a.py").collect()} == {"a.py"}
    assert readers.open_target(spark, root)[0] == "tree" and readers.open_target(spark, "https://github.com/a/b")[0] == "remote"
    with pytest.raises(ValueError):
        readers.open_target(spark, "https://example.org/a/b")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "empty.png").write_bytes(b"")
    (tmp_path / "m" / "big.png").write_bytes(b"x" * 100)
    assert [r.refused for r in readers.media_files(spark, root + "/m", max_bytes=50).collect()] == ["too large"]
    assert [r.refused for r in readers.media_files(spark, root + "/m/empty.png").collect()] == ["empty file"]


def test_evaluation_commands(spark, tmp_path, capsys):
    f = tmp_path / "c.jsonl"
    f.write_text("".join(f'{{"text": "Seamless robust synergy, guaranteed {i}.", "label": "ai", "domain": "marketing"}}\n{{"text": "We walked home at {i}.", "label": "human"}}\n' for i in range(4)))
    assert cli.main(["learn-weights", str(f), "--out", str(tmp_path / "w.json")]) == 0 and readers is not None
    assert "unsupported_claims" in (tmp_path / "w.json").read_text()
    assert cli.main(["calibrate", str(f)]) == 0 and "ece_after" in capsys.readouterr().out
    assert cli.main(["report", str(f)]) == 0 and '"auc":1.0' in capsys.readouterr().out
    assert cli.main(["inline", "A seamless text."]) == 0 and '"alert":false' in capsys.readouterr().out
    assert cli.main(["report", str(tmp_path / "w.json")]) == 2
    assert cli.main(["scan", str(tmp_path), "--skipped"]) == 0
