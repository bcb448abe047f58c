"""Trees: what is pruned is neither listed nor opened; lines of large files by byte ranges."""

from __future__ import annotations

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewarden.sources import files, walk


@pytest.fixture
def tree(tmp_path):
    for file, body in {"b.py": "x", "A/z.php": "1\n2", "A/y.php": "", "a.js": "\n", "c/node_modules/d/e.js": "no", "c/notes.bin": "no", "c/tests/t.py": "no"}.items():
        (tmp_path / file).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / file).write_text(body)
    os.symlink(tmp_path / "A", tmp_path / "linked")
    os.symlink(tmp_path / "b.py", tmp_path / "also.py")
    os.symlink(tmp_path, tmp_path / "c" / "round")
    return tmp_path


def test_listing(spark, tree):
    listed = files.listing(spark, str(tree))
    assert sorted(r["file"] for r in listed.collect()) == ["A/y.php", "A/z.php", "a.js", "b.py", "c/notes.bin", "c/tests/t.py"]
    shown = [r["file"] for r in listed.orderBy(walk.tree_order(F.col("file"))).collect()]
    assert shown == ["A/y.php", "A/z.php", "c/tests/t.py", "c/notes.bin", "a.js", "b.py"]


def test_only_kept_files_are_opened(spark, tree, monkeypatch):
    """What is left out is gone from the disk, or unreadable, when the kept files are read."""
    kept = files.scannable(spark, str(tree))
    names = sorted(r["file"] for r in kept.collect())
    assert names == ["A/y.php", "A/z.php", "a.js", "b.py"]
    for file in ("c/notes.bin", "c/tests/t.py", "c/node_modules/d/e.js"):
        os.remove(tree / file)
    assert {r["file"]: bytes(r["content"]).decode() for r in walk.contents(kept, str(tree)).collect()} == {"A/y.php": "", "A/z.php": "1\n2", "a.js": "\n", "b.py": "x"}
    # a folder that is never entered may be unreadable, and even a loop of links is none
    assert files.sources(spark, str(tree), "A").count() == 2
    one = files.viewed(spark, str(tree), "A/../b.py").collect()
    assert [(r["file"], r["text"], r["truncated"]) for r in one] == [("b.py", "x", False)]
    assert files.viewed(spark, str(tree), "also.py").count() == 0
    for outside in ("../b.py", "/etc/passwd", "A/../../x", "", "."):
        with pytest.raises(ValueError):
            files.viewed(spark, str(tree), outside)


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_lines_by_ranges(spark, tmp_path, step):
    rng = random.Random(step)
    bodies = {"empty": "", "end": "\n", "ends": "a\n\n\n", "long": "x" * 50, "longs": "y" * 20 + "\n" + "z" * 9 + "\n", "crlf": "a\r\nb\r\n", "wide": "né\n日本\n"}
    bodies |= {f"r{i}": "".join(rng.choice("ab\n\n") for _ in range(rng.randrange(30))) for i in range(12)}
    for file, body in bodies.items():
        (tmp_path / file).write_bytes(body.encode())
    listed = walk.names(spark, str(tmp_path), lambda _: F.lit(True)).select("file", "size")
    found = walk.lines(listed, str(tmp_path), step).collect()
    assert sorted((r["file"], r["line"], r["code"]) for r in found) == sorted((f, i + 1, c.rstrip("\r")) for f, body in bodies.items() for i, c in enumerate(body.split("\n")))


def test_many_records_in_few_batches(spark, tmp_path):
    """Scan records: several in a file, none, broken ones, names beside them; they come from tasks, in batches of many files."""
    from tracewarden.plans.scratch import write_tree
    from tracewarden.sources import files

    at = "s/o/r/v"
    given = [(f"{at}/artifacts/scans/{i}/scan.json", f'{{"status":\n "s{i}", "n": {i}}}') for i in range(300)]
    given += [(f"{at}/artifacts/scans/two/scan.json", '[{"n": 1}, {"status": "x"}]'), (f"{at}/artifacts/scans/blank/scan.json", " \n"), (f"{at}/artifacts/scans/bad/scan.json", '{"n"')]
    given += [(f"{at}/artifacts/scans/0/other.json", "{}"), (f"{at}/artifacts/other/0/scan.json", "{}"), (f"{at}/artifacts/scans/scan.json", "{}"), (f"{at}/artifacts/scans/0/a/scan.json", "{}")]
    assert write_tree(spark.createDataFrame(given, "file string, body string").coalesce(1), f"file://{tmp_path}") == len(given)
    found = files.scans(spark, f"file://{tmp_path}", "status string, n int")
    want = [(at, str(i), f"s{i}", i) for i in range(300)] + [(at, "two", None, 1), (at, "two", "x", None), (at, "bad", None, None)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert len(files.markdown(spark, f"file://{tmp_path}/s/*/r/v/artifacts/*/?/*.json").collect()) == 12
    opened = walk._opened(f"file://{tmp_path}", None)
    names = pa.RecordBatch.from_arrays([pa.array([f for f, _ in given])], names=["file"])
    assert [b.num_rows for b in opened(iter([names]))] == [len(given)]


def test_roots_are_named_as_they_are(spark, tmp_path):
    """A root with signs that an address may not hold, or that mean something else there, is listed, read and written as it is named."""
    from tracewarden.plans.scratch import write_tree

    for name in ("a b", "c%20d", "é#1"):
        root = f"{tmp_path}/{name}"
        assert write_tree(spark.createDataFrame([("x/a.py", "1\n2")], "file string, body string"), f"file://{root}") == 1
        assert (tmp_path / name / "x" / "a.py").read_text() == "1\n2"
        assert [(r["file"], r["text"]) for r in files.sources(spark, root).collect()] == [("x/a.py", "1\n2")]
        assert sorted((r["line"], r["code"]) for r in files.source_lines(spark, f"file://{root}").collect()) == [(1, "1"), (2, "2")]
