"""Reports, details, orders and told paths with known answers."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from tracewarden.functions import paths
from tracewarden.operators import catalog, metrics, packs, reports
from tracewarden.sources import sinks

SCHEMA = "ord int, verdict string, title string, severity string, cwe string, vulnerability_type string, sink_file string, sink_line int, source_file string, source_line int, confidence double, principle string, data_flow array<string>, poc string, fix string, refuted_by string, missing array<string>, evidence array<struct<source: string, detail: string, file: string, line: int>>"


def _text(path) -> str:
    """A written text, part files in the order of their names."""
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


def _row(ord, verdict, title, **more):
    names = [x.strip().split(" ")[0] for x in SCHEMA.split(", ") if not x.strip().startswith(("detail:", "file:", "line:"))]
    return tuple({"ord": ord, "verdict": verdict, "title": title, **more}.get(n) for n in names)


def test_report_is_whole_and_in_order(spark, tmp_path):
    rows = spark.createDataFrame(
        [
            _row(3, "safe", "a|b", vulnerability_type="xss", sink_file="s.php", sink_line=4, refuted_by="x\n" + "y" * 90),
            _row(2, "uncertain", "second", severity="low", sink_file="u.php", missing=["entry"], evidence=[(None, "seen", "e.php", None)]),
            _row(1, "vulnerable", "first", cwe="CWE-79", sink_file="v.php", sink_line=9, source_file="i.php", source_line=1, confidence=0.86, principle=" why ", data_flow=["a", "b"]),
            _row(4, "odd", "uncounted"),
        ],
        SCHEMA,
    )
    blocks = reports.audit_blocks(rows, "s/o/r/v", [F.col("ord")], str(tmp_path / "ranks"), "src")
    sinks.blocks(blocks, str(tmp_path / "audit.md"), "part", "number")
    text = _text(tmp_path / "audit.md")
    assert text.startswith("# Audit report\n\n**Project**: `s/o/r/v`\n**Target**: `src`\n**Summary**: 4 chains audited, 1 vulnerable, 1 uncertain, 1 safe\n\n## Headlines\n\n- **Vulnerable** `v.php:9`: first\n- **Uncertain** `u.php:?`: second\n\n## [1/2] [Vulnerable] first\n")
    assert "| Verdict | **Vulnerable** (confidence 86%) |" in text
    assert "### Principle\n\nwhy\n\n### Data flow\n\n- a\n- b\n\n## [2/2] [Uncertain] second" in text
    assert "### Missing\n\n- entry\n\n### Evidence\n\n- [unknown] seen (e.php:?)\n" in text
    assert text.endswith(f"| 1 | xss | `s.php:4` | a/b | x {'y' * 75}... |\n")


def test_report_without_findings(spark, tmp_path):
    rows = spark.createDataFrame([], SCHEMA)
    blocks = reports.audit_blocks(rows, "p", [F.col("ord")], str(tmp_path / "ranks")).collect()
    assert [b["text"].splitlines()[-1] for b in blocks] == ["Nothing is exploitable, and nothing needs more context."]
    head = reports.audit_head(rows).first()
    assert (head["status"], head["summary"]["total_audited"], head["summary"]["by_severity"]) == ("no_auditable_chains", 0, {})


def test_strategies(spark):
    scans = spark.createDataFrame([("p", "1", True), ("p", "2", False), ("q", "1", False)], "project_path string, scan_id string, has_audit boolean")
    chosen = lambda s: sorted(map(tuple, metrics.selected(scans, s).select("project_path", "scan_id").collect()))
    assert chosen("latest") == [("p", "1"), ("q", "1")] and len(chosen("union")) == 3
    with pytest.raises(ValueError, match="no strategy"):
        metrics.selected(scans, "newest")


def test_ranks_of_falling_keys(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 2)], "t string, n int")
    ranked = packs.ranks(rows, [F.col("t"), F.col("n")], "place", str(tmp_path / "r"), (True, False)).orderBy("place").collect()
    assert [(r["t"], r["n"]) for r in ranked] == [("c", 2), ("b", 2), ("a", 1), ("a", 3)]
    assert [r["place"] for r in ranked] == [1, 2, 3, 4]


@pytest.mark.parametrize(
    ("told", "expected"),
    [("a/b.php", "a/b.php"), ("./a//b", "a/b"), ("a\\b", "a/b"), ("../../etc", "src"), ("a/../../p/c", "c"), ("/w/p/../p/c", "c"), ("/w/p", "."), ("/w/px", "src"), ("C:\\x", "src"), ("'q.php'", "q.php"), (None, "src"), (".", ".")],
)
def test_told_path(spark, told, expected):
    assert spark.createDataFrame([(told,)], "t string").select(paths.contained(F.col("t"), "/w/p", "src").alias("x")).first()["x"] == expected


def test_default_outside_is_the_root(spark):
    assert spark.range(1).select(paths.contained(F.lit("../x"), "/w/p", "../y").alias("x")).first()["x"] == "."


def test_regions_of_missing_files_are_left_out(spark):
    place = "struct<file: string, line: int, expr: string, detail: string>"
    rows = spark.createDataFrame(
        [("v", ["p"], "gone.php:3", (None, ("php", ("a.php", 1, "read", None), ("/a.php", 1, "again", None), None))), ("w", None, "a.php:1", None)],
        f"vulnerability_id string, links array<string>, location string, source_finding struct<project_path: string, finding: struct<language: string, source: {place}, sink: {place}, evidence: array<struct<file: string, line: int, detail: string, source: string>>>>",
    )
    lines = spark.createDataFrame([("p", "a.php", i, f"l{i}") for i in range(1, 30)] + [("other", "a.php", 1, "x")], "project_path string, file string, line int, code string")
    found = catalog.code_regions(rows, lines).collect()
    assert [(r["vulnerability_id"], [(x["id"], x["line_start"], x["line_end"], x["code"].count("\n")) for x in r["code_regions"]]) for r in found] == [("v", [("1:source:a.php:1", 1, 11, 10)])]
