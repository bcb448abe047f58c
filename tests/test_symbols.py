"""Spans, call sites and windows: against plain Python on small files, and on one large file."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tracewarden.operators import packs, symbols


def test_enclosing(spark):
    """Nested, equal, crossing and very wide spans; a hit outside all of them."""
    rng = random.Random(3)
    spans = [(rng.choice("ab"), f"f{i}", s := rng.randrange(1, 300), s + rng.choice([0, 1, 2, 7, 8, 9, 100, 2_000_000_000])) for i in range(80)]
    hits = [(rng.choice("abc"), rng.randrange(1, 320), i) for i in range(400)]
    out = symbols.enclosing(spark.createDataFrame(hits, "file string, line int, n int"), spark.createDataFrame(spans, "file string, function string, start int, end int"), ["n"]).collect()
    assert len(out) == len(hits)
    for r in out:
        fits = sorted((e - s, f, s, e) for file, f, s, e in spans if file == r["file"] and s <= r["line"] <= e)
        assert (r["function"], r["start"], r["end"]) == (fits[0][1:] if fits else ("<module>", None, None))


def test_large_file(spark):
    """A million hits and 100,000 spans in one file: each hit is in the span of its ten lines, or in the class around all."""
    spans = spark.range(100_000).selectExpr("'f' AS file", "concat('g', id) AS function", "CAST(10 * id + 1 AS INT) AS start", "CAST(10 * id + 9 AS INT) AS end").union(spark.createDataFrame([("f", "all", 1, 1_000_000)], "file string, function string, start int, end int"))
    hits = spark.range(1, 1_000_001).selectExpr("'f' AS file", "CAST(id AS INT) AS line")
    out = symbols.enclosing(hits, spans, ["file", "line"])
    wrong = out.where(F.expr("function <> CASE WHEN line % 10 = 0 THEN 'all' ELSE concat('g', CAST(floor((line - 1) / 10) AS BIGINT)) END"))
    assert out.count() == 1_000_000 and wrong.isEmpty()


def test_call_sites(spark):
    code = ["foo(1)", "x.bar (2)", "foobar(3)", "foo", "  é.foo  (4)", "say foo? (5)", "a::b(6) foo(7)", None, "bar(\n", "((foo(8)))"]
    callees = ["foo", "Cls.bar", "foo?", "a::b", "", "<module>", "b", "gone", "Mod.foobar"]
    lines = spark.createDataFrame([("f", i + 1, c) for i, c in enumerate(code)] + [("g", 1, "foo()")], "file string, line int, code string")
    nodes = [(n, "f", start, end, c) for n, (c, start, end) in enumerate((c, s, e) for c in callees for s, e in ((1, 10), (2, 9), (5, None)))]
    found = symbols.call_sites(spark.createDataFrame(nodes, "n int, file string, start int, end int, callee string"), lines, ["n"])
    got = {r["n"]: (r["line"], r["code"]) for r in found.collect()}
    expected = {}
    for n, _, start, end, callee in nodes:
        method = callee.split(".")[-1]
        for i, c in enumerate(code):
            if method not in ("", "<module>") and c and start <= i + 1 <= (end or start + 120) and re.search(r"\b" + re.escape(method) + r"\s*\(", c, re.ASCII):
                expected[n] = (i + 1, c.strip(" ")[:240])
                break
    assert got == expected and len(got) > 10


def test_windows_and_slices(spark):
    lines = spark.createDataFrame([("f", i, f"c{i}") for i in range(1, 31)], "file string, line int, code string")
    at = spark.createDataFrame([("f", 1), ("f", 15), ("f", 30), ("f", 60), ("gone", 3)], "file string, line int")
    found = {r["line"]: (r["line_start"], r["line_end"], r["code"]) for r in symbols.windows(at, lines, ["file", "line"], 2, 3).collect()}
    assert {k: v[:2] for k, v in found.items()} == {1: (1, 4), 15: (13, 18), 30: (28, 30)} and found[30][2] == "28: c28\n29: c29\n30: c30"
    functions = spark.createDataFrame([("f", 3, 4), ("f", 1, 30), ("f", 9, 8)], "file string, start int, end int")
    cut = {r["start"]: r["code_slice"] for r in symbols.slices(functions, lines, ["file", "start"], 12).collect()}
    assert cut[3] == "c3\nc4" and cut[1].split("\n") == ["c1", "c2", "// ... omitted 18 line(s) ...", *(f"c{i}" for i in range(22, 31))] and 9 not in cut


def test_pack_without_callers(spark):
    """A sink that nothing calls: no caller section, and a place twice in a finding's list is one snippet."""
    pool = spark.createDataFrame([("r", "F.go", "a.py", 1, 3, "body")], "function_ref string, function string, file string, line int, line_end int, code_slice string")
    lines = spark.createDataFrame([("a.py", i, f"l{i}") for i in range(1, 4)], "file string, line int, code string")
    nodes = packs.with_calls(spark.createDataFrame([("c", 1, 0, "r")], "chain_id string, place int, at int, function_ref string"), pool, lines).withColumn("name", F.col("function"))
    assert packs.direct_callers(nodes, pool).isEmpty()
    pack = packs.packs(spark.createDataFrame([("c", "# head")], "chain_id string, head string"), nodes, pool, sections=(packs.direct_callers(nodes, pool),)).first()["pack"]
    assert pack == "# head\n\n## Call chains\n1. F.go\n\n## Functions\n### F.go (a.py:1-3)\n```\nbody\n```"
    places = spark.createDataFrame([("c", 0, "a.py", 2), ("c", 1, "a.py", 2), ("c", 2, "a.py", None), ("c", 3, "b.py", 1), ("c", 4, " ", 1)], "chain_id string, ord int, file string, line int")
    found = sorted((r["place"], r["file"], r["line"], r["line_start"], r["line_end"]) for r in packs.snippets(places, lines).collect())
    assert found == [(1, "a.py", 2, 1, 3), (2, "a.py", None, 1, 3), (3, "b.py", 1, None, None)]


def test_sink_packs_scan_once(spark, sf, monkeypatch):
    """Documents are read for the hits and for the lines of the files that have some, however many sections ask for them."""
    from tracewarden.plans import pack_queries
    from tracewarden.sources.shared import stored

    plans = []

    def noted(df, name):
        plans.append(df)
        return stored(df, name)

    monkeypatch.setattr(pack_queries, "stored", noted, raising=False)
    plans.append(pack_queries.sink_packs(spark, sf("0.001")))
    shown = [line for p in plans for line in p._jdf.queryExecution().executedPlan().toString().splitlines()]
    assert sum("FileScan parquet" in line and "text#" in line for line in shown) == 2


def test_bodies_are_cut_for_chains_only(spark):
    from tracewarden.plans import pack_queries

    spans = spark.createDataFrame([("a", "f", 1, 2), ("a", "g", 3, 3), ("b", "f", 1, 9)], "file string, function string, start int, end int")
    lines = spark.createDataFrame([(f, i, f"{f}{i}") for f in "ab" for i in range(1, 4)], "file string, line int, code string")
    nodes = spark.createDataFrame([("c", "a#1"), ("d", "a#1"), ("d", "b#1"), ("e", "gone#1")], "chain_id string, function_ref string")
    found = pack_queries._pool(spans, lines, nodes).collect()
    assert sorted((r["function_ref"], r["function"], r["file"], r["line"], r["line_end"], r["code_slice"]) for r in found) == [("a#1", "f", "a", 1, 2, "a1\na2"), ("b#1", "f", "b", 1, 9, "b1\nb2\nb3")]


def test_words_end_at_other_letters(spark):
    """Words are of ASCII letters, as in SQL: a class name ends, and a called one begins, beside another letter."""
    code = ["Les f", "La g", "Lesè h", "Un i", "éUn (1)", "Lest j"]
    lines = spark.createDataFrame([("f", i + 1, c) for i, c in enumerate(code)], "file string, line int, code string")
    found = symbols.spans(lines, r"^([A-Z][a-z]{1,5}) ", r"^(Les|Los|Una)\b").collect()
    assert sorted((r["start"], r["function"]) for r in found) == [(1, "Les.Les"), (2, "Les.La"), (4, "Les.Un"), (6, "Les.Lest")]
    found = symbols.spans(lines.where("line > 1"), r"^([A-Z][a-z]{1,5}) ", r"^(Les|Los|Una)\b").collect()
    assert sorted((r["start"], r["function"]) for r in found) == [(2, "La"), (4, "Les.Un"), (6, "Les.Lest")]
    nodes = spark.createDataFrame([("f", 1, 6, "Un")], "file string, start int, end int, callee string")
    assert [(r["line"], r["code"]) for r in symbols.call_sites(nodes, lines, ["file"]).collect()] == [(5, "éUn (1)")]


def test_ranges_are_not_broadcast(spark):
    """However small Spark takes the places for, their lines don't go through the driver: the places meet blocks of lines."""
    lines = spark.range(1, 1001).selectExpr("'f' AS file", "CAST(id AS INT) AS line", "concat('c', id) AS code")
    places = spark.createDataFrame([("f", n) for n in (1, 4, 500, 999, 1003, 5000)] + [("g", 1), ("f", None)], "file string, line int")
    out = symbols.windows(places, lines, ["file", "line"], 3, 5)
    shown = {n: (max(1, n - 3), min(1000, n + 5)) for n in (1, 4, 500, 999, 1003)}
    want = {n: (a, b, "\n".join(f"{i}: c{i}" for i in range(a, b + 1))) for n, (a, b) in shown.items()}
    assert {r["line"]: (r["line_start"], r["line_end"], r["code"]) for r in out.collect()} == want
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
