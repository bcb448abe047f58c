"""Best reads, pairs of heavy fields and capped chains: against plain Python on small tables, and on large ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import bridge, chains, facts

FACT = "field string, file string, line int, kind string, template string, template_var string, evidence string"


@pytest.mark.parametrize("quirk", [True, False])
def test_best_reads(spark, quirk):
    rng = random.Random(2)
    templates = [None, "", "a.html", "x/a.html", "y/x/a.html", "b.html"]
    fact = lambda: (rng.choice(["f", "g", ""]), rng.choice("pqr"), rng.randrange(30), "k", rng.choice(templates), rng.choice(["f", "g", None]), "e")
    reads, sinks = [fact() for _ in range(40)], [(i, *fact()) for i in range(200)]

    def best(sink):
        _, field, _, line, _, template, _, _ = sink
        ranked = []
        for f, file, at, _, t, var, _ in reads:
            if f and f == field:
                fits = bool(template) and (template.endswith(t) if t is not None else quirk)
                ranked.append((not fits, var != f, abs(at - line), file, at))
        return min(ranked, default=None)

    found = bridge.best_reads(spark.createDataFrame(sinks, f"sink_id int, {FACT}"), spark.createDataFrame(reads, FACT), quirk).collect()
    assert len(found) == len(sinks)
    for r in found:
        expected = best(next(s for s in sinks if s[0] == r["sink_id"]))
        assert (None if r["read"] is None else (r["read"]["file"], r["read"]["line"])) == (None if expected is None else expected[3:])


def test_heavy_field(spark):
    """A field with 100,000 reads and 100,000 sinks: each sink's own line has a read."""
    reads = spark.range(100_000).selectExpr("'f' AS field", "concat('r', id % 7) AS file", "CAST(id % 5000 AS INT) AS line", "'k' AS kind", "CASE WHEN id % 2 = 0 THEN concat('t', id % 50, '.html') END AS template", "'f' AS template_var", "'' AS evidence")
    sinks = spark.range(100_000).selectExpr("id AS sink_id", "'f' AS field", "'s' AS file", "CAST(id % 5000 AS INT) AS line", "'k' AS kind", "concat('v/t', id % 60, '.html') AS template", "'f' AS template_var", "'' AS evidence")
    found = bridge.best_reads(sinks, reads)
    row = found.agg(F.count("*").alias("n"), F.count_if(F.expr("read.line = line")).alias("same"), F.max(F.abs(F.col("read.line") - F.col("line"))).alias("far")).first()
    assert row["n"] == 100_000 and row["same"] >= 50_000 and row["far"] <= 1


def test_pairs_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(bridge, "PAIRS_A_TASK", 50)
    w = spark.createDataFrame([("f", (i,)) for i in range(30)] + [("g", (99,))], "field string, w struct<write_id: int>")
    s = spark.createDataFrame([("f", i) for i in range(20)] + [("g", 7), ("h", 8)], "field string, s int")
    met = bridge._met(w, s)
    assert sorted((r["field"], r["w"]["write_id"], r["s"]) for r in met.collect()) == sorted([("f", i, k) for i in range(30) for k in range(20)] + [("g", 99, 7)])


def test_chains_of_one_place_are_one(spark):
    """Facts repeated at one place give one chain, that of the first write and sink."""
    side = lambda name, rows: spark.createDataFrame(rows, f"{name} long, field string, file string, line int, kind string, evidence string, vulnerability_type string, severity string, template string, template_var string, source_expr string, sink_function string")
    row = lambda i, file, line: (i, "F.name", file, line, "sql_field", "e", "xss", "high", None, None, "request.args", "echo")
    found = bridge.chains(side("write_id", [row(5, "w", 1), row(2, "w", 1), row(3, "w", 2)]), side("read_id", [row(1, "r", 1)]), side("sink_id", [row(9, "s", 4), row(8, "s", 4)])).collect()
    assert sorted((r["write_id"], r["sink_id"], r["field"]) for r in found) == [(2, 8, "name"), (3, 8, "name")]
    assert len({r["chain_id"] for r in found}) == 2


def walked(sink, up, most, depth, branches):
    """Chains as a walk meets them, then the longest first."""
    found = []

    def go(path, ends):
        callers = up.get(path[-1], [])
        if len(path) >= depth or ends or not callers:
            found.append(path)
            return
        for c, end in callers:
            if c in path:
                found.append(path)
            else:
                go([*path, c], end)

    for c, end in up.get(sink, []):
        go([c], end)
    once = list(dict.fromkeys(map(tuple, found))) or [()]
    return sorted(once, key=lambda p: -len(p))[:most]


@pytest.mark.parametrize("seed", range(4))
def test_longest_chains(spark, seed):
    rng = random.Random(seed)
    nodes, calls, up = [f"n{i}" for i in range(12)], [], {}
    for callee in nodes:
        for k in range(rng.randrange(6)):
            caller, ends = rng.choice(nodes), rng.random() < 0.15
            calls.append((caller, callee, k, ends))
            if k < 4:
                up.setdefault(callee, []).append((caller, ends))
    found = chains.longest_chains(spark.createDataFrame([(n,) for n in [*nodes, "lonely"]], "sink string"), spark.createDataFrame(calls, "caller string, callee string, child_ord int, ends boolean"), most=6, depth=5, branches=4)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["place"]):
        got.setdefault(r["sink"], []).append(tuple(r["path"]))
    assert got == {n: [(*reversed(p), n) for p in walked(n, up, 6, 5, 4)] for n in [*nodes, "lonely"]}


def test_dense_calls(spark):
    """16 callers of each function, 8 levels, and a last level that only some reach: 16 ** 8 paths, of which 50 are made."""
    layers = spark.range(8).selectExpr("id AS layer")
    calls = layers.crossJoin(spark.range(16).selectExpr("id AS a")).crossJoin(spark.range(16).selectExpr("CAST(id AS INT) AS child_ord"))
    calls = calls.where("layer < 7 OR child_ord = 15").selectExpr("concat('f', layer + 1, '_', child_ord) AS caller", "concat('f', layer, '_', a) AS callee", "child_ord", "false AS ends")
    found = chains.longest_chains(spark.createDataFrame([("f0_3",)], "sink string"), calls)
    rows = sorted(found.collect(), key=lambda r: r["place"])
    assert len(rows) == 50 and all(len(r["path"]) == 9 for r in rows)
    assert [r["path"][0] for r in rows] == ["f8_15"] * 50
    assert rows[17]["path"][1:4] == ["f7_1", "f6_1", "f5_0"]


def test_nothing_stays_in_the_session(spark):
    before, views = dict(spark.sparkContext.getConf().getAll()), len(spark.catalog.listTables())
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    calls = spark.createDataFrame([("a", "b", 0, False)], "caller string, callee string, child_ord int, ends boolean")
    chains.reverse_chains(spark.createDataFrame([("b",)], "sink string"), calls).count()
    chains.helpers(spark.createDataFrame([("a",)], "root string"), calls).count()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit and len(spark.catalog.listTables()) == views
    assert dict(spark.sparkContext.getConf().getAll()) == before


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_facts_are_worked_out_once(spark):
    """Lines and rendering calls come from a file's own array without a join, and facts are read where they were written."""
    source = "\n".join(["x = 1", "render_template(", "'a.html',", "title=post.title)", "# render_template('b.html', a=b)"])
    files = spark.createDataFrame([("a.py", "python", source), ("a.html", "template", "{{ post.title | safe }}"), ("b.py", "python", None)], "file string, language string, text string")
    assert "Join" not in _plan(facts.statements(files))
    found = facts.facts(files)
    assert "MapInArrow" not in _plan(found) and "Aggregate" not in _plan(found)
    assert sorted((r["role"], r["file"], r["line"], r["field"], r["template"]) for r in found.collect()) == [("read", "a.py", 2, "title", "a.html"), ("sink", "a.html", 1, "title", "a.html")]


def test_bridged_sides_are_read_where_they_were_written(spark):
    """No pattern runs again for each use of the chains, and of one storage identity and sink the best chain stays."""
    side = lambda name, rows: spark.createDataFrame(rows, f"{name} long, field string, file string, line int, kind string, evidence string, vulnerability_type string, severity string, template string, template_var string, source_expr string, sink_function string")
    row = lambda i, file, line, evidence: (i, "name", file, line, "sql_field", evidence, "xss", "high", None, None, "request.args", "echo")
    writes, reads, sinks = side("write_id", [row(1, "w", 1, "htmlspecialchars(x)"), row(2, "w", 2, "strip_tags(x)"), row(3, "w", 3, "x")]), side("read_id", [row(1, "r", 1, "e")]), side("sink_id", [row(8, "w", 1, "htmlspecialchars(x)")])
    found = bridge.chains(writes, reads, sinks)
    assert "Window" not in _plan(found) and "htmlspecialchars" not in _plan(found)
    told = {r["write_id"]: r for r in bridge.without_repeats(found).collect()}
    assert {k: (r["n_strong"], r["n_weak"], len(r["breakpoints"])) for k, r in told.items()} == {1: (1, 0, 0), 2: (1, 1, 0), 3: (1, 0, 0)}
    assert {k: r["noise_tags"] for k, r in told.items()} == {1: ["sanitized_before_sink"], 2: ["sanitized_before_sink", "duplicate_storage_sink"], 3: ["sanitized_before_sink", "duplicate_storage_sink"]}
