"""Cases with known answers: what each operator must do with a few rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracewarden.functions import flow, paths, text, verdicts
from tracewarden.operators import bridge, browse, chains, code, facts, findings, metrics, profiles, review, rules, symbols, telemetry, trees
from tracewarden.sources import files, sinks
from tracewarden.streaming import events


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def values(spark, schema, data, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *d) for i, d in enumerate(data)], f"i int, {schema}").select("i", *columns).orderBy("i").drop("i").collect()]


APP = 't = request.form["title"]\nu = t\npost.title = u\nreturn render_template("page.html", head=post.title)\n'


def chained(spark, sources):
    """Chains of a few files: (file, language, text)."""
    found = facts.facts(spark.createDataFrame(sources, "file string, language string, text string"))
    columns = ["field", "kind", "file", "line", "evidence", "vulnerability_type", "severity", "template", "template_var", "source_expr", "sink_function"]
    side = lambda role, number: found.where(F.col("role") == role).select(F.col("fact_id").alias(number), *columns)
    return bridge.without_repeats(bridge.chains(side("write", "write_id"), side("read", "read_id"), side("sink", "sink_id")))


def test_taint_reaches_a_template(spark):
    found = chained(spark, [("app.py", "python", APP), ("page.html", "template", "<h1>{{ post.title | safe }}</h1>")]).collect()
    assert [(r["field"], r["breakpoints"], r["suppressed"]) for r in found] == [("title", [], False)]
    assert found[0]["evidence_score"] >= 50 and found[0]["evidence_quality"] in ("confirmed", "probable")


def test_browser_storage_reaches_html(spark):
    source = "const q = location.search;\nlocalStorage.setItem('draft', q);\nconst d = localStorage.getItem('draft');\nbox.innerHTML = d;\n"
    found = chained(spark, [("a.js", "javascript", source)])
    assert [r["storage_identity"] for r in found.where("not suppressed").collect()] == ["cache_key:draft"]


def test_cleaned_values_are_not_written(spark):
    found = facts.facts(spark.createDataFrame([("a.py", "python", "t = escape(request.form['x'])\npost.x = t\npost.y = request.args.get('y')\n")], "file string, language string, text string"))
    assert rows(found.where("role = 'write'").select("field", "line")) == [("y", 3)]


def test_php_and_sql_facts(spark):
    source = "<?php\n// $_GET in a comment\n$id = $_GET['id'];\n$q = \"insert into users (name, mail) values ('$id', 1)\";\necho $id;\ninclude($page);\n"
    found = facts.facts(spark.createDataFrame([("a.php", "php", source)], "file string, language string, text string"))
    assert rows(found.select("role", "kind", "field", "line", "severity"), "line", "role", "kind", "field") == [
        ("write", "request_var", "id", 3, None),
        ("write", "request_var", "q", 4, None),
        ("write", "sql_field", "mail", 4, None),
        ("write", "sql_field", "name", 4, None),
        ("sink", "template_field", "id", 5, "high"),
        ("sink", "file_slot", "page", 6, "critical"),
    ]


def test_recovered_partials(spark):
    scanned = spark.createDataFrame([("C-1", "xss", "high", "a.php", 3, False), ("C-2", "xss", "high", "a.php", 4, True), ("C-3", "ssrf", "high", "a.php", 5, False)], "chain_id string, vulnerability_type string, severity string, sink_file string, sink_line int, has_call_chain boolean")
    none = spark.createDataFrame([], "chain_id string")
    found = bridge.recovered(scanned, none)
    assert rows(found.select("evidence_quality", "suppressed", F.array_join("breakpoints", ","))) == [("weak", True, "missing_storage_bridge")]
    assert bridge.recovered(scanned, found.select("chain_id")).isEmpty()


def test_scores_stay_in_bounds(spark):
    every = spark.sql("SELECT q, h, r, p, s, w, b FROM VALUES ('exact_storage_key'), ('template_binding'), ('storage_read_binding'), ('weak_name_match') t(q), VALUES (true), (false) h(h), VALUES (true), (false) r(r), VALUES (0), (9) p(p), VALUES (0), (2) s(s), VALUES (0), (1) w(w), VALUES (0), (9) b(b)")
    c = F.col
    score = flow.score(c("q"), c("h"), c("r"), c("r"), c("p"), c("s"), c("w"), c("b"))
    low, high = every.select(score.alias("x")).agg(F.min("x"), F.max("x")).first()
    assert (low, high) == (0, 100)


def test_profile_levels(spark):
    hits = [("php", "xss", "a.php", "x", "f"), ("php", "xss", "actions/show.php", "echo $x", "f"), ("php", "xss", "actions/a.php", '<a href="<?= $config ?>"', "f"), ("python", "deserialization", "a.py", "unserialize(hidden)", "f")]
    df = spark.createDataFrame([(i, *h) for i, h in enumerate(hits)], "i int, language string, vulnerability_type string, file string, code string, function string")
    none = F.array().cast("array<string>")
    df = df.withColumns({"enclosing": F.lit("g"), "rule_id": F.lit("r"), "level": F.lit(None).cast("string"), "semantic_tags": F.array(F.lit(" own "), F.lit("own")), "required_evidence": none, "repair_hints": none})
    out = profiles.profiled(df).orderBy("i").collect()
    assert [r["level"] for r in out] == ["L0", "L1", "L2", "L2"]
    assert out[0]["semantic_tags"] == ["own", "generic_sink", "render_sink"] and out[0]["required_evidence"] == ["source_control", "sanitizer_state", "template_binding"]


def test_rule_funnel_and_dedupe(spark):
    own = [rules.Rule("low", "f", r"f\(", "php", "xss", "low", ("php",)), rules.Rule("high", "f", r"f\(", "php", "xss", "high", ("php",)), rules.Rule("built", "q", r"q\(", "php", "xss", "high", (), True), rules.Rule("more", "e", r"e\(", "php", "xss", "high", (), False, ("zz",)), rules.Rule("unused", "n", r"n\(", "php", "xss")]
    lines = spark.createDataFrame([("a.php", 1, "f(1)"), ("tests/a.php", 2, "f(1)"), ("a.py", 3, "f(1)"), ("a.php", 4, "q('x')"), ("a.php", 5, "q($x)"), ("a.php", 6, "e(1)"), ("a.php", 7, "e(zz)")], "file string, line int, code string")
    hits = rules.staged(rules.matched(lines, own))
    assert rules.funnel(hits).first().asDict() == {"rg_raw": 8, "filtered_by_path": 2, "filtered_by_scope": 0, "filtered_by_comment": 0, "filtered_by_dynamic": 1, "filtered_by_extra": 1, "kept": 4}
    kept = hits.where("stage = 'kept'")
    best = rules.one_a_line(kept)
    assert rows(best.select("line", "rule_id"), "line") == [(1, "high"), (5, "built"), (7, "more")]
    assert rows(rules.skipped(rules.table(spark, own), kept).select("rule_id")) == [("unused",)]
    again = rules.one_a_line(best.select(*kept.columns))
    assert rows(again.select("line", "rule_id"), "line") == rows(best.select("line", "rule_id"), "line")
    overridden = rules.staged(rules.matched(lines, own), override=F.when(F.col("line") == 4, True).when(F.col("line") == 5, False))
    assert rows(overridden.where("stage = 'kept' and rule_id = 'built'").select("line")) == [(4,)]
    assert rules.load(rules.table(spark, own).withColumn("endings", F.array().cast("array<string>")))[1].severity == "high"


def test_column_is_the_match_s_own(spark):
    """The place of the match, not the first place of its text."""
    own = [rules.Rule("word", "foo", r"\bfoo", "any", "xss", "low"), rules.Rule("ahead", "bar", r"bar(?=\()", "any", "xss", "low"), rules.Rule("letters", "é", r"é\b", "any", "xss", "low")]
    lines = spark.createDataFrame([("a.js", 1, "xfoo foo"), ("a.js", 2, "bar bar( foo"), ("a.js", 3, "éa é 🙂 foo")], "file string, line int, code string")
    found = {(r["line"], r["rule_id"]): r["column"] for r in rules.matched(lines, own).collect()}
    assert found == {(1, "word"): 5, (2, "ahead"): 4, (2, "word"): 9, (3, "letters"): 3, (3, "word"): 7}


def test_comments_and_strings():
    source = "<?php\n/* f() */ f();\n$a = 'f() \\' f()'; f(); // f()\n# f()\n$b = \"\n f()\n\"; f();"
    at = lambda line, n: source.split("\n")[line - 1].find("f()", 0 if not n else source.split("\n")[line - 1].find("f()") + 1) if n < 2 else source.split("\n")[line - 1].rfind("f()")
    places = [(2, at(2, 0)), (2, at(2, 1)), (3, at(3, 0)), (3, 19), (3, at(3, 2)), (4, at(4, 0)), (6, at(6, 0)), (7, at(7, 0)), (99, 0)]
    assert code.code_flags(source, places) == [False, True, False, True, False, False, False, True, True]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("cur.execute('select 1')", False),
        ("cur.execute(f'select {1}')", False),
        ("x = input()\ncur.execute('a' + x)", True),
        ("x = request.args.get('q')\ncur.execute('a %s' % x)", True),
        ("d = {'a': 'x'}\nk = d.get(1, 'y')\ncur.execute(k)", False),
        ("p = ['a']\np.append(request.form)\ncur.execute(' '.join(p))", True),
        ("def f(q):\n    cur.execute(q)\nf('select')", False),
        ("def f(q):\n    cur.execute(q)\nf(input())", True),
        ("for t in ['a', 'b']:\n    cur.execute('x ' + t)", False),
        ("cur.execute(unknown())", None),
        ("cur.execute('a' if x else input())", True),
        ("cur.execute('{}'.format(request.values))", True),
        ("not python (", None),
        ("print(1)", None),
    ],
)
def test_sql_built_in_python(source, expected):
    line = next((i for i, t in enumerate(source.split("\n"), 1) if "execute" in t), 1)
    assert code.judged(source, [line], ["sql"]) == [expected]


def test_long_chains_in_python():
    """A query that is built over thousands of lines is judged by its beginning, whatever Python's limit of depth."""
    n = 3000
    source = "\n".join(["q0 = request.args.get('x')", *(f"q{i} = q{i - 1} + 'a'" for i in range(1, n)), f"cur.execute(q{n - 1})", "r = 'a'" + " + 'a'" * 400, "cur.execute(r)"])
    assert code.judged(source, [n + 1, n + 3], ["sql", "sql"]) == [True, False]
    assert code.judged(source.replace("request.args.get('x')", "'query { a }'"), [n + 1], ["graphql"]) == [True]


def test_graphql_calls():
    lines = "schema.execute(q)\ndb.execute('query { a }')\nx.execute('query { a }')\nx.execute('select a from b')\nx.execute(y)"
    assert code.judged(lines, [1, 2, 3, 4, 5], ["graphql"] * 5) == [True, False, True, False, None]


def test_javascript_templates():
    pack = lambda *bodies: "\n".join(f"### {n} (a.js:1)\n```js\n{b}\n```" for n, b in bodies)
    good = pack(("show", "el.innerHTML = `${escapeHtml(a)} ${x ? 'a' : 'b'} ${n.length}`;"))
    assert code.refuted(good, "show", "vulnerable") and not code.refuted(good, "show", "safe")
    assert not code.refuted(pack(("show", "el.innerHTML = `${escapeHtml(a)} ${raw}`;")), "show", "vulnerable")
    helped = pack(("show", "el.innerHTML = list.map(card).join('')"), ("card", "const t = `${escapeHtml(a)}`;\nreturn `<b>${t}</b>`"))
    assert code.refuted(helped, "show", "uncertain")
    assert not code.refuted(helped, "<module>", "uncertain") and not code.refuted(None, "show", "uncertain")


def test_confidence_and_verdict(spark):
    given = ["90%", "high", "Very High", "medium/low", "0.3", "42", "140", "-1", "abc", "", None, "true", "偏高"]
    assert [r[0] for r in values(spark, "v string", [(g,) for g in given], F.coalesce(verdicts.confidence(F.col("v")), F.lit(0.5)))] == [0.9, 0.85, 0.95, 0.45, 0.3, 0.42, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.85]
    given = ["Vulnerable", "not exploitable", "unsafe", "存在漏洞", "无漏洞", "", None, "hm", "likely vulnerable"]
    assert [r[0] for r in values(spark, "v string", [(g,) for g in given], verdicts.verdict(F.col("v")))] == ["vulnerable", "safe", "safe", "vulnerable", "safe", "uncertain", "uncertain", "uncertain", "vulnerable"]
    assert values(spark, "v string", [("unsafe",)], verdicts.verdict(F.col("v"), careful=True)) == [("vulnerable",)]


def test_loose_answers(spark):
    answers = [
        ("a", '{"verdict": "vulnerable", "confidence": "high", "missing_info": "path", "repair_rounds": "x"}'),
        ("b", '```json\n{"verdict": "safe", "confidence": "90%", "missing_info": ["x", " "]}\n```'),
        ("c", 'so: {"verdict": "vulnerable", "confidence": 0.4, "sink": {"file": "z.php", "line": 9}} end'),
        ("d", '{"verdict": "vul'),
        ("e", None),
        ("f", "[1, 2]"),
    ]
    df = spark.createDataFrame([(i, "xss", None, "s.php", 4, "f", r) for i, r in answers], "chain_id string, vulnerability_type string, severity string, sink_file string, sink_line int, sink_function string, raw string")
    out = {r["chain_id"]: r for r in findings.parsed(df).collect()}
    assert [(out[k]["verdict"], out[k]["confidence"]) for k in "abcdef"] == [("uncertain", 0.6), ("safe", 0.9), ("uncertain", 0.4), ("uncertain", 0.5), ("uncertain", 0.5), ("uncertain", 0.5)]
    assert out["a"]["missing_info"] == ["path"] and out["a"]["repair_rounds"] == 0 and out["a"]["told_file"] == "s.php" and out["a"]["severity"] == "medium"
    assert out["b"]["missing_info"] == ["x"] and out["c"]["told_file"] == "z.php" and out["c"]["cwe_guess"] == "CWE-79"


def test_breakpoints_and_repair(spark):
    df = spark.createDataFrame([("c", "app/views/show.php", ["模板未绑定", "auth unclear", "sanitizer_state", "nothing"], ["missing_permission_check"])], "chain_id string, sink_file string, told array<string>, resolved array<string>")
    df = df.withColumn("missing", findings.missing_kinds(F.col("told")))
    tasks = findings.repair_tasks(df)
    assert rows(tasks.select("place", "kind", "path"), "place") == [(1, "missing_template_binding", "app/views"), (2, "missing_permission_check", "app/views"), (3, "missing_sanitizer_state", "app/views")]
    out = findings.repaired(df, tasks.where("place = 1")).first()
    assert (out["resolved"], out["unresolved"], out["repair_rounds"], out["evidence_count"]) == (["missing_permission_check", "missing_template_binding"], ["missing_sanitizer_state"], 1, 1)


def test_precheck(spark):
    df = spark.createDataFrame([("a", "cross_request", ["html_escape"], ["dangerous_sink"]), ("b", "cross_request", ["html_escape"], ["file_flow"]), ("c", "cross_request", None, None), ("d", "direct_call", ["html_escape"], None)], "chain_id string, chain_kind string, refuting array<string>, positive array<string>")
    assert rows(findings.prechecked(df).select("chain_id", "verdict", "confidence")) == [("a", "safe", 0.95)]


def test_chain_files(spark):
    full = spark.createDataFrame([("C-1", 1, "callscan", None, False), ("C-2", 2, "callscan", None, False), ("C-3", 3, "callscan", None, False)], "chain_id string, line int, origin string, evidence_quality string, suppressed boolean")
    flow_rows = spark.createDataFrame([("DF-1", 1, "dataflow", "weak", False), ("DF-2", 2, "dataflow", "probable", True), ("DF-3", 3, "dataflow", "probable", False), ("C-1", 4, "dataflow", "probable", False)], full.schema)
    kept = findings.auditable(findings.united(full, flow_rows))
    assert [r[0] for r in rows(kept.select("chain_id", "source_ord", "line"), "source_ord", "line")] == ["C-1", "C-2", "C-3", "DF-3"]
    log = spark.createDataFrame([("C-1", 1, "bad"), ("C-1", 2, "good"), ("", 3, "x")], "chain_id string, line int, verdict string")
    done = findings.progress(log)
    assert rows(done.select("chain_id", "verdict")) == [("C-1", "good")]
    assert findings.pending(full, done).count() == 2 and findings.completed(full, done).count() == 1


def test_checker(spark):
    df = spark.createDataFrame([("a", "Confirmed", "0.9", "x=1", "HIGH"), ("b", "confirmed", "0.9", " ", "urgent"), ("c", "maybe", None, None, None), ("d", "refuted", "95%", None, "low")], "finding_id string, verdict string, confidence string, concrete_payload string, severity_revised string")
    out = review.checked(df)
    assert rows(out.select("finding_id", "verdict", "confidence", "severity_revised"), "finding_id") == [("a", "confirmed", 0.9, "high"), ("b", "refuted", 0.7, None), ("c", "need_context", 0.5, None), ("d", "refuted", 0.95, "low")]
    assert review.checker_summary(out, 4, 0).first()["status"] == "ok" and review.checker_summary(out.limit(0), 2, 2).first()["status"] == "error"
    found = spark.createDataFrame([("a", "Vulnerable"), ("b", "safe")], "chain_id string, verdict string")
    assert rows(review.targets(found).select("chain_id")) == [("a",)] and review.targets(found, "b").count() == 1
    with pytest.raises(ValueError):
        review.targets(found, "zz")


def test_marks(spark):
    columns = "chain_id string, favorite boolean, codex_verdict string, codex_review string, manual_verdict string, manual_review string, cc_verdict string, cc_review string, user_verdict string, note string"
    raw = spark.createDataFrame([("a", None, None, None, "", None, None, None, "true_positive", "old"), ("b", False, None, None, None, None, None, None, None, None), ("c", True, None, None, None, None, None, None, None, None)], columns)
    marks = review.normal_marks(raw)
    assert rows(marks.select("chain_id", "favorite", "manual_verdict", "manual_review"), "chain_id") == [("a", False, "true_positive", "old"), ("c", True, "", "")]
    changes = spark.createDataFrame([("a", "manual", "clear", "", None), ("c", "cc", "uncertain", None, False), ("d", "codex", "false_positive", None, None)], "chain_id string, track string, verdict string, review string, favorite boolean")
    after = review.upsert(marks, changes)
    assert rows(after.select("chain_id", "favorite", "codex_verdict", "manual_verdict", "cc_verdict"), "chain_id") == [("c", False, "", "", "uncertain"), ("d", False, "false_positive", "", "")]


def test_quality(spark):
    columns = "chain_id string, codex_verdict string, manual_verdict string, cc_verdict string"
    marks = spark.createDataFrame([("a", "", "true_positive", ""), ("b", "true_positive", "false_positive", ""), ("c", "uncertain", "", ""), ("z", "", "true_positive", "")], columns)
    vulnerable = spark.createDataFrame([("a",), ("b",), ("c",)], "chain_id string")
    out = review.quality(vulnerable, marks, 1).first()
    assert (out["true_positives"], out["false_positives"], out["uncertain"], out["precision"], out["recall"], out["f1"]) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert review.quality(vulnerable, marks.limit(0)).first()["precision"] is None


def test_helpers_breadth_first(spark):
    calls = spark.createDataFrame([("r", "a", 0), ("r", "b", 1), ("a", "c", 0), ("b", "c", 0), ("b", "d", 1), ("c", "r", 0), ("d", "e", 0)], "caller string, callee string, child_ord int")
    found = chains.helpers(spark.createDataFrame([("r",)], "root string"), calls, depth=2, most=8)
    assert rows(found.select("helper", "depth"), "place") == [("a", 1), ("b", 1), ("c", 2), ("d", 2)]
    functions = spark.createDataFrame([("f.js", "show", "if (x) { card(a); list.map(row) } other(1)"), ("f.js", "card", "return show()"), ("f.js", "row", "")], "file string, name string, code string")
    assert rows(chains.helper_calls(functions).select("caller", "callee", "child_ord"), "caller", "child_ord") == [("card", "show", 0), ("show", "card", 1), ("show", "row", 5)]


def test_chains_end_and_cap(spark):
    calls = spark.createDataFrame([("b", "a", 0, False), ("c", "b", 0, False), ("a", "c", 0, False), ("d", "b", 1, True), ("e", "d", 0, False), ("x", "b", 99, False)], "caller string, callee string, child_ord int, ends boolean")
    found = chains.reverse_chains(spark.createDataFrame([("a",), ("lonely",)], "sink string"), calls)
    assert rows(found.select("sink", F.array_join("path", ">")), "sink", "path") == [("a", "a>c>b>a"), ("a", "d>b>a"), ("lonely", "lonely")]
    assert rows(chains.capped(found, 1).select("sink", "place"), "sink") == [("a", 1), ("lonely", 1)]
    deep = spark.createDataFrame([(f"n{i + 1}", f"n{i}", 0, False) for i in range(30)], "caller string, callee string, child_ord int, ends boolean")
    assert chains.reverse_chains(spark.createDataFrame([("n0",)], "sink string"), deep).select(F.size("path")).first()[0] == 9


def test_symbols(spark):
    lines = spark.createDataFrame([("a.php", i, t) for i, t in enumerate(["class A {", "public function f() {", "g();", "}", "function h() {", "f(1); f(2)", "}"], 1)] + [("b.php", 1, "f()")], "file string, line int, code string")
    from tracewarden.functions import fixed

    spans = symbols.spans(lines, fixed.PHP_FUNCTION, fixed.PHP_CLASS)
    assert rows(spans.select("function", "start", "end"), "start") == [("A.f", 2, 4), ("A.h", 5, 7)]
    hits = spark.createDataFrame([("a.php", 3), ("a.php", 1), ("b.php", 1)], "file string, line int")
    assert rows(symbols.enclosing(hits, spans, ["file", "line"]).select("file", "line", "function"), "file", "line") == [("a.php", 1, "<module>"), ("a.php", 3, "A.f"), ("b.php", 1, "<module>")]
    sites = symbols.call_sites(spans.withColumn("callee", F.lit("A.f")), lines, ["file", "start"])
    assert rows(sites.select("start", "line", "code"), "start") == [(2, 2, "public function f() {"), (5, 6, "f(1); f(2)")]
    long = spark.createDataFrame([([f"l{i}" for i in range(130)],), (["a"],)], "code array<string>").select(symbols.shortened(F.col("code"))).collect()
    assert long[0][0].split("\n")[110] == "// ... omitted 10 line(s) ..." and len(long[0][0].split("\n")) == 120 and long[1][0] == "a"


def test_includers(spark):
    lines = spark.createDataFrame([("index.php", 3, "require_once 'lib/db.php';"), ("other.php", 1, "include(\"../lib/db.php\")"), ("x.php", 1, "require 'my_db.php'"), ("lib/db.php", 1, "require 'lib/db.php'")], "file string, line int, code string")
    found = symbols.includers(spark.createDataFrame([("lib/db.php",)], "file string"), symbols.includes(lines))
    assert rows(found.select("place", "file"), "place") == [(1, "index.php"), (2, "other.php")]


def test_paths(spark):
    given = ["src/a.test.js", "a/vendor/b.php", "src/A.php", ".env", "x", "Docs/readme.md"]
    out = values(spark, "p string", [(g,) for g in given], paths.extension(F.col("p")), paths.skip_reason(F.col("p")).isNull(), paths.scan_language(F.col("p")))
    assert out == [(".js", False, "javascript"), (".php", False, "php"), (".php", True, "php"), ("<no_ext>", True, "template"), ("<no_ext>", True, "template"), (".md", False, "template")]
    assert values(spark, "p string", [("s/o/r/v",), ("s/o/r",), ("s/../r/v",)], paths.project_part(F.col("p"), 4)) == [("v",), (None,), (None,)]
    assert values(spark, "p string", [("a/b/c.php",), ("c.php",)], F.array_join(paths.needles(F.col("p")), "|")) == [("a/b/c.php|b/c.php|c.php",), ("c.php",)]


def test_texts(spark):
    assert values(spark, "t string, n int", [("aé日b", 0), ("aé日b", 1), ("aé日b", 2), ("aé日b", 3), ("aé日b", 5), ("aé日b", 6), ("aé日b", 99)], text.char_index(F.col("t"), F.col("n"))) == [(0,), (1,), (1,), (2,), (2,), (3,), (4,)]
    assert values(spark, "t string", [("head\n## a\nx\n## b",), ("## a",), ("none",)], F.array_join(text.sections(F.col("t")), "|")) == [("head\n|## a\nx\n|## b",), ("|## a",), ("none",)]
    assert values(spark, "t string", [("x" * 5_000,), ("ok",), (None,)], text.shortened_log(F.col("t"))) == [("x" * 4_000 + "...<truncated 1000 chars>",), ("ok",), (None,)]
    assert values(spark, "t string", [("obj.user['name']",), ("request.form",), ("$a . $b",), ("",)], text.field_of(F.col("t"))) == [("user",), ("",), ("b",), ("",)]
    assert text.available_tokens(100, 200, 10) == 1
    assert values(spark, "c long, n long", [(450_000, 1), (0, 0)], text.estimated_tokens(F.col("c"), F.col("n"))) == [(150_008,), (0,)]


def test_git_refs(spark):
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    df = spark.createDataFrame([(f"{a}\trefs/heads/main",), (f"{b} refs/tags/v1",), (f"{c} refs/tags/v1^{{}}",), (f"{a} refs/pull/1",), ("ref: refs/heads/main HEAD",), ("zz refs/heads/x",)], "value string")
    assert rows(files.git_refs(df).select("kind", "name", "short_commit", "peeled"), "kind") == [("branch", "main", "a" * 12, False), ("tag", "v1", "c" * 12, True)]


def test_tree_budget(spark):
    listed = [(f"file{i:03}.txt",) for i in range(121)] + [("pom.xml",)] + [(f"module{i:02}/src/main/A{k}.java",) for i in range(80) for k in range(6)]
    df = spark.createDataFrame(listed, "file string")
    assert trees.counts(df).first().asDict() == {"files": 602, "dirs": 240}
    whole, policy = trees.fitting(df)
    assert policy is None and whole.count() == 602
    small, policy = trees.fitting(df, 3_000)
    shown = [r[0] for r in small.collect()]
    assert trees.sizes(df, (policy,)).first()["chars"] <= 3_000 < trees.sizes(df, (trees.WHOLE,)).first()["chars"] and "pom.xml" in shown


def test_rounds_turns_and_states(spark):
    log = [(1, "llm_response", "x", "r0"), (2, "llm_request", "a", None), (3, "llm_error", "a", "e1"), (4, "llm_response", "a", "r1"), (5, "llm_response", "a", "r2"), (6, "llm_request", "b", None), (7, "other", "b", "z")]
    df = spark.createDataFrame([("l", *r) for r in log], "log string, line long, type string, agent string, text string")
    assert rows(telemetry.rounds(df).select("round", "agent", "response", "error"), "round") == [(0, "x", "r0", None), (1, "a", "r2", "e1"), (2, "b", None, None)]
    turns = spark.createDataFrame([(1, 1, "pending", 0), (1, 2, "ok", 5), (1, 3, "error", 6), (1, 4, "ok", 7), (2, 5, "pending", 0), (2, 6, "pending", 1)], "turn int, line int, status string, prompt int").withColumn("completion", F.lit(1))
    assert rows(telemetry.merged_turns(turns, ["turn"]).select("turn", "status", "line"), "turn") == [(1, "ok", 4), (2, "pending", 6)]
    assert rows(telemetry.first_tokens(turns, ["turn"]).select("turn", "prompt")) == [(1, 5)]
    run = [("a", 1, "agent_start", None), ("a", 2, "agent_error", None), ("a", 3, "agent_end", 2.0), ("b", 4, "agent_start", None), ("c", 5, "agent_start", None), ("c", 6, "agent_end", 4.0), ("d", 7, "llm_request", None), ("e", 8, "agent_error", None), ("e", 9, "agent_start", None)]
    states = telemetry.agent_states(spark.createDataFrame(run, "agent string, line int, type string, elapsed double"))
    assert rows(states.select("agent", "status"), "agent") == [("a", "error"), ("b", "running"), ("c", "done"), ("d", "pending"), ("e", "running")]
    assert rows(telemetry.workflow(states, ["c", "zz"]).select("agent", "after", "status"), "place") == [("c", None, "done"), ("zz", "c", "pending")]


def test_reports(spark):
    scans = spark.createDataFrame([("p", "1", True, 0, 1), ("p", "2", False, 1, 5), ("q", "3", False, 2, 5), ("q", "4", False, 3, 5)], "project_path string, scan_id string, has_audit boolean, ord int, vulnerable int")
    assert rows(metrics.latest(scans).select("project_path", "scan_id"), "project_path") == [("p", "1"), ("q", "4")]
    assert rows(metrics.best_scan(scans).select("project_path", "scan_count", "best_scan_id"), "project_path") == [("p", 2, "2"), ("q", 2, "3")]
    full = scans.withColumns({m: F.lit(0) for m in metrics.MEASURES if m != "vulnerable"})
    assert metrics.funnel(full).first()["vuln_per_audit"] is None
    assert browse.page_size("audit") == 50
    with pytest.raises(ValueError):
        browse.page_size("audit", 501)
    pages = browse.page(scans, [F.col("scan_id")], 1, 2)
    assert [r["scan_id"] for r in pages.collect()] == ["2", "3"] and browse.page(scans, [F.col("scan_id")], 1).count() == 3


def test_files_and_writers(spark, tmp_path):
    tree = tmp_path / "repo"
    for name, body in {"src/a.php": "<?php\r\necho 1;", "vendor/b.php": "x", "img/c.png": "x", "d.pyc": "x", "docs/e.py": "x", "f.txt": "x"}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(body.encode())
    listed = files.listing(spark, f"file://{tree}")
    assert sorted(r["file"] for r in listed.collect()) == ["docs/e.py", "f.txt", "img/c.png", "src/a.php"]
    found = files.sources(spark, str(tree))
    assert rows(files.lines(found).select("file", "line", "code"), "line") == [("src/a.php", 1, "<?php"), ("src/a.php", 2, "echo 1;")]
    out = f"{tmp_path}/chains"
    data = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "n int, chain_id string")
    sinks.with_meta(data, F.struct(F.lit("meta").alias("type"), F.lit(3).alias("total")), out, [F.col("n")])
    (tmp_path / "chains" / "_bad").mkdir()
    back = files.json_lines(spark, out, "n int, chain_id string")
    assert rows(back, "n") == [(1, "a"), (2, "b"), (3, "c")]
    assert json.loads(files.meta_line(spark, f"{out}/_meta").first()[0]) == {"type": "meta", "total": 3}
    (tmp_path / "log.jsonl").write_text('{"n": 1, "chain_id": "x"}\nnot json\n\n{"type": "meta"}\n')
    assert rows(files.json_lines(spark, f"{tmp_path}/log.jsonl", "n int, chain_id string")) == [(1, "x")]
    (tmp_path / "r.md").write_text("head\n## one\na\n## two\n")
    assert rows(files.markdown(spark, f"{tmp_path}/r.md").select("number", "section"), "number") == [(0, "head\n"), (1, "## one\na\n"), (2, "## two\n")]
    history = spark.createDataFrame([("a", 1), ("a", 2)], "target string, version int")
    assert rows(sinks.next_versions(history, spark.createDataFrame([("a",), ("b",)], "target string")).select("target", "version"), "target") == [("a", 3), ("b", 1)]
    assert rows(files.tail(data, F.col("n"), 2).select("n")) == [(2,), (3,)]
    report = sinks.report(data.select("n", "chain_id", F.lit("t").alias("title"), F.lit("safe").alias("verdict"), F.lit(0.5).alias("confidence"), F.lit("low").alias("severity"), F.lit("p").alias("principle")), "n", F.lit(3))
    assert report.where("n = 1").first()["section"].startswith("## [1/3] t")


def test_sources_beyond_the_viewers_prefix(spark, tmp_path):
    from tracewarden.operators import facts

    body = "t = request.form['x']\n" + "# filler\n" * (files.MOST_BYTES // 9 + 1) + "post.title = t\n"
    (tmp_path / "big.py").write_text(body)
    found = files.sources(spark, str(tmp_path))
    assert found.select("file", F.length("text")).collect() == [("big.py", len(body))]
    n = body.count("\n")
    assert files.lines(found).where("code like 'post%'").select("line", "code").collect() == [(n, "post.title = t")]
    assert rows(facts.facts(found).select("role", "field", "line", "source_line")) == [("write", "title", n, 1)]
    assert files.viewed(spark, str(tmp_path), "big.py").select("file", "size", "text", "truncated").collect() == [("big.py", len(body), body[: files.MOST_BYTES], True)]


def test_sources_that_are_not_utf8(spark, tmp_path):
    bodies = {"a.py": b"A\xc3", "b.py": "x = 'caf\xe9'\ny = 1\n".encode("latin-1"), "c.py": "\ufeffé".encode(), "d.py": b"\xe2\x82 \xf0\x9f\x98x \xed\xa0\x80 \xc0\xaf \xff\xfe \xf4\x90\x80\x80"}
    bodies["e.py"] = b"a" * (files.MOST_BYTES - 1) + "é".encode()
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    assert dict(files.sources(spark, str(tmp_path)).select("file", "text").collect()) == {k: v.decode(errors="replace") for k, v in bodies.items()}
    assert files.viewed(spark, str(tmp_path), "e.py").first()["text"] == bodies["e.py"][: files.MOST_BYTES].decode(errors="replace")


def test_streams_match_batches(spark, tmp_path):
    from datetime import datetime

    log = tmp_path / "log"
    log.mkdir()
    lines = [{"log": "l", "line": i, "ts": f"2024-01-0{1 + i // 4}T00:0{i}:00Z", "type": k, "agent": "a", "elapsed": 1.0} for i, k in enumerate(["agent_start", "llm_request", "agent_end", "agent_start", "agent_error"])]
    (log / "1.json").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    states = f"{tmp_path}/states"
    events.to_table(events.agent_states(events.events(spark, str(log))), states, f"{tmp_path}/c1", "complete").awaitTermination()
    assert rows(spark.read.option("recursiveFileLookup", True).parquet(states).select("agent", "status")) == [("a", "error")]
    days = f"{tmp_path}/days"
    events.to_table(events.daily(events.events(spark, str(log)), "1 minute"), days, f"{tmp_path}/c2").awaitTermination()
    assert {tuple(r)[1:] for r in spark.read.parquet(days).collect()} == {("agent_start", 2), ("llm_request", 1), ("agent_end", 1)}
    runs = f"{tmp_path}/sessions"
    events.to_table(events.sessions(events.events(spark, str(log)), "5 minutes", "1 minute"), runs, f"{tmp_path}/c3").awaitTermination()
    assert rows(spark.read.parquet(runs).select("agent", "n")) == [("a", 4)]
    due = spark.createDataFrame([("1", "pending", "2024-01-01T00:00:00"), ("2", "running", "2024-01-01T00:00:00"), ("3", "stopped", "2030-01-01T00:00:00"), ("4", "pending", "junk"), ("5", "pending", None)], "scan_id string, status string, scheduled_at string")
    assert rows(events.due(due, F.lit(datetime(2025, 1, 1))).select("scan_id")) == [("1",)]


def test_sql_texts(spark):
    given = [("INSERT INTO Users (a.id, `Full Name` as nm, x) VALUES (1)",), ("update users set a.b = 1, c=2 where id = 3",), ("select u.name, max(v) as top from `logs` l",), ("select * from t",), ("x = 1",)]
    c = F.col("t")
    out = values(spark, "t string", given, F.array_join(text.written_columns(c), ","), F.array_join(text.selected_columns(c), ","), flow.sql_table(c), flow.sql_column(c, F.lit("zz")))
    assert out == [("id,nm,x", "", "users", "id"), ("b,c", "", "users", "b"), ("", "name,top", "logs", "zz"), ("", "", "t", "zz"), ("", "", None, "zz")]


def test_packs_can_be_read_back(spark):
    heads = spark.createDataFrame([("c", "# head"), ("d", "# alone")], "chain_id string, head string")
    nodes = spark.createDataFrame([("c", 1, 0, "a.js::run", "run"), ("c", 1, 1, "a.js::show", "show"), ("c", 2, 0, "a.js::show", "show")], "chain_id string, place int, at int, function_ref string, name string")
    pool = spark.createDataFrame([("a.js::run", "run", "a.js", 1, 3, "show()"), ("a.js::show", "show", "a.js", 5, 9, "el.innerHTML = x")], "function_ref string, function string, file string, line int, line_end int, code_slice string")
    from tracewarden.operators import catalog, packs

    out = dict(rows(packs.packs(heads, nodes, pool)))
    assert "1. run -> show\n2. show" in out["c"] and out["c"].count("### show (a.js:5-9)") == 1 and out["d"] == "# alone"
    assert code.sections(out["c"])["show"] == "el.innerHTML = x"
    asked = spark.createDataFrame([(0, []), (1, ["all"]), (2, ["poc", "zz"])], "i int, s array<string>")
    known = {"all": ("poc", "fix"), "code": ("fix",)}
    assert rows(asked.orderBy("i").select(F.array_join(catalog.chosen_sections(F.col("s"), known), ","))) == [("fix,poc",), ("fix,poc",), ("poc",)]
    changed = spark.createDataFrame([("a/marks.json", 5), ("b/marks.json", 9), ("c/x", 99)], "file string, modified int")
    assert rows(catalog.fingerprint(changed, ("marks.json",))) == [(2, 9)]
    assert rows(catalog.with_options(spark.createDataFrame([("99", "x")], "callscan_concurrency string, auditor_concurrency string"))) == [(16, 8)]
    assert catalog.confirmed_only(spark.createDataFrame([("weak", False), ("probable", True), ("probable", False)], "evidence_quality string, suppressed boolean")).count() == 1
    assert rows(packs.public_rules(rules.table(spark, [rules.Rule("a", "f", "p", "php", "xss", level="l9", semantic_tags=(" t", "t", ""))])).select("level", F.array_join("semantic_tags", ","))) == [("L0", "t")]
    assert packs.compact(heads.withColumn("index", F.lit(1))).columns == ["chain_id", "index"]


def test_scan_checks(spark):
    from tracewarden.operators import code, rules
    from tracewarden.sources.files import lines

    files = spark.createDataFrame(
        [("a.php", "<?php\n// eval($a);\neval($b); $s = 'eval(';\n$t = 'x\neval($c);'; eval($d);"), ("b.py", "client.execute('query { user }')\ndb.execute('select 1')\nq = input()\ncur.execute(q)"), ("c.js", "eval(x)"), ("d.py", "broken(\nclient.execute('query')"), ("e.php", None)],
        "file string, text string",
    )
    own = [rules.Rule("php-eval", "eval", r"eval\(", "php", "code_execution", endings=("php", "js")), rules.Rule("py-graphql-gql-client", "execute", r"client\.execute\(", "python", "graphql_injection", endings=("py",), needs_dynamic=True), rules.Rule("py-sql", "execute", r"(db|cur)\.execute\(", "python", "sql_injection", endings=("py",), needs_dynamic=True)]
    hits = code.judged_hits(rules.matched(lines(files), own), files)
    staged = rules.staged(hits, None, F.col("in_code"), F.col("override")).select("file", "line", "in_code", "override", "stage")
    assert sorted(map(tuple, staged.collect()), key=str) == sorted([
        ("a.php", 2, False, None, "filtered_by_comment"), ("a.php", 3, True, None, "kept"), ("a.php", 5, False, None, "filtered_by_comment"),
        ("b.py", 1, True, True, "kept"), ("b.py", 2, True, False, "filtered_by_dynamic"), ("b.py", 4, True, True, "kept"),
        ("c.js", 1, True, None, "kept"), ("d.py", 2, True, None, "filtered_by_dynamic"),
    ], key=str)
    assert code.judged_hits(rules.matched(lines(files.limit(0)), own), files).count() == 0


def test_paths_with_signs(spark, tmp_path):
    from tracewarden.plans.scratch import write_tree

    place = "s/o wner/r#1+2/v%201"
    body = '{"status": "done"}'
    given = spark.createDataFrame([(f"{place}/artifacts/scans/7/scan.json", body), (f"{place}/é+ä.md", "x\n## y"), ("empty", None)], "file string, body string")
    assert write_tree(given, f"file://{tmp_path}") == 3
    assert files.scans(spark, f"file://{tmp_path}", "status string").collect() == [(place, "7", "done")]
    found = files.markdown(spark, f"file://{tmp_path}/s/o wner/*/*/*.md").select("path", "number").collect()
    assert sorted((r.path.split("/", 3)[-1][-len(f"{place}/é+ä.md") :], r.number) for r in found) == [(f"{place}/é+ä.md", 0), (f"{place}/é+ä.md", 1)]
    assert (tmp_path / "empty").read_bytes() == b""


def test_logs(spark, tmp_path):
    from tracewarden.sources import files

    for name in ("b.log", "a.log", "c.txt"):
        (tmp_path / name).write_text(name)
    assert [(r.name, r.size) for r in files.logs(spark, str(tmp_path)).collect()] == [("b.log", 5), ("a.log", 5)]


def test_graph_keeps_one_node_of_a_field(spark):
    from tracewarden.operators import graph

    schema = "role string, file string, line int, kind string, field string, evidence string, sink_function string"
    facts = spark.createDataFrame([("write", "a.py", 1, "sql_field", "t", "x", None), ("write", "b.py", 2, "sql_field", "t", "y", None), ("write", "b.py", 2, "sql_field", "t", "y", None), ("sink", "c.py", 3, "sql_field", "t", None, "f"), ("read", "d.py", 4, "sql_field", "t", "", None)], schema)
    nodes, edges = graph.nodes(facts), graph.edges(facts)
    assert sorted((r.kind, r.file, r.line) for r in nodes.collect()) == [("request_source", "a.py", 1), ("request_source", "b.py", 2), ("sink", "c.py", 3), ("storage_field", "c.py", 3)]
    assert sorted((r.file, r.line) for r in edges.collect()) == [("a.py", 1), ("b.py", 2)]
    assert {(r.measure, r.key): r.n for r in graph.summary(nodes, edges, facts).collect()}[("storage", "sql_field")] == 3
