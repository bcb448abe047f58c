"""Queries of what needs a file's grammar: every line of every document becomes lines of a program, by the line's length.

The words of a line go into comments, strings and templates, so that whole texts pass through the readers, and what a line means
depends on the lines before it. The SQL never builds the programs: it works the answers out from lengths and line numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..operators import bridge, code, facts, rules
from ..sources import files as sources
from . import standins as S
from .registry import query, quoted

#: Characters that a language could read as more than words, and all that ends a line.
SPECIAL = "\"'`\\${}#\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029\x00"
CUT_SQL = f"{S.FILES_SQL}, raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM files)"


def _program(forms: list, size: int) -> Column:
    """The document's lines, each in the form at its length modulo size: functions of its words and its number (from 1)."""

    def line(x: Column, i: Column) -> Column:
        words, n = F.regexp_replace(x["line"], f"[{''.join(map(re.escape, SPECIAL))}]", ""), (i + 1).cast("string")
        made = None
        for k, form in enumerate(forms):
            here, text = x["form"] == k, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in form(words, n)))
            made = F.when(here, text) if made is None else made.when(here, text)
        return made

    cut = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), (F.length(x) % size).alias("form")))
    return F.array_join(F.transform(cut, line), "\n")


def _files(spark, sf_dir, ending: str, text: Column):
    # asked of the table: asked of the program, it would be made once more for the answer
    given = S.table(spark, sf_dir, "documents").where("text is not null")
    return given.select("doc_id", F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(ending)).alias("file"), text.alias("text"))


PHP_FORMS = [
    lambda w, n: ["/* ", w, " eval($x);"], lambda w, n: [w, " */ eval($x);"], lambda w, n: ["// ", w, " eval($x);"], lambda w, n: ["$s = 'x' . ", w, "; eval($x);"],
    lambda w, n: ["echo \"", w, " eval($x);"], lambda w, n: [w, " eval($x);"], lambda w, n: [w, "\" eval($x);"], lambda w, n: ["# it's ", w, " eval($x);"], lambda w, n: ["'", w, "\\' eval($x);"],
]
#: What the lines above come to, for SQL: the same texts, and what is a comment or a string in them.
_WORDS_SQL = "translate(raw, concat('\"''`\\${}#', chr(13), chr(11), chr(12), chr(28), chr(29), chr(30), chr(133), chr(8232), chr(8233)), '')"
_PHP_SQL = f"CASE length(raw) % 9 WHEN 0 THEN concat('/* ', w, ' eval($x);') WHEN 1 THEN concat(w, ' */ eval($x);') WHEN 2 THEN concat('// ', w, ' eval($x);') WHEN 3 THEN concat('$s = ''x'' . ', w, '; eval($x);') WHEN 4 THEN concat('echo \"', w, ' eval($x);') WHEN 5 THEN concat(w, ' eval($x);') WHEN 6 THEN concat(w, '\" eval($x);') WHEN 7 THEN concat('# it''s ', w, ' eval($x);') ELSE concat('''', w, '\\'' eval($x);') END"
_SPANS = r"""(?s)/\*.*?(?:\*/|\z)|(?://|#)[^\r\n]*|"(?:\\.|[^"\\])*(?:"|\z)|'(?:\\.|[^'\\])*(?:'|\z)"""
PHP_SQL = f"{CUT_SQL}, php AS (SELECT doc_id, count(*) AS hits, string_agg({_PHP_SQL}, chr(10) ORDER BY n) AS program FROM (SELECT *, {_WORDS_SQL} AS w FROM raw) GROUP BY doc_id), told AS (SELECT doc_id, hits, CAST(len(regexp_extract_all(regexp_replace(program, {quoted(_SPANS)}, ' ', 'g'), 'eval\\(')) AS BIGINT) AS in_code FROM php)"
PHP_RULES = [rules.Rule("php-eval", "eval", r"eval\(", "php", "code_execution", "critical", ("php",))]


def _php(spark, sf_dir):
    found = _files(spark, sf_dir, ".php", _program(PHP_FORMS, 9))
    return code.judged_hits(rules.matched(sources.lines(found), PHP_RULES), found)


@query(f"WITH {PHP_SQL} SELECT doc_id, hits, in_code FROM told")
def php_comment_filter(spark, sf_dir):
    return _php(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("hits"), F.count_if("in_code").alias("in_code"))


PYTHON_FORMS = [
    lambda w, n: ["q", n, " = \"", w, "\"\ncur.execute(q", n, ")"],
    lambda w, n: ["q", n, " = \"", w, "\" + request.args.get(\"x\")\ncur.execute(q", n, ")"],
    lambda w, n: ["q", n, " = helper(\"", w, "\")\ncur.execute(q", n, ")"],
    lambda w, n: ["q", n, " = f\"", w, " {request.args}\"\ncur.execute(q", n, ")"],
    lambda w, n: ["q", n, " = q", (n.cast("int") - 1).cast("string"), " + \"", w, "\"\ncur.execute(q", n, ")"],
]
PYTHON_SQL = f"{CUT_SQL}, forms AS (SELECT doc_id, n, length(raw) % 5 AS f FROM raw), based AS (SELECT *, max(CASE WHEN f <> 4 THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS base FROM forms), judged AS (SELECT b.doc_id, CAST(2 * b.n AS INT) AS line, CASE WHEN o.f IN (1, 3) THEN true WHEN b.f = 2 THEN NULL ELSE false END AS dynamic FROM based b LEFT JOIN forms o ON o.doc_id = b.doc_id AND o.n = b.base)"
PYTHON_RULES = [rules.Rule("py-execute", "execute", r"\.execute\(", "python", "sql_injection", "high", ("py",), True)]


def _python(spark, sf_dir):
    found = _files(spark, sf_dir, ".py", _program(PYTHON_FORMS, 5))
    return code.judged_hits(rules.matched(sources.lines(found), PYTHON_RULES), found)


@query(f"WITH {PYTHON_SQL} SELECT doc_id, line, dynamic FROM judged")
def python_sql_ast(spark, sf_dir):
    return _python(spark, sf_dir).select("doc_id", "line", F.col("override").alias("dynamic"))


@query(f"WITH {PHP_SQL}, {PYTHON_SQL.removeprefix(CUT_SQL + ', ')} SELECT CAST((SELECT sum(hits) FROM told) + (SELECT count(*) FROM judged) AS BIGINT) AS rg_raw, CAST(0 AS BIGINT) AS filtered_by_path, CAST(0 AS BIGINT) AS filtered_by_scope, CAST((SELECT sum(hits - in_code) FROM told) AS BIGINT) AS filtered_by_comment, (SELECT count(*) FROM judged WHERE dynamic IS NOT TRUE) AS filtered_by_dynamic, CAST(0 AS BIGINT) AS filtered_by_extra, CAST((SELECT sum(in_code) FROM told) + (SELECT count(*) FROM judged WHERE dynamic) AS BIGINT) AS kept")
def rule_scan_checked_funnel(spark, sf_dir):
    """The funnel of a scan with the comment and override stages at work."""
    hits = _php(spark, sf_dir).unionByName(_python(spark, sf_dir))
    return rules.funnel(rules.staged(hits, None, F.col("in_code"), F.col("override")))


JS_FORMS = [lambda w, n: ["${u.name}"]] + [
    [lambda w, n: ["<b>${escapeHtml(", w, ")}</b>"], lambda w, n: [w], lambda w, n: ["${list.length} ", w], lambda w, n: ["${ok ? 'a' : 'b'} ", w]][k % 4] for k in range(1, 23)
]


@query(f"WITH {CUT_SQL}, told AS (SELECT doc_id, bool_or(length(raw) % 23 = 0) AS bad, bool_or(length(raw) % 23 IN ({', '.join(str(k) for k in range(4, 23, 4))})) AS cleaned FROM raw GROUP BY doc_id) SELECT doc_id, doc_id % 3 = 0 AND cleaned AND NOT bad AS refuted FROM told")
def js_template_refutation(spark, sf_dir):
    pack = F.concat(F.lit("### show (a.js:1-9)\n```js\nbox.innerHTML = `"), _program(JS_FORMS, 23), F.lit("`;\n```"))
    verdict = F.element_at(F.array(*map(F.lit, ("vulnerable", "uncertain", "safe"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", pack.alias("pack"), verdict.alias("verdict"))
    return rows.select("doc_id", code.template_refuted("pack", F.lit("show"), "verdict").alias("refuted"))


def _tainted(make):
    """A form for each of three variables: the length modulo 21 gives both."""
    return lambda k: (lambda w, n: make(f"t{k % 3}", w))


_TAINT = [_tainted(m) for m in (
    lambda t, w: [f"{t} = request.form[\"k\"]"], lambda t, w: [f"post.title = {t}"], lambda t, w: [f"post.body = escape({t})"], lambda t, w: ["# ", w],
    lambda t, w: [f"db.run(\"insert into posts (title) values (\" + {t} + \")\")"], lambda t, w: [f"u = {t}"], lambda t, w: ["post.note = u"],
)]
APP_FORMS = [_TAINT[k % 7](k) for k in range(21)]
TAINT_SQL = f"""{CUT_SQL}, l AS (SELECT doc_id, n, length(raw) % 7 AS f, length(raw) % 3 AS v FROM raw), t AS (SELECT doc_id, v, min(n) AS since FROM l WHERE f = 0 GROUP BY ALL), u AS (SELECT l.doc_id, min(n) AS since FROM l JOIN t USING (doc_id, v) WHERE f = 5 AND n > since GROUP BY ALL),
writes AS (SELECT doc_id, 'orm_field' AS kind, 'title' AS field, n FROM l JOIN t USING (doc_id, v) WHERE f = 1 AND n > since UNION ALL SELECT doc_id, 'sql_field', 'title', n FROM l JOIN t USING (doc_id, v) WHERE f = 4 AND n > since UNION ALL SELECT l.doc_id, 'orm_field', 'note', n FROM l JOIN u USING (doc_id) WHERE f = 6 AND n > since)"""


def _apps(spark, sf_dir):
    return _files(spark, sf_dir, "/app.py", F.concat(_program(APP_FORMS, 21), F.lit("\nrender_template(\"a.html\", head=post.title)"))).withColumn("language", F.lit("python"))


def _pages(spark, sf_dir):
    forms = [lambda w, n: ["<b>{{ post.title | safe }}</b>"]] + [lambda w, n: ["<i>", w, "</i>"]] * 8
    return _files(spark, sf_dir, "/a.html", _program(forms, 9)).withColumn("language", F.lit("template"))


def _doc(file: str) -> Column:
    return F.regexp_extract(file, "^src/f([0-9]+)/", 1)


@query(f"WITH {TAINT_SQL} SELECT doc_id, kind, field, CAST(n AS INT) AS line FROM writes")
def taint_extract(spark, sf_dir):
    return facts.facts(_apps(spark, sf_dir)).where("role = 'write'").select(_doc("file").cast("long").alias("doc_id"), "kind", "field", "line")


@query(f"WITH {TAINT_SQL}, s AS (SELECT doc_id, count(*) AS sinks FROM raw WHERE length(raw) % 9 = 0 GROUP BY doc_id), w AS (SELECT doc_id, count(*) AS writes FROM writes WHERE field = 'title' GROUP BY doc_id) SELECT doc_id, 'template_binding' AS match_quality, 'confirmed' AS evidence_quality, CAST(writes * sinks AS BIGINT) AS n FROM w JOIN s USING (doc_id)")
def taint_to_template(spark, sf_dir):
    """Facts of one application a document, bridged: its writes reach its template's raw output through the render call."""
    found = facts.facts(_apps(spark, sf_dir).unionByName(_pages(spark, sf_dir))).withColumn("field", F.concat(F.col("field"), F.lit("_f"), _doc("file")))
    columns = ["field", "kind", "file", "line", "evidence", "vulnerability_type", "severity", "template", "template_var", "source_expr", "sink_function"]
    side = lambda role, number: found.where(F.col("role") == role).select(F.col("fact_id").alias(number), *columns)
    rows = bridge.chains(side("write", "write_id"), side("read", "read_id"), side("sink", "sink_id"))
    return rows.groupBy(_doc("sink_file").cast("long").alias("doc_id"), "match_quality", "evidence_quality").agg(F.count("*").alias("n"))
