"""Queries of written reports, dashboards and graphs, of shown details and orders, and of told paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, paths
from ..operators import catalog, graph, metrics, packs, reports
from ..sources import sinks
from ..sources.shared import stored
from . import standins as S
from .finding_queries import FULL_SQL, _findings
from .record_queries import GRAPH_SQL, _graph_facts
from .registry import mapped, query, quoted
from .scratch import scratch

# --- The graph -------------------------------------------------------------------------------------------------------

_EDGE = "left(sha1(concat(kind, ':', source_id, ':', target_id, ':', file, ':', line)), 16)"


@query(f"WITH {GRAPH_SQL}, b AS (SELECT 'node' AS part, node_id AS id, kind, file, line, label, field FROM nodes UNION ALL SELECT 'edge', {_EDGE}, kind, file, line, source_id, target_id FROM edges) SELECT *, row_number() OVER (PARTITION BY part ORDER BY file, line, id) AS place FROM b")
def graph_written(spark, sf_dir):
    """The graph's files read back: places are those of lines in part files, in the order of their names."""
    out = scratch(spark, "graph")
    graph.written(_graph_facts(spark, sf_dir), out)
    node = _placed(spark, f"{out}/nodes.jsonl", "node_id string, kind string, file string, line int, label string, field string")
    edge = _placed(spark, f"{out}/edges.jsonl", "edge_id string, source_id string, target_id string, kind string, file string, line int")
    shown = node.select(F.lit("node").alias("part"), F.col("node_id").alias("id"), "kind", "file", "line", "label", "field", "place")
    return shown.unionByName(edge.select(F.lit("edge").alias("part"), F.col("edge_id").alias("id"), "kind", "file", "line", F.col("source_id").alias("label"), F.col("target_id").alias("field"), "place"))


def _placed(spark, path: str, schema: str):
    """Rows of JSON lines with their place: rows of the part files before, and lines of the own one in the order of its reading."""
    from pyspark.sql import Window as W

    rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("_part"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    sizes = rows.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))  # one row a file
    at = F.row_number().over(W.partitionBy("_part").orderBy("_block", "_at"))
    return rows.withColumn("_n", at).join(before, "_part").withColumn("place", F.col("_before") + F.col("_n")).drop("_part", "_block", "_at", "_before", "_n")


@query(f"WITH {GRAPH_SQL} SELECT 'node' AS measure, kind AS key, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind UNION ALL SELECT 'storage', kind, count(*) FROM src GROUP BY kind")
def graph_summary_file(spark, sf_dir):
    out = scratch(spark, "graph-summary")
    graph.written(_graph_facts(spark, sf_dir), out)
    return spark.read.schema("counts array<struct<measure: string, key: string, n: bigint>>").json(f"{out}/summary.json").select(F.inline("counts"))


# --- The audit report ------------------------------------------------------------------------------------------------

_EXTRA = {
    "source_file": S.pick("doc_id", "concat('in/', CAST(doc_id AS STRING), '.py')", "''", "CAST(NULL AS STRING)"), "source_line": "CAST(doc_id % 7 AS INT)",
    "poc": S.pick("doc_id", "' GET /x '", "''"), "fix": S.pick("doc_id", "CAST(NULL AS STRING)", "'escape it'", "' '"),
    "refuted_by": S.pick("doc_id", "concat('a|b  ', repeat('word ', CAST(doc_id % 40 AS INT)))", "''", "CAST(NULL AS STRING)", "concat('line', chr(10), 'end')"),
    "flow": S.pick("doc_id", "'read'", "'read,join,sink'", "''"), "lacks": S.pick("doc_id", "''", "'entry,auth'", "CAST(NULL AS STRING)"),
}
#: Verdicts by documents, so that each is common.
_VERDICT = S.pick("doc_id", "'vulnerable'", "'safe'", "'uncertain'", "'odd'", "'safe'")
_REPORT_SQL = f"{FULL_SQL}, e AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _EXTRA.items())}, {_VERDICT} AS told FROM g)"


def _report_rows(spark, sf_dir):
    rows = _findings(spark, sf_dir).selectExpr("*", *(f"{e} AS {n}" for n, e in _EXTRA.items()), f"{_VERDICT} AS told")
    told = F.array(F.struct(F.lit("scan").alias("source"), F.col("title").alias("detail"), F.col("sink_file").alias("file"), F.col("sink_line").alias("line")), F.struct(F.lit(None).cast("string").alias("source"), F.lit("seen").alias("detail"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line")))
    items = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.split(c, ","))
    return rows.withColumns({"verdict": F.col("told"), "data_flow": items("flow"), "missing": items("lacks"), "evidence": F.when(F.col("n_evidence") > 0, told)})


_OR = "coalesce(nullif(CAST({0} AS VARCHAR), ''), '{1}')"
_AT = "concat('`', " + _OR.format("{0}_file", "?") + ", ':', " + _OR.format("{0}_line", "?") + ", '`')"
_TITLE = _OR.format("title", "?")
_LABEL = "CASE verdict WHEN 'vulnerable' THEN 'Vulnerable' ELSE 'Uncertain' END"
_BODY = "trim(coalesce({0}, ''), ' ' || chr(9) || chr(10) || chr(13))"
_CHAPTER = "CASE WHEN {1} <> '' THEN concat(chr(10), '### {0}', chr(10), chr(10), {1}) END"
_POINTS = "coalesce(array_to_string(list_transform(string_split(nullif({0}, ''), ','), lambda x: concat('- ', x)), chr(10)), '')"
_EVIDENCE = f"CASE WHEN n_evidence > 0 THEN concat('- [scan] ', title, ' (', sink_file, ':', sink_line, ')', chr(10), '- [unknown] seen') ELSE '' END"
_SECTION = ", ".join([
    f"concat('## [', number, '/', heads, '] [', {_LABEL}, '] ', {_TITLE})", "concat(chr(10), '| Field | Content |', chr(10), '|---|---|')",
    f"concat('| Verdict | **', {_LABEL}, '** (confidence ', format('{{:.0f}}', confidence * 100), '%) |')", f"concat('| CWE | ', {_OR.format('cwe', '?')}, ' |')", f"concat('| Severity | ', upper({_OR.format('severity', 'medium')}), ' |')",
    f"concat('| Type | ', vulnerability_type, ' |')", f"concat('| Sink | ', {_AT.format('sink')}, ' |')", f"CASE WHEN source_file <> '' THEN concat('| Source | ', {_AT.format('source')}, ' |') END",
    _CHAPTER.format("Principle", _BODY.format("principle")), _CHAPTER.format("Data flow", _POINTS.format("flow")), _CHAPTER.format("Proof of concept", _BODY.format("poc")), _CHAPTER.format("Fix", _BODY.format("fix")),
    _CHAPTER.format("Refuted by", "CASE WHEN refuted_by <> '' THEN concat('```', chr(10), refuted_by, chr(10), '```') END"), _CHAPTER.format("Missing", _POINTS.format("lacks")), _CHAPTER.format("Evidence", _EVIDENCE),
])
_FLAT = "trim(regexp_replace(coalesce(refuted_by, ''), '\\s+', ' ', 'g'))"
_SHORT = f"CASE WHEN length({_FLAT}) > 80 THEN concat(left({_FLAT}, 77), '...') ELSE {_FLAT} END"


@query(f"""WITH {_REPORT_SQL}, r AS (SELECT * EXCLUDE (verdict), told AS verdict, row_number() OVER (PARTITION BY told IN ('vulnerable', 'uncertain') ORDER BY ord) AS number, (SELECT count(*) FROM e WHERE told IN ('vulnerable', 'uncertain')) AS heads, (SELECT count(*) FROM e WHERE told = 'safe') AS safes FROM e WHERE told <> 'odd'),
b AS (SELECT 0 AS part, 0 AS number, concat('# Audit report', chr(10), chr(10), '**Project**: `s/o/r/v`', chr(10), '**Summary**: ', (SELECT count(*) FROM e), ' chains audited, ', (SELECT count(*) FROM e WHERE told = 'vulnerable'), ' vulnerable, ', (SELECT count(*) FROM e WHERE told = 'uncertain'), ' uncertain, ', (SELECT count(*) FROM e WHERE told = 'safe'), ' safe', chr(10), chr(10), '## Headlines', chr(10)) AS text
UNION ALL SELECT 1, number, concat('- **', {_LABEL}, '** ', {_AT.format('sink')}, ': ', {_TITLE}) FROM r WHERE verdict <> 'safe' UNION ALL SELECT 2, number, concat(chr(10), concat_ws(chr(10), {_SECTION})) FROM r WHERE verdict <> 'safe'
UNION ALL SELECT 3, 0, concat(chr(10), '## Safe', chr(10), chr(10), (SELECT any_value(safes) FROM r), ' findings are safe; findings.jsonl holds them whole.', chr(10), chr(10), '| # | Type | Sink | Title | Refuted by |', chr(10), '|---|---|---|---|---|')
UNION ALL SELECT 4, number, concat('| ', number, ' | ', vulnerability_type, ' | ', {_AT.format('sink')}, ' | ', replace({_TITLE}, '|', '/'), ' | ', replace({_SHORT}, '|', '/'), ' |') FROM r WHERE verdict = 'safe'),
l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM b) SELECT line, count(*) AS n FROM l GROUP BY line""")
def audit_report_lines(spark, sf_dir):
    """The lines of a written audit.md, counted."""
    out, rows = scratch(spark, "audit"), _report_rows(spark, sf_dir)
    order = [F.col("ord")]
    sections = reports.audit_blocks(rows, "s/o/r/v", order, scratch(spark, "audit-order"))
    sinks.audit_files(reports.audit_head(rows), rows.drop("evidence", "missing", "data_flow"), order, sections, out)
    return spark.read.text(f"{out}/audit.md").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


_BY = "(SELECT '{0}' AS measure, {1} AS key, count(*) AS n FROM e WHERE told = 'vulnerable' GROUP BY ALL)"


@query(f"WITH {_REPORT_SQL} SELECT 'verdict' AS measure, told AS key, count(*) AS n FROM e WHERE told <> 'odd' GROUP BY ALL UNION ALL SELECT 'verdict', 'total', count(*) FROM e UNION ALL {_BY.format('severity', _OR.format('severity', 'unknown'))} UNION ALL {_BY.format('vulnerability_type', 'vulnerability_type')} UNION ALL SELECT 'status:partial', 'total', count(*) FROM e")
def audit_document(spark, sf_dir):
    """audit.json read back, and how many findings its neighbour holds."""
    out, rows = scratch(spark, "audit-json"), _report_rows(spark, sf_dir)
    sinks.document(reports.audit_head(rows, True), f"{out}/audit.json")
    sinks.json_lines(rows.select("chain_id", "verdict", "ord"), f"{out}/findings.jsonl", [F.col("ord")])
    head = spark.read.schema("status string, summary struct<total_audited: bigint, vulnerable: bigint, uncertain: bigint, safe: bigint, by_severity: map<string, bigint>, by_vulnerability: map<string, bigint>>").json(f"{out}/audit.json")
    verdict = F.create_map(*(x for k, v in (("total", "total_audited"), *((v, v) for v in reports.LABELS)) for x in (F.lit(k), F.col(f"summary.{v}"))))
    shown = head.select(F.explode(F.create_map(F.lit("verdict"), verdict, F.lit("severity"), F.col("summary.by_severity"), F.lit("vulnerability_type"), F.col("summary.by_vulnerability"))).alias("measure", "m")).select("measure", F.explode("m").alias("key", "n"))
    total = spark.read.schema("chain_id string").json(f"{out}/findings.jsonl").agg(F.count("*").alias("n"))
    return shown.unionByName(head.join(total, how="cross").select(F.concat(F.lit("status:"), "status").alias("measure"), F.lit("total").alias("key"), "n"))


# --- The dashboard ---------------------------------------------------------------------------------------------------

_SCAN_EXTRA = {"primary_language": S.pick("ord", "'php'", "'python'", "CAST(NULL AS STRING)"), "spoken": S.pick("ord", "'php,html'", "'python'", "''"), "duration_seconds": "CAST(ord % 600 AS BIGINT)"}


def _board_rows(spark, sf_dir):
    """Scans with languages, and a finding for each scan whose number is a document's."""
    scans = S.scans(spark, sf_dir).selectExpr("*", *(f"{e} AS {n}" for n, e in _SCAN_EXTRA.items()))
    scans = scans.withColumn("languages", F.when(F.col("spoken") == "", F.array().cast("array<string>")).otherwise(F.split("spoken", ","))).drop("spoken")
    scans = stored(scans, "board-scans")
    found = _findings(spark, sf_dir).drop("scan_id").withColumn("verdict", F.expr(_VERDICT))
    return scans, found.join(scans.select("project_path", "scan_id", "ord"), "ord")


_BOARD_SQL = f"""{S.SCANS_SQL}, {FULL_SQL}, s AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _SCAN_EXTRA.items())} FROM scans), picked AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY project_path ORDER BY has_audit DESC, scan_id DESC) AS k FROM s) WHERE k = 1),
w AS (SELECT g.ord, {_VERDICT} AS verdict, coalesce(nullif(upper(cwe), ''), 'UNKNOWN') AS cwe, coalesce(nullif(lower(severity), ''), 'unknown') AS severity, lower(vulnerability_type) AS type, coalesce(nullif(lower(language), ''), 'unknown') AS language, g.repo, confidence, title, sink_file, sink_line, s.project_path, s.scan_id FROM g JOIN s ON s.ord = g.ord),
wl AS (SELECT w.* FROM w JOIN picked USING (project_path, scan_id)), toplist AS (SELECT *, row_number() OVER (ORDER BY {mapped('severity', fixed.SEVERITIES, '0')} DESC, coalesce(confidence, 0) DESC, ord) AS i FROM {{0}} WHERE verdict = 'vulnerable' QUALIFY i <= 50)"""


def _measures(rows: str, chosen: str) -> str:
    """What a dashboard counts, as rows section, key, n."""
    rates = " UNION ALL ".join(f"SELECT 'rate', '{n}', CASE WHEN sum({b}) > 0 THEN round_even(sum({a}) / sum({b}), 4) END FROM {chosen}" for n, (a, b) in metrics.RATES.items())
    sums = " UNION ALL ".join(f"SELECT 'funnel', '{m}', sum({m}) FROM {chosen}" for m in metrics.MEASURES)
    return f"""SELECT 'coverage' AS section, 'repos_total' AS key, CAST(count(DISTINCT project_path) AS DOUBLE) AS n FROM s UNION ALL SELECT 'coverage', 'scans_total', count(*) FROM s UNION ALL SELECT 'coverage', 'scans_with_audit', count(*) FILTER (has_audit) FROM s UNION ALL SELECT 'coverage', 'cwes', count(DISTINCT cwe) FROM {rows} UNION ALL SELECT 'coverage', 'types', count(DISTINCT type) FROM {rows}
    UNION ALL SELECT 'coverage', 'languages_count', count(DISTINCT l) FROM (SELECT unnest(string_split(spoken, ',')) AS l FROM {chosen}) WHERE l <> '' UNION ALL {sums} UNION ALL {rates}
    UNION ALL SELECT 'severity', severity, count(*) FROM {rows} WHERE verdict = 'vulnerable' GROUP BY severity UNION ALL SELECT 'type', type, count(*) FROM {rows} GROUP BY type UNION ALL SELECT 'language', language, count(*) FILTER (verdict = 'safe') FROM {rows} GROUP BY language UNION ALL SELECT 'top', sink_file, i FROM toplist"""


_BOARD_SCHEMA = (
    f"strategy string, coverage struct<repos_total: bigint, scans_total: bigint, scans_with_audit: bigint, languages_count: bigint, cwes: bigint, types: bigint>, funnel struct<{', '.join(f'{m}: bigint' for m in metrics.MEASURES)}, {', '.join(f'{r}: double' for r in metrics.RATES)}>, "
    "by_severity map<string, bigint>, by_type map<string, struct<total: bigint, vulnerable: bigint>>, by_language map<string, struct<total: bigint, safe: bigint>>, top_vulnerable array<struct<sink_file: string>>"
)


def _written(spark, sf_dir, strategy: str) -> str:
    out = scratch(spark, f"dashboard-{strategy}")
    scans, found = _board_rows(spark, sf_dir)
    # what several files are made of is worked out once
    chosen = scans if strategy == "union" else stored(metrics.selected(scans, strategy), "board-chosen")
    rows = stored(metrics.flat(found.join(chosen.select(*metrics.SCAN), metrics.SCAN, "left_semi")), "board-findings")
    board = stored(reports.board_of(scans, chosen, rows, strategy, F.col("ord")), "board")
    own, weak = stored(reports.repositories(scans), "board-repositories"), stored(metrics.by_cwe(rows), "board-weaknesses")
    shown = rows.select("project_path", "scan_id", "chain_id", "verdict", "cwe", "severity", "vulnerability_type", "language", "confidence", "title", "sink_file", "sink_line")
    sinks.dashboard_files(board, own, weak, scans, shown, reports.dashboard_blocks(board, own, weak), out)
    return out


def _measured(spark, sf_dir, strategy: str):
    board = spark.read.schema(_BOARD_SCHEMA).json(f"{_written(spark, sf_dir, strategy)}/dashboard.json")
    pairs = lambda section, m: board.select(F.lit(section).alias("section"), F.explode(m).alias("key", "n")).withColumn("n", F.col("n").cast("double"))
    named = lambda struct, names: F.create_map(*(x for c in names for x in (F.lit(c), F.col(f"{struct}.{c}").cast("double"))))
    values = lambda m, c: F.transform_values(m, lambda _, v: v[c])
    top = board.select(F.lit("top").alias("section"), F.posexplode("top_vulnerable").alias("i", "t")).select("section", F.col("t.sink_file").alias("key"), (F.col("i") + 1).cast("double").alias("n"))
    parts = [pairs("coverage", named("coverage", ("repos_total", "scans_total", "scans_with_audit", "cwes", "types", "languages_count"))), pairs("funnel", named("funnel", metrics.MEASURES)), pairs("rate", named("funnel", metrics.RATES)), pairs("severity", "by_severity"), pairs("type", values("by_type", "total")), pairs("language", values("by_language", "safe")), top]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query(f"WITH {_BOARD_SQL.format('wl')} {_measures('wl', 'picked')}")
def dashboard_latest(spark, sf_dir):
    """dashboard.json over the newest audited scan of each project."""
    return _measured(spark, sf_dir, "latest")


@query(f"WITH {_BOARD_SQL.format('w')} {_measures('w', 's')}")
def dashboard_union(spark, sf_dir):
    """dashboard.json over all scans."""
    return _measured(spark, sf_dir, "union")


def _row(*cells: str) -> str:
    return "concat('| ', " + ", ' | ', ".join(cells) + ", ' |')"


def _int(value: str) -> str:
    return f"format('{{:,}}', CAST({value} AS BIGINT))"


def _rate(value: str) -> str:
    return f"coalesce(printf('%.2f%%', {value} * 100), '-')"


_TABLES = {"Coverage": "What Number", "Funnel": "Step Number Rate", "Languages": "Language Audited Vulnerable Uncertain Safe", "Weaknesses": "CWE Found Vulnerable Repositories", "Severities of the vulnerable": "Severity Number", "Types": "Type Found Vulnerable", "Repositories": "Repository Language Files Sinks Chains Audited Vulnerable Uncertain Safe Scans", "Vulnerable findings": "# Severity CWE Type Language Confidence Title Sink"}
_HEADS = ["# Dashboard", "", "Strategy: latest", *(x for t, c in _TABLES.items() for x in ("", f"## {t}", "", f"| {' | '.join(c.split())} |", f"|{'---|' * len(c.split())}")), ""]
_STEPS = [("Files", "files", None), ("Raw hits", "rg_raw", "rg_kept_ratio"), ("Sink hits", "sink_hits", "sink_per_file"), ("Candidate chains", "candidate_chains", "chain_per_sink"), ("With a call chain", "with_call_chain", "with_chain_ratio"), ("Audited", "audited", "audit_per_chain"), ("Vulnerable", "vulnerable", "vuln_per_audit"), ("Uncertain", "uncertain", None), ("Safe", "safe", None)]
_COVER = {"Repositories": "(SELECT count(DISTINCT project_path) FROM s)", "Scans": "(SELECT count(*) FROM s)", "Audited scans": "(SELECT count(*) FROM s WHERE has_audit)", "Languages": "(SELECT coalesce(string_agg(DISTINCT l, ',' ORDER BY l), '') FROM (SELECT unnest(string_split(spoken, ',')) AS l FROM picked) WHERE l <> '')", "Weaknesses": "(SELECT count(DISTINCT cwe) FROM wl)", "Types": "(SELECT count(DISTINCT type) FROM wl)"}
_SUMMED = "(SELECT sum({0}) FROM picked)"
_QUOTIENT = "(SELECT CASE WHEN sum({1}) > 0 THEN round_even(sum({0}) / sum({1}), 4) END FROM picked)"
_BOARD_LINES = " UNION ALL ".join([
    *(f"SELECT {quoted(x)} AS line" for x in _HEADS), *(f"SELECT {_row(quoted(k), v)}" for k, v in _COVER.items()),
    *(f"SELECT {_row(quoted(n), _int(_SUMMED.format(c)), _rate(_QUOTIENT.format(*metrics.RATES[r])) if r else quoted(''))}" for n, c, r in _STEPS), f"SELECT concat('Of candidates vulnerable: ', {_rate(_QUOTIENT.format(*metrics.RATES['vuln_per_candidate']))})",
    f"SELECT {_row('language', 'count(*)', *(f'count(*) FILTER (verdict = {quoted(v)})' for v in reports.LABELS))} FROM wl GROUP BY language",
    f"SELECT {_row('cwe', 'count(*)', 'count(*) FILTER (verdict = {})'.format(quoted('vulnerable')), 'string_agg(DISTINCT repo, {0} ORDER BY repo)'.format(quoted(',')))} FROM wl GROUP BY cwe",
    f"SELECT {_row('severity', 'count(*)')} FROM wl WHERE verdict = 'vulnerable' GROUP BY severity", f"SELECT {_row('type', 'count(*)', 'count(*) FILTER (verdict = {})'.format(quoted('vulnerable')))} FROM wl GROUP BY type",
    f"SELECT {_row('project_path', 'coalesce(primary_language, {})'.format(quoted('-')), *map(_int, ('files', 'sink_hits', 'candidate_chains', 'audited', 'vulnerable', 'uncertain', 'safe')), 'best.n')} FROM picked JOIN best USING (project_path)",
    "SELECT " + _row("i", "severity", "cwe", "type", "language", "printf('%.2f', confidence)", "left(replace(coalesce(title, ''), '|', '/'), 80)", "concat('`', sink_file, ':', sink_line, '`')") + " FROM toplist",
])


@query(f"WITH {_BOARD_SQL.format('wl')}, best AS (SELECT project_path, count(*) AS n FROM s GROUP BY project_path), b AS ({_BOARD_LINES}) SELECT line, count(*) AS n FROM b GROUP BY line")
def dashboard_lines(spark, sf_dir):
    """The lines of a written dashboard.md, counted."""
    return spark.read.text(f"{_written(spark, sf_dir, 'latest')}/dashboard.md").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(f"WITH {_BOARD_SQL.format('w')} SELECT chain_id, w.project_path, w.scan_id, w.verdict, w.cwe, w.severity, w.confidence FROM w JOIN f USING (ord)")
def dashboard_findings(spark, sf_dir):
    """findings.jsonl beside a dashboard over all scans."""
    return spark.read.schema("chain_id string, project_path string, scan_id string, verdict string, cwe string, severity string, confidence double").json(f"{_written(spark, sf_dir, 'union')}/findings.jsonl")


# --- Curated vulnerabilities -----------------------------------------------------------------------------------------

_V = {"vulnerability_id": "concat('v', CAST(p_partkey AS STRING))", "project_key": "p_brand", "name": "CASE p_partkey % 3 WHEN 0 THEN '' ELSE p_name END", "severity": S.pick("p_partkey", "'high'", "'low'", "CAST(NULL AS STRING)"), "status": S.pick("p_partkey", "'draft'", "'Confirmed'"), "source": "'manual'", "updated_at": "CASE WHEN p_partkey % 9 > 0 THEN CAST(2000 + p_size AS STRING) END", "link": "CASE WHEN p_partkey % 4 > 0 THEN p_brand END"}
_V_SQL = f"v AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _V.items())}, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS tag FROM part)"


def _curated(spark, sf_dir):
    rows = S.table(spark, sf_dir, "part").selectExpr("*", *(f"{e} AS {n}" for n, e in _V.items()))
    return rows.withColumns({"tags": F.when(F.col("p_partkey") % 2 == 0, F.array("p_type")), "links": F.when(F.col("link").isNotNull(), F.array("link"))})


_HAY = "lower(concat_ws(' ', coalesce(name, ''), vulnerability_id, coalesce(severity, ''), status, source, nullif(tag, '')))"


@query(f"WITH {_V_SQL} " + " UNION ALL ".join(f"SELECT {quoted(w)} AS word, vulnerability_id FROM v" + (f" WHERE contains({_HAY}, {quoted(w.strip().lower())})" if w else "") for w in ("", " CONFIRMED manual", "brass", "low draft", "v1")))
def vulnerability_link_candidates(spark, sf_dir):
    rows = _curated(spark, sf_dir)
    parts = [catalog.link_candidates(rows, w).select(F.lit(w).alias("word"), "vulnerability_id") for w in ("", " CONFIRMED manual", "brass", "low draft", "v1")]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


_REFS = {"name": "CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END", "kind": S.pick("p_partkey", "'tag'", "'branch'", "'tag'")}
_ORDERED = {
    "vulnerability": ("SELECT vulnerability_id AS key, coalesce(updated_at, '') AS o FROM v", "o DESC, key"),
    "ref": (f"SELECT name || ':' || kind || ':' || p_partkey AS key, CASE kind WHEN 'branch' THEN 0 ELSE 1 END AS k, lower(name) AS o, name, p_partkey FROM (SELECT p_partkey, {', '.join(f'{e} AS {n}' for n, e in _REFS.items())} FROM part)", "k, o, name, p_partkey"),
    "run": ("SELECT CAST(o_orderkey AS VARCHAR) AS key, strftime(o_orderdate, '%Y-%m-%d') AS o, o_orderkey FROM orders", "o DESC, lpad(key, 12, '0') DESC"),
    "history": ("SELECT CAST(event_id AS VARCHAR) AS key, event_id FROM events", "event_id DESC"),
}


@query(f"WITH {_V_SQL} " + " UNION ALL ".join(f"SELECT {quoted(kind)} AS kind, key, row_number() OVER (ORDER BY {order}) AS place FROM ({rows})" for kind, (rows, order) in _ORDERED.items()))
def shown_orders(spark, sf_dir):
    """Vulnerabilities, references, runs and history versions in the orders in which lists show them."""
    refs = S.table(spark, sf_dir, "part").selectExpr("p_partkey", *(f"{e} AS {n}" for n, e in _REFS.items())).withColumn("key", F.concat_ws(":", "name", "kind", F.col("p_partkey").cast("string")))
    runs = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("run_id"))
    history = S.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("key"), F.col("event_id").alias("version"))
    kinds = {"vulnerability": (_curated(spark, sf_dir).withColumn("key", F.col("vulnerability_id")), catalog.vulnerability_order()), "ref": (refs, ([*catalog.ref_order()[0], F.col("p_partkey")], (*catalog.ref_order()[1], False))), "run": (runs, catalog.run_order()), "history": (history, catalog.history_order())}
    out = None
    for kind, (rows, (keys, falling)) in kinds.items():
        placed = packs.ranks(rows, keys, "place", scratch(spark, f"order-{kind}"), falling).select(F.lit(kind).alias("kind"), "key", "place")
        out = placed if out is None else out.unionByName(placed)
    return out


# --- Details ---------------------------------------------------------------------------------------------------------

_NODE = "named_struct('file', {0}, 'line', {1}, 'expr', {2}, 'detail', CAST(NULL AS STRING))"
_DOC = "concat('d', CAST(p_partkey AS STRING))"
_LOCATION = S.pick("p_partkey", f"concat({_DOC}, ':3 in f')", "'nowhere'", "CAST(NULL AS STRING)")
_CANDIDATES_SQL = f"""[{{'place': 0, 'role': 'source', 'file': {_DOC}, 'line': 1, 'd': 'read'}}, {{'place': 1, 'role': 'sink', 'file': concat('/', {_DOC}), 'line': 12, 'd': ' put '}}, {{'place': 2, 'role': 'evidence', 'file': {_DOC}, 'line': 12, 'd': 'again'}}, {{'place': 3, 'role': 'evidence', 'file': '../x', 'line': 1, 'd': ''}}, {{'place': 4, 'role': 'evidence', 'file': {_DOC}, 'line': NULL, 'd': 'scan'}}]"""
_DETAIL_SQL = rf"""v AS (SELECT *, {_LOCATION} AS location FROM part), c AS (SELECT p_partkey, unnest({_CANDIDATES_SQL}) AS x FROM v UNION ALL SELECT p_partkey, {{'place': 5, 'role': 'location', 'file': {_DOC}, 'line': 3, 'd': location}} FROM v WHERE p_partkey % 3 = 0),
u AS (SELECT p_partkey, x.place AS place, x.role AS role, trim(x.file, '/') AS file, x.line AS line, trim(x.d) AS description FROM c WHERE x.place NOT IN (2, 3)), docs AS (SELECT concat('d', doc_id) AS file, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
r AS (SELECT p_partkey, place, role, file, line, description, CASE WHEN line IS NULL THEN 1 ELSE greatest(1, line - 8) END AS a, least(len(ls), CASE WHEN line IS NULL THEN 80 ELSE line + 10 END) AS z, ls FROM u JOIN docs USING (file)), k AS (SELECT * FROM r WHERE z >= a)"""


def _details(spark, sf_dir):
    """Vulnerabilities that lead to the document of their number, whose lines are those of a file."""
    rows = _curated(spark, sf_dir)
    node = lambda line, expr, slash="": F.struct(F.concat(F.lit(slash), F.expr(_DOC)).alias("file"), F.lit(line).alias("line"), F.lit(expr).alias("expr"), F.lit(None).cast("string").alias("detail"))
    proof = lambda file, line, detail, source: F.struct(file.alias("file"), F.lit(line).cast("int").alias("line"), F.lit(detail).alias("detail"), F.lit(source).alias("source"))
    own = F.expr(_DOC)
    finding = F.struct(F.lit("php").alias("language"), node(1, "read").alias("source"), node(12, " put ", "/").alias("sink"), F.array(proof(own, 12, "again", "scan"), proof(F.lit("../x"), 1, "", "scan"), proof(own, None, None, "scan")).alias("evidence"))
    rows = rows.select("p_partkey", "vulnerability_id", "project_key", "name", "severity", "status", "source", "tags", F.lit("2000").alias("created_at"), "updated_at", F.array(F.lit("p")).alias("links"), F.col("p_name").alias("details"), F.expr(_LOCATION).alias("location"), F.lit(None).cast("string").alias("affected_version"), F.lit("CVE-1").alias("cve"), F.lit(None).cast("array<string>").alias("references"), F.struct(F.when(F.col("p_partkey") % 2 == 0, "p").alias("project_path"), finding.alias("finding")).alias("source_finding"))
    cut = S.table(spark, sf_dir, "documents").select(F.lit("p").alias("project_path"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "code"))
    lines = cut.select("project_path", "file", (F.col("i") + 1).alias("line"), "code")
    return rows, lines


@query(f"WITH {_DETAIL_SQL} SELECT concat('v', p_partkey) AS vulnerability_id, concat(row_number() OVER (PARTITION BY p_partkey ORDER BY place), ':', role, ':', file, ':', coalesce(line, 0)) AS id, CAST(a AS INT) AS line_start, CAST(z AS INT) AS line_end, description, md5(array_to_string(ls[a:z], chr(10))) AS code FROM k")
def vulnerability_regions(spark, sf_dir):
    rows, lines = _details(spark, sf_dir)
    found = catalog.code_regions(rows, lines).select("vulnerability_id", F.inline("code_regions"))
    return found.select("vulnerability_id", "id", "line_start", "line_end", "description", F.md5("code").alias("code"))


@query(f"WITH {_DETAIL_SQL}, n AS (SELECT p_partkey, count(*) AS n FROM k GROUP BY p_partkey), s AS (SELECT ps.*, s_suppkey FROM part ps LEFT JOIN supplier ON s_suppkey = p_partkey) SELECT concat('v', v.p_partkey) AS vulnerability_id, CASE WHEN v.p_partkey % 3 = 0 THEN concat('v', v.p_partkey) ELSE v.p_name END AS name, v.p_name AS details, coalesce(location, '') AS location, '' AS affected_version, 'CVE-1' AS cve, CAST(coalesce(n.n, 0) AS INT) AS regions, CASE WHEN s_suppkey IS NOT NULL THEN 'a.sh,b.txt' ELSE '' END AS poc_files, CASE WHEN s_suppkey IS NOT NULL THEN concat('run ', s_suppkey) ELSE '' END AS poc_commands FROM v LEFT JOIN n USING (p_partkey) JOIN s USING (p_partkey)")
def vulnerability_details(spark, sf_dir):
    rows, lines = _details(spark, sf_dir)
    files = F.array(F.struct(F.lit("b.txt").alias("file"), F.lit(None).cast("string").alias("commands")), F.struct(F.lit("a.sh").alias("file"), F.lit(None).cast("string").alias("commands")), F.struct(F.lit(None).cast("string").alias("file"), F.concat(F.lit("run "), F.col("s_suppkey").cast("string")).alias("commands")))
    attached = S.table(spark, sf_dir, "supplier").select(F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("vulnerability_id"), F.lit("poc").alias("area"), F.inline(files))
    shown = catalog.vulnerability_detail(rows, lines, attached)
    poc = F.coalesce(F.array_join("poc.files", ","), F.lit(""))
    return shown.select("vulnerability_id", "name", "details", "location", "affected_version", "cve", F.coalesce(F.size("code_regions"), F.lit(0)).alias("regions"), poc.alias("poc_files"), F.coalesce("poc.commands", F.lit("")).alias("poc_commands"))


# --- Told paths ------------------------------------------------------------------------------------------------------

_N = "CAST(doc_id AS STRING)"
#: A path as a model tells it, and what it is below /w/repo/p with src as what else there is.
_TOLD = [(f"concat('a/f', {_N})", f"concat('a/f', {_N})"), (f"concat('\"./a//f', {_N}, '\"')", f"concat('a/f', {_N})"), (f"concat('../f', {_N})", "'src'"), (f"concat('/a/../f', {_N})", f"concat('f', {_N})"), (f"concat('/w/repo/p/f', {_N})", f"concat('f', {_N})"), (f"concat('/W/repo/p/f', {_N})", "'src'"), (f"concat('/w/repo/pq/f', {_N})", "'src'"), (f"concat('repo/p/f', {_N})", f"concat('f', {_N})"), (f"concat('/repo/q/f', {_N})", "'src'"), ("'C:/x'", "'src'"), ("''", "'src'"), ("' ./ '", "'.'"), ("CAST(NULL AS STRING)", "'src'"), (f"concat('a', chr(92), 'f', {_N}, '/..')", "'a'"), ("'/w/repo/p'", "'.'")]


@query(f"SELECT doc_id, {S.pick('doc_id', *(a for _, a in _TOLD))} AS path FROM documents")
def told_paths(spark, sf_dir):
    told = S.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{S.pick('doc_id', *(t for t, _ in _TOLD))} AS told")
    return told.select("doc_id", paths.contained(F.col("told"), "/w/repo/p", "src", "/w").alias("path"))


# --- Strategies ------------------------------------------------------------------------------------------------------


@query(f"WITH {S.SCANS_SQL}, p AS (SELECT * FROM scans QUALIFY row_number() OVER (PARTITION BY project_path ORDER BY has_audit DESC, scan_id DESC) = 1) SELECT 'latest' AS strategy, CAST(count(*) AS BIGINT) AS scans, CAST(sum(vulnerable) AS BIGINT) AS vulnerable FROM p UNION ALL SELECT 'union', count(*), CAST(sum(vulnerable) AS BIGINT) FROM scans")
def scans_selected(spark, sf_dir):
    scans = S.scans(spark, sf_dir)
    one = lambda s: metrics.selected(scans, s).agg(F.lit(s).alias("strategy"), F.count("*").alias("scans"), F.sum("vulnerable").alias("vulnerable"))
    return one("latest").unionByName(one("union"))
