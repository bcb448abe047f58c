"""Queries of scan records, the data-flow graph, orders of work, states and curated records."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import fixed
from ..operators import catalog, findings, graph, metrics, rules
from . import standins as S
from .flow_queries import BRIDGE_SQL, _chains
from .registry import mapped, query

# --- Scan records ----------------------------------------------------------------------------------------------------

_STACK = {"project_type": S.pick("ord", "'web'", "'library'", "CAST(NULL AS STRING)"), "backend_text": S.pick("ord", "' Python ,PHP'", "''", "'Go'", "'php,python'"), "frontend_text": S.pick("ord", "'Vue'", "'python'", "''"), "runtime_text": "'Docker'"}
_CALL_LANGUAGES = S.pick("ord", "'python,Ruby'", "'PHP'", "''")
_LIST = "list_filter(list_transform(string_split({}, ','), lambda v: lower(trim(v))), lambda v: v <> '')"
_WITH = {"tree": "ord % 5 <> 0", "treescan": "ord % 3 <> 0", "callscan": "ord % 7 <> 0", "audit": "has_audit"}
_TAKEN = {"files": "tree", "sink_hits": "callscan", "candidate_chains": "callscan", "with_call_chain": "callscan", "audited": "audit", "vulnerable": "audit", "uncertain": "audit", "safe": "audit"}
_RECORD_SQL = f"""{S.SCANS_SQL}, r AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _STACK.items())}, {_CALL_LANGUAGES} AS call_text FROM scans),
l AS (SELECT *, list_concat(CASE WHEN ord % 3 <> 0 THEN list_concat({_LIST.format('backend_text')}, {_LIST.format('frontend_text')}, {_LIST.format('runtime_text')}) ELSE [] END, CASE WHEN ord % 7 <> 0 THEN {_LIST.format('call_text')} ELSE [] END) AS named FROM r),
u AS (SELECT ord, v, min(k) AS k FROM (SELECT ord, unnest(named) AS v, generate_subscripts(named, 1) AS k FROM l) GROUP BY ord, v), j AS (SELECT ord, string_agg(v, ',' ORDER BY k) AS languages FROM u GROUP BY ord)"""


@query(
    f"WITH {_RECORD_SQL} SELECT project_path, scan_id, ord % 3 <> 0 AS has_treescan, ord % 7 <> 0 AS has_callscan, has_audit, "
    + ", ".join(f"CAST(CASE WHEN {_WITH[w].replace('has_audit', 'l.has_audit')} THEN {n} ELSE 0 END AS BIGINT) AS {n}" for n, w in _TAKEN.items())
    + f", CASE WHEN ord % 3 <> 0 THEN project_type END AS project_type, coalesce(languages, '') AS languages, CASE WHEN ord % 3 <> 0 THEN nullif(lower(trim(string_split(backend_text, ',')[1])), '') END AS primary_language FROM l LEFT JOIN j USING (ord)"
)
def scan_record(spark, sf_dir):
    rows = S.scans(spark, sf_dir)
    key = metrics.SCAN
    split = lambda c: F.split(c, ",").alias(c.removesuffix("_text"))
    stack = rows.where(_WITH["treescan"]).selectExpr(*key, *(f"{e} AS {n}" for n, e in _STACK.items())).select(*key, "project_type", *map(split, ("backend_text", "frontend_text", "runtime_text")))
    calls = rows.where(_WITH["callscan"]).selectExpr(*key, "sink_hits", "candidate_chains", "with_call_chain", f"split({_CALL_LANGUAGES}, ',') AS languages")
    audits = rows.where(_WITH["audit"]).selectExpr(*key, "audited", "vulnerable", "uncertain", "safe", "0 AS llm_failed")
    found = metrics.scan_records(rows.select(*key), rows.where(_WITH["tree"]).select(*key, "files"), stack, calls, audits)
    return found.withColumn("languages", F.array_join("languages", ",")).select(*key, "has_treescan", "has_callscan", "has_audit", *_TAKEN, "project_type", "languages", "primary_language")


_STATES = "WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS a, count(*) FILTER (event_type = 'purchase') AS b, count(*) FILTER (event_type = 'error') > 1 AS p FROM events GROUP BY user_id)"


@query(f"{_STATES} SELECT user_id, CASE WHEN a > 0 THEN 'ok' WHEN b > 0 THEN 'no_sinks' ELSE 'partial' END AS callscan, CASE WHEN a > 0 THEN 'ok' WHEN b > 0 THEN 'partial_only' ELSE 'no_cross_request_chains' END AS dataflow, CASE WHEN a = 0 THEN 'no_auditable_chains' WHEN p THEN 'partial' ELSE 'ok' END AS audit FROM n")
def agent_statuses(spark, sf_dir):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    rows = S.table(spark, sf_dir, "events").groupBy("user_id").agg(n("signup").alias("a"), n("purchase").alias("b"), (n("error") > 1).alias("p"))
    a, b = F.col("a"), F.col("b")
    return rows.select("user_id", metrics.call_status(a, b).alias("callscan"), metrics.flow_status(a, b).alias("dataflow"), metrics.audit_status(a, F.col("p")).alias("audit"))


# --- The graph -------------------------------------------------------------------------------------------------------

_ROLE = "CASE event_type WHEN 'signup' THEN 'write' WHEN 'purchase' THEN 'sink' WHEN 'view' THEN 'read' END"
GRAPH_SQL = f"""{S.FACTS_SQL}, g AS (SELECT *, {_ROLE} AS role, concat('storage:', kind, ':', field) AS storage_id FROM facts),
src AS (SELECT *, concat('request_source:', left(sha1(concat('request_source:', file, ':', line, ':', evidence)), 16)) AS source_id FROM g WHERE role = 'write'), snk AS (SELECT *, concat('sink:', left(sha1(concat('sink:', file, ':', line, ':', evidence)), 16)) AS sink_id FROM g WHERE role = 'sink'),
every AS (SELECT source_id AS node_id, 'request_source' AS kind, file, line, 'request input' AS label, NULL AS field FROM src UNION ALL SELECT sink_id, 'sink', file, line, sink_function, field FROM snk UNION ALL SELECT storage_id, 'storage_field', file, line, concat(kind, '.', field), field FROM g WHERE role IN ('write', 'sink')),
nodes AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY file DESC, line DESC) AS rn FROM every) WHERE rn = 1), edges AS (SELECT DISTINCT source_id, storage_id AS target_id, 'source_to_write' AS kind, file, line FROM src)"""


def _graph_facts(spark, sf_dir):
    return S.facts(spark, sf_dir).withColumn("role", F.expr(_ROLE))


@query(f"WITH {GRAPH_SQL} SELECT * FROM nodes")
def graph_nodes(spark, sf_dir):
    return graph.nodes(_graph_facts(spark, sf_dir))


@query(f"WITH {GRAPH_SQL} SELECT left(sha1(concat(kind, ':', source_id, ':', target_id, ':', file, ':', line)), 16) AS edge_id, * FROM edges")
def graph_edges(spark, sf_dir):
    return graph.edges(_graph_facts(spark, sf_dir))


@query(f"WITH {GRAPH_SQL} SELECT 'node' AS measure, kind AS key, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind UNION ALL SELECT 'storage', kind, count(*) FROM src GROUP BY kind")
def graph_summary(spark, sf_dir):
    rows = _graph_facts(spark, sf_dir)
    return graph.summary(graph.nodes(rows), graph.edges(rows), rows)


# --- Orders and needs ------------------------------------------------------------------------------------------------

_CANDIDATES = {"event_id": "event_id", "level": S.pick("event_id", "'L0'", "'l2'", "CAST(NULL AS STRING)", "'L1'", "'odd'"), "severity": S.pick("event_id", "'critical'", "'low'", "'medium'", "'odd'", "'high'", "CAST(NULL AS STRING)", "''"), "has_call_chain": "CASE WHEN event_id % 11 < 4 THEN true WHEN event_id % 11 < 9 THEN false END", "chain_kind": "CASE event_type WHEN 'signup' THEN 'cross_request' WHEN 'view' THEN 'recovered_partial' ELSE 'direct_call' END"}
_HEAD = 200
_RANKED = f"{mapped('severity', fixed.SEVERITIES, '0')} DESC, coalesce(has_call_chain, false) DESC, event_id"


def _first(spark, sf_dir, order):
    """The first page of an order, as readers that take n at a time see it."""
    rows = S.table(spark, sf_dir, "events").selectExpr(*(f"{e} AS {n}" for n, e in _CANDIDATES.items()))
    return rows.orderBy(*order).limit(_HEAD).select(F.row_number().over(W.orderBy(*order)).alias("place"), "event_id")


@query(f"WITH c AS ({S.sql(_CANDIDATES, 'events')}) SELECT CAST(row_number() OVER (ORDER BY {mapped('upper(level)', fixed.LEVELS, '1')} DESC, {_RANKED}) AS INT) AS place, event_id FROM c ORDER BY place LIMIT {_HEAD}")
def chain_output_order(spark, sf_dir):
    return _first(spark, sf_dir, rules.output_order(F.col("event_id")))


@query(f"WITH c AS ({S.sql(_CANDIDATES, 'events')}) SELECT CAST(row_number() OVER (ORDER BY CASE WHEN chain_kind = 'cross_request' THEN 2 ELSE 1 END DESC, {_RANKED}) AS INT) AS place, event_id FROM c ORDER BY place LIMIT {_HEAD}")
def audit_queue_order(spark, sf_dir):
    return _first(spark, sf_dir, findings.audit_order(F.col("event_id")))


_IMPACT = S.pick("event_id", "concat('{\"targets\": {\"f', CAST(user_id AS STRING), '\": {\"callers\": [\"a\", \"b\"]}}}')", "'{\"targets\": {\"f\": {\"callers\": []}, \"g\": {}}}'", "'no json'", "CAST(NULL AS STRING)", "'{\"targets\": {\"f\": {\"callers\": []}, \"g\": {\"callers\": [\"x\"]}}}'", "'{}'")


@query("SELECT event_id, NOT (event_type = 'error' OR event_id % 6 IN (0, 4)) AS needed FROM events")
def model_needed(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").selectExpr("event_id", "event_type", f"{_IMPACT} AS impact")
    return rows.select("event_id", rules.model_needed(F.col("impact"), F.col("event_type") != "error").alias("needed"))


@query("WITH c AS (SELECT concat('K-', CAST(user_id AS VARCHAR)) AS chain_id, max(event_id) AS line, arg_max(event_type, event_id) AS told FROM events WHERE event_type <> 'error' GROUP BY user_id) SELECT doc_id, c.line, told FROM documents d LEFT JOIN c ON c.chain_id = concat('K-', CAST(d.doc_id AS VARCHAR))")
def finding_chain_last(spark, sf_dir):
    found = S.table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('K-', doc_id) AS chain_id")
    rows = S.table(spark, sf_dir, "events").selectExpr("concat(' K-', user_id, ' ') AS chain_id", "event_id AS line", "CASE event_type WHEN 'error' THEN 'meta' ELSE 'chain' END AS type", "event_type AS told")
    return findings.with_chains(found, rows).select("doc_id", "chain.line", "chain.told")


# --- Curated records, profiles, sources ------------------------------------------------------------------------------


@query("SELECT concat('v', CAST(p_partkey AS VARCHAR)) AS vulnerability_id, p_brand AS project_key, CASE WHEN p_partkey % 3 = 0 THEN concat('v', CAST(p_partkey AS VARCHAR)) ELSE p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN concat(p_type, ',', p_brand) ELSE '' END AS tags, 0 AS links FROM part")
def vulnerability_summary(spark, sf_dir):
    rows = S.table(spark, sf_dir, "part").selectExpr("concat('v', p_partkey) AS vulnerability_id", "p_brand AS project_key", "CASE p_partkey % 3 WHEN 0 THEN '' ELSE p_name END AS name", "'high' AS severity", "'draft' AS status", "'manual' AS source", "CASE WHEN p_partkey % 2 = 0 THEN array(p_type, p_brand) END AS tags", "p_size AS created_at", "p_size AS updated_at", "CAST(NULL AS ARRAY<STRING>) AS links", "p_name AS details")
    return catalog.vulnerability_summary(rows).select("vulnerability_id", "project_key", "name", F.array_join("tags", ",").alias("tags"), F.size("links").alias("links"))


@query("SELECT o_orderkey AS scan_id, o_orderstatus AS status FROM orders")
def audit_head(spark, sf_dir):
    return catalog.audit_head(S.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS scan_id", "o_orderstatus AS status", "array(o_orderpriority) AS findings"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('type=', p_type) END AS shown FROM part")
def shown_profile(spark, sf_dir):
    rows = S.table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("project_name"), "p_name", F.lit("confidence"), F.lit("1"), F.when(F.col("p_partkey") % 4 == 0, "limits").otherwise("type"), "p_type").alias("profile"))
    return rows.select("p_partkey", F.array_join(F.transform(F.map_entries(catalog.shown_profile(F.col("profile"))), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("shown"))


@query(f"WITH {S.SCANS_SQL}, p AS (SELECT project_path AS name, max(day) AS updated_at FROM scans GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY updated_at DESC, name) AS INT) AS place, name FROM p ORDER BY place LIMIT {_HEAD}")
def projects_newest(spark, sf_dir):
    rows, order = S.scans(spark, sf_dir).groupBy(F.col("project_path").alias("name")).agg(F.max("day").alias("updated_at")), catalog.project_order()
    return rows.orderBy(*order).limit(_HEAD).select(F.row_number().over(W.orderBy(*order)).alias("place"), "name")


@query("WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey, o_orderkey, 'full' AS told FROM f UNION ALL SELECT o_custkey, o_orderkey, 'legacy' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM f)")
def fallback_source(spark, sf_dir):
    rows = S.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    full = rows.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.lit("full").alias("told"))
    return catalog.first_source(full, rows.select("o_custkey", "o_orderkey", F.lit("legacy").alias("told")), ["o_custkey"])


@query(f"WITH {S.SCANS_SQL} SELECT project_path, CASE status WHEN 'done' THEN scan_id WHEN 'pending' THEN 'legacy-root' ELSE concat('legacy-', scan_id) END AS scan_id, day AS created_at, status <> 'done' AS legacy FROM scans")
def all_scans(spark, sf_dir):
    rows = S.scans(spark, sf_dir).withColumn("created_at", F.col("day"))
    return catalog.all_scans(rows.where("status = 'done'"), rows.where("status = 'pending'"), rows.where("status = 'running'"))


# --- Packs -----------------------------------------------------------------------------------------------------------

_STEP = "CASE WHEN {0} IS NOT NULL THEN concat('- {1}: ', {0}, ':', {2}) END"


@query(f"WITH {BRIDGE_SQL} SELECT chain_id, concat_ws(chr(10), {_STEP.format('w.file', 'write', 'w.line')}, concat('- storage: ', identity), CASE WHEN has_read THEN {_STEP.format('r.file', 'read', 'r.line')} END, {_STEP.format('s.file', 'sink', 's.line')}) AS steps FROM chains")
def bridge_steps(spark, sf_dir):
    from ..operators import packs

    steps = F.filter(F.split("pack", "\n"), lambda x: F.rlike(x, F.lit("^- (write|storage|read|sink): ")))
    return packs.bridge_packs(_chains(spark, sf_dir)).select("chain_id", F.array_join(steps, "\n").alias("steps"))
