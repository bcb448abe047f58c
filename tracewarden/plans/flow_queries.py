"""Queries of the data flow and of call chains, over events as facts and parts as calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, flow, text
from ..operators import bridge, chains
from . import standins as S
from .registry import cases, listed, mapped, query, quoted

SIDES = ("event_id", "field", "kind", "file", "line", "evidence", "vulnerability_type", "severity", "template", "template_var", "source_expr", "sink_function")


def _sides(spark, sf_dir):
    facts = S.facts(spark, sf_dir)
    side = lambda kind, number: facts.where(F.col("event_type") == kind).select(*SIDES).withColumnRenamed("event_id", number)
    return side("signup", "write_id"), side("view", "read_id"), side("purchase", "sink_id")


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


def _identity(p: str, field: str) -> str:
    """SQL for the identity and confidence of a fact with prefix p."""
    ev, kind = f"{p}.evidence", f"{p}.kind"
    insert = f"regexp_extract({ev}, {quoted(fixed.SQL_INSERT)}, 1)"
    first = f"nullif(trim(string_split(regexp_extract({ev}, {quoted(fixed.SAVE_CALL)}, 1), ',')[1]), '')"
    column = f"CASE WHEN {insert} <> '' THEN trim(string_split(regexp_extract({ev}, {quoted(fixed.SQL_INSERT)}, 2), ',')[1]) ELSE {field} END"
    value = cases([
        (f"{kind} = 'sql_field'", f"struct_pack(i := concat('sql_column:', CASE WHEN {insert} <> '' THEN lower({insert}) ELSE '*' END, ':', {column}), c := CASE WHEN {insert} <> '' THEN 3 ELSE 2 END)"),
        (f"{kind} = 'file_slot'", f"struct_pack(i := concat('file_path:', coalesce({first}, {field})), c := CASE WHEN {first} IS NOT NULL THEN 3 ELSE 2 END)"),
        (f"{kind} = 'session_key'", f"struct_pack(i := concat('session_key:', {field}), c := 3)"),
        (f"{kind} = 'template_field'", f"struct_pack(i := concat('template_binding:', {field}), c := 2)"),
    ], f"struct_pack(i := concat({kind}, ':', {field}), c := 2)")
    return value


def _strong(p: str) -> str:
    return f"coalesce({_has(f'{p}.evidence', fixed.STRONG_SANITIZER)}, false)"


def _weak(p: str) -> str:
    return f"coalesce({_has(f'{p}.evidence', fixed.WEAK_SANITIZER)}, false)"


_DANGER = cases([("s.vulnerability_type = 'xss'", _has("s.evidence", fixed.RAW_HTML)), ("starts_with(s.vulnerability_type, 'file')", f"{_has('s.evidence', fixed.FILE_READ)} OR {_has('s.evidence', fixed.FILE_WRITE)}")], "true")
BRIDGE_SQL = f"""{S.FACTS_SQL}, w AS (SELECT * FROM facts WHERE event_type = 'signup'), r AS (SELECT * FROM facts WHERE event_type = 'view'), s AS (SELECT * FROM facts WHERE event_type = 'purchase'),
b AS (SELECT s.event_id AS sid, r.event_id AS rid, row_number() OVER (PARTITION BY s.event_id ORDER BY CASE WHEN coalesce(s.template, '') <> '' AND ends_with(s.template, coalesce(r.template, '')) THEN 0 ELSE 1 END, CASE WHEN r.template_var = s.field THEN 0 ELSE 1 END, abs(r.line - s.line), r.file, r.line) AS rn FROM s JOIN r USING (field)),
j AS (SELECT w.field, w, s, r, r.event_id IS NOT NULL AS has_read, w.kind AS wk, s.kind AS sk, r.kind AS rk FROM w JOIN s ON w.field = s.field LEFT JOIN (SELECT * FROM b WHERE rn = 1) b ON b.sid = s.event_id LEFT JOIN r ON r.event_id = b.rid),
m AS (SELECT *, CASE WHEN wk = sk OR (has_read AND wk = rk AND sk = rk) THEN 'exact_storage_key' WHEN has_read THEN CASE WHEN coalesce(r.template_var, '') <> '' THEN 'template_binding' ELSE 'storage_read_binding' END ELSE 'weak_name_match' END AS match_quality,
 CAST({_strong('w')} AS INT) + CAST(has_read AND {_strong('r')} AS INT) + CAST({_strong('s')} AS INT) AS n_strong, CAST({_weak('w')} AS INT) + CAST(has_read AND {_weak('r')} AS INT) + CAST({_weak('s')} AS INT) AS n_weak,
 CAST({_DANGER} AS INT) + CAST(sk = 'file_slot' AS INT) + CAST(coalesce(r.template_var, '') <> '' AS INT) AS n_positive FROM j),
k AS (SELECT *, list_sort(list_distinct(list_filter([CASE WHEN match_quality = 'weak_name_match' THEN CASE wk WHEN 'sql_field' THEN 'missing_sql_column_mapping' WHEN 'file_slot' THEN 'missing_file_save_path' ELSE 'weak_storage_name_match' END END,
 CASE WHEN match_quality = 'storage_read_binding' OR (NOT has_read AND sk = 'template_field') THEN 'missing_template_binding' END, CASE WHEN wk = 'file_slot' AND NOT {_has('w.evidence', fixed.FILE_WRITE)} THEN 'missing_file_save_path' END], lambda v: v IS NOT NULL))) AS breakpoints,
 list_sort(list_filter([CASE WHEN match_quality = 'weak_name_match' THEN 'weak_name_match' END, CASE WHEN match_quality = 'storage_read_binding' THEN 'storage_read_without_template_binding' END, CASE WHEN NOT has_read AND sk = 'template_field' THEN 'missing_template_binding' END, CASE WHEN n_strong > 0 THEN 'sanitized_before_sink' END], lambda v: v IS NOT NULL)) AS noise FROM m),
sc AS (SELECT *, CAST(greatest(0, least(100, 25 + 15 + CASE match_quality WHEN 'exact_storage_key' THEN 25 WHEN 'template_binding' THEN 25 WHEN 'storage_read_binding' THEN 15 ELSE 8 END + CASE WHEN has_read THEN 20 ELSE 0 END + 10 + least(15, 5 * n_positive) - CASE WHEN n_strong > 0 THEN 35 ELSE 0 END - least(30, 12 * len(breakpoints)) - CASE WHEN match_quality = 'weak_name_match' THEN 15 ELSE 0 END - CASE WHEN n_weak > 0 THEN 5 ELSE 0 END)) AS INT) AS score FROM k),
q AS (SELECT *, CASE WHEN score >= 80 AND has_read AND n_strong = 0 AND match_quality IN ('exact_storage_key', 'template_binding') THEN 'confirmed' WHEN score >= 50 AND n_strong = 0 THEN 'probable' ELSE 'weak' END AS quality FROM sc),
z AS (SELECT *, concat('DF-', left(sha1(concat(w.file, ':', w.line, ':field:', field, ':', s.file, ':', s.line)), 12)) AS chain_id, quality = 'weak' OR n_strong > 0 AS suppressed, {_identity('w', 'field')} AS iw, CASE WHEN has_read THEN {_identity('r', 'field')} END AS ir, {_identity('s', 'field')} AS si FROM q),
chains AS (SELECT *, CASE WHEN iw.c >= coalesce(ir.c, 0) AND iw.c >= si.c THEN iw.i WHEN coalesce(ir.c, 0) >= si.c THEN ir.i ELSE si.i END AS identity FROM z)"""


def _chains(spark, sf_dir):
    return bridge.chains(*_sides(spark, sf_dir))


@query(f"WITH {BRIDGE_SQL} SELECT field, match_quality, count(*) AS n, count(*) FILTER (has_read) AS with_read FROM chains GROUP BY ALL")
def bridge_join(spark, sf_dir):
    return _chains(spark, sf_dir).groupBy("field", "match_quality").agg(F.count("*").alias("n"), F.count_if(F.col("read_line").isNotNull()).alias("with_read"))


@query(f"WITH {BRIDGE_SQL} SELECT s.event_id AS sink_id, r.event_id AS read_id, r.template_var AS template_var FROM s LEFT JOIN (SELECT * FROM b WHERE rn = 1) b ON b.sid = s.event_id LEFT JOIN r ON r.event_id = b.rid")
def best_read_topk(spark, sf_dir):
    _, reads, sinks = _sides(spark, sf_dir)
    return bridge.best_reads(sinks, reads).select("sink_id", F.col("read.line").cast("long").alias("read_id"), F.col("read.template_var").alias("template_var"))


@query(f"WITH {BRIDGE_SQL} SELECT chain_id, match_quality, array_to_string(breakpoints, ',') AS breakpoints, array_to_string(noise, ',') AS noise_tags FROM chains")
def match_quality(spark, sf_dir):
    return _chains(spark, sf_dir).select("chain_id", "match_quality", F.array_join("breakpoints", ",").alias("breakpoints"), F.array_join("noise_tags", ",").alias("noise_tags"))


@query(f"WITH {BRIDGE_SQL} SELECT chain_id, score AS evidence_score, quality AS evidence_quality, n_strong, n_weak, n_positive, suppressed, identity AS storage_identity FROM chains")
def evidence_score(spark, sf_dir):
    return _chains(spark, sf_dir).select("chain_id", "evidence_score", "evidence_quality", "n_strong", "n_weak", "n_positive", "suppressed", "storage_identity")


_REPEATS_SQL = f"""{BRIDGE_SQL}, u AS (SELECT *, row_number() OVER (PARTITION BY identity, s.file, s.line, s.vulnerability_type ORDER BY score DESC, w.event_id, s.event_id) AS rn FROM chains)"""


@query(f"WITH {_REPEATS_SQL} SELECT chain_id, suppressed OR rn > 1 AS suppressed, rn > 1 AS repeated FROM u")
def duplicate_suppress(spark, sf_dir):
    found = bridge.without_repeats(_chains(spark, sf_dir))
    return found.select("chain_id", "suppressed", F.array_contains("noise_tags", "duplicate_storage_sink").alias("repeated"))


@query(f"WITH {BRIDGE_SQL} SELECT CAST(row_number() OVER (ORDER BY score DESC, {mapped('s.severity', fixed.SEVERITIES, '0')} DESC, s.file DESC, s.line DESC, chain_id) AS INT) AS index, chain_id, score AS evidence_score FROM chains ORDER BY index LIMIT 200")
def chain_sort_index(spark, sf_dir):
    from pyspark.sql import Window as W

    top = _chains(spark, sf_dir).orderBy(*bridge.chain_order()).limit(200)
    return top.select(F.row_number().over(W.orderBy(*bridge.chain_order())).alias("index"), "chain_id", "evidence_score")


_SCANNED = {"chain_id": "concat('C-', CAST(event_id AS STRING))", "vulnerability_type": S.FACTS["vulnerability_type"], "severity": S.FACTS["severity"], "sink_file": S.FACTS["file"], "sink_line": S.FACTS["line"], "has_call_chain": "event_id % 3 = 1 AND event_type <> 'error'", "known": "event_type = 'click'"}
_RECOVERED = "concat('DF-R-', left(sha1(concat(chain_id, ':', sink_file, ':', sink_line)), 12))"


@query(f"WITH sc AS ({S.sql(_SCANNED, 'events')}), p AS (SELECT *, {_RECOVERED} AS rid FROM sc WHERE NOT has_call_chain AND vulnerability_type IN ({listed(fixed.RECOVERED_TYPES)})) SELECT rid AS chain_id, vulnerability_type, severity, sink_file, sink_line, 15 AS evidence_score FROM p WHERE rid NOT IN (SELECT {_RECOVERED} FROM sc WHERE known)")
def partial_anti(spark, sf_dir):
    scanned = S.table(spark, sf_dir, "events").selectExpr(*(f"{e} AS {n}" for n, e in _SCANNED.items()))
    known = scanned.where("known").select(flow.stable_id("DF-R-", 12, F.col("chain_id"), F.col("sink_file"), F.col("sink_line").cast("string")).alias("chain_id"))
    return bridge.recovered(scanned, known).select("chain_id", "vulnerability_type", "severity", "sink_file", "sink_line", "evidence_score")


_OTHER_KIND = cases([("starts_with(vulnerability_type, 'file')", "'path_or_filename_policy'")], "'sanitizer'")


@query(f"WITH {S.FACTS_SQL} SELECT event_id, array_to_string(list_filter([CASE WHEN {_has('evidence', fixed.STRONG_SANITIZER)} THEN 'strong' END, CASE WHEN {_has('evidence', fixed.WEAK_SANITIZER)} THEN 'weak' END], lambda v: v IS NOT NULL), ',') AS strengths, {mapped('vulnerability_type', fixed.SANITIZER_KINDS, _OTHER_KIND)} AS kind FROM facts")
def sanitizer_flags(spark, sf_dir):
    facts = S.facts(spark, sf_dir)
    return facts.select("event_id", F.array_join(F.transform(flow.sanitizers(F.col("evidence"), F.col("vulnerability_type")), lambda x: x["strength"]), ",").alias("strengths"), flow.sanitizer_kind(F.col("vulnerability_type")).alias("kind"))


@query(f"WITH {S.FACTS_SQL} SELECT event_id, ({_identity('facts', 'field')}).i AS identity, CASE ({_identity('facts', 'field')}).c WHEN 3 THEN 'confirmed' WHEN 2 THEN 'probable' ELSE 'weak' END AS confidence, concat('storage:', kind, ':', field) AS storage_id, concat(kind, '.', field) AS label FROM facts")
def storage_identity(spark, sf_dir):
    own = flow.storage_identity(F.col("kind"), F.col("field"), F.col("evidence"))
    return S.facts(spark, sf_dir).select("event_id", own["identity"].alias("identity"), own["confidence"].alias("confidence"), flow.storage_id(F.col("kind"), F.col("field")).alias("storage_id"), flow.storage_label(F.col("kind"), F.col("field")).alias("label"))


_FLOW_SIGNS = (("source", fixed.UPLOAD, "multipart file", "unknown"), ("filename_sanitizer", fixed.FILE_NAME_SANITIZER, "present", "missing"), ("extension_policy", fixed.EXTENSION_POLICY, "present", "unknown"), ("confidence", fixed.FILE_WRITE, "confirmed", "weak"))
_FLOW_SQL = ", ".join(f"{cases([(_has('evidence', p), quoted(a))], quoted(b))} AS {n}" for n, p, a, b in _FLOW_SIGNS)


@query(f"WITH {S.FACTS_SQL} SELECT {_FLOW_SQL}, {_has('evidence', fixed.WEB_PATH)} AS web_accessible, count(*) AS n FROM facts GROUP BY ALL")
def file_flow(spark, sf_dir):
    own = flow.file_flow(F.col("evidence"))
    keys = ["source", "filename_sanitizer", "extension_policy", "confidence", "web_accessible"]
    return S.facts(spark, sf_dir).select(*(own[k].alias(k) for k in keys)).groupBy(*keys).agg(F.count("*").alias("n"))


@query(f"""WITH {BRIDGE_SQL}, e AS (SELECT 'chain_kind' AS measure, 'cross_request' AS key FROM chains UNION ALL SELECT 'evidence_quality', quality FROM chains UNION ALL SELECT 'suppressed', CAST(suppressed AS VARCHAR) FROM chains UNION ALL SELECT 'match_quality', match_quality FROM chains
UNION ALL SELECT 'noise_tag', unnest(noise) FROM chains UNION ALL SELECT 'breakpoint', unnest(breakpoints) FROM chains) SELECT measure, key, count(*) AS n FROM e GROUP BY ALL""")
def dataflow_summary(spark, sf_dir):
    return bridge.summary(_chains(spark, sf_dir))


_STATEMENTS = {"event_id": "event_id", "statement": S.pick("event_id", "concat('INSERT INTO t', CAST(user_id AS STRING), ' (A.id, `na me` as nm, x) VALUES (1)')", "concat('update users set a.b = 1, c=2 where id = ', CAST(user_id AS STRING))", "'select u.name, max(v) as top from `logs` l'", "'select * from t'", "'x = obj.field[\"key\"]'", "'$name . $other'", "'request.form.args'")}

_WRITTEN = S.pick("event_id", "'id,nm,x'", "'b,c'", "''", "''", "''", "''", "''")
_SELECTED = S.pick("event_id", "''", "''", "'name,top'", "''", "''", "''", "''")
_TABLE = S.pick("event_id", "concat('t', CAST(user_id AS STRING))", "'users'", "'logs'", "'t'", "NULL", "NULL", "NULL")
_FIELD = S.pick("event_id", "'id'", "'b'", "'name'", "'t'", "'field'", "'other'", "''")


@query(f"SELECT event_id, {_WRITTEN} AS written, {_SELECTED} AS selected, {_TABLE} AS sql_table, {_FIELD} AS field FROM events")
def sql_fields(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").selectExpr(*(f"{e} AS {n}" for n, e in _STATEMENTS.items()))
    s = F.col("statement")
    return rows.select("event_id", F.array_join(text.written_columns(s), ",").alias("written"), F.array_join(text.selected_columns(s), ",").alias("selected"), flow.sql_table(s).alias("sql_table"), text.field_of(s).alias("field"))


def _sinks(spark, sf_dir):
    return S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sink"))


def _walk_sql(edges: str, depth: int) -> str:
    return f"""RECURSIVE {edges}, walk AS (
 SELECT p_partkey AS sink, c.caller AS node, [c.caller] AS path, 1 AS n, c.ends FROM part JOIN calls c ON c.callee = p_partkey
 UNION ALL SELECT w.sink, c.caller, list_append(w.path, c.caller), w.n + 1, c.ends FROM walk w JOIN calls c ON c.callee = w.node WHERE w.n < {depth} AND NOT w.ends AND NOT list_contains(w.path, c.caller)),
up AS (SELECT callee AS node, list(caller) AS callers FROM calls GROUP BY callee),
ended AS (SELECT DISTINCT sink, array_to_string(list_append(list_reverse(path), sink), '>') AS path, n + 1 AS nodes FROM walk LEFT JOIN up USING (node) WHERE n >= {depth} OR ends OR callers IS NULL OR list_has_any(callers, path)
 UNION ALL SELECT p_partkey, CAST(p_partkey AS VARCHAR), 1 FROM part WHERE p_partkey NOT IN (SELECT callee FROM calls))"""


def _shown(found):
    return found.select("sink", F.array_join("path", ">").alias("path"), F.size("path").alias("nodes"))


@query(f"WITH {_walk_sql(S.CALLS_SQL, 8)} SELECT sink, path, CAST(nodes AS INT) AS nodes FROM ended")
def chain_recursive(spark, sf_dir):
    return _shown(chains.reverse_chains(_sinks(spark, sf_dir), S.calls(spark, sf_dir)))


_LOOPED = "SELECT CAST(floor(p_partkey / 4) AS BIGINT), p_partkey, CAST(2 AS INT), false FROM part WHERE p_partkey >= 4"


@query(f"WITH {_walk_sql(S.CALLS_SQL[:-1] + ' UNION ALL ' + _LOOPED + ')', 4)} SELECT sink, path, CAST(nodes AS INT) AS nodes FROM ended")
def chain_cycle_guard(spark, sf_dir):
    wrapped = S.table(spark, sf_dir, "part").where("p_partkey >= 4").selectExpr("CAST(floor(p_partkey / 4) AS BIGINT) AS caller", "p_partkey AS callee", "2 AS child_ord", "false AS ends")
    return _shown(chains.reverse_chains(_sinks(spark, sf_dir), S.calls(spark, sf_dir).unionByName(wrapped), depth=4))


@query(f"WITH {_walk_sql(S.CALLS_SQL, 8)}, c AS (SELECT sink, nodes, row_number() OVER (PARTITION BY sink ORDER BY nodes DESC, list_transform(string_split(path, '>'), lambda v: CAST(v AS BIGINT))) AS place, path FROM ended) SELECT sink, path, CAST(place AS INT) AS place FROM c WHERE place <= 5")
def chain_cap(spark, sf_dir):
    found = chains.capped(chains.reverse_chains(_sinks(spark, sf_dir), S.calls(spark, sf_dir)), 5)
    return found.select("sink", F.array_join("path", ">").alias("path"), "place")


@query(f"""WITH RECURSIVE {S.CALLS_SQL[:-1]} UNION ALL {_LOOPED}), walk AS (
 SELECT p_partkey AS sink, c.caller AS node, [c.caller] AS path, [c.child_ord] AS trail, 1 AS n, c.ends FROM part JOIN calls c ON c.callee = p_partkey
 UNION ALL SELECT w.sink, c.caller, list_append(w.path, c.caller), list_append(w.trail, c.child_ord), w.n + 1, c.ends FROM walk w JOIN calls c ON c.callee = w.node WHERE w.n < 5 AND NOT w.ends AND NOT list_contains(w.path, c.caller)),
up AS (SELECT callee AS node, list(caller) AS callers FROM calls GROUP BY callee),
ended AS (SELECT sink, path, n, min(trail) AS trail FROM walk LEFT JOIN up USING (node) WHERE n >= 5 OR ends OR callers IS NULL OR list_has_any(callers, path) GROUP BY ALL)
SELECT sink, array_to_string(list_append(list_reverse(path), sink), '>') AS path, CAST(row_number() OVER (PARTITION BY sink ORDER BY n DESC, trail) AS INT) AS place FROM ended QUALIFY place <= 3
UNION ALL SELECT p_partkey, CAST(p_partkey AS VARCHAR), 1 FROM part WHERE p_partkey NOT IN (SELECT callee FROM calls)""")
def chain_longest(spark, sf_dir):
    wrapped = S.table(spark, sf_dir, "part").where("p_partkey >= 4").selectExpr("CAST(floor(p_partkey / 4) AS BIGINT) AS caller", "p_partkey AS callee", "2 AS child_ord", "false AS ends")
    found = chains.longest_chains(_sinks(spark, sf_dir), S.calls(spark, sf_dir).unionByName(wrapped), most=3, depth=5)
    return found.select("sink", F.array_join("path", ">").alias("path"), "place")


@query(f"""WITH RECURSIVE {S.CALLS_SQL}, walk AS (SELECT callee AS root, caller AS helper, 1 AS n, [child_ord] AS trail FROM calls UNION ALL SELECT w.root, c.caller, w.n + 1, list_append(w.trail, c.child_ord) FROM walk w JOIN calls c ON c.callee = w.helper WHERE w.n < 3),
f AS (SELECT root, helper, min({{'n': n, 't': trail}}) AS x FROM walk WHERE root <> helper GROUP BY ALL), p AS (SELECT root, helper, CAST(x.n AS INT) AS depth, CAST(row_number() OVER (PARTITION BY root ORDER BY x.n, x.t, helper) AS INT) AS place FROM f) SELECT * FROM p WHERE place <= 8""")
def helper_bfs(spark, sf_dir):
    turned = S.calls(spark, sf_dir).select(F.col("callee").alias("caller"), F.col("caller").alias("callee"), "child_ord")
    return chains.helpers(turned.select(F.col("caller").alias("root")), turned, depth=3, most=8)


@query(f"WITH {_walk_sql(S.CALLS_SQL, 8)}, c AS (SELECT sink, path, row_number() OVER (PARTITION BY sink ORDER BY nodes DESC, list_transform(string_split(path, '>'), lambda v: CAST(v AS BIGINT))) AS place FROM ended QUALIFY place <= 2), u AS (SELECT sink, place, unnest(string_split(path, '>')) AS node, generate_subscripts(string_split(path, '>'), 1) - 1 AS k FROM c) SELECT sink, CAST(place AS INT) AS place, CAST(k AS INT) AS depth, CAST(node AS BIGINT) AS node, p_name AS function, p_size AS line FROM u LEFT JOIN part ON p_partkey = CAST(node AS BIGINT)")
def chain_function_pool(spark, sf_dir):
    found = chains.capped(chains.reverse_chains(_sinks(spark, sf_dir), S.calls(spark, sf_dir)), 2)
    pool = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("function_ref"), F.col("p_name").alias("function"), F.col("p_size").alias("line"))
    return chains.with_functions(found, pool).select("sink", "place", F.col("at").alias("depth"), "node", "function", "line")
