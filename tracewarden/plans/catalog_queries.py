"""Queries of projects, scans, curated vulnerabilities and audit packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import catalog, chains, packs
from . import standins as S
from .flow_queries import BRIDGE_SQL, _chains, _sinks, _strong, _walk_sql, _weak
from .registry import cases, mapped, query, quoted


@query(f"WITH {S.SCANS_SQL} SELECT source, owner, repo, count(DISTINCT version) AS versions, count(*) AS scans FROM scans GROUP BY ALL")
def project_counts(spark, sf_dir):
    return catalog.project_counts(S.scans(spark, sf_dir))


@query(f"WITH {S.SCANS_SQL} SELECT CASE status WHEN 'running' THEN 'stopped' ELSE status END AS status, count(*) AS n, count(*) FILTER (status <> 'running') AS with_agent FROM scans GROUP BY 1")
def orphans_stopped(spark, sf_dir):
    rows = catalog.without_orphans(S.scans(spark, sf_dir).withColumn("current_agent", F.lit("auditor")))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count("current_agent").alias("with_agent"))


@query(f"WITH {S.SCANS_SQL}, f AS (SELECT l_orderkey, count(*) AS failure_count FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT scan_id, failure_count, 'pending' AS status, 'treescan,callscan' AS completed_agents FROM scans JOIN f ON lpad(CAST(l_orderkey AS VARCHAR), 12, '0') = scan_id WHERE status <> 'running'")
def retry_failures(spark, sf_dir):
    scans = S.scans(spark, sf_dir).select("scan_id", "status").withColumn("completed_agents", F.array(*map(F.lit, ("treescan", "callscan", "auditor"))))
    failures = S.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("scan_id"))
    return catalog.retried(scans, failures).select("scan_id", "failure_count", "status", F.array_join("completed_agents", ",").alias("completed_agents"))


@query(f"WITH {S.SCANS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY project_path ORDER BY priority = '1-URGENT', day DESC, scan_id DESC) AS rn FROM scans) SELECT project_path, scan_id FROM r WHERE rn = 1")
def latest_scan_for_version(spark, sf_dir):
    scans = S.scans(spark, sf_dir).select("project_path", "scan_id", F.col("day").alias("created_at"), (F.col("priority") == "1-URGENT").alias("legacy"))
    return catalog.latest_scan(scans).select("project_path", "scan_id")


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(concat_ws(' ', r_name, n_name, c_name, c_mktsegment)), 'am')")
def project_search(spark, sf_dir):
    rows = S.table(spark, sf_dir, "customer").join(S.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(S.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return catalog.searched(rows, ["r_name", "n_name", "c_name", "c_mktsegment"], " AM ").select("c_custkey")


@query("WITH v AS (SELECT DISTINCT doc_id, unnest([source, concat('src', doc_id % 50), source]) AS project_path FROM documents) SELECT doc_id AS vulnerability_id, project_path FROM v WHERE project_path IN (SELECT source FROM documents)")
def curated_links(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents")
    rows = docs.selectExpr("doc_id AS vulnerability_id", "array(source, concat('src', doc_id % 50), source) AS links")
    return catalog.linked(rows, docs.selectExpr("source AS project_path").distinct())


@query(f"WITH {S.FINDINGS_SQL} SELECT chain_id FROM findings WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def curated_duplicates(spark, sf_dir):
    found = S.findings(spark, sf_dir).withColumn("project_path", F.col("repo"))
    return catalog.already_curated(found, found.where("toxic = 1")).select("chain_id")


@query(f"WITH {S.FINDINGS_SQL} SELECT sink_file AS file, count(*) AS n, string_agg(CAST(sink_line AS VARCHAR), ',' ORDER BY sink_line) AS lines FROM findings GROUP BY 1")
def findings_by_file(spark, sf_dir):
    return catalog.file_groups(S.findings(spark, sf_dir).select(F.col("sink_file").alias("file"), F.col("sink_line").alias("line")))


@query(f"WITH {S.FINDINGS_SQL} SELECT chain_id, lower(severity) AS severity, doc_id % 2 = 0 AS has_call_chain FROM findings ORDER BY {mapped('lower(severity)', fixed.SEVERITIES, '0')} DESC, doc_id % 2 = 0 DESC, chain_id LIMIT 30")
def top_candidates(spark, sf_dir):
    rows = S.findings(spark, sf_dir).withColumns({"severity": F.lower("severity"), "has_call_chain": F.expr("doc_id % 2 = 0"), "sink_function": F.lit("f")})
    return packs.top_candidates(rows).select("chain_id", "severity", "has_call_chain")


@query(f"""WITH {_walk_sql(S.CALLS_SQL, 8)}, c AS (SELECT sink, path, row_number() OVER (PARTITION BY sink ORDER BY nodes DESC, list_transform(string_split(path, '>'), lambda v: CAST(v AS BIGINT))) AS place FROM ended QUALIFY place <= 3),
u AS (SELECT sink, place, unnest(string_split(path, '>')) AS node, generate_subscripts(string_split(path, '>'), 1) AS k FROM c), p AS (SELECT sink, place, string_agg(p_name, ' -> ' ORDER BY k) AS path FROM u JOIN part ON p_partkey = CAST(node AS BIGINT) GROUP BY ALL), l AS (SELECT sink, string_agg(concat(place, '. ', path), chr(10) ORDER BY place) AS chains FROM p GROUP BY sink),
f AS (SELECT sink, node, min({{'p': place, 'k': k}}) AS first FROM u GROUP BY ALL), b AS (SELECT sink, string_agg(concat('### ', p_name, ' (', p_brand, ':', p_size, '-', p_size + 1, ')', chr(10), '```', chr(10), p_type, chr(10), '```'), chr(10) ORDER BY first, CAST(node AS BIGINT)) AS bodies FROM f JOIN part ON p_partkey = CAST(node AS BIGINT) GROUP BY sink)
SELECT CAST(sink AS VARCHAR) AS chain_id, md5(concat('# sink ', sink, chr(10), chr(10), '## Call chains', chr(10), chains, chr(10), chr(10), '## Functions', chr(10), bodies)) AS pack FROM l JOIN b USING (sink)""")
def audit_packs(spark, sf_dir):
    found = chains.capped(chains.reverse_chains(_sinks(spark, sf_dir), S.calls(spark, sf_dir)), 3)
    part = S.table(spark, sf_dir, "part")
    pool = part.select(F.col("p_partkey").alias("function_ref"), F.col("p_name").alias("function"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"), (F.col("p_size") + 1).alias("line_end"), F.col("p_type").alias("code_slice"))
    nodes = chains.with_functions(found, pool).select(F.col("sink").cast("string").alias("chain_id"), "place", "at", "function_ref", F.col("function").alias("name"))
    heads = found.select(F.col("sink").cast("string").alias("chain_id"), F.concat(F.lit("# sink "), F.col("sink").cast("string")).alias("head")).distinct()
    return packs.packs(heads, nodes, pool).select("chain_id", F.md5("pack").alias("pack"))


def _kind_sql(of: str) -> str:
    return mapped(of, fixed.SANITIZER_KINDS, cases([(f"starts_with({of}, 'file')", "'path_or_filename_policy'")], "'sanitizer'"))


def _cleaned_sql(side: str, kind: str) -> list[str]:
    """The strong and the weak sanitizer of a side, null where there is none."""
    at = f"concat({side}.file, ':', {side}.line)"
    return [f"CASE WHEN {side}.event_id IS NOT NULL AND {sign} THEN concat_ws(' ', '{strength}', {kind}, {at}) END" for strength, sign in (("strong", _strong(side)), ("weak", _weak(side)))]


_CLEANED = ", ".join([*_cleaned_sql("w", _kind_sql("w.vulnerability_type")), *_cleaned_sql("r", quoted(fixed.SANITIZER_KINDS["xss"])), *_cleaned_sql("s", _kind_sql("s.vulnerability_type"))])
_AT = "concat('- {1}: ', {0}.file, ':', {0}.line)"
_WORDS = "CASE WHEN len({1}) > 0 THEN concat('- {0}: ', array_to_string({1}, ', ')) END"


@query(f"""WITH {BRIDGE_SQL}, t AS (SELECT *, list_filter([{_CLEANED}], lambda v: v IS NOT NULL) AS cleaned FROM chains)
SELECT chain_id, concat_ws(chr(10), concat('# ', s.vulnerability_type, ' (', quality, ', ', score, ')'), {_AT.format('w', 'write')}, concat('- storage: ', identity), CASE WHEN has_read THEN {_AT.format('r', 'read')} END, {_AT.format('s', 'sink')}, {_WORDS.format('sanitizers', 'cleaned')}, {_WORDS.format('breakpoints', 'breakpoints')}, {_WORDS.format('noise', 'noise')}) AS pack FROM t""")
def bridge_packs(spark, sf_dir):
    return packs.bridge_packs(_chains(spark, sf_dir))
