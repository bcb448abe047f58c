"""Queries that write files and read them back, and of the artifacts' small parts: trees, records, logs, reports, streams."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Window as W, functions as F

from ..functions import fixed, paths, text, verdicts
from ..operators import catalog, chains, packs, review, rules, telemetry, trees
from ..sources import files, sinks, walk
from ..streaming import events as streams
from . import standins as S
from .finding_queries import FULL_SQL, _findings
from .registry import query, quoted
from .rule_queries import SKIP_SQL, _ext
from .run_queries import _event_stream
from .scratch import scratch, write_tree

# --- Trees -----------------------------------------------------------------------------------------------------------

_DENIED = " OR ".join(f"regexp_matches(file, {quoted('(?i)' + p)})" for p in fixed.DENIED_DIRS + fixed.DENIED_FILES)
_SOURCE = f"{_ext('file')} IN ({', '.join(map(quoted, fixed.SOURCE_SUFFIXES))})"
_BODY = "coalesce(text, '')"


def _tree(spark, sf_dir):
    root = scratch(spark, "tree")
    write_tree(S.files(spark, sf_dir).select("file", F.col("text").alias("body")), root)
    return root


@query(f"WITH {S.FILES_SQL} SELECT file, CAST(strlen({_BODY}) AS BIGINT) AS size FROM files WHERE NOT ({_DENIED})")
def tree_listing(spark, sf_dir):
    return files.listing(spark, _tree(spark, sf_dir)).select("file", "size")


@query(f"WITH {S.FILES_SQL} SELECT file, CASE WHEN {_ext('file')} = '' THEN '<no_ext>' ELSE concat('.', {_ext('file')}) END AS ext, sha256({_BODY}) AS text_sha256 FROM files WHERE {_SOURCE} AND ({SKIP_SQL}) IS NULL")
def tree_sources(spark, sf_dir):
    return files.sources(spark, _tree(spark, sf_dir)).select("file", "ext", F.sha2("text", 256).alias("text_sha256"))


@query(f"""WITH {S.LINES_SQL.replace('string_split(text, chr(10))', "string_split(coalesce(text, ''), chr(10))")} SELECT file, line, md5(code) AS code FROM lines WHERE {_SOURCE} AND ({SKIP_SQL}) IS NULL""")
def tree_source_lines(spark, sf_dir):
    root = _tree(spark, sf_dir)
    return walk.lines(files.scannable(spark, root), root, 5_000).withColumn("code", F.md5("code"))


_SHOWN_SQL = "list_transform(range(1, len(parts) + 1), lambda i: {'last': i = len(parts), 'folded': lower(parts[i]), 'name': parts[i]})"


@query(f"WITH {S.FILES_SQL}, l AS (SELECT file, string_split(file, '/') AS parts FROM files WHERE NOT ({_DENIED})) SELECT file, row_number() OVER (ORDER BY {_SHOWN_SQL}) AS place FROM l")
def tree_in_order(spark, sf_dir):
    listed = files.listing(spark, _tree(spark, sf_dir)).select("file")
    return packs.ranks(listed, [walk.tree_order(F.col("file"))], "place", scratch(spark, "tree-order")).select("file", "place")


@query(f"WITH {S.FILES_SQL} SELECT file, CAST(strlen({_BODY}) AS BIGINT) AS size, strlen({_BODY}) > {files.MOST_BYTES} AS truncated, sha256(text) AS text_sha256 FROM files ORDER BY strlen({_BODY}) DESC, file LIMIT 1")
def file_viewed(spark, sf_dir):
    """The largest file of a tree, as the viewer shows it."""
    largest = S.files(spark, sf_dir).orderBy(F.desc(F.octet_length(F.coalesce("text", F.lit("")))), "file").select("file").first()["file"]
    parts = largest.split("/")
    asked = "/".join([*parts[:-1], ".", "gone", "..", parts[-1]])
    return files.viewed(spark, _tree(spark, sf_dir), asked).select("file", "size", "truncated", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {S.FILES_SQL}, p AS (SELECT string_split(file, '/') AS parts FROM files), u AS (SELECT parts, unnest(range(1, len(parts))) AS k FROM p) SELECT (SELECT count(*) FROM files) AS files, count(DISTINCT array_to_string(parts[1:k], '/')) AS dirs FROM u")
def tree_counts(spark, sf_dir):
    return trees.counts(S.files(spark, sf_dir))


@query("SELECT concat(n_name, '.log') AS name, CAST(strlen(concat(n_name, ' ', CAST(n_regionkey AS STRING))) AS BIGINT) AS size FROM nation")
def log_list(spark, sf_dir):
    root = scratch(spark, "logs")
    rows = S.table(spark, sf_dir, "nation")
    body = F.concat("n_name", F.lit(" "), F.col("n_regionkey").cast("string"))
    both = rows.select(F.explode(F.array(*(F.concat("n_name", F.lit(e)) for e in (".log", ".txt")))).alias("file"), body.alias("body"))
    write_tree(both, root)
    return files.logs(spark, root).select("name", "size")


# --- JSON, JSON lines, CSV, Markdown ---------------------------------------------------------------------------------


@query("SELECT doc_id, lang, sha256(text) AS text_sha256 FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Sorted chains under a meta line, and a file of lines that aren't rows."""
    out = scratch(spark, "chains")
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    sinks.with_meta(docs, F.struct(F.lit("meta").alias("type"), F.lit("documents").alias("name")), out, [F.col("doc_id")])
    S.table(spark, sf_dir, "region").select("r_name").write.mode("append").text(f"{out}/_rest")
    back = files.json_lines(spark, [out, f"{out}/_meta", f"{out}/_rest"], "doc_id long, lang string, text string")
    return back.select("doc_id", "lang", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT min(doc_id) AS first_id, max(doc_id) AS last_id, true AS in_order FROM documents")
def jsonl_order(spark, sf_dir):
    """Part files in name order hold the rows in order."""
    out = scratch(spark, "sorted")
    sinks.json_lines(S.table(spark, sf_dir, "documents").select("doc_id", "text"), out, [F.col("doc_id")])
    rows = spark.read.schema("doc_id long").json(out).select("doc_id", F.col("_metadata.file_name").alias("part"))
    parts = rows.groupBy("part").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    later = F.lead("least").over(W.orderBy("part"))  # one row a part file
    return parts.select("least", "most", (F.coalesce(later, F.col("most") + 1) > F.col("most")).alias("fits")).agg(F.min("least").alias("first_id"), F.max("most").alias("last_id"), F.bool_and("fits").alias("in_order"))


@query("SELECT 'meta' AS type, count(*) AS total FROM documents")
def jsonl_meta(spark, sf_dir):
    out = scratch(spark, "meta")
    docs = S.table(spark, sf_dir, "documents")
    sinks.with_meta(docs.select("doc_id"), F.struct(F.lit("meta").alias("type"), F.lit(docs.count()).alias("total")), out, [F.col("doc_id")])
    line = files.meta_line(spark, f"{out}/_meta").select(F.from_json("value", "type string, total long").alias("x"))
    return line.select("x.type", "x.total")


_RECORDS_SQL = "SELECT concat(r_name, '/', n_name, '/', c_name, '/', c_mktsegment) AS project_path, CAST(c_custkey AS STRING) AS scan_id, CASE WHEN c_acctbal < 0 THEN 'error' ELSE 'done' END AS status, c_acctbal AS duration FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(_RECORDS_SQL)
def scan_records_read(spark, sf_dir):
    """A scan.json of each customer, some with line ends inside, below source/owner/repo/version/artifacts/scans."""
    root = scratch(spark, "projects")
    places = S.table(spark, sf_dir, "nation").join(S.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = S.table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    file = F.concat_ws("/", "r_name", "n_name", "c_name", "c_mktsegment", F.lit("artifacts/scans"), F.col("c_custkey").cast("string"), F.lit("scan.json"))
    record = F.to_json(F.struct(F.when(F.col("c_acctbal") < 0, "error").otherwise("done").alias("status"), F.col("c_acctbal").alias("duration")))
    write_tree(rows.select(file.alias("file"), F.replace(record, F.lit(","), F.lit(",\n  ")).alias("body")), root, dealt=True)
    return files.scans(spark, root, "status string, duration double")


_FUNNEL = {"duration_seconds": "CAST(ord % 600 AS BIGINT)", "primary_language": S.pick("ord", "'php'", "'a, \"b\"'", "CAST(NULL AS STRING)")}


@query(f"WITH {S.SCANS_SQL} SELECT {', '.join(f'{_FUNNEL.get(c, c)} AS {c}' for c in sinks.FUNNEL_COLUMNS)} FROM scans")
def funnel_csv(spark, sf_dir):
    out = scratch(spark, "funnel")
    sinks.funnel_csv(S.scans(spark, sf_dir).selectExpr("*", *(f"{e} AS {n}" for n, e in _FUNNEL.items())), out)
    texts = ("project_path", "scan_id", "status", "primary_language")
    schema = ", ".join(f"{c} {'string' if c in texts else 'long'}" for c in sinks.FUNNEL_COLUMNS)
    return spark.read.schema(schema).csv(out, header=True)


_LINE = "concat('- {0}: ', coalesce(CAST({1} AS VARCHAR), ''))"
_FULL = ", ".join(["head", *(_LINE.format(k, c) for k, c in (("verdict", "verdict"), ("confidence", "CAST(confidence AS VARCHAR)"), ("severity", "severity"), ("chain", "chain_id"))), "''", "principle"])


@query(f"WITH {S.FINDINGS_SQL}, r AS (SELECT *, {S.pick('ord', quoted('safe'), quoted('vulnerable'), quoted('uncertain'))} AS verdict, 0.5 AS confidence, concat('## [', CAST(ord AS VARCHAR), '/', CAST((SELECT count(*) FROM documents) AS VARCHAR), '] ', title) AS head FROM findings) SELECT ord, chain_id, CASE WHEN verdict = 'safe' THEN concat_ws(chr(10), head, {_LINE.format('verdict', 'verdict')}, {_LINE.format('chain', 'chain_id')}) ELSE concat_ws(chr(10), {_FULL}) END AS section FROM r")
def report_sections(spark, sf_dir):
    rows = S.findings(spark, sf_dir).selectExpr("*", f"{S.pick('ord', quoted('safe'), quoted('vulnerable'), quoted('uncertain'))} AS verdict", "0.5D AS confidence")
    return sinks.report(rows, "ord", F.lit(S.table(spark, sf_dir, "documents").count()))


@query(f"WITH {S.FILES_SQL} SELECT concat(source, '/', CAST(doc_id AS STRING), '.md') AS file, CAST(k AS INT) AS number, concat(CASE k WHEN 0 THEN concat(lang, chr(10)) WHEN 1 THEN concat('## one', chr(10), CAST(n AS STRING), chr(10)) ELSE '## two' END) AS section FROM (SELECT *, length({_BODY}) AS n, unnest([0, 1, 2]) AS k FROM files) WHERE lang IS NOT NULL")
def markdown_files(spark, sf_dir):
    root = scratch(spark, "reports")
    docs = S.table(spark, sf_dir, "documents").where("lang is not null")
    n = F.length(F.coalesce("text", F.lit(""))).cast("string")
    file = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    write_tree(docs.select(file.alias("file"), F.concat("lang", F.lit("\n## one\n"), n, F.lit("\n## two")).alias("body")), root, dealt=True)
    found = files.markdown(spark, f"{root}/*")
    return found.select(F.substring_index("path", "/", -2).alias("file"), "number", "section")


@query("SELECT event_id, event_type FROM events")
def progress_append(spark, sf_dir):
    """Progress that comes in two parts, the second after a line that isn't whole."""
    out = scratch(spark, "progress")
    rows = S.table(spark, sf_dir, "events").select("event_id", "event_type")
    sinks.append(rows.where("event_id % 2 = 0"), out)
    spark.range(1).select(F.lit('{"event_id": 1, "event_').alias("value")).write.mode("append").text(out)
    sinks.append(rows.where("event_id % 2 <> 0"), out)
    return files.json_lines(spark, out, "event_id long, event_type string")


@query("SELECT c_custkey AS target, count(o_orderkey) + 1 AS version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def history_versions(spark, sf_dir):
    out = scratch(spark, "history")
    orders = S.table(spark, sf_dir, "orders")
    sinks.append(orders.select(F.col("o_custkey").alias("target"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("version")), out)
    history = files.json_lines(spark, out, "target long, version long")
    return sinks.next_versions(history, S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target")))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 2000")
def event_tail(spark, sf_dir):
    return files.tail(S.table(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_id"))


# --- Small parts -----------------------------------------------------------------------------------------------------


@query(f"WITH {FULL_SQL} SELECT chain_id, sink_file FROM g WHERE verdict = 'vulnerable'")
def review_targets(spark, sf_dir):
    return review.targets(_findings(spark, sf_dir)).select("chain_id", "sink_file")


_QUALITY = {"o_orderkey": "o_orderkey", "evidence_quality": S.pick("o_orderkey", "'weak'", "'probable'", "CAST(NULL AS STRING)", "'confirmed'"), "suppressed": S.pick("o_custkey", "true", "false", "CAST(NULL AS BOOLEAN)")}


@query(f"SELECT o_orderkey FROM ({S.sql(_QUALITY, 'orders')}) WHERE coalesce(evidence_quality, '') <> 'weak' AND suppressed IS NOT TRUE")
def confirmed_chains(spark, sf_dir):
    return catalog.confirmed_only(S.table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in _QUALITY.items()))).select("o_orderkey")


@query(f"WITH {S.FACTS_SQL} SELECT count(*) AS files, max(ts) AS modified FROM facts JOIN events USING (event_id) WHERE regexp_matches(file, '/(1|2|30)[.]py$')")
def changed_files(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").selectExpr(f"{S.FACTS['file']} AS file", "ts AS modified")
    return catalog.fingerprint(rows, ("1.py", "2.py", "30.py"))


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN greatest(1, least(16, o_custkey - 5)) WHEN 2 THEN 3 ELSE 16 END AS INT) AS callscan_concurrency, CAST(greatest(1, least(2500, o_custkey * 3)) AS INT) AS auditor_concurrency FROM orders")
def scan_options(spark, sf_dir):
    asked = S.pick("o_orderkey", "'many'", "CAST(o_custkey - 5 AS STRING)", "CAST(NULL AS STRING)", "'99'")
    return catalog.with_options(S.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{asked} AS callscan_concurrency", "CAST(o_custkey * 3 AS STRING) AS auditor_concurrency"))


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S-%f') AS scan_id FROM events")
def scan_ids(spark, sf_dir):
    return S.table(spark, sf_dir, "events").select("event_id", catalog.scan_id(F.col("ts")).alias("scan_id"))


@query(f"WITH {S.SCANS_SQL} SELECT scan_id, CAST(row_number() OVER (PARTITION BY project_path ORDER BY status <> 'done', day DESC NULLS LAST, scan_id DESC) AS INT) AS place FROM scans")
def scans_in_order(spark, sf_dir):
    rows = S.scans(spark, sf_dir).selectExpr("project_path", "scan_id", "day AS created_at", "status <> 'done' AS legacy")
    return rows.select("scan_id", F.row_number().over(W.partitionBy("project_path").orderBy(*catalog.in_order())).alias("place"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'fix,impact,poc' WHEN 1 THEN 'fix,poc' WHEN 2 THEN 'impact' ELSE '' END AS sections FROM orders")
def report_choice(spark, sf_dir):
    asked = F.expr(S.pick("o_orderkey", "CAST(array() AS array<string>)", "array('code', 'poc')", "array('impact', 'zz')", "array('zz')"))
    known = {"all": ("poc", "fix", "impact"), "code": ("fix", "poc")}
    return S.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(catalog.chosen_sections(asked, known), ",").alias("sections"))


@query("WITH w AS (SELECT p_partkey, p_size, unnest(string_split(p_type, ' ')) AS v, generate_subscripts(string_split(p_type, ' '), 1) AS k FROM part), d AS (SELECT p_partkey, p_size, v, min(k) AS k FROM w WHERE v <> '' GROUP BY ALL) SELECT p_partkey AS rule, CASE p_size % 4 WHEN 1 THEN 'L1' WHEN 2 THEN 'L2' ELSE 'L0' END AS level, string_agg(v, ',' ORDER BY k) AS tags, '' AS hints FROM d GROUP BY ALL")
def public_rules(spark, sf_dir):
    words = "concat(split(p_type, ' '), array('', ' '), split(p_type, ' '))"
    rules = S.table(spark, sf_dir, "part").selectExpr("p_partkey AS rule", f"{S.pick('p_size', quoted('l9'), quoted('l1'), quoted('L2'), 'CAST(NULL AS STRING)')} AS level", f"{words} AS semantic_tags", "array('a') AS required_evidence", "CAST(NULL AS array<string>) AS repair_hints", "1 AS extra")
    return packs.public_rules(rules).select("rule", "level", F.array_join("semantic_tags", ",").alias("tags"), F.array_join("repair_hints", ",").alias("hints"))


@query(f"WITH {S.FINDINGS_SQL} SELECT chain_id, language, vulnerability_type, severity, sink_file, sink_line FROM findings")
def compact_chains(spark, sf_dir):
    return packs.compact(S.findings(spark, sf_dir))


@query(f"WITH {S.CALLS_SQL} SELECT DISTINCT callee AS sink, concat(CAST(caller AS STRING), '>', CAST(callee AS STRING)) AS path FROM calls")
def include_chains(spark, sf_dir):
    calls = S.calls(spark, sf_dir).select(F.col("caller").alias("file"), F.col("callee").alias("sink_file"))
    return chains.include_chains(calls.unionByName(calls)).select("sink", F.array_join("path", ">").alias("path"))


@query("SELECT doc_id AS file, concat('f', CAST(doc_id AS STRING)) AS caller, v AS callee, CAST(k AS INT) AS child_ord FROM (SELECT doc_id, unnest(['run', 'show']) AS v, unnest([0, 2]) AS k FROM documents)")
def helper_calls(spark, sf_dir):
    """Each file calls one function of its own, one that isn't there and one as a callback; the called ones call nothing."""
    docs = S.table(spark, sf_dir, "documents").selectExpr("doc_id AS file", "CAST(doc_id AS STRING) AS n")
    body = F.concat(F.lit("if (a) { run(x.y); lost"), "n", F.lit("(); each(list, show) }"))
    own = F.array(F.struct(F.concat(F.lit("f"), "n").alias("name"), body.alias("code")), F.struct(F.lit("run").alias("name"), F.lit("return 1;").alias("code")), F.struct(F.lit("show").alias("name"), F.lit("").alias("code")))
    found = chains.helper_calls(docs.select("file", F.explode(own).alias("x")).select("file", "x.*"))
    return found.select("file", "caller", "callee", F.when(F.col("callee") == "run", 0).otherwise(2).alias("child_ord"))


@query("WITH a AS (SELECT concat('a', CAST(user_id % 5 AS STRING)) AS agent FROM events GROUP BY 1) SELECT CAST(place AS INT) AS place, n.agent, CASE place WHEN 0 THEN NULL ELSE concat('a', CAST(place - 1 AS STRING)) END AS after, CASE WHEN a.agent IS NULL THEN 'pending' ELSE 'seen' END AS status FROM (SELECT unnest(range(7)) AS place, concat('a', CAST(place AS STRING)) AS agent) n LEFT JOIN a USING (agent)")
def workflow_nodes(spark, sf_dir):
    states = S.run_events(spark, sf_dir).select("agent").distinct().withColumn("status", F.lit("seen"))
    return telemetry.workflow(states, [f"a{i}" for i in range(7)])


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('c', CAST(o_custkey AS STRING)) END AS owner FROM orders")
def project_parts(spark, sf_dir):
    name = "concat('c', CAST(o_custkey AS STRING))"
    path = S.pick("o_orderkey", f"concat('s/', {name}, '/r/v')", f"concat('s/', {name}, '/r')", f"concat('s/', {name}, '/../v')", f"concat('s/', {name}, '//v')")
    return S.table(spark, sf_dir, "orders").select("o_orderkey", paths.project_part(F.expr(path), 2).alias("owner"))


@query(rf"WITH {S.FILES_SQL} SELECT doc_id, file AS path, lower(regexp_replace(regexp_replace(CAST(doc_id AS STRING), '(.)', '\1-_', 'g'), '[^A-Za-z0-9_]+', '_', 'g')) AS padded, left(trim(regexp_replace({_BODY}, '[ \t\n\r\f\x0b]+', ' ', 'g')), {fixed.EVIDENCE_CHARS}) AS evidence FROM files")
def text_forms(spark, sf_dir):
    """Slashes, evidence and field names."""
    dashed = F.concat(F.lit("[`a."), F.regexp_replace(F.col("doc_id").cast("string"), "(.)", "$1-_"), F.lit("x`]"))
    field = F.regexp_replace(text.normal_field(dashed), "x$", "")
    return S.files(spark, sf_dir).select("doc_id", paths.slashed(F.replace("file", F.lit("/"), F.lit("\\"))).alias("path"), field.alias("padded"), text.trimmed(F.col("text")).alias("evidence"))


@query("SELECT doc_id, CAST(least(length(text), 7) AS INT) AS chars FROM documents WHERE text IS NOT NULL")
def char_index(spark, sf_dir):
    """The seventh character's place in bytes, looked up again."""
    docs = S.table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", text.char_index(F.col("text"), F.octet_length(F.left("text", F.lit(7)))).cast("int").alias("chars"))


@query(f"SELECT doc_id, CAST(least(n, {fixed.LOG_ITEMS} + 1) AS INT) AS shown, CASE WHEN n > {fixed.LOG_ITEMS} THEN concat('...<truncated ', CAST(n - {fixed.LOG_ITEMS} AS STRING), ' list items>') END AS note FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents WHERE text IS NOT NULL)")
def log_lists(spark, sf_dir):
    items = text.shortened_list(F.split("text", " "))
    rows = S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", items.alias("items"))
    last = F.element_at("items", -1)
    return rows.select("doc_id", F.size("items").alias("shown"), F.when(F.size("items") > fixed.LOG_ITEMS, last).alias("note"))


# --- Streams ---------------------------------------------------------------------------------------------------------


def _all(spark, stream, name, mode="append"):
    out = scratch(spark, name)
    streams.to_table(stream, out, scratch(spark, f"{name}-log"), mode).awaitTermination()
    if mode == "append":
        return spark.read.parquet(out)
    batches = spark.read.option("basePath", out).parquet(out)
    return batches.where(F.col("batch") == batches.agg(F.max("batch")).first()[0]).drop("batch")


@query(f"WITH {S.RUN_SQL} SELECT log, line, type, agent, elapsed FROM run")
def stream_event_log(spark, sf_dir):
    """An event log in four parts and lines that aren't events, a file a micro-batch, written exactly once."""
    log = scratch(spark, "events")
    rows = S.run_events(spark, sf_dir).withColumn("log", F.col("log").cast("string"))
    sinks.append(rows.repartition(4, "line"), log)
    S.table(spark, sf_dir, "region").select("r_name").write.mode("append").text(log)
    found = _all(spark, streams.events(spark, log, files_a_trigger=1), "event-rows")
    return found.select(F.col("log").cast("long").alias("log"), "line", "type", "agent", "elapsed")


@query("SELECT event_id, concat(event_type, ' ', CAST(user_id AS STRING)) AS line FROM events")
def stream_log_lines(spark, sf_dir):
    log = scratch(spark, "console")
    S.table(spark, sf_dir, "events").select(F.concat_ws("\t", F.col("event_id").cast("string"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")))).write.text(log)
    parts = F.split("value", "\t")
    return _all(spark, streams.log_lines(spark, log), "lines").select(F.get(parts, F.lit(0)).cast("long").alias("event_id"), F.get(parts, F.lit(1)).alias("line"))


_DUE = {"scan_id": "scan_id", "status": S.pick("ord", "'pending'", "'running'", "'stopped'", "'done'"), "scheduled_at": S.pick("(ord + CAST(floor(ord / 4) AS BIGINT))", "concat(day, ' 08:30:00')", "CAST(NULL AS STRING)", "'soon'", "concat(day, 'T23:59:59')")}


@query(f"WITH {S.SCANS_SQL}, d AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _DUE.items())} FROM scans) SELECT scan_id, CAST(NULL AS STRING) AS scheduled_at FROM d WHERE status IN ('pending', 'stopped') AND TRY_CAST(scheduled_at AS TIMESTAMP) <= TIMESTAMP '1998-04-25 08:30:00'")
def due_scans(spark, sf_dir):
    rows = S.scans(spark, sf_dir).selectExpr(*(f"{e} AS {n}" for n, e in _DUE.items()))
    return streams.due(rows, F.lit("1998-04-25 08:30:00").cast("timestamp")).select("scan_id", "scheduled_at")


@query(f"WITH {S.SCANS_SQL}, d AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _DUE.items())} FROM scans), t AS (SELECT scan_id, TRY_CAST(scheduled_at AS TIMESTAMP) AS due FROM d WHERE status IN ('pending', 'stopped')) SELECT scan_id, CASE WHEN due <= TIMESTAMP '1995-01-01 00:00:00' THEN 0 WHEN due <= TIMESTAMP '1997-01-01 00:00:00' THEN 1 ELSE 2 END AS batch FROM t WHERE due <= TIMESTAMP '1998-04-25 08:30:00'")
def scans_claimed(spark, sf_dir):
    """Three ticks of the scheduler, the second of which runs twice: every scan is claimed once, by the first tick after its time."""
    rows, claims = S.scans(spark, sf_dir).selectExpr(*(f"{e} AS {n}" for n, e in _DUE.items())), scratch(spark, "claims")
    times = ("1995-01-01 00:00:00", "1997-01-01 00:00:00", "1998-04-25 08:30:00")
    for tick in (0, 1, 1, 2):
        streams.claim(rows, claims, tick, F.lit(times[tick]).cast("timestamp"))
    return spark.read.option("basePath", claims).parquet(claims).select("scan_id", F.col("batch").cast("int").alias("batch"))


@query("WITH e AS (SELECT concat('r', user_id % 7) AS run, concat(event_type, ' ', event_id) AS data FROM events) SELECT run, 'line' AS type, data FROM e UNION ALL SELECT run, 'end', concat('done after ', count(*)) FROM e GROUP BY run")
def stream_run_live(spark, sf_dir):
    """Runs whose log is partly there when the stream starts; the rest, and what says that they have ended, comes while it runs."""
    log, ended, out = (scratch(spark, n) for n in ("live", "live-ends", "live-rows"))
    rows = S.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("r"), F.col("user_id") % 7).alias("run"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("value"))
    ends = rows.groupBy("run").agg(F.count("*").alias("n_lines")).withColumn("status", F.concat(F.lit("done after "), F.col("n_lines").cast("string")))
    rows.where("event_id % 3 = 0").drop("event_id").write.mode("append").json(log)
    ends.where("false").write.mode("append").json(ended)
    lines = spark.readStream.schema("run string, value string").option("maxFilesPerTrigger", 4).json(log)
    said = spark.readStream.schema("run string, status string, n_lines long").json(ended)
    running = streams.to_table(streams.followed(lines, said), out, scratch(spark, "live-log"), every="1 second")
    try:
        ends.write.mode("append").json(ended)  # the end is told before the last lines are there
        for part in (1, 2):
            rows.where(F.col("event_id") % 3 == part).drop("event_id").write.mode("append").json(log)
        found, runs, till = spark.read.schema("run string, type string, data string"), ends.count(), time.monotonic() + 300
        while found.parquet(out).where("type = 'end'").count() < runs and time.monotonic() < till:
            time.sleep(1)
    finally:
        running.stop()
    return found.parquet(out)


@query("SELECT 'line' AS type, concat(event_type, ' ', CAST(event_id AS STRING)) AS data FROM events UNION ALL SELECT 'end', 'done'")
def stream_run_log(spark, sf_dir):
    """What is there first, then what comes, then the status."""
    log, out, place = scratch(spark, "run"), scratch(spark, "run-rows"), scratch(spark, "run-log")
    rows = S.table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("value"))
    for part in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        rows.where(part).select("value").write.mode("append").text(log)
        streams.to_table(streams.log_lines(spark, log), out, place).awaitTermination()
    return streams.with_end(spark.read.parquet(out), "done")


@query("SELECT count(*) AS n_rows, true AS started FROM events")
def stream_heartbeats(spark, sf_dir):
    beats = []
    listener = streams.Heartbeats(lambda *beat: beats.append(beat))
    spark.streams.addListener(listener)
    try:
        lines = _event_stream(spark, sf_dir).select(F.col("text").alias("value"))
        streams.to_table(lines, scratch(spark, "beats"), scratch(spark, "beats-log")).awaitTermination()
        listener.ended.wait(60)
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([(sum(n or 0 for _, _, n in beats), any(b is None for _, b, _ in beats))], "n_rows long, started boolean")


# --- Chain records, searches, workflow -------------------------------------------------------------------------------

_CANDIDATE = {
    "id": S.pick("ord", "chain_id", "''", "CAST(NULL AS STRING)"), "severity": "severity", "vulnerability_type": "nullif(vulnerability_type, 'xss')", "language": "language", "file": "sink_file", "line": "nullif(sink_line, 3)",
    "function": S.pick("ord", "'run'", "CAST(NULL AS STRING)"), "rule_id": "concat('r', CAST(ord % 9 AS STRING))", "level": S.pick("ord", "'L1'", "''", "CAST(NULL AS STRING)"), "summary": "title", "audit_pack": S.pick("ord", "concat(title, ' ')", "''"), "ord": "ord",
}
_RECORD = "coalesce(nullif({0}, ''), '{1}')"


def _candidates(spark, sf_dir):
    rows = S.findings(spark, sf_dir).selectExpr(*(f"{e} AS {n}" for n, e in _CANDIDATE.items()))
    none, chain = F.array().cast("array<string>"), F.array(F.array(F.lit("a"), F.lit("b")))
    lists = {"semantic_tags": F.when(F.col("ord") % 2 == 0, F.array(F.lit("t"))), "required_evidence": none, "repair_hints": none, "limits": none, "call_chains": F.when(F.col("ord") % 3 == 0, chain)}
    return packs.chain_records(rows.withColumns(lists), [-F.coalesce(verdicts.severity_rank(F.lower("severity")), F.lit(0)), F.col("ord")], scratch(spark, "ranks"))


_RECORDS = f"""WITH {S.FINDINGS_SQL}, k AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _CANDIDATE.items())} FROM findings), i AS (SELECT *, row_number() OVER (ORDER BY CASE lower(severity) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, ord) AS index FROM k),
records AS (SELECT 'chain' AS type, index, coalesce(nullif(id, ''), concat('C-', lpad(CAST(index AS STRING), 6, '0'))) AS chain_id, lower({_RECORD.format('severity', 'unknown')}) AS severity, {_RECORD.format('vulnerability_type', 'unknown')} AS vulnerability_type, {_RECORD.format('language', 'unknown')} AS language, {_RECORD.format('file', '')} AS sink_file, coalesce(line, 0) AS sink_line, {_RECORD.format('"function"', '')} AS sink_function, rule_id AS sink_rule_id, {_RECORD.format('level', 'L0')} AS sink_level, CASE ord % 2 WHEN 0 THEN 't' ELSE '' END AS tags, ord % 3 = 0 AS has_call_chain, CAST(CASE ord % 3 WHEN 0 THEN 1 ELSE 0 END AS INT) AS call_chain_count, {_RECORD.format('summary', '')} AS summary, {_RECORD.format('audit_pack', '')} AS audit_pack FROM i)"""


@query(f"{_RECORDS} SELECT * FROM records")
def chain_records(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("tags", F.array_join("semantic_tags", ","))
    return rows.drop("semantic_tags", "required_evidence", "repair_hints", "call_chains", "limits")


@query(f"{_RECORDS} SELECT name, section FROM (SELECT concat('=== CHAIN BEGIN ', chain_id, ' | index=', CAST(index AS STRING), '/', CAST((SELECT count(*) FROM records) AS STRING), ' | severity=', severity, ' | vuln=', vulnerability_type, ' | lang=', language, ' | sink=', sink_file, ':', CAST(sink_line AS STRING), ' ===', chr(10), CASE audit_pack WHEN '' THEN '(no audit_pack rendered)' ELSE rtrim(audit_pack) END, chr(10), '=== CHAIN END ', chain_id, ' ===', chr(10)) AS section, 'md' AS name FROM records UNION ALL SELECT chain_id, 'jsonl' FROM records UNION ALL SELECT chain_id, 'priority' FROM records)")
def chain_files(spark, sf_dir):
    """The three files of the chains, read back: sections of the Markdown, ids of the two others."""
    folder, records = scratch(spark, "chain-files"), _candidates(spark, sf_dir)
    sinks.chain_files(records, packs.chain_section(F.lit(S.table(spark, sf_dir, "documents").count())), folder)
    cut = spark.read.option("lineSep", f"{fixed.CHAIN_BEGIN} ").text(f"{folder}/chains.md").where("value <> ''")
    sections = cut.select(F.lit("md").alias("name"), F.concat(F.lit(f"{fixed.CHAIN_BEGIN} "), F.regexp_replace("value", r"\n\z", "")).alias("section"))
    ids = [files.json_lines(spark, f"{folder}/{f}", "chain_id string").select(F.lit(n).alias("name"), F.col("chain_id").alias("section")) for n, f in (("jsonl", "chains.jsonl"), ("priority", "chains.priority.jsonl"))]
    return sections.unionByName(ids[0]).unionByName(ids[1])


@query(f"WITH {S.LINES_SQL} SELECT file, line FROM lines WHERE regexp_matches(code, '(?i)tion') AND {_ext('file')} IN ('py', 'js', 'html') AND (regexp_matches(file, '^(?:.*/)?src/f[^/]*[.](?:py|js)$') OR regexp_matches(file, '(?:^|/)f[^/]*7[.]html$')) ORDER BY file, line LIMIT 30")
def grep_scoped(spark, sf_dir):
    found = rules.grep(S.lines(spark, sf_dir), "tion", ignore_case=True, endings=("py", "js", "html"), globs=("**/src/f*.{py,js}", "f*7.html"))
    return rules.grep_page(found).select("file", "line")


@query(f"WITH {S.LINES_SQL} SELECT count(*) AS lines, CAST(coalesce(sum(len(regexp_extract_all(code, '(?i)[a-z]*tion'))), 0) AS BIGINT) AS matches FROM lines WHERE regexp_matches(code, '(?i)[a-z]*tion')")
def grep_count(spark, sf_dir):
    return rules.grep_count(rules.grep(S.lines(spark, sf_dir), "[a-z]*tion", ignore_case=True))


@query(f"WITH {S.FILES_SQL} SELECT file FROM files WHERE regexp_matches(file, '(?:^|/)f[^/][^/]?[.]php$') ORDER BY file LIMIT 100")
def grep_files(spark, sf_dir):
    either = S.files(spark, sf_dir).where(paths.glob(F.col("file"), "f?.php") | paths.glob(F.col("file"), "f??.php"))
    return rules.grep_files(either.unionByName(either))


@query("SELECT p_partkey, p_size % 3 = 0 AS shown FROM part")
def hierarchy_visible(spark, sf_dir):
    path = S.pick("p_size", "concat('s/o.k/', CAST(p_partkey AS STRING))", "concat('s/.', CAST(p_partkey AS STRING), '/r')", "concat('s/o/', CAST(p_partkey AS STRING), '/vulnerability')")
    return S.table(spark, sf_dir, "part").select("p_partkey", paths.visible(F.expr(path)).alias("shown"))


_TAGGED = {"p_partkey": "p_partkey", "name": "p_name", "source": "'Local'", "owner": "p_brand", "repo": "concat('r', CAST(p_partkey AS STRING))", "project_path": "concat('Local/', p_brand)", "description": "CAST(NULL AS STRING)"}


@query(f"SELECT p_partkey FROM ({S.sql(_TAGGED | {'tags': 'p_type'}, 'part')}) WHERE contains(lower(concat_ws(' ', name, source, owner, repo, project_path, description, tags)), 'econ')")
def project_search_tags(spark, sf_dir):
    rows = S.table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in _TAGGED.items()), "split(p_type, ' ') AS tags")
    return catalog.searched(rows, ["name", "source", "owner", "repo", "project_path", "description", "tags"], " Econ ").select("p_partkey")


@query(f"WITH {S.SCANS_SQL} SELECT status AS asked, scan_id FROM scans WHERE status IN ('done', 'running') UNION ALL SELECT 'all', scan_id FROM scans")
def queue_by_status(spark, sf_dir):
    rows = S.scans(spark, sf_dir)
    asked = [catalog.by_status(rows, s).select(F.lit(s).alias("asked"), "scan_id") for s in ("done", "running", "all")]
    return asked[0].unionByName(asked[1]).unionByName(asked[2])


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), '12') OR contains(left(md5(p_name), 12), '12') OR contains(CASE p_partkey % 2 WHEN 0 THEN 'tag' ELSE 'branch' END, '12')")
def ref_search(spark, sf_dir):
    rows = S.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "tag").otherwise("branch").alias("kind"), F.left(F.md5("p_name"), F.lit(12)).alias("short_commit"))
    return catalog.any_field(rows, ["name", "kind", "short_commit"], " 12").select("p_partkey")


_SEEN = "SELECT log AS run, CASE agent WHEN 'a0' THEN 'treescan' WHEN 'a1' THEN 'callscan' WHEN 'a2' THEN 'auditor' ELSE 'pipeline' END AS agent, CASE WHEN max(line) % 2 = 0 THEN 'done' ELSE 'running' END AS status FROM run GROUP BY ALL"


@query(f"WITH {S.RUN_SQL}, s AS ({_SEEN}), n AS (SELECT run, unnest(['pipeline', 'treescan', 'callscan', 'dataflowscan', 'auditor', 'repo', 'findings']) AS node, unnest(['pipeline', 'agent', 'agent', 'agent', 'agent', 'input', 'output']) AS kind FROM (SELECT DISTINCT run FROM s)) SELECT n.run, node, kind, CASE kind WHEN 'input' THEN 'ready' WHEN 'output' THEN CASE n.run % 2 WHEN 0 THEN 'done' ELSE 'pending' END ELSE coalesce(status, 'pending') END AS status FROM n LEFT JOIN s ON s.run = n.run AND s.agent = node")
def workflow_graph_nodes(spark, sf_dir):
    S.run_events(spark, sf_dir).createOrReplaceTempView(view := f"run_{uuid.uuid4().hex}")
    states = spark.sql(_SEEN.replace("FROM run ", f"FROM {view} "))
    found = telemetry.workflow_nodes(states, states.where("run % 2 = 0"))
    spark.catalog.dropTempView(view)
    return found


@query(f"SELECT run, unnest([{', '.join(quoted(e[0]) for e in fixed.WORKFLOW_EDGES)}]) AS from_node, unnest([{', '.join(quoted(e[1]) for e in fixed.WORKFLOW_EDGES)}]) AS to_node, unnest([{', '.join(quoted(e[2]) for e in fixed.WORKFLOW_EDGES)}]) AS label FROM (SELECT DISTINCT user_id AS run FROM events)")
def workflow_graph_edges(spark, sf_dir):
    return telemetry.workflow_edges(S.table(spark, sf_dir, "events").select(F.col("user_id").alias("run")))
