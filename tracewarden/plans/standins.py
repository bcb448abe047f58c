"""Stand-ins: what the driver's tables mean to an audit engine.

Each is a list of expressions over one table, written so that Spark and DuckDB read them alike. They give every row of the
table a part; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import cases

NUMBERED = "CAST(doc_id AS STRING)"
CHAIN = f"concat('C-', left(sha1({NUMBERED}), 12))"


def pick(key: str, *values: str) -> str:
    """The value whose number is key modulo their count; values are SQL."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


FILE = "concat(source, '/', " + pick("doc_id", "'vendor/'", "'src/tests/'", "'docs/'", "'src/app/'", "'api/'", "'src/config/'", "'src/'", "'web/static/'", "'modules/Order/'") + f", 'f', {NUMBERED}, " + pick("doc_id", "'.py'", "'.php'", "'.js'", "'.html'", "'.min.js'", "''", "'.png'") + ")"
FILES = {"doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source", "file": FILE}

#: Model answers for documents joined with labels.
FINDINGS = {
    "doc_id": "doc_id", "chain_id": CHAIN, "ord": "doc_id", "language": "lang", "repo": "source", "scan_id": "concat('s-', source)", "sink_file": FILE, "sink_line": "CAST(n_chars % 97 AS INT)",
    "vulnerability_type": pick("doc_id", "'xss'", "'sql_injection'", "'file_upload'", "'weird_kind'", "'ssrf'", "'file_inclusion'"),
    "verdict_text": cases([("toxic = 1", "'Confirmed VULNERABLE'"), ("quality = 1", "'not exploitable'"), ("quality = 0", "'unsafe code'"), ("doc_id % 2 = 0", "'vulnerable'")], "'needs review'"),
    "confidence_text": pick("doc_id", "'High'", "'medium-low'", "'90%'", "'0.35'", "'42'", "'abc'", "'程度高'", "'1.5e2'", "'very low'", "'-1'", "'likely'", "CAST(NULL AS STRING)", "'0.8'"),
    "severity": pick("doc_id", "'Critical'", "'high'", "'MEDIUM'", "'low'", "''"),
    "missing_text": pick("doc_id", "CAST(NULL AS STRING)", "'source entry unknown'", "''", "'模板 binding'", "'missing_reachability'", "'storage_identity'", "'权限'", "'nothing special'", "'runtime flag'"),
    "cwe": pick("doc_id", "'cwe-79'", "'CWE-89'", "''", "'cwe-918'"),
    "title": pick("doc_id", "concat('Finding ', CAST(doc_id AS STRING))", "'tool-loop exhausted'", "''", "'LLM 调用失败: timeout'", "'unit-test'"),
    "principle": pick("doc_id", "'because'", "''", "CAST(NULL AS STRING)"),
    "n_evidence": "CAST(doc_id % 3 AS INT)", "n_missing": "CAST(doc_id % 2 AS INT)",
    "stopped": cases([("doc_id % 17 = 0", "'llm_error'"), ("doc_id % 5 = 0", "'max_tool_rounds'")]),
    "n_chars": "n_chars", "toxic": "toxic", "quality": "quality",
}

#: Data-flow facts for events: signups write, views read, purchases are sinks, errors are scanned sinks.
FACTS = {
    "event_id": "event_id", "event_type": "event_type", "field": "concat('u', CAST(user_id AS STRING))",
    "kind": pick("event_id", "'sql_field'", "'file_slot'", "'request_var'", "'session_key'", "'template_field'", "'orm_field'"),
    "file": "concat('app/', event_type, '/', CAST(user_id AS STRING), '.py')", "line": "CAST(event_id AS INT)",
    "evidence": pick("event_id", "'x = htmlspecialchars(v)'", "'y = strip_tags(v)'", "'{{ v|safe }}'", "'open(p, \"w\")'", "'echo $v;'", "'insert into Orders (a, b) values (1, 2)'", "'move_uploaded_file(f, static/uploads)'", "'el.innerHTML = v'"),
    "vulnerability_type": pick("event_id", "'xss'", "'file_inclusion'", "'sql_injection'"),
    "severity": pick("event_id", "'critical'", "'high'", "'medium'", "'low'"),
    "template": "CASE WHEN event_id % 2 = 0 THEN concat('tpl/', CAST(user_id AS STRING), '.html') END",
    "template_var": "CASE WHEN event_id % 4 < 2 THEN concat('u', CAST(user_id AS STRING)) END",
    "source_expr": "'request.args'", "sink_function": "'sink'",
}

#: Run events and turns for events.
RUN = {
    "log": "user_id", "line": "event_id", "agent": "concat('a', CAST(user_id % 5 AS STRING))", "elapsed": "CAST(event_id % 1000 AS DOUBLE)", "text": "concat(event_type, CAST(event_id AS STRING))",
    "type": "CASE event_type WHEN 'signup' THEN 'llm_request' WHEN 'view' THEN 'llm_response' WHEN 'error' THEN 'llm_error' WHEN 'click' THEN 'agent_start' ELSE 'agent_end' END", "ts": "ts",
}
TURNS = {
    "agent": "user_id", "turn": "event_id % 40", "line": "event_id", "prompt": "event_id % 100", "completion": "event_id % 37",
    "status": "CASE event_type WHEN 'view' THEN 'ok' WHEN 'error' THEN 'error' ELSE 'pending' END",
}

#: Calls for parts: a part is called by its two heap children.
CALLS = {"caller": "p_partkey", "callee": "CAST(floor(p_partkey / 2) AS BIGINT)", "child_ord": "CAST(p_partkey % 2 AS INT)", "ends": "p_partkey % 11 = 0"}

#: Scans for orders: the project is a customer's place, measures come from its lines.
MEASURES = {"files": "1=1", "rg_raw": "l_quantity > 5", "sink_hits": "l_quantity > 10", "candidate_chains": "l_quantity > 20", "with_call_chain": "l_quantity > 25", "audited": "l_quantity > 30", "vulnerable": "l_returnflag = 'R' AND l_quantity > 30", "uncertain": "l_returnflag = 'A' AND l_quantity > 30", "safe": "l_returnflag = 'N' AND l_quantity > 30", "filtered_by_comment": "l_quantity < 3", "filtered_by_dynamic": "l_quantity = 3", "filtered_by_extra": "l_quantity = 4", "kept": "l_quantity > 9", "dedup_dropped": "l_quantity = 10"}
SCANS_SQL = (
    "measures AS (SELECT l_orderkey, " + ", ".join(f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, c in MEASURES.items()) + " FROM lineitem GROUP BY l_orderkey), "
    "scans AS (SELECT concat(r_name, '/', n_name, '/', c_name, '/', c_mktsegment) AS project_path, r_name AS source, n_name AS owner, c_name AS repo, c_mktsegment AS version, lpad(CAST(o_orderkey AS STRING), 12, '0') AS scan_id, o_orderkey AS ord, o_orderstatus = 'F' AS has_audit, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, "
    "strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS priority, " + ", ".join(f"coalesce({n}, 0) AS {n}" for n in MEASURES) + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN measures ON l_orderkey = o_orderkey)"
)


def sql(expressions: dict[str, str], table: str) -> str:
    """The stand-in as a DuckDB subquery."""
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in expressions.items())} FROM {table}"


FILES_SQL = f"files AS ({sql(FILES, 'documents')})"
LINES_SQL = FILES_SQL + ", cut AS (SELECT doc_id, lang, source, file, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM files), lines AS (SELECT doc_id, lang, source, file, CAST(n AS INT) AS line, rtrim(raw, chr(13)) AS code FROM cut)"
FINDINGS_SQL = f"findings AS ({sql(FINDINGS, '(SELECT d.*, toxic, quality FROM documents d LEFT JOIN labels USING (doc_id))')})"
FACTS_SQL = f"facts AS ({sql(FACTS, 'events')})"
RUN_SQL = f"run AS ({sql(RUN, 'events')})"
TURNS_SQL = f"turns AS ({sql(TURNS, 'events')})"
CALLS_SQL = f"calls AS ({sql(CALLS, 'part')} WHERE p_partkey > 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.selectExpr(*(f"{e} AS {n}" for n, e in expressions.items()))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(table(spark, sf_dir, "documents"), FILES)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import lines as cut

    return cut(files(spark, sf_dir))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), FINDINGS)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(table(spark, sf_dir, "events"), FACTS)


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(table(spark, sf_dir, "events"), RUN)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(table(spark, sf_dir, "events"), TURNS)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(table(spark, sf_dir, "part").where("p_partkey > 1"), CALLS)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*(F.count_if(F.expr(c)).alias(n) for n, c in MEASURES.items()))
    places = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "orders").join(places, F.col("o_custkey") == F.col("c_custkey")).join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.selectExpr(
        "concat(r_name, '/', n_name, '/', c_name, '/', c_mktsegment) AS project_path", "r_name AS source", "n_name AS owner", "c_name AS repo", "c_mktsegment AS version", "lpad(CAST(o_orderkey AS STRING), 12, '0') AS scan_id", "o_orderkey AS ord", "o_orderstatus = 'F' AS has_audit",
        "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END AS status", "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "o_orderpriority AS priority", *(f"coalesce({n}, 0L) AS {n}" for n in MEASURES),
    )
