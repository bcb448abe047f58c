"""Queries of telemetry and metrics, over events as run logs and orders as scans; streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import metrics, review, telemetry
from ..streaming import events as streams
from . import standins as S
from .finding_queries import FULL_SQL, MARKS_SQL, _findings, _marks
from .registry import mapped, query
from .scratch import scratch

_ROUNDS_SQL = f"{S.RUN_SQL}, l AS (SELECT * FROM run WHERE type IN ('llm_request', 'llm_response', 'llm_error')), n AS (SELECT *, sum(CASE WHEN type = 'llm_request' THEN 1 ELSE 0 END) OVER (PARTITION BY log ORDER BY line) AS round FROM l)"


@query(f"WITH {_ROUNDS_SQL} SELECT log, CAST(round AS BIGINT) AS round, min(line) AS started, arg_min(agent, line) AS agent, count(*) FILTER (type = 'llm_request') AS n_requests, arg_max(text, line) FILTER (type = 'llm_response') AS response, arg_max(text, line) FILTER (type = 'llm_error') AS error FROM n GROUP BY log, round")
def llm_rounds(spark, sf_dir):
    return telemetry.rounds(S.run_events(spark, sf_dir))


@query(f"WITH {S.TURNS_SQL}, f AS (SELECT agent, turn, coalesce(arg_min(status, line) FILTER (status <> 'pending'), 'pending') AS s FROM turns GROUP BY ALL) SELECT t.agent, t.turn, s AS status, max(line) AS line, arg_max(prompt, line) AS prompt FROM turns t JOIN f ON f.agent = t.agent AND f.turn = t.turn AND t.status = s GROUP BY ALL")
def turn_merge(spark, sf_dir):
    return telemetry.merged_turns(S.turns(spark, sf_dir), ["agent", "turn"]).select("agent", "turn", "status", "line", "prompt")


@query(f"WITH {S.TURNS_SQL}, f AS (SELECT agent, turn, arg_min(prompt, line) AS p, arg_min(completion, line) AS c FROM turns WHERE status IN ('ok', 'error') GROUP BY ALL) SELECT agent, count(*) AS turns, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens FROM f GROUP BY agent")
def turn_first_tokens(spark, sf_dir):
    return telemetry.tokens(telemetry.first_tokens(S.turns(spark, sf_dir), ["agent", "turn"]), ["agent"])


@query(f"WITH {S.RUN_SQL}, t AS (SELECT log AS agent, line, CASE type WHEN 'llm_error' THEN 'agent_error' ELSE type END AS type, elapsed FROM run), a AS (SELECT agent, max(line) FILTER (type = 'agent_start') AS started, max(line) FILTER (type = 'agent_end') AS ended, max(line) FILTER (type = 'agent_error') AS failed, arg_max(elapsed, line) FILTER (type = 'agent_end') AS elapsed, count(*) FILTER (type = 'llm_request') AS requests FROM t GROUP BY agent) SELECT agent, CASE WHEN failed IS NOT NULL AND (started IS NULL OR failed > started) THEN 'error' WHEN ended IS NOT NULL AND (started IS NULL OR ended > started) THEN 'done' WHEN started IS NOT NULL THEN 'running' ELSE 'pending' END AS status, started, ended, elapsed, requests FROM a")
def agent_state(spark, sf_dir):
    rows = S.run_events(spark, sf_dir).selectExpr("log AS agent", "line", "CASE type WHEN 'llm_error' THEN 'agent_error' ELSE type END AS type", "elapsed")
    return telemetry.agent_states(rows)


@query(f"WITH {S.RUN_SQL} SELECT agent, count(*) AS n, avg(elapsed) AS elapsed FROM run WHERE type = 'agent_end' GROUP BY agent")
def agent_avg_elapsed(spark, sf_dir):
    return telemetry.average_elapsed(S.run_events(spark, sf_dir))


_LAST, _DAYS = "2024-01-31", 14


@query(f"WITH d AS (SELECT strftime(DATE '{_LAST}' - CAST(i AS INT), '%Y-%m-%d') AS day FROM range({_DAYS}) t(i)), e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1) SELECT day, coalesce(events, 0) AS events, coalesce(errors, 0) AS errors FROM d LEFT JOIN e USING (day)")
def daily_series(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").withColumn("day", telemetry.day(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    return telemetry.daily(rows, "day", {"events": F.count("*"), "errors": F.count_if(F.col("event_type") == "error")}, _LAST, _DAYS)


@query(r"WITH m AS (SELECT conv_id AS conversation, turn AS place, role, concat(text, ' chain_id : K-', CAST(conv_id AS VARCHAR), ' end') AS text FROM conversations), f AS (SELECT conversation, arg_min(text, place) AS text FROM m WHERE role = 'user' GROUP BY 1) SELECT conversation, nullif(regexp_extract(text, 'chain_id\s*:\s*(\S+)', 1), '') AS chain_id FROM f")
def turn_chain_extract(spark, sf_dir):
    rows = S.table(spark, sf_dir, "conversations").selectExpr("conv_id AS conversation", "turn AS place", "role", "concat(text, ' chain_id : K-', CAST(conv_id AS STRING), ' end') AS text")
    return telemetry.turn_chain(rows)


@query(f"SELECT conv_id, count(*) AS messages, CAST((sum(length(coalesce(text, ''))) + 2) // 3 + 8 * count(*) AS BIGINT) AS tokens, (sum(length(coalesce(text, ''))) + 2) // 3 + 8 * count(*) <= {text.available_tokens(2000, 500, 200)} AS fits FROM conversations GROUP BY conv_id")
def token_budget(spark, sf_dir):
    sums = S.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    tokens = text.estimated_tokens(F.col("chars"), F.col("messages"))
    return sums.select("conv_id", "messages", tokens.alias("tokens"), (tokens <= text.available_tokens(2000, 500, 200)).alias("fits"))


@query("SELECT doc_id, CASE WHEN length(text) <= 4000 THEN md5(text) ELSE md5(concat(left(text, 4000), '...<truncated ', length(text) - 4000, ' chars>')) END AS logged FROM documents")
def log_truncate(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.shortened_log(F.col("text"))).alias("logged"))


@query("SELECT role, count(*) AS calls, count(*) FILTER (length(text) > 40) AS ok, count(*) FILTER (length(text) > 40) >= 100 AS passed FROM conversations GROUP BY role")
def concurrency_counts(spark, sf_dir):
    rows = S.table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("calls"), F.count_if(F.length("text") > 40).alias("ok"))
    return rows.withColumn("passed", F.col("ok") >= 100)


_LATEST_SQL = f"{S.SCANS_SQL}, latest AS (SELECT *, row_number() OVER (PARTITION BY project_path ORDER BY has_audit DESC, scan_id DESC) AS rn FROM scans)"


@query(f"WITH {_LATEST_SQL} SELECT project_path, scan_id, has_audit, status, vulnerable FROM latest WHERE rn = 1")
def latest_per_project(spark, sf_dir):
    return metrics.latest(S.scans(spark, sf_dir)).select("project_path", "scan_id", "has_audit", "status", "vulnerable")


_SUMS = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in metrics.MEASURES)
_RATES = ", ".join(f"CASE WHEN {b} = 0 THEN NULL ELSE round_even(CAST({a} AS DOUBLE) / {b}, 4) END AS {n}" for n, (a, b) in metrics.RATES.items())


@query(f"WITH {S.SCANS_SQL}, t AS (SELECT source, {_SUMS} FROM scans GROUP BY source) SELECT source, {', '.join(metrics.MEASURES)}, {_RATES} FROM t")
def funnel_ratios(spark, sf_dir):
    return metrics.funnel(S.scans(spark, sf_dir), ["source"])


@query(f"WITH {S.SCANS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY project_path ORDER BY vulnerable DESC, ord) AS rn, count(*) OVER (PARTITION BY project_path) AS scan_count FROM scans) SELECT project_path, scan_count, scan_id AS best_scan_id, vulnerable AS best_vulnerable FROM b WHERE rn = 1")
def best_scan(spark, sf_dir):
    return metrics.best_scan(S.scans(spark, sf_dir))


@query(f"WITH {S.SCANS_SQL}, c AS (SELECT project_path, has_audit, unnest([priority, status]) AS l FROM scans) SELECT (SELECT count(DISTINCT project_path) FROM scans) AS repos_total, (SELECT count(*) FROM scans) AS scans_total, (SELECT count(*) FROM scans WHERE has_audit) AS scans_with_audit, string_agg(DISTINCT l, ',' ORDER BY l) AS languages, count(DISTINCT l) AS languages_count FROM c")
def coverage_counts(spark, sf_dir):
    return metrics.coverage(S.scans(spark, sf_dir).withColumn("languages", F.array("priority", "status")))


_FLAT_SQL = f"{FULL_SQL}, flat AS (SELECT doc_id, chain_id, repo, confidence, verdict, coalesce(nullif(upper(cwe), ''), 'UNKNOWN') AS cwe, coalesce(nullif(lower(severity), ''), 'unknown') AS severity, coalesce(nullif(lower(vulnerability_type), ''), 'unknown') AS vulnerability_type, coalesce(nullif(lower(language), ''), 'unknown') AS language FROM g)"


def _flat(spark, sf_dir):
    return metrics.flat(_findings(spark, sf_dir))


@query(f"WITH {_FLAT_SQL} SELECT cwe, count(*) AS total, count(*) FILTER (verdict = 'vulnerable') AS vulnerable, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos FROM flat GROUP BY cwe")
def by_cwe_repos(spark, sf_dir):
    return metrics.by_cwe(_flat(spark, sf_dir))


@query(f"WITH {_FLAT_SQL} SELECT vulnerability_type, count(*) AS total, count(*) FILTER (verdict = 'vulnerable') AS vulnerable FROM flat GROUP BY 1")
def by_vulnerability_type(spark, sf_dir):
    return metrics.by_type(_flat(spark, sf_dir))


@query(f"WITH {_FLAT_SQL} SELECT severity, count(*) AS n FROM flat WHERE verdict = 'vulnerable' GROUP BY 1")
def by_severity_vulnerable(spark, sf_dir):
    return metrics.by_severity(_flat(spark, sf_dir))


@query(f"WITH {_FLAT_SQL} SELECT language, count(*) AS total, count(*) FILTER (verdict = 'vulnerable') AS vulnerable, count(*) FILTER (verdict = 'uncertain') AS uncertain, count(*) FILTER (verdict = 'safe') AS safe FROM flat GROUP BY 1")
def by_language_pivot(spark, sf_dir):
    return metrics.by_language(_flat(spark, sf_dir))


@query(f"WITH {_FLAT_SQL} SELECT chain_id, severity, confidence FROM flat WHERE verdict = 'vulnerable' ORDER BY {mapped('severity', fixed.SEVERITIES, '0')} DESC, confidence DESC, doc_id LIMIT 50")
def top50(spark, sf_dir):
    return metrics.top_vulnerable(_flat(spark, sf_dir), 50, F.col("doc_id")).select("chain_id", "severity", "confidence")


_LEVELS = ("source", "owner", "version")


@query(f"WITH {S.SCANS_SQL} SELECT source, owner, version, count(*) AS scans, CAST(sum(audited) AS BIGINT) AS audited, CAST(sum(vulnerable) AS BIGINT) AS vulnerable, CAST(3 - (grouping(source) + grouping(owner) + grouping(version)) AS INT) AS depth FROM scans GROUP BY ROLLUP (source, owner, version)")
def dashboard_rollup(spark, sf_dir):
    return metrics.totals(S.scans(spark, sf_dir), list(_LEVELS), ["audited", "vulnerable"])


@query(f"WITH {S.SCANS_SQL}, c AS (SELECT unnest(['R', 'A', 'N']) AS key, unnest([vulnerable, uncertain, safe]) AS n FROM scans) SELECT key, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY key")
def counter_merge(spark, sf_dir):
    rows = S.scans(spark, sf_dir).withColumn("counters", F.create_map(F.lit("R"), "vulnerable", F.lit("A"), "uncertain", F.lit("N"), "safe"))
    return metrics.merged_counters(rows, "counters")


@query(f"WITH {FULL_SQL}, {MARKS_SQL.replace('raw AS', 'raw_marks AS').replace('FROM raw)', 'FROM raw_marks)')}, v AS (SELECT coalesce(nullif(manual_verdict, ''), nullif(codex_verdict, '')) AS verdict FROM marks WHERE chain_id IN (SELECT chain_id FROM g WHERE verdict = 'vulnerable')), c AS (SELECT count(*) FILTER (verdict = 'true_positive') AS tp, count(*) FILTER (verdict = 'false_positive') AS fp, count(*) FILTER (verdict = 'uncertain') AS un FROM v), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + 7 > 0 THEN CAST(tp AS DOUBLE) / (tp + 7) END AS recall FROM c) SELECT tp AS true_positives, fp AS false_positives, un AS uncertain, CAST(7 AS BIGINT) AS missed, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM p")
def quality_prf(spark, sf_dir):
    return review.quality(_findings(spark, sf_dir).where("verdict = 'vulnerable'"), _marks(spark, sf_dir), 7)


@query("SELECT p_type, count(*) AS n, count(*) / sum(count(*)) OVER () * 100 AS share FROM part GROUP BY p_type")
def share_of_total(spark, sf_dir):
    return metrics.shares(S.table(spark, sf_dir, "part"), "p_type", F.count("*"))


_STATUSES = ["pending", "running", "done", "error", "stopped"]


@query(f"WITH {S.SCANS_SQL}, s AS (SELECT unnest({_STATUSES}) AS status) SELECT status, count(scans.status) AS n FROM s LEFT JOIN scans USING (status) GROUP BY status")
def status_counts(spark, sf_dir):
    return metrics.status_counts(S.scans(spark, sf_dir), _STATUSES)


@query(f"WITH {S.SCANS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY project_path ORDER BY day DESC, ord DESC) AS rn FROM scans) SELECT project_path, scan_id, day FROM f WHERE rn = 1")
def latest_by_day(spark, sf_dir):
    scans = S.scans(spark, sf_dir)
    best = scans.groupBy("project_path").agg(F.max(F.struct("day", "ord", "scan_id")).alias("x"))
    return best.select("project_path", "x.scan_id", "x.day")


# --- Extras that the audit platform itself doesn't have --------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, quantile_disc(event_id % 1000, 0.5) AS middle FROM events GROUP BY 1")
def extra_median(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").groupBy("event_type")
    return rows.agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id % 1000)").cast("long").alias("middle"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k")
def extra_sessions(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("began"), "n")


# --- Streams ---------------------------------------------------------------------------------------------------------


def _last_batch(spark, out):
    """In complete mode the last micro-batch holds the whole result."""
    batches = spark.read.option("basePath", out).parquet(out)
    return batches.where(F.col("batch") == batches.agg(F.max("batch")).first()[0]).drop("batch")


def _event_stream(spark, sf_dir):
    schema = S.table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(*(f"{e} AS {n}" for n, e in S.RUN.items()))


@query(f"WITH {S.RUN_SQL}, t AS (SELECT log AS agent, line, CASE type WHEN 'llm_error' THEN 'agent_error' ELSE type END AS type, elapsed FROM run), a AS (SELECT agent, max(line) FILTER (type = 'agent_start') AS started, max(line) FILTER (type = 'agent_end') AS ended, max(line) FILTER (type = 'agent_error') AS failed, count(*) FILTER (type = 'llm_request') AS requests FROM t GROUP BY agent) SELECT agent, CASE WHEN failed IS NOT NULL AND (started IS NULL OR failed > started) THEN 'error' WHEN ended IS NOT NULL AND (started IS NULL OR ended > started) THEN 'done' WHEN started IS NOT NULL THEN 'running' ELSE 'pending' END AS status, requests FROM a")
def stream_agent_state(spark, sf_dir):
    stream = _event_stream(spark, sf_dir).selectExpr("log AS agent", "line", "CASE type WHEN 'llm_error' THEN 'agent_error' ELSE type END AS type", "elapsed")
    out = scratch(spark, "states")
    streams.to_table(streams.agent_states(stream), out, scratch(spark, "states-log"), "complete").awaitTermination()
    return _last_batch(spark, out).select("agent", "status", "requests")


@query("SELECT CAST(ts AS DATE) AS day, CASE event_type WHEN 'signup' THEN 'llm_request' WHEN 'view' THEN 'llm_response' WHEN 'error' THEN 'llm_error' WHEN 'click' THEN 'agent_start' ELSE 'agent_end' END AS type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily(spark, sf_dir):
    out = scratch(spark, "days")
    streams.to_table(streams.daily(_event_stream(spark, sf_dir)), out, scratch(spark, "days-log"), "complete").awaitTermination()
    return _last_batch(spark, out).select("day", "type", "n")
