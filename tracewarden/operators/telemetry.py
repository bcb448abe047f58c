"""Run telemetry: rounds of a log, turns of a conversation, agent states, tokens, daily series.

Logs are partitioned by their name: order matters within a log only. What can be told by first, last, max or sum is
aggregated, which sums before it shuffles; only rounds need a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed


def rounds(events: DataFrame, log: str = "log", order: str = "line") -> DataFrame:
    """log, round, started, agent, n_requests, response, error: a round begins at each llm_request; the last response and
    error in it count; what comes before the first request is a round of its own. events(log, line, type, agent, text)."""
    rows = events.where(F.col("type").isin("llm_request", "llm_response", "llm_error"))
    number = F.sum(F.when(F.col("type") == "llm_request", 1).otherwise(0)).over(W.partitionBy(log).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    numbered = rows.withColumn("round", number)
    last = lambda kind: F.max_by(F.when(F.col("type") == kind, F.col("text")), F.when(F.col("type") == kind, F.col(order)))
    return numbered.groupBy(log, "round").agg(F.min(order).alias("started"), F.min_by("agent", order).alias("agent"), F.count_if(F.col("type") == "llm_request").alias("n_requests"), last("llm_response").alias("response"), last("llm_error").alias("error"))


def merged_turns(turns: DataFrame, keys: list[str], order: str = "line") -> DataFrame:
    """One row a turn: its status is the first one that isn't pending, its row the last with that status; a turn that is only
    pending keeps its last row. turns(keys, line, status, …)."""
    rest = [c for c in turns.columns if c not in keys]
    settled = F.col("status") != "pending"
    first = turns.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.min_by("status", F.when(settled, F.col(order))).alias("_first"), F.max(F.when(settled, 1).otherwise(0)).alias("_any"))
    status = F.when(F.col("_any") == 1, F.col("_first")).otherwise("pending")
    rows = turns.join(first.select(*keys, status.alias("_status")), keys).where(F.col("status") == F.col("_status"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def first_tokens(turns: DataFrame, keys: list[str], order: str = "line") -> DataFrame:
    """One row a turn: its first row with status ok or error, whose tokens count. turns(keys, line, status, prompt, completion)."""
    rest = [c for c in turns.columns if c not in keys]
    return turns.where(F.col("status").isin("ok", "error")).groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def tokens(turns: DataFrame, by: list[str]) -> DataFrame:
    return turns.groupBy(*by).agg(F.count("*").alias("turns"), F.sum(F.coalesce("prompt", F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce("completion", F.lit(0))).alias("completion_tokens"))


def agent_states(events: DataFrame, order: str = "line") -> DataFrame:
    """agent, status, started, ended, elapsed, requests: an error stays; else done after an end that follows the last start,
    else running; an agent with none of these is pending. events(agent, line, type, elapsed)."""
    at = lambda kind: F.max(F.when(F.col("type") == kind, F.col(order)))
    ends = F.when(F.col("type") == "agent_end", F.col(order))
    rows = events.groupBy("agent").agg(at("agent_start").alias("started"), at("agent_end").alias("ended"), at("agent_error").alias("failed"), F.max_by("elapsed", ends).alias("elapsed"), F.count_if(F.col("type") == "llm_request").alias("requests"))
    later = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) > F.col(b)))
    error = later("failed", "started")
    status = F.when(error, "error").when(later("ended", "started"), "done").when(F.col("started").isNotNull(), "running").otherwise("pending")
    return rows.select("agent", status.alias("status"), "started", "ended", "elapsed", "requests")


def average_elapsed(events: DataFrame) -> DataFrame:
    """agent, n, elapsed: the mean over its ends; null elapsed don't count."""
    return events.where("type = 'agent_end' and agent is not null and elapsed is not null").groupBy("agent").agg(F.count("*").alias("n"), F.avg("elapsed").alias("elapsed"))


def day(created: Column) -> Column:
    """The day as written, without any conversion of zones."""
    return F.coalesce(F.nullif(F.left(created, F.lit(10)), F.lit("")), F.lit("unknown"))


def daily(rows: DataFrame, day_col: str, measures: dict[str, Column], last: str, days: int) -> DataFrame:
    """One row for each of the last `days` days up to `last`, zero where nothing happened."""
    spine = rows.sparkSession.range(days).select(F.date_format(F.date_sub(F.lit(last).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias(day_col))
    sums = rows.groupBy(day_col).agg(*(c.alias(n) for n, c in measures.items()))
    return spine.join(sums, day_col, "left").select(day_col, *(F.coalesce(n, F.lit(0)).alias(n) for n in measures))


def turn_chain(messages: DataFrame) -> DataFrame:
    """conversation, chain_id that its first user message names; null if none. messages(conversation, place, role, text)."""
    first = messages.where("role = 'user'").groupBy("conversation").agg(F.min_by("text", "place").alias("text"))
    return first.select("conversation", F.nullif(F.regexp_extract("text", r"chain_id\s*:\s*(\S+)", 1), F.lit("")).alias("chain_id"))


def workflow(states: DataFrame, agents: list[str]) -> DataFrame:
    """The pipeline's nodes in order with the state of each agent and the one that comes before."""
    spark = states.sparkSession
    order = spark.createDataFrame([(i, a, agents[i - 1] if i else None) for i, a in enumerate(agents)], "place int, agent string, after string")
    return order.join(states, "agent", "left").select("place", "agent", "after", F.coalesce("status", F.lit("pending")).alias("status"))


def workflow_nodes(states: DataFrame, audited: DataFrame) -> DataFrame:
    """run, node, kind, status of the seven nodes of each run in states(run, agent, status): the pipeline, its four agents, the
    repository and the findings, which are done for the runs in audited(run). Agents that haven't been seen are pending."""
    named = [("pipeline", "pipeline"), *((a, "agent") for a in fixed.PIPELINE), ("repo", "input"), ("findings", "output")]
    seven = F.array(*(F.struct(F.lit(n).alias("node"), F.lit(k).alias("kind")) for n, k in named))
    every = states.select("run").distinct().select("run", F.explode(seven).alias("n")).select("run", "n.*")
    done = audited.select("run").distinct().withColumn("_done", F.lit(True))
    rows = every.join(states.select("run", F.col("agent").alias("node"), "status"), ["run", "node"], "left").join(done, "run", "left")
    status = F.when(F.col("kind") == "input", "ready").when(F.col("kind") == "output", F.when(F.col("_done"), "done").otherwise("pending")).otherwise(F.coalesce("status", F.lit("pending")))
    return rows.select("run", "node", "kind", status.alias("status"))


def workflow_edges(runs: DataFrame) -> DataFrame:
    """run, from_node, to_node, label of the five edges of each run."""
    edges = F.array(*(F.struct(F.lit(a).alias("from_node"), F.lit(b).alias("to_node"), F.lit(label).alias("label")) for a, b, label in fixed.WORKFLOW_EDGES))
    return runs.select("run").distinct().select("run", F.explode(edges).alias("e")).select("run", "e.*")
