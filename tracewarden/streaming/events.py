"""Structured Streaming forms of the telemetry: state of agents, daily counts, rounds, log lines, due scans."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "log string, line long, ts timestamp, type string, agent string, elapsed double, text string"


def events(spark: SparkSession, path: str, schema: T.StructType | str = EVENT, files_a_trigger: int = 1_000) -> DataFrame:
    """Appended JSON-lines event logs; lines that aren't events have only nulls and are dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).json(path).where("type is not null")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def agent_states(stream: DataFrame) -> DataFrame:
    """The same aggregation as the batch form, in update mode; one row of state for each agent."""
    from ..operators.telemetry import agent_states as batch

    return batch(stream)


def daily(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Events a day and type; rows that come later than `late` are dropped and finished days leave the state."""
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "type").agg(F.count("*").alias("n"))
    return days.select(F.to_date("w.start").alias("day"), "type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extra beyond batch: runs of an agent's events without a longer gap."""
    found = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "agent").agg(F.count("*").alias("n"))
    return found.select("agent", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def due(scans: DataFrame, now) -> DataFrame:
    """Waiting scans whose time has come; times without a zone are local."""
    at = F.try_to_timestamp("scheduled_at")
    return scans.where(F.col("status").isin("pending", "stopped") & (at <= now)).withColumn("scheduled_at", F.lit(None).cast("string"))


def claim(scans: DataFrame, claims: str, batch: int, now) -> None:
    """One tick: what is due (see due) and in no other tick's claims goes to claims/batch=n, whole or not at all. A tick that runs
    again overwrites its own claims, so no scan is claimed twice."""
    spark = scans.sparkSession
    spark.createDataFrame([], "scan_id string").write.mode("append").parquet(f"{claims}/batch=-1")  # so that there is something to read
    taken = spark.read.schema("scan_id string, batch long").option("basePath", claims).parquet(claims).where(F.col("batch") != batch)
    due(scans, now).select(F.col("scan_id").cast("string").alias("scan_id")).distinct().join(taken, "scan_id", "left_anti").write.mode("overwrite").parquet(f"{claims}/batch={batch}")


def schedule(spark: SparkSession, scans: Callable[[], DataFrame], claims: str, checkpoint: str, every: str = "15 seconds") -> StreamingQuery:
    """Claims due scans at every tick of a processing-time trigger; a restart goes on with the tick that wasn't finished."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    batch = lambda _, n: claim(scans(), claims, n, F.current_timestamp())
    return ticks.writeStream.trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(batch).start()


_RUN_STATE = "seen long, expected long, status string, ended boolean"
_RUN_RECORD = "run string, type string, data string"


def _until_end(wait_ms: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, expected, status, ended = state.get if state.exists else (0, -1, "", False)
        if not state.hasTimedOut:
            for part in parts:
                lines, last = part[part["n_lines"].isna()], part[part["n_lines"].notna()]
                seen += len(lines)
                if len(last):
                    expected, status = int(last["n_lines"].iloc[-1]), last["value"].iloc[-1]
                if len(lines):
                    yield pd.DataFrame({"run": key[0], "type": "line", "data": lines["value"]})
        if not ended and expected >= 0 and (seen >= expected or state.hasTimedOut):
            ended = True
            yield pd.DataFrame({"run": [key[0]], "type": ["end"], "data": [status]})
        state.update((seen, expected, status, ended))
        if expected >= 0 and not ended:
            state.setTimeoutDuration(wait_ms)

    return run


def followed(lines: DataFrame, ends: DataFrame, wait_ms: int = 60_000) -> DataFrame:
    """run, type, data as a subscriber gets them: the lines(run, value) of each run, those that are there and those that come, and once, behind
    them, its status. ends(run, status, n_lines) says how many lines a run has written; if they don't come within wait_ms, it ends without them."""
    both = lines.select("run", "value", F.lit(None).cast("long").alias("n_lines")).unionByName(ends.select("run", F.col("status").alias("value"), "n_lines"))
    return both.groupBy("run").applyInPandasWithState(_until_end(wait_ms), _RUN_RECORD, _RUN_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", prepare: Callable[[DataFrame], DataFrame] | None = None, every: str | None = None) -> StreamingQuery:
    """Writes a stream: append as Parquet exactly once; update and complete by whole micro-batches under path/batch=n, which
    a rerun batch overwrites. Without `every` it processes what is there and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if mode == "append" and prepare is None:
        return writer.format("parquet").start(path)

    def batch(df: DataFrame, n: int) -> None:
        (prepare(df) if prepare else df).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return writer.foreachBatch(batch).start()


def with_end(lines: DataFrame, status: str) -> DataFrame:
    """Lines of a run that has ended, and a last record with its status, as a subscriber gets them: type, data."""
    end = lines.sparkSession.range(1).select(F.lit("end").alias("type"), F.lit(status).alias("data"))
    return lines.select(F.lit("line").alias("type"), F.col("value").alias("data")).unionByName(end)


class Heartbeats(StreamingQueryListener):
    """Tells `beat` of each micro-batch (query id, batch, rows) and, every ten seconds, of an idle query (batch and rows None).
    ended is set once a query has terminated."""

    def __init__(self, beat: Callable[[str, int | None, int | None], None]):
        self.beat, self.ended = beat, threading.Event()

    def onQueryStarted(self, event) -> None:
        self.beat(str(event.id), None, None)

    def onQueryProgress(self, event) -> None:
        self.beat(str(event.progress.id), event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.beat(str(event.id), None, None)

    def onQueryTerminated(self, event) -> None:
        self.ended.set()
