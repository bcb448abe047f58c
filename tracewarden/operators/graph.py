"""The data-flow graph of facts: nodes (request sources, storage fields, sinks), edges from sources to storage, and counts.

Facts are those of operators.facts: writes with evidence and source_line, sinks with sink_function. What many facts name, as
a storage field, is one node: its last place by file and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import flow
from ..functions.text import trimmed
from ..sources import sinks

SOURCE, STORAGE, SINK = "request_source", "storage_field", "sink"


def _node_id(kind: str, line: Column) -> Column:
    return flow.stable_id(f"{kind}:", 16, F.lit(kind), F.col("file"), line.cast("string"), trimmed(F.col("evidence")))


def nodes(facts: DataFrame) -> DataFrame:
    """node_id, kind, file, line, label, field: of each write a source and a storage field, of each sink a sink and a storage
    field. Fields are summed before they shuffle."""
    storage = F.struct(flow.storage_id(F.col("kind"), F.col("field")).alias("node_id"), F.lit(STORAGE).alias("kind"), F.col("line"), flow.storage_label(F.col("kind"), F.col("field")).alias("label"), F.col("field"))
    source = F.struct(_node_id(SOURCE, F.col("line")).alias("node_id"), F.lit(SOURCE).alias("kind"), F.col("line"), F.lit("request input").alias("label"), F.lit(None).cast("string").alias("field"))
    sink = F.struct(_node_id(SINK, F.col("line")).alias("node_id"), F.lit(SINK).alias("kind"), F.col("line"), F.col("sink_function").alias("label"), F.col("field"))
    rows = facts.select("file", F.explode(F.when(F.col("role") == "write", F.array(source, storage)).when(F.col("role") == "sink", F.array(sink, storage))).alias("n")).select("file", "n.*")
    last = F.max_by(F.struct("kind", "file", "line", "label", "field"), F.struct("file", "line"))
    return rows.groupBy("node_id").agg(last.alias("n")).select("node_id", "n.*")


def edges(facts: DataFrame) -> DataFrame:
    """edge_id, source_id, target_id, kind, file, line: from the source of each write to its storage field."""
    ends = facts.where("role = 'write'").select(_node_id(SOURCE, F.col("line")).alias("source_id"), flow.storage_id(F.col("kind"), F.col("field")).alias("target_id"), F.lit("source_to_write").alias("kind"), "file", "line")
    own = flow.stable_id("", 16, F.col("kind"), F.col("source_id"), F.col("target_id"), F.col("file"), F.col("line").cast("string"))
    return ends.distinct().select(own.alias("edge_id"), "source_id", "target_id", "kind", "file", "line")


def order(key: str) -> list[Column]:
    """How nodes and edges are written: by file, line and id."""
    return [F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), F.col(key)]


def summary(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """measure, key, n: nodes and edges by kind, writes by the kind of their storage."""
    counted = lambda rows, measure: rows.groupBy(F.lit(measure).alias("measure"), F.coalesce("kind", F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"))
    return counted(nodes, "node").unionByName(counted(edges, "edge")).unionByName(counted(facts.where("role = 'write'"), "storage"))


def written(facts: DataFrame, folder: str) -> None:
    """Writes nodes.jsonl and edges.jsonl in order, and summary.json with the counts of their kinds, below folder."""
    found, joined = nodes(facts), edges(facts)
    sinks.json_lines(found, f"{folder}/nodes.jsonl", order("node_id"))
    sinks.json_lines(joined, f"{folder}/edges.jsonl", order("edge_id"))
    counts = summary(found, joined, facts).agg(F.array_sort(F.collect_list(F.struct("measure", "key", "n"))).alias("counts"))
    sinks.document(counts, f"{folder}/summary.json")
