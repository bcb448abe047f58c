"""Writers: sorted JSON lines, CSV funnel, Markdown reports, append-only progress and version history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FUNNEL_COLUMNS = ("project_path", "scan_id", "status", "primary_language", "files", "sink_hits", "candidate_chains", "audited", "vulnerable", "uncertain", "safe", "duration_seconds")


def json_lines(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """Globally sorted part files: reading them in name order gives the order, and no task holds everything."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.write.mode("overwrite").json(path)


def with_meta(chains: DataFrame, meta: Column, path: str, order: list[Column]) -> None:
    """JSON lines whose first file holds one meta line."""
    json_lines(chains, path, order)
    chains.sparkSession.range(1).select(meta.alias("meta")).select("meta.*").coalesce(1).write.mode("append").json(f"{path}/_meta")


def chain_files(records: DataFrame, section: Column, folder: str) -> None:
    """Chain records by index as JSON lines, again under the name that older readers know, and as Markdown sections."""
    ordered = records.withColumn("_section", section).repartitionByRange("index").sortWithinPartitions("index")
    for name in ("chains.jsonl", "chains.priority.jsonl"):
        ordered.drop("_section").write.mode("overwrite").json(f"{folder}/{name}")
    ordered.select("_section").write.mode("overwrite").text(f"{folder}/chains.md")


def funnel_csv(rows: DataFrame, path: str) -> None:
    """The twelve funnel columns only, whatever else the rows hold."""
    rows.select(*FUNNEL_COLUMNS).write.mode("overwrite").csv(path, header=True)


def blocks(rows: DataFrame, path: str, *order: str) -> None:
    """Texts in order, as part files whose names sort as their contents do."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.mode("overwrite").text(path)


def document(row: DataFrame, path: str) -> None:
    """One row as one JSON document."""
    row.coalesce(1).write.mode("overwrite").json(path)


def audit_files(head: DataFrame, findings: DataFrame, order: list[Column], sections: DataFrame, folder: str) -> None:
    """audit.json without its findings, findings.jsonl in order, and the report in Markdown."""
    document(head, f"{folder}/audit.json")
    json_lines(findings, f"{folder}/findings.jsonl", order)
    blocks(sections, f"{folder}/audit.md", "part", "number")


def dashboard_files(board: DataFrame, repositories: DataFrame, weaknesses: DataFrame, scans: DataFrame, findings: DataFrame, sections: DataFrame, folder: str) -> None:
    """dashboard.json (what is bounded), repositories, weaknesses and findings as JSON lines, funnel.csv and dashboard.md."""
    document(board, f"{folder}/dashboard.json")
    json_lines(repositories, f"{folder}/repositories.jsonl", [F.col("project_path")])
    json_lines(weaknesses, f"{folder}/weaknesses.jsonl", [F.col("cwe")])
    json_lines(findings, f"{folder}/findings.jsonl", [F.col(c) for c in ("project_path", "scan_id", "chain_id")])
    funnel_csv(scans.repartitionByRange("project_path", "scan_id").sortWithinPartitions("project_path", "scan_id"), f"{folder}/funnel.csv")
    blocks(sections, f"{folder}/dashboard.md", "part", "key")


def report(findings: DataFrame, number: str, total: Column) -> DataFrame:
    """Markdown section of each finding: full for vulnerable and uncertain ones, a line for safe ones."""
    head = F.concat(F.lit("## ["), F.col(number).cast("string"), F.lit("/"), total.cast("string"), F.lit("] "), F.col("title"))
    line = lambda label, c: F.concat(F.lit(f"- {label}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    full = F.concat_ws("\n", head, line("verdict", "verdict"), line("confidence", "confidence"), line("severity", "severity"), line("chain", "chain_id"), F.lit(""), F.col("principle"))
    short = F.concat_ws("\n", head, line("verdict", "verdict"), line("chain", "chain_id"))
    return findings.select("chain_id", F.col(number), F.when(F.col("verdict") == "safe", short).otherwise(full).alias("section"))


def append(rows: DataFrame, path: str) -> None:
    """Progress, failures and events: part files are added whole or not at all, so a rerun task writes nothing twice."""
    rows.write.mode("append").json(path)


def next_versions(history: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows to append to a history (target, version, …) for each changed target: one version more than its last."""
    last = history.groupBy("target").agg(F.max("version").alias("_last"))
    return changed.join(last, "target", "left").withColumn("version", F.coalesce("_last", F.lit(0)) + 1).drop("_last")
