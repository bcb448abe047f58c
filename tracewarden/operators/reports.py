"""The audit report and the dashboard as rows that sinks write: Markdown blocks in order, and heads of one JSON document each.

Blocks are rows (part, number, text): what grows with the input stays in rows, and only totals, which rule tables bound, meet in
one row. sinks.blocks writes them in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import verdicts
from . import metrics, packs

#: What a report calls verdicts, and how it orders severities.
LABELS = {"vulnerable": "Vulnerable", "uncertain": "Uncertain", "safe": "Safe"}
SEVERITY_ORDER = ("critical", "high", "medium", "low", "unknown")
TOP, TOP_TYPES, REFUTED_CHARS, TITLE_CHARS = 50, 15, 80, 80


def _or(column: str, otherwise: str = "?") -> Column:
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(otherwise))


def _place(file: str, line: str) -> Column:
    return F.concat(F.lit("`"), _or(file), F.lit(":"), _or(line), F.lit("`"))


def _cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("/"))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _chapter(title: str, body: Column) -> Column:
    """Null, which concat_ws leaves out, without a body."""
    return F.when(body != "", F.concat(F.lit(f"\n### {title}\n\n"), body))


def _points(items: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), "\n")


def _finding(total: Column) -> Column:
    """The whole section of a vulnerable or uncertain finding."""
    label = F.when(F.col("verdict") == "vulnerable", LABELS["vulnerable"]).otherwise(LABELS["uncertain"])
    sure = F.concat(F.format_number(F.coalesce("confidence", F.lit(0.0)) * 100, 0), F.lit("%"))
    told = F.transform("evidence", lambda e: F.concat(F.lit("["), F.coalesce(e["source"], F.lit("unknown")), F.lit("] "), F.coalesce(e["detail"], F.lit("")), F.coalesce(F.concat(F.lit(" ("), e["file"], F.lit(":"), F.coalesce(e["line"].cast("string"), F.lit("?")), F.lit(")")), F.lit(""))))
    body = lambda c: F.btrim(F.coalesce(F.col(c), F.lit("")), F.lit(" \t\r\n"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("## ["), F.col("number").cast("string"), F.lit("/"), total.cast("string"), F.lit("] ["), label, F.lit("] "), _or("title")),
        F.lit("\n| Field | Content |\n|---|---|"),
        _row(F.lit("Verdict"), F.concat(F.lit("**"), label, F.lit("** (confidence "), sure, F.lit(")"))),
        _row(F.lit("CWE"), _or("cwe")), _row(F.lit("Severity"), F.upper(_or("severity", "medium"))), _row(F.lit("Type"), _or("vulnerability_type")), _row(F.lit("Sink"), _place("sink_file", "sink_line")),
        F.when(_or("source_file") != "?", _row(F.lit("Source"), _place("source_file", "source_line"))),
        _chapter("Principle", body("principle")), _chapter("Data flow", _points(F.col("data_flow"))), _chapter("Proof of concept", body("poc")), _chapter("Fix", body("fix")),
        _chapter("Refuted by", F.when(_or("refuted_by") != "?", F.concat(F.lit("```\n"), F.col("refuted_by"), F.lit("\n```")))),
        _chapter("Missing", _points(F.col("missing"))), _chapter("Evidence", _points(told)),
    )


def audit_blocks(findings: DataFrame, project: str, order: list[Column], folder: str, target: str | None = None) -> DataFrame:
    """part, number, text of the report over findings: its head with counts, a line for each vulnerable or uncertain finding, a
    section for each of them, and a table of the safe ones. Numbers run from 1 in the given order among findings shown alike;
    findings of another verdict are counted only. findings(verdict, title, severity, cwe, vulnerability_type, sink_file, sink_line,
    source_file, source_line, confidence, principle, data_flow, poc, fix, refuted_by, missing, evidence)."""
    count = lambda *v: F.count_if(F.col("verdict").isin(*v))
    totals = findings.agg(F.count("*").alias("_all"), *(count(v).alias(f"_{v}") for v in LABELS))
    shown = F.col("verdict").isin("vulnerable", "uncertain")
    rows = packs.ranks(findings.where(F.col("verdict").isin(*LABELS)), [~shown, *order], "_rank", folder).join(F.broadcast(totals), how="cross")  # one row
    headlines = F.col("_vulnerable") + F.col("_uncertain")
    rows = rows.withColumn("number", F.when(shown, F.col("_rank")).otherwise(F.col("_rank") - headlines))
    label = F.when(F.col("verdict") == "vulnerable", LABELS["vulnerable"]).otherwise(LABELS["uncertain"])
    point = F.concat(F.lit("- **"), label, F.lit("** "), _place("sink_file", "sink_line"), F.lit(": "), _or("title"))
    refuted = F.btrim(F.regexp_replace(F.coalesce("refuted_by", F.lit("")), r"\s+", " "))
    short = F.when(F.length(refuted) > REFUTED_CHARS, F.concat(F.left(refuted, F.lit(REFUTED_CHARS - 3)), F.lit("..."))).otherwise(refuted)
    safe = _row(F.col("number").cast("string"), _or("vulnerability_type"), _place("sink_file", "sink_line"), _cell(_or("title")), _cell(short))
    block = lambda part, text: F.struct(F.lit(part).alias("part"), "number", text.alias("text"))
    blocks = F.when(shown, F.array(block(1, point), block(2, F.concat(F.lit("\n"), _finding(headlines))))).otherwise(F.array(block(4, safe)))
    where = F.concat(F.lit(f"\n\n**Project**: `{project}`"), F.lit(f"\n**Target**: `{target}`" if target else ""))
    counts = F.concat(F.lit("\n**Summary**: "), F.col("_all").cast("string"), F.lit(" chains audited"), *(x for v in LABELS for x in (F.lit(", "), F.col(f"_{v}").cast("string"), F.lit(f" {v}"))), F.lit("\n\n## Headlines\n"))
    none = F.when(headlines == 0, F.lit("\nNothing is exploitable, and nothing needs more context.")).otherwise("")
    head = F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("number"), F.concat(F.lit("# Audit report"), where, counts, none).alias("text"))
    tail = F.struct(F.lit(3).alias("part"), F.lit(0).cast("long").alias("number"), F.concat(F.lit("\n## Safe\n\n"), F.col("_safe").cast("string"), F.lit(" findings are safe; findings.jsonl holds them whole.\n\n| # | Type | Sink | Title | Refuted by |\n|---|---|---|---|---|")).alias("text"))
    ends = totals.select(F.explode(F.when(F.col("_safe") > 0, F.array(head, tail)).otherwise(F.array(head))).alias("b"))
    return rows.select(F.explode(blocks).alias("b")).unionByName(ends).select("b.*")


def _map(rows: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """One row with one map, of keys that a rule table bounds."""
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), value.alias("v"))))).alias(out))


def _beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.join(other, how="cross")  # one row each
    return first


def audit_head(findings: DataFrame, partial: bool = False) -> DataFrame:
    """One row, the audit without its findings: status, counts by verdict, and of the vulnerable ones by severity and type."""
    counts = findings.agg(F.count("*").alias("total_audited"), *(F.count_if(F.col("verdict") == v).alias(v) for v in LABELS))
    bad = findings.where("verdict = 'vulnerable'")
    by = lambda c, out: _map(bad.groupBy(_or(c, "unknown").alias("k")).agg(F.count("*").alias("n")), "k", F.col("n"), out)
    rows = _beside(counts, by("severity", "by_severity"), by("vulnerability_type", "by_vulnerability"))
    return rows.select(metrics.audit_status(F.col("total_audited"), F.lit(partial)).alias("status"), F.struct("total_audited", *LABELS, "by_severity", "by_vulnerability", F.lit(partial).alias("checkpoint")).alias("summary"))


def of_selected(findings: DataFrame, scans: DataFrame, strategy: str) -> DataFrame:
    """Findings of the scans that a strategy selects, with flat fields; a finding names its project_path and scan_id."""
    chosen = metrics.selected(scans, strategy).select(*metrics.SCAN)
    return metrics.flat(findings.join(chosen, metrics.SCAN, "left_semi"))


def repositories(scans: DataFrame) -> DataFrame:
    """Of each project its newest audited scan, the number of its scans and the one with the most vulnerable findings."""
    shown = ("files", "sink_hits", "candidate_chains", "audited", "vulnerable", "uncertain", "safe")
    latest = metrics.latest(scans).select("project_path", F.col("scan_id").alias("latest_scan_id"), "primary_language", *shown)
    return latest.join(metrics.best_scan(scans), "project_path")


def dashboard(scans: DataFrame, findings: DataFrame, strategy: str = "latest", *ties: Column) -> DataFrame:
    """One row: strategy, coverage, funnel, by_severity, by_type, by_language, top_vulnerable. Repositories, weaknesses with their
    repositories, scans and findings grow with the input and are files of their own. scans needs languages (array) beside the
    measures, findings project_path and scan_id."""
    return board_of(scans, metrics.selected(scans, strategy), of_selected(findings, scans, strategy), strategy, *ties)


def board_of(scans: DataFrame, chosen: DataFrame, rows: DataFrame, strategy: str, *ties: Column) -> DataFrame:
    """`dashboard` of scans that are selected and of their flat findings, which it reads several times: they may be stored."""
    covered = _coverage(scans, chosen, rows)
    funnel = metrics.funnel(chosen).select(F.struct("*").alias("funnel"))
    types = metrics.by_type(rows)
    top = metrics.top_vulnerable(rows, TOP, *ties).select(F.struct("severity", "confidence", "cwe", "vulnerability_type", "language", "title", "sink_file", "sink_line").alias("t"), verdicts.severity_rank(F.col("severity")).alias("r"), *(c.alias(f"_tie{i}") for i, c in enumerate(ties)))
    key = F.struct((-F.col("r")).alias("r"), (-F.coalesce("t.confidence", F.lit(0.0))).alias("c"), *(F.col(f"_tie{i}") for i in range(len(ties))))
    listed = top.agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("t")))), lambda x: x["t"]).alias("top_vulnerable"))
    return _beside(
        covered.select(F.lit(strategy).alias("strategy"), F.struct("*").alias("coverage")), funnel,
        _map(metrics.by_severity(rows), "severity", F.col("n"), "by_severity"), _map(types, "vulnerability_type", F.struct("total", "vulnerable"), "by_type"),
        _map(metrics.by_language(rows), "language", F.struct("total", *LABELS), "by_language"), listed,
    )


def _coverage(scans: DataFrame, chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts of all scans, languages of the selected ones, weaknesses and types of their findings."""
    counted = metrics.coverage(scans).drop("languages", "languages_count")
    spoken = metrics.coverage(chosen).select("languages", "languages_count")
    kinds = rows.agg(F.count_distinct("cwe").alias("cwes"), F.count_distinct("vulnerability_type").alias("types"))
    return _beside(counted, spoken, kinds)


def _number(value: Column) -> Column:
    return F.format_number(value, 0)


def _rate(value: Column) -> Column:
    return F.coalesce(F.format_string("%.2f%%", value * 100), F.lit("-"))


def dashboard_blocks(board: DataFrame, repositories: DataFrame, weaknesses: DataFrame) -> DataFrame:
    """part, number, text of the dashboard in Markdown. board is one row of `dashboard`; weaknesses(cwe, total, vulnerable, repos)
    and repositories are tables whose lines stand in binary order of their keys."""
    lines = lambda a: F.array_join(a, "\n")
    table = lambda title, head: F.lit(f"\n## {title}\n\n{head}\n|{'---|' * (head.count('|') - 1)}")
    cover = F.array(*(_row(F.lit(name), F.col(f"coverage.{c}").cast("string")) for name, c in (("Repositories", "repos_total"), ("Scans", "scans_total"), ("Audited scans", "scans_with_audit"), ("Languages", "languages"), ("Weaknesses", "cwes"), ("Types", "types"))))
    steps = (("Files", "files", None), ("Raw hits", "rg_raw", "rg_kept_ratio"), ("Sink hits", "sink_hits", "sink_per_file"), ("Candidate chains", "candidate_chains", "chain_per_sink"), ("With a call chain", "with_call_chain", "with_chain_ratio"), ("Audited", "audited", "audit_per_chain"), ("Vulnerable", "vulnerable", "vuln_per_audit"), ("Uncertain", "uncertain", None), ("Safe", "safe", None))
    funnel = F.array(*(_row(F.lit(name), _number(F.col(f"funnel.{c}")), _rate(F.col(f"funnel.{r}")) if r else F.lit("")) for name, c, r in steps))
    spoken = F.transform(F.map_entries("by_language"), lambda e: _row(e["key"], *(e["value"][c].cast("string") for c in ("total", *LABELS))))
    severe = F.filter(F.array(*(F.when(F.map_contains_key("by_severity", s), _row(F.lit(s), F.col("by_severity")[s].cast("string"))) for s in SEVERITY_ORDER)), lambda x: x.isNotNull())
    by_count = F.array_sort(F.transform(F.map_entries("by_type"), lambda e: F.struct((-e["value"]["total"]).alias("o"), e["key"].alias("key"), e["value"].alias("v"))))
    types = F.transform(F.slice(by_count, 1, TOP_TYPES), lambda e: _row(e["key"], e["v"]["total"].cast("string"), e["v"]["vulnerable"].cast("string")))
    place = lambda t: F.concat(F.lit("`"), F.coalesce(t["sink_file"], F.lit("-")), F.lit(":"), F.coalesce(t["sink_line"].cast("string"), F.lit("")), F.lit("`"))
    top = F.transform("top_vulnerable", lambda t, i: _row((i + 1).cast("string"), t["severity"], t["cwe"], t["vulnerability_type"], t["language"], F.coalesce(F.format_string("%.2f", t["confidence"]), F.lit("-")), F.left(_cell(F.coalesce(t["title"], F.lit(""))), F.lit(TITLE_CHARS)), place(t)))
    parts = [
        (0, F.concat(F.lit("# Dashboard\n\nStrategy: "), F.col("strategy"))),
        (1, F.concat(table("Coverage", "| What | Number |"), F.lit("\n"), lines(cover))),
        (2, F.concat(table("Funnel", "| Step | Number | Rate |"), F.lit("\n"), lines(funnel), F.lit("\n\nOf candidates vulnerable: "), _rate(F.col("funnel.vuln_per_candidate")))),
        (3, F.concat_ws("\n", table("Languages", "| Language | Audited | Vulnerable | Uncertain | Safe |"), F.nullif(lines(spoken), F.lit("")))),
        (4, table("Weaknesses", "| CWE | Found | Vulnerable | Repositories |")),
        (6, F.concat_ws("\n", table("Severities of the vulnerable", "| Severity | Number |"), F.nullif(lines(severe), F.lit("")))),
        (7, F.concat_ws("\n", table("Types", "| Type | Found | Vulnerable |"), F.nullif(lines(types), F.lit("")))),
        (8, table("Repositories", "| Repository | Language | Files | Sinks | Chains | Audited | Vulnerable | Uncertain | Safe | Scans |")),
        (10, F.when(F.size("top_vulnerable") > 0, F.concat(table("Vulnerable findings", "| # | Severity | CWE | Type | Language | Confidence | Title | Sink |"), F.lit("\n"), lines(top)))),
    ]
    fixed = board.select(F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit("").alias("key"), t.alias("text")) for p, t in parts))).alias("b")).select("b.*").where("text is not null")
    weak = weaknesses.select(F.lit(5).alias("part"), F.col("cwe").alias("key"), _row(F.col("cwe"), F.col("total").cast("string"), F.col("vulnerable").cast("string"), F.coalesce(F.nullif("repos", F.lit("")), F.lit("-"))).alias("text"))
    measures = (_number(F.col(c)) for c in ("files", "sink_hits", "candidate_chains", "audited", "vulnerable", "uncertain", "safe"))
    own = repositories.select(F.lit(9).alias("part"), F.col("project_path").alias("key"), _row(F.col("project_path"), F.coalesce("primary_language", F.lit("-")), *measures, F.col("scan_count").cast("string")).alias("text"))
    return fixed.unionByName(weak).unionByName(own)
