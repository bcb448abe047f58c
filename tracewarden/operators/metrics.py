"""Reports over scans and findings: latest scans, funnel, breakdowns, coverage, dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import verdicts

RATES = {
    "sink_per_file": ("sink_hits", "files"),
    "rg_kept_ratio": ("sink_hits", "rg_raw"),
    "chain_per_sink": ("candidate_chains", "sink_hits"),
    "with_chain_ratio": ("with_call_chain", "candidate_chains"),
    "audit_per_chain": ("audited", "candidate_chains"),
    "vuln_per_audit": ("vulnerable", "audited"),
    "vuln_per_candidate": ("vulnerable", "candidate_chains"),
}
MEASURES = ("files", "rg_raw", "sink_hits", "candidate_chains", "with_call_chain", "audited", "vulnerable", "uncertain", "safe", "filtered_by_comment", "filtered_by_dynamic", "filtered_by_extra", "kept", "dedup_dropped")
SCAN = ["project_path", "scan_id"]


def latest(scans: DataFrame) -> DataFrame:
    """The newest audited scan of each project, else its newest: scan ids sort by time."""
    rest = [c for c in scans.columns if c != "project_path"]
    best = scans.groupBy("project_path").agg(F.max_by(F.struct(*rest), F.struct(F.col("has_audit"), F.col("scan_id"))).alias("x"))
    return best.select("project_path", "x.*")


def selected(scans: DataFrame, strategy: str = "latest") -> DataFrame:
    """The scans that reports sum: `latest` takes one of each project, `union` all."""
    if strategy not in ("latest", "union"):
        raise ValueError(f"no strategy {strategy!r}")
    return latest(scans) if strategy == "latest" else scans


def best_scan(scans: DataFrame) -> DataFrame:
    """For each project its number of scans and the first scan with the most vulnerable findings."""
    best = F.max_by(F.struct("scan_id", "vulnerable"), F.struct("vulnerable", (-F.col("ord")).alias("o"))).alias("b")
    return scans.groupBy("project_path").agg(F.count("*").alias("scan_count"), best).select("project_path", "scan_count", F.col("b.scan_id").alias("best_scan_id"), F.col("b.vulnerable").alias("best_vulnerable"))


def funnel(scans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of the measures and their rates, to four digits half to even, null where nothing is divided by."""
    sums = scans.groupBy(*(by or [])).agg(*(F.sum(F.coalesce(m, F.lit(0))).cast("long").alias(m) for m in MEASURES))
    return sums.withColumns({name: F.bround(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 4) for name, (a, b) in RATES.items()})


def flat(findings: DataFrame) -> DataFrame:
    """Findings with lower or upper case keys and names for missing ones."""
    low = lambda c: F.coalesce(F.nullif(F.lower(F.col(c)), F.lit("")), F.lit("unknown"))
    return findings.withColumns({"verdict": F.lower(F.coalesce("verdict", F.lit(""))), "cwe": F.coalesce(F.nullif(F.upper("cwe"), F.lit("")), F.lit("UNKNOWN")), "severity": low("severity"), "vulnerability_type": low("vulnerability_type"), "language": low("language")})


def by_cwe(findings: DataFrame) -> DataFrame:
    """cwe, total, vulnerable, repos (sorted, joined by commas). Repos are made distinct before they are gathered."""
    repos = findings.select("cwe", "repo").distinct().groupBy("cwe").agg(F.array_join(F.array_sort(F.collect_list("repo")), ",").alias("repos"))
    return findings.groupBy("cwe").agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "vulnerable").alias("vulnerable")).join(repos, "cwe", "left")


def by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("vulnerability_type").agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "vulnerable").alias("vulnerable"))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.where("verdict = 'vulnerable'").groupBy("severity").agg(F.count("*").alias("n"))


def by_language(findings: DataFrame) -> DataFrame:
    """language, total and a column for each verdict."""
    return findings.groupBy("language").agg(F.count("*").alias("total"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("vulnerable", "uncertain", "safe")))


def coverage(scans: DataFrame) -> DataFrame:
    """One row: projects, scans, audited scans, languages. languages is an array column of scans."""
    spoken = scans.select(F.explode("languages").alias("l")).distinct().agg(F.array_join(F.array_sort(F.collect_list("l")), ",").alias("languages"), F.count("*").alias("languages_count"))
    totals = scans.select("project_path", "has_audit").groupBy("project_path").agg(F.count("*").alias("n"), F.count_if("has_audit").alias("a")).agg(F.count("*").alias("repos_total"), F.sum("n").alias("scans_total"), F.sum("a").alias("scans_with_audit"))
    return totals.join(spoken, how="cross")  # one row each


def top_vulnerable(findings: DataFrame, n: int = 50, *ties: Column) -> DataFrame:
    return findings.where("verdict = 'vulnerable'").orderBy(verdicts.severity_rank(F.col("severity")).desc(), F.coalesce("confidence", F.lit(0.0)).desc(), *ties).limit(n)


def totals(scans: DataFrame, levels: list[str], measures: list[str]) -> DataFrame:
    """Counts and sums at every level of a hierarchy and overall; null stands for all of a level, depth says how deep."""
    depth = F.lit(len(levels)) - sum((F.grouping(c).cast("int") for c in levels), F.lit(0))
    return scans.rollup(*levels).agg(F.count("*").alias("scans"), *(F.sum(m).alias(m) for m in measures), depth.cast("int").alias("depth"))


def merged_counters(rows: DataFrame, counters: str) -> DataFrame:
    """key, n: the sums of map columns."""
    return rows.select(F.explode(counters).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))


def shares(rows: DataFrame, key: str, value: Column, top: int | None = None) -> DataFrame:
    """key, n, share of all in percent, largest first. Only sums meet in one place."""
    sums = rows.groupBy(key).agg(value.alias("n"))
    whole = sums.agg(F.sum("n").alias("_all"))
    out = sums.join(F.broadcast(whole), how="cross").select(key, "n", (F.col("n") / F.col("_all") * 100).alias("share"))
    return out.orderBy(F.col("n").desc(), key).limit(top) if top else out


def status_counts(rows: DataFrame, statuses: list[str], column: str = "status") -> DataFrame:
    """A row for each status, zero where none has it."""
    known = rows.sparkSession.createDataFrame([(s,) for s in statuses], f"{column} string")
    return known.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def scan_records(scans: DataFrame, trees: DataFrame, tree_agents: DataFrame, call_agents: DataFrame, audits: DataFrame) -> DataFrame:
    """One row for each of scans(project_path, scan_id, …) with what its five files say, none of which must be there. trees(files),
    tree_agents(project_type, backend, frontend, runtime: arrays), call_agents(sink_hits, candidate_chains, with_call_chain, languages),
    audits(audited, vulnerable, uncertain, safe, llm_failed), each with project_path and scan_id, at most once a scan. All joins
    have one key, so that each side shuffles once. languages: those of the stack, then others of the call agent."""
    none = F.array().cast("array<string>")
    named = lambda c: F.filter(F.transform(F.coalesce(c, none), lambda x: F.lower(F.btrim(x))), lambda x: x != "")
    sides = [("tree", trees, ("files",)), ("treescan", tree_agents, ("project_type", "backend", "frontend", "runtime")), ("callscan", call_agents, ("sink_hits", "candidate_chains", "with_call_chain", "languages")), ("audit", audits, ("audited", "vulnerable", "uncertain", "safe", "llm_failed"))]
    rows = scans
    for name, side, columns in sides:
        rows = rows.join(side.select(*SCAN, F.struct(*columns).alias(f"_{name}")), SCAN, "left")
    numbers = {c: F.coalesce(F.col(f"_{name}.{c}"), F.lit(0)).cast("long") for name, _, columns in sides if name != "treescan" for c in columns if c != "languages"}
    stack = [named(F.col(f"_treescan.{c}")) for c in ("backend", "frontend", "runtime")]
    has = {f"has_{name}": F.col(f"_{name}").isNotNull() for name, _, _ in sides if name != "tree"}
    languages = F.array_distinct(F.concat(*stack, named(F.col("_callscan.languages"))))
    primary = F.nullif(F.lower(F.btrim(F.get("_treescan.backend", F.lit(0)))), F.lit(""))
    return rows.select(*scans.columns, *(c.alias(n) for n, c in (has | numbers).items()), F.col("_treescan.project_type").alias("project_type"), languages.alias("languages"), primary.alias("primary_language"))


def call_status(chains: Column, skipped: Column) -> Column:
    """Of the call scan: whether it found chains or, if not, skipped rules."""
    return F.when(chains > 0, "ok").when(skipped > 0, "no_sinks").otherwise("partial")


def flow_status(bridged: Column, recovered: Column) -> Column:
    """Of the data-flow scan, by its cross-request chains and its partial ones."""
    return F.when(bridged > 0, "ok").when(recovered > 0, "partial_only").otherwise("no_cross_request_chains")


def audit_status(findings: Column, partial: Column) -> Column:
    """Of the audit, by its findings and whether it was cut short."""
    return F.when(findings == 0, "no_auditable_chains").when(partial, "partial").otherwise("ok")
