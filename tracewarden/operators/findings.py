"""Findings: raw model answers to typed rows, evidence repair, unions of chain files, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed, text, verdicts

#: Fields of an answer, all read as text so that none can fail.
ANSWER = "verdict string, confidence string, title string, cwe_guess string, severity string, principle string, sink string, source string, exploit_poc string, fix_suggestion string, refuted_by string, missing_info string, evidence string, repair_rounds string, _tool_stopped string"


def items(value: Column) -> Column:
    """A list from a JSON list of texts, or from one text; empty for null and for blanks."""
    listed = F.startswith(text.stripped(value), F.lit("["))
    return verdicts.text_items(F.when(listed, F.from_json(value, "array<string>")).when(value.isNotNull(), F.array(value)))


def parsed(answers: DataFrame) -> DataFrame:
    """Findings of answers(chain_id, vulnerability_type, severity, sink_file, sink_line, sink_function, raw): one for each
    row; an answer without a JSON object is uncertain at 0.5. The guard rails are applied."""
    row = F.from_json(text.json_text(F.col("raw")), ANSWER)
    rows = answers.withColumn("_a", row).withColumn("_fit", F.col("_a").isNotNull() & F.startswith(text.stripped(text.json_text(F.col("raw"))), F.lit("{")))
    field = lambda name: F.when(F.col("_fit"), F.col(f"_a.{name}"))
    missing = items(field("missing_info"))
    first, sure = verdicts.verdict(field("verdict")), verdicts.confidence(field("confidence"))
    rows = rows.withColumns({"_v": first, "_c": F.coalesce(sure, F.lit(0.5)), "_m": missing})
    verdict, confidence = verdicts.guarded(F.col("_v"), F.col("_c"), F.col("_m"))
    place = F.concat_ws(":", F.coalesce("sink_file", F.lit("None")), F.coalesce(F.col("sink_line").cast("string"), F.lit("None")))
    told = F.from_json(field("sink"), "file string, line string, expr string")
    fallback = lambda name, own: F.when(told.isNotNull(), told[name]).otherwise(F.col(own).cast("string"))
    known = [c for c in answers.columns if c not in ("raw", "severity")]
    return rows.select(
        *known, verdict.alias("verdict"), confidence.alias("confidence"),
        F.coalesce(field("title"), F.concat(F.coalesce("vulnerability_type", F.lit("None")), F.lit(" 风险点 @ "), place)).alias("title"),
        F.coalesce(field("cwe_guess"), verdicts.cwe(F.col("vulnerability_type"))).alias("cwe_guess"),
        F.coalesce(field("severity"), F.nullif("severity", F.lit("")), F.lit("medium")).alias("severity"),
        text.stripped(F.coalesce(field("principle"), F.lit(""))).alias("principle"),
        fallback("file", "sink_file").alias("told_file"), fallback("line", "sink_line").alias("told_line"),
        F.col("_m").alias("missing_info"), items(field("evidence")).alias("evidence"),
        F.coalesce(field("repair_rounds").try_cast("int"), F.lit(0)).alias("repair_rounds"),
        F.nullif(text.stripped(field("refuted_by")), F.lit("")).alias("refuted_by"), F.nullif(text.stripped(field("_tool_stopped")), F.lit("")).alias("tool_stopped"),
    )


def prechecked(chains: DataFrame) -> DataFrame:
    """Data-flow chains that need no answer: refuted by a strong sanitizer with no sign but the sink itself are safe at 0.95.
    chains(chain_id, chain_kind, refuting array<string>, positive array<string>): kinds of evidence."""
    others = F.filter(F.coalesce("positive", F.array().cast("array<string>")), lambda x: x != "dangerous_sink")
    rows = chains.where(F.col("chain_kind").isin("cross_request", "recovered_partial") & (F.size(F.coalesce("refuting", F.array().cast("array<string>"))) > 0) & (F.size(others) == 0))
    return rows.select("chain_id", "chain_kind", F.lit("safe").alias("verdict"), F.lit(0.95).alias("confidence"), F.array_join(F.slice("refuting", 1, 3), "; ").alias("refuted_by"))


def missing_kinds(*lists: Column) -> Column:
    """Kinds that free texts in several lists name, in order, each once."""
    whole = F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))
    return F.array_distinct(F.array_compact(F.transform(whole, verdicts.breakpoint_of)))


def repair_tasks(chains: DataFrame) -> DataFrame:
    """chain_id, place, kind, pattern, path for chains(chain_id, sink_file, missing): the first kinds, one search each, in the
    sink's directory; the searches that run are the first REPAIR_RUNS."""
    from ..functions.paths import directory_of, slashed

    rows = chains.select("chain_id", directory_of(slashed(F.coalesce("sink_file", F.lit("")))).alias("path"), F.posexplode(F.slice("missing", 1, fixed.REPAIR_KINDS)).alias("at", "kind"))
    pattern = text.lookup(F.col("kind"), fixed.REPAIR_PATTERNS)
    return rows.withColumn("pattern", pattern).where(F.col("pattern").isNotNull() & (F.col("at") < fixed.REPAIR_RUNS)).select("chain_id", (F.col("at") + 1).alias("place"), "kind", "pattern", "path")


def repaired(chains: DataFrame, found: DataFrame) -> DataFrame:
    """chains(chain_id, missing, resolved) after a round of searches; found(chain_id, kind, place) has those that found lines."""
    hits = found.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("place", "kind"))).alias("_hits"))
    none = F.array().cast("array<string>")
    kinds = F.coalesce(F.transform("_hits", lambda x: x["kind"]), none)
    resolved = verdicts.once(F.concat(F.coalesce("resolved", none), kinds))
    rows = chains.join(hits, "chain_id", "left").withColumns({"resolved": resolved, "evidence_count": F.size(kinds)})
    return rows.withColumns({"unresolved": F.filter("missing", lambda x: ~F.array_contains("resolved", x)), "repair_rounds": F.lit(1)}).drop("_hits")


def united(*sources: DataFrame) -> DataFrame:
    """Chains of several files (chain_id, line and any other columns) in the order given; of one id the first row stays."""
    rows = None
    for i, df in enumerate(sources):
        own = df.withColumn("source_ord", F.lit(i))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    rest = [c for c in rows.columns if c != "chain_id"]
    first = rows.where(F.coalesce("chain_id", F.lit("")) != "").groupBy("chain_id").agg(F.min_by(F.struct(*rest), F.struct("source_ord", "line")).alias("x"))
    return first.select("chain_id", "x.*")


def auditable(chains: DataFrame) -> DataFrame:
    """Chains to audit: data-flow ones only if neither suppressed nor weak. chains has origin, suppressed, evidence_quality."""
    doubtful = F.coalesce("suppressed", F.lit(False)) | (F.coalesce("evidence_quality", F.lit("")) == "weak")
    return chains.where(~((F.col("origin") == "dataflow") & doubtful))


def progress(rows: DataFrame, key: str = "chain_id", order: str = "line") -> DataFrame:
    """The last row of each key in a progress log: later answers replace earlier ones."""
    rest = [c for c in rows.columns if c != key]
    last = rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x"))
    return last.select(key, "x.*")


def with_chains(found: DataFrame, rows: DataFrame) -> DataFrame:
    """findings with `chain`, the last of the rows(chain_id, line, type, …) of type chain that has their id, or null."""
    last = progress(rows.where("type = 'chain'").withColumn("chain_id", text.stripped(F.col("chain_id"))))
    return found.join(last.select("chain_id", F.struct(*(c for c in last.columns if c != "chain_id")).alias("chain")), "chain_id", "left")


def audit_order(*ties: Column) -> list[Column]:
    """Chains to audit: cross-request ones first, then severe ones, then those with a call chain; then as they came (ties)."""
    kind = F.when(F.col("chain_kind") == "cross_request", 2).otherwise(1)
    return [kind.desc(), F.coalesce(verdicts.severity_rank(F.col("severity")), F.lit(0)).desc(), F.coalesce("has_call_chain", F.lit(False)).desc(), *ties]


def pending(chains: DataFrame, done: DataFrame, key: str = "chain_id") -> DataFrame:
    return chains.join(done.select(key), key, "left_anti")


def completed(chains: DataFrame, done: DataFrame, key: str = "chain_id") -> DataFrame:
    return chains.join(done.select(key), key, "left_semi")


def summary(findings: DataFrame) -> DataFrame:
    """measure, key, n: publishable findings by verdict, and vulnerable ones by severity and type. Unknown verdicts count as
    uncertain. findings(verdict, severity, vulnerability_type, publishable)."""
    verdict = F.when(F.col("verdict").isin(*fixed.VERDICTS), F.col("verdict")).otherwise("uncertain")
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    entry = lambda measure, key: F.struct(F.lit(measure).alias("measure"), key.alias("key"))
    bad = F.col("verdict") == "vulnerable"
    entries = F.array_compact(F.array(entry("verdict", verdict), entry("verdict", F.lit("done")), F.when(bad, entry("severity", named("severity"))), F.when(bad, entry("vulnerability_type", named("vulnerability_type")))))
    return findings.where("publishable").select(F.explode(entries).alias("e")).groupBy("e.measure", "e.key").agg(F.count("*").alias("n"))


def skills(chains: DataFrame, table: DataFrame) -> DataFrame:
    """chains with the skill of their language and type, else of their type alone, else default. table(language,
    vulnerability_type, skill), language null for the general ones."""
    exact = table.where("language is not null").select("language", "vulnerability_type", F.col("skill").alias("_exact"))
    general = table.where("language is null").select("vulnerability_type", F.col("skill").alias("_general"))
    rows = chains.join(exact, ["language", "vulnerability_type"], "left").join(general, "vulnerability_type", "left")
    return rows.withColumn("skill", F.coalesce("_exact", "_general", F.lit("default"))).drop("_exact", "_general")


def curated(findings: DataFrame) -> DataFrame:
    """Fields of a curated vulnerability from findings(project_path, scan_id, chain_id, title, verdict, severity, language,
    vulnerability_type, cwe_guess, sink_file, sink_line, sink_expr, principle, fix_suggestion)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    location = text.stripped(F.concat(blank("sink_file"), F.lit(":"), blank("sink_line"), F.lit(" "), blank("sink_expr")))
    title = text.stripped(blank("title"))
    part = lambda label, c: F.when(blank(c) != "", F.concat(F.lit(f"## {label}\n"), F.col(c)))
    return findings.select(
        "project_path", "scan_id", "chain_id",
        F.when((title != "") & (title != "unit-test"), title).otherwise(F.concat(F.coalesce(F.nullif("vulnerability_type", F.lit("")), F.lit("漏洞")), F.lit(" @ "), location)).alias("name"),
        location.alias("location"), F.array_join(F.array_compact(F.array(part("原理", "principle"), part("修复建议", "fix_suggestion"))), "\n\n").alias("details"),
        F.filter(F.array("vulnerability_type", "language", "cwe_guess"), lambda x: F.coalesce(x, F.lit("")) != "").alias("tags"),
        F.lower(F.coalesce(F.nullif("severity", F.lit("")), F.lit("medium"))).alias("severity"),
        F.when(F.col("verdict") == "vulnerable", "confirmed").otherwise("draft").alias("status"),
    )


def skill_table(spark: SparkSession, rows: list[tuple[str | None, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "language string, vulnerability_type string, skill string")
