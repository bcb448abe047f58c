"""Audit packs: what a reviewer reads about a chain, as Markdown built by aggregation; rule and chain projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed, paths, verdicts
from . import symbols

COMPACT = ("chain_id", "index", "language", "vulnerability_type", "severity", "sink_file", "sink_line", "sink_function", "has_call_chain", "call_chains", "evidence", "limits", "audit_pack")


def public_rules(rules: DataFrame) -> DataFrame:
    """Rules as they are shown: without extra patterns, levels and lists in normal form."""
    lists = {c: verdicts.once(F.col(c)) for c in ("semantic_tags", "required_evidence", "repair_hints")}
    return rules.drop("extra").withColumns(lists | {"level": verdicts.level(F.col("level"))})


def compact(chains: DataFrame) -> DataFrame:
    """Of the thirteen fields that a checker gets those that are there."""
    return chains.select(*(c for c in COMPACT if c in chains.columns))


def chain_records(candidates: DataFrame, order: list[Column], folder: str) -> DataFrame:
    """The twenty fields of a chain record, with its index by ascending order (see ranks); missing texts are empty or unknown, missing lists are empty.

    candidates(id, severity, vulnerability_type, language, file, line, function, rule_id, level, semantic_tags,
    required_evidence, repair_hints, call_chains (arrays of names), summary, limits, audit_pack)."""
    ranked = ranks(candidates, order, "index", folder)
    told = lambda c, otherwise="": F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(otherwise))
    listed = lambda c: F.coalesce(F.col(c), F.array().cast(candidates.schema[c].dataType))
    return ranked.select(
        F.lit("chain").alias("type"), "index", F.coalesce(F.nullif(F.col("id"), F.lit("")), F.concat(F.lit("C-"), F.lpad(F.col("index").cast("string"), 6, "0"))).alias("chain_id"),
        F.lower(told("severity", "unknown")).alias("severity"), told("vulnerability_type", "unknown").alias("vulnerability_type"), told("language", "unknown").alias("language"),
        told("file").alias("sink_file"), F.coalesce("line", F.lit(0)).alias("sink_line"), told("function").alias("sink_function"), F.col("rule_id").alias("sink_rule_id"), told("level", "L0").alias("sink_level"),
        *(listed(c).alias(c) for c in ("semantic_tags", "required_evidence", "repair_hints")), (F.size(listed("call_chains")) > 0).alias("has_call_chain"), F.size(listed("call_chains")).alias("call_chain_count"),
        listed("call_chains").alias("call_chains"), told("summary").alias("summary"), listed("limits").alias("limits"), told("audit_pack").alias("audit_pack"),
    )


def ranks(rows: DataFrame, order: list[Column], out: str, folder: str, falling: tuple[bool, ...] = ()) -> DataFrame:
    """rows with their place by order, from 1; keys ascend but where `falling` says otherwise. They are written to folder in sorted ranges, a file each, and numbered
    by the rows of the files before, so that no task holds all and a rerun task finds the same files."""
    placed = rows.withColumn("_key", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(order))))
    keys = [F.col(f"_key.k{i}").desc() if i < len(falling) and falling[i] else F.col(f"_key.k{i}") for i in range(len(order))]
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed.write.mode("overwrite").parquet(folder)
    parts = rows.sparkSession.read.schema(placed.schema).parquet(folder).withColumn("_part", F.col("_metadata.file_name"))
    sizes = parts.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))  # one row a file
    at = F.row_number().over(W.partitionBy("_part").orderBy(*keys))
    return parts.withColumn("_at", at).join(before, "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_key", "_part", "_at", "_before")


def chain_section(total: Column) -> Column:
    """The Markdown section of a chain record, between marks by which the file can be split."""
    head = F.concat(F.lit(f"{fixed.CHAIN_BEGIN} "), F.col("chain_id"), F.lit(" | index="), F.col("index").cast("string"), F.lit("/"), total.cast("string"), F.lit(" | severity="), F.col("severity"), F.lit(" | vuln="), F.col("vulnerability_type"), F.lit(" | lang="), F.col("language"), F.lit(" | sink="), F.col("sink_file"), F.lit(":"), F.col("sink_line").cast("string"), F.lit(" ==="))
    body = F.when(F.col("audit_pack") == "", "(no audit_pack rendered)").otherwise(F.rtrim(F.col("audit_pack"), F.lit(" \t\n\r")))
    return F.concat(head, F.lit("\n"), body, F.lit(f"\n{fixed.CHAIN_END} "), F.col("chain_id"), F.lit(" ===\n"))


def top_candidates(chains: DataFrame, n: int = 30) -> DataFrame:
    """The first candidates: severe ones, then those with a chain, then by id."""
    order = [verdicts.severity_rank(F.col("severity")).desc(), F.col("has_call_chain").desc(), F.col("chain_id")]
    return chains.orderBy(*order).limit(n).select("chain_id", "severity", "vulnerability_type", "sink_file", "sink_line", "sink_function", "has_call_chain")


def _listed(rows: DataFrame, keys: list[str], order: Column, line: Column, out: str, between: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("t")))), lambda x: x["t"])
    return rows.groupBy(*keys).agg(F.array_join(parts, between).alias(out))


def with_calls(nodes: DataFrame, pool: DataFrame, lines: DataFrame) -> DataFrame:
    """nodes(chain_id, place, at, function_ref) with the pool's function, file, line and line_end, and call_line and call_code: the
    first line of the node's body that calls the next node of its chain. Nodes alike in many chains look once."""
    known = nodes.join(pool.select("function_ref", "function", "file", "line", "line_end"), "function_ref", "left")
    known = known.withColumn("callee", F.lead("function").over(W.partitionBy("chain_id", "place").orderBy("at")))
    asked = known.where("callee is not null and line is not null").select("file", F.col("line").alias("start"), F.col("line_end").alias("end"), "callee").distinct()
    found = symbols.call_sites(asked, lines, ["file", "start", "end", "callee"]).select("file", F.col("start").alias("line"), F.col("end").alias("line_end"), "callee", F.col("line").alias("call_line"), F.col("code").alias("call_code"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("file", "line", "line_end", "callee")]
    return known.alias("k").join(found.alias("f"), same, "left").select("k.*", "f.call_line", "f.call_code").drop("callee")


def sink_head() -> Column:
    """The head of a sink's pack: rule, place, severity, its semantic profile and its line."""
    listed = lambda name, c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"- {name}: "), F.array_join(c, ", ")))
    profile = F.concat_ws("\n", F.lit("## Sink profile"), F.concat(F.lit("- level: "), F.coalesce("level", F.lit("L0"))), *(listed(c.replace("_", " "), F.col(c)) for c in ("semantic_tags", "required_evidence", "repair_hints")))
    place = F.concat(F.lit("# Sink "), F.col("rule_function"), F.lit(" at "), F.col("file"), F.lit(":"), F.col("line").cast("string"))
    kind = F.concat_ws(" / ", F.col("severity"), F.col("vulnerability_type"), F.col("language"))
    return F.concat_ws("\n", place, kind, profile, F.when(F.btrim("code") != "", F.concat(F.lit("sink line: "), F.btrim("code"))))


#: Imports of a file that an extract names, places that a finding shows, lines around a sink.
IMPORTS, SNIPPETS, AROUND = 24, 12, 20


def extracts(sinks: DataFrame, imports: DataFrame) -> DataFrame:
    """chain_id, section: language, function and the first imports(file, line, module) of the file of each sink(chain_id, file,
    language, function)."""
    first = symbols.first_rows(imports, ["file"], [F.col("line"), F.col("module")], IMPORTS)
    named = _listed(first, ["file"], F.col("place"), F.col("module"), "_imports", ", ")
    rows = sinks.join(named, "file", "left")
    return rows.select("chain_id", F.concat_ws("\n", F.lit("## File extract"), F.concat_ws(" ", F.col("file"), F.col("language"), F.col("function")), F.concat(F.lit("imports: "), F.col("_imports"))).alias("section"))


def contexts(sinks: DataFrame, lines: DataFrame) -> DataFrame:
    """chain_id, section: the numbered lines around each sink(chain_id, file, line, function)."""
    around = symbols.windows(sinks, lines, ["chain_id", "function"], AROUND, AROUND)
    return around.select("chain_id", F.concat(F.lit("## Context of "), F.col("function"), F.lit("\n```\n"), F.col("code"), F.lit("\n```")).alias("section"))


def direct_callers(nodes: DataFrame, pool: DataFrame) -> DataFrame:
    """chain_id, section: of the first chain of nodes (see with_calls) the one before the sink, its call and its body."""
    at = F.row_number().over(W.partitionBy("chain_id").orderBy(F.desc("at")))
    caller = nodes.where("place = 1").withColumn("_back", at).where("_back = 2").join(pool.select("function_ref", "code_slice"), "function_ref", "left")
    call = F.concat(F.lit("line "), F.col("call_line").cast("string"), F.lit(": "), F.col("call_code"))
    body = F.concat(F.lit("```\n"), F.col("code_slice"), F.lit("\n```"))
    return caller.select("chain_id", F.concat_ws("\n", F.lit("## Direct caller"), F.concat_ws(" ", F.coalesce("function", F.lit("?")), F.lit("in"), F.coalesce("file", F.lit("?"))), call, body).alias("section"))


def packs(heads: DataFrame, nodes: DataFrame, pool: DataFrame, most_chains: int = 30, sections: tuple[DataFrame, ...] = ()) -> DataFrame:
    """chain_id, pack. heads(chain_id, head): the sink's own section; sections(chain_id, section): what comes between it and the chains, in
    order; nodes(chain_id, place, at, function_ref, name): the nodes of its numbered call chains, with call_line and call_code or
    without; pool(function_ref, function, file, line, line_end, code_slice): bodies, each of which
    comes once, at its first place. A chain's nodes are at most its caps' product, so a pack is bounded."""
    shown = nodes.where(F.col("place") <= most_chains)
    paths = _listed(shown, ["chain_id", "place"], F.col("at"), F.col("name"), "path", " -> ")
    if "call_line" in nodes.columns:
        told = F.concat(F.lit("   "), F.col("name"), F.lit(" line "), F.col("call_line").cast("string"), F.lit(": "), F.col("call_code"))
        paths = paths.join(_listed(shown.where("call_line is not null"), ["chain_id", "place"], F.col("at"), told, "calls", "\n"), ["chain_id", "place"], "left")
        paths = paths.withColumn("path", F.concat_ws("\n", "path", "calls")).drop("calls")
    chains = _listed(paths, ["chain_id"], F.col("place"), F.concat(F.col("place").cast("string"), F.lit(". "), F.col("path")), "chains", "\n")
    first = shown.groupBy("chain_id", "function_ref").agg(F.min(F.struct("place", "at")).alias("first")).join(pool, "function_ref")
    title = F.concat(F.lit("### "), F.col("function"), F.lit(" ("), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit(")"))
    body = F.concat(title, F.lit("\n```\n"), F.col("code_slice"), F.lit("\n```"))
    bodies = _listed(first.withColumn("o", F.struct("first", "function_ref")), ["chain_id"], F.col("o"), body, "bodies", "\n")
    rows = heads.join(chains, "chain_id", "left").join(bodies, "chain_id", "left")
    for i, own in enumerate(sections):
        rows = rows.join(own.withColumnRenamed("section", f"_section{i}"), "chain_id", "left")
    section = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"## {name}\n"), F.col(c)))
    return rows.select("chain_id", F.concat_ws("\n\n", "head", *(f"_section{i}" for i in range(len(sections))), section("Call chains", "chains"), section("Functions", "bodies")).alias("pack"))


def snippets(places: DataFrame, lines: DataFrame) -> DataFrame:
    """chain_id, place, file, line, line_start, line_end, code of the first SNIPPETS distinct places(chain_id, ord, file, line) of each finding;
    a place without a line is the file's first, and one whose file isn't there has no code."""
    once = places.where(F.btrim(F.coalesce("file", F.lit(""))) != "").groupBy("chain_id", paths.slashed(F.btrim("file")).alias("file"), "line").agg(F.min("ord").alias("ord"))
    first = symbols.first_rows(once, ["chain_id"], [F.col("ord"), F.col("file"), F.col("line")], SNIPPETS)
    ends = lines.groupBy("file").agg(F.max("line").alias("_last"))
    at = first.join(ends, "file", "left").withColumn("_at", F.greatest(F.lit(1), F.least(F.coalesce("line", F.lit(1)), F.coalesce("_last", F.lit(1)))))
    asked = at.select("file", F.col("_at").alias("line")).distinct()
    found = symbols.windows(asked, lines, ["file", "line"], fixed.SNIPPET_LINES, fixed.SNIPPET_LINES).withColumnRenamed("line", "_at")
    return at.join(found, ["file", "_at"], "left").select("chain_id", "place", "file", "line", "line_start", "line_end", "code")


#: Rows of a bridge pack for sanitizers and for what refutes it.
SANITIZERS, REFUTING = 8, 6


def bridge_packs(chains: DataFrame, refuting: DataFrame | None = None) -> DataFrame:
    """chain_id, pack of cross-request chains: where data comes in, is kept, is read and comes out, what is doubtful, and the first
    refuting(chain_id, ord, kind, evidence)."""
    step = lambda name, file, line: F.when(F.col(file).isNotNull(), F.concat(F.lit(f"- {name}: "), F.col(file), F.lit(":"), F.col(line).cast("string")))
    words = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"- {name}: "), F.array_join(c, ", ")))
    head = F.concat(F.lit("# "), F.col("vulnerability_type"), F.lit(" ("), F.col("evidence_quality"), F.lit(", "), F.col("evidence_score").cast("string"), F.lit(")"))
    trace = F.transform(F.slice("sanitizer_trace", 1, SANITIZERS), lambda x: F.concat_ws(" ", x["strength"], x["kind"], F.concat_ws(":", x["file"], x["line"].cast("string"))))
    made = F.concat_ws("\n", head, step("write", "write_file", "write_line"), F.concat(F.lit("- storage: "), F.col("storage_identity")), step("read", "read_file", "read_line"), step("sink", "sink_file", "sink_line"), words("sanitizers", trace), words("breakpoints", F.col("breakpoints")), words("noise", F.col("noise_tags")))
    found = chains.select("chain_id", made.alias("pack"))
    if refuting is None:
        return found
    first = symbols.first_rows(refuting, ["chain_id"], [F.col("ord")], REFUTING)
    rows = _listed(first, ["chain_id"], F.col("place"), F.concat(F.lit("- "), F.col("kind"), F.lit(": "), F.left(F.btrim(F.coalesce("evidence", F.lit(""))), F.lit(240))), "_refuting", "\n")
    # the text is what meets them, not what it is made of
    return found.join(rows, "chain_id", "left").select("chain_id", F.concat_ws("\n", "pack", F.concat(F.lit("## Refuting evidence\n"), F.col("_refuting"))).alias("pack"))
