"""Cross-request chains: writes meet sinks and reads through the storage field they share.

Facts have file, line, kind (of storage), field, evidence and, by side: writes source_expr, vulnerability_type;
reads template, template_var; sinks template, vulnerability_type, severity, sink_function. Overlap of storage keys comes
down to equal normalised fields, so the nested loops of the definition are two equi-joins: the best read depends on the sink alone
and is looked up by nearest line first, and only then are writes joined. A pair is a chain, so the output is what it must be.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed, flow, verdicts
from ..functions.text import first_true, lookup, normal_field
from ..sources.shared import stored

TRACE = "array<struct<kind:string,strength:string,file:string,line:int>>"


def _nearest(asks: DataFrame, reads: DataFrame, key: list[str]) -> DataFrame:
    """asks(key, line, ...) with the read `r` of reads(key, line, r; one a line) that is nearest in line; of two the first by file
    and line. One ordered pass in each direction, whatever the number of reads."""
    events = asks.withColumns({"r": F.lit(None).cast(reads.schema["r"].dataType), "_asked": F.lit(True)}).unionByName(reads.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    upto = lambda *order: F.last("r", ignorenulls=True).over(W.partitionBy(*key).orderBy(*order, "_asked").rowsBetween(W.unboundedPreceding, 0))
    rank = lambda c: F.struct(F.abs(F.col(f"{c}.line") - F.col("line")).alias("away"), F.col(f"{c}.file").alias("file"), F.col(f"{c}.line").alias("line"), F.col(c).alias("r"))
    found = events.withColumns({"_up": upto("line"), "_down": upto(F.desc("line"))}).where("_asked and (_up is not null or _down is not null)")
    both = F.array_min(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), rank(c)) for c in ("_up", "_down")))))
    return found.withColumn("best", both).drop("r", "_asked", "_up", "_down")


def best_reads(sinks: DataFrame, reads: DataFrame, template_quirk: bool = True) -> DataFrame:
    """sinks with `read`, the best read of the same field or null: its template ends the sink's, its variable is the field,
    it is near in line, it comes first. With the quirk a read without a template fits any sink that has one.

    Reads stand in classes: those of one template, and all of a field, with the field as their variable or not. A sink looks for
    the nearest line in the classes of its template's endings and in that of all; sinks alike in field, template and line look once. So a
    field costs its lines, not reads times sinks."""
    own = [c for c in ("trace", "identity") if c in reads.columns]
    r = reads.where("field <> ''").select("field", "line", F.when(F.col("template_var") == F.col("field"), 0).otherwise(1).alias("named"), F.struct("file", "line", "kind", "template", "template_var", "evidence", *own).alias("r"))
    of = F.concat(F.lit("/"), F.coalesce("r.template", F.lit("" if template_quirk else None)))
    known = r.withColumn("class", F.explode(F.array_compact(F.array(of, F.lit("any"))))).groupBy("field", "class", "named", "line").agg(F.min("r").alias("r"))
    template = F.coalesce("template", F.lit(""))
    asks = sinks.where("field <> ''").select("field", template.alias("template"), "line").distinct()
    endings = F.when(F.col("template") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length("template") + 1), lambda i: F.concat(F.lit("/"), F.substring(F.col("template"), i, F.length("template")))))
    asks = asks.withColumn("class", F.explode(F.concat(endings, F.array(F.lit("any"))))).join(known.select("field", "class", "named").distinct(), ["field", "class"])
    near = _nearest(asks, known, ["field", "class", "named"])
    rank = F.struct(F.when(F.col("class") == "any", 1).otherwise(0).alias("fits"), F.col("named").alias("named"), F.col("best").alias("best"))
    best = near.groupBy("field", F.col("template").alias("_template"), "line").agg(F.min(rank).alias("_rank"))
    found = sinks.withColumn("_template", template).join(best, ["field", "_template", "line"], "left")
    return found.select(*sinks.columns, F.col("_rank.best.r").alias("read"))


#: Pairs of a field that one task may make; more are dealt out.
PAIRS_A_TASK = 1_000_000


def _met(w: DataFrame, s: DataFrame) -> DataFrame:
    """w(field, w) and s(field, ...) joined by field. Where a field makes many pairs, its writes are dealt over tasks and its sinks go to each."""
    counts = w.groupBy("field").agg(F.count("*").alias("n")).join(s.groupBy("field").agg(F.count("*").alias("m")), "field")
    heavy = counts.select("field", F.least(F.ceil(F.col("n") * F.col("m") / PAIRS_A_TASK), F.col("n")).cast("int").alias("_deals")).where("_deals > 1")
    deals = F.coalesce("_deals", F.lit(1))
    w = w.join(heavy, "field", "left").withColumn("_deal", F.pmod(F.xxhash64("w.write_id"), deals).cast("int")).drop("_deals")
    s = s.join(heavy, "field", "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("_deals")
    return w.join(s, ["field", "_deal"]).drop("_deal")


def _first(facts: DataFrame, number: str) -> DataFrame:
    """Of facts at one place with one field the first: the chains of the others have the ids of its own."""
    rest = [c for c in facts.columns if c not in ("file", "line", "field")]
    first = facts.groupBy("file", "line", "field").agg(F.min_by(F.struct(*rest), number).alias("_x"))
    return first.select("file", "line", "field", "_x.*").select(*facts.columns)


def _judged(facts: DataFrame, type_: Column) -> DataFrame:
    """facts with their sanitizer trace, storage identity and danger, so that no pattern runs on pairs."""
    evidence = F.coalesce("evidence", F.lit(""))
    trace = F.transform(flow.sanitizers(evidence, type_), lambda x: F.struct(x["kind"].alias("kind"), x["strength"].alias("strength"), F.col("file").alias("file"), F.col("line").alias("line")))
    identity = F.when(F.col("kind").isNotNull(), flow.storage_identity(F.col("kind"), F.col("field"), evidence))
    rank = F.when(identity.isNotNull(), F.struct(lookup(identity["confidence"], fixed.CONFIDENCE_RANK).alias("rank"), identity["identity"].alias("identity")))
    return facts.withColumns({"trace": trace.cast(TRACE), "identity": rank, "danger": flow.dangerous(type_, F.col("evidence"))})


def _distinct(strength: str) -> Column:
    """How many sanitizers of a strength write, read and sink have, one at one place counted once; a fact has at most one of each."""
    own = [F.get(F.filter(F.col(f"{x}.trace"), lambda t: t["strength"] == strength), F.lit(0)) for x in "wrs"]
    return sum((F.when(reduce(and_, (~x.eqNullSafe(y) for y in own[:i]), x.isNotNull()), 1).otherwise(0) for i, x in enumerate(own)), F.lit(0))


def chains(writes: DataFrame, reads: DataFrame, sinks: DataFrame, template_quirk: bool = True) -> DataFrame:
    """One row per chain id, scored. writes need write_id and sinks sink_id, orders of facts without repeats."""
    writes, reads, sinks = (x.withColumn("field", normal_field(F.col("field"))) for x in (writes, reads, sinks))
    writes, sinks = (_judged(_first(x, number), F.col("vulnerability_type")) for x, number in ((writes, "write_id"), (sinks, "sink_id")))
    best = best_reads(sinks, _judged(reads, F.lit("xss")), template_quirk)
    w = writes.where("field <> ''").select("field", F.struct(*(c for c in writes.columns if c != "field")).alias("w"))
    s = best.where("field <> ''").select("field", F.struct(*(c for c in sinks.columns if c != "field")).alias("s"), F.col("read").alias("r"))
    pairs = _met(stored(w, "writes"), stored(s, "sinks"))
    has_read = F.col("r").isNotNull()
    kind = F.coalesce(F.col("s.vulnerability_type"), F.col("w.vulnerability_type"), F.lit("unknown"))
    quality = flow.match_quality(F.col("w.kind"), F.col("r.kind"), F.col("s.kind"), F.col("r.template_var"))
    none = F.array().cast(TRACE)
    trace = F.array_distinct(F.concat(*(F.coalesce(F.col(f"{x}.trace"), none) for x in "wrs")))
    rows = pairs.withColumns({"match_quality": quality, "sanitizer_trace": trace, "vulnerability_type": kind})
    strong, weak = _distinct("strong"), _distinct("weak")
    n_breakpoints = flow.n_breakpoints(F.col("match_quality"), F.col("w.kind"), has_read, F.col("s.kind"), F.col("w.evidence"))
    positive = F.when(F.col("s.danger"), 1).otherwise(0) + F.when(F.col("s.kind") == "file_slot", 1).otherwise(0) + F.when(F.coalesce(F.col("r.template_var"), F.lit("")) != "", 1).otherwise(0)
    rows = rows.withColumns({"n_strong": strong, "n_weak": weak, "n_positive": positive, "breakpoints": flow.breakpoints(F.col("match_quality"), F.col("w.kind"), has_read, F.col("s.kind"), F.col("w.evidence"))})
    rows = rows.withColumn("noise_tags", flow.noise_tags(F.col("match_quality"), has_read, F.col("s.kind"), F.col("n_strong")))
    rows = rows.withColumn("evidence_score", flow.score(F.col("match_quality"), F.col("w.source_expr").isNotNull(), has_read, F.col("s.sink_function").isNotNull(), F.col("n_positive"), F.col("n_strong"), F.col("n_weak"), n_breakpoints))
    rows = rows.withColumn("evidence_quality", flow.evidence_quality(F.col("evidence_score"), has_read, F.col("n_strong"), F.col("match_quality")))
    ranks = {x: F.coalesce(F.col(f"{x}.identity.rank"), F.lit(-1)) for x in "wrs"}
    best_rank = F.greatest(*ranks.values())
    identity = first_true([(best_rank < 0, None), *((rank == best_rank, F.col(f"{x}.identity.identity")) for x, rank in ranks.items())])
    return rows.select(
        flow.stable_id("DF-", 12, F.col("w.file"), F.col("w.line").cast("string"), flow.field_key(F.col("field")), F.col("s.file"), F.col("s.line").cast("string")).alias("chain_id"),
        F.lit("cross_request").alias("chain_kind"), "vulnerability_type", F.coalesce(F.col("s.severity"), F.lit("high")).alias("severity"), "field",
        F.col("w.file").alias("write_file"), F.col("w.line").alias("write_line"), F.col("w.write_id").alias("write_id"), F.col("w.kind").alias("write_kind"),
        F.col("r.file").alias("read_file"), F.col("r.line").alias("read_line"),
        F.col("s.file").alias("sink_file"), F.col("s.line").alias("sink_line"), F.col("s.sink_id").alias("sink_id"), F.col("s.sink_function").alias("sink_function"),
        identity.alias("storage_identity"), "match_quality", "sanitizer_trace", "n_positive", "n_strong", "n_weak", "breakpoints", "noise_tags", "evidence_score", "evidence_quality",
        ((F.col("evidence_quality") == "weak") | (F.col("n_strong") > 0)).alias("suppressed"),
    )


def recovered(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Partial chains for scanned sinks (chain_id, vulnerability_type, severity, sink_file, sink_line, has_call_chain) that
    have no context and no chain of their own in known: weak, suppressed, without a storage bridge."""
    rows = scanned.where(~F.coalesce("has_call_chain", F.lit(False)) & F.col("vulnerability_type").isin(*fixed.RECOVERED_TYPES))
    own = flow.stable_id("DF-R-", 12, F.col("chain_id"), F.coalesce("sink_file", F.lit("")), F.coalesce("sink_line", F.lit(0)).cast("string"))
    rows = rows.select(own.alias("chain_id"), F.lit("recovered_partial").alias("chain_kind"), "vulnerability_type", F.coalesce("severity", F.lit("medium")).alias("severity"), "sink_file", "sink_line")
    rows = rows.dropDuplicates(["chain_id"]).join(known.select("chain_id"), "chain_id", "left_anti")
    tags = lambda *words: F.array(*map(F.lit, words))
    return rows.withColumns({"evidence_quality": F.lit("weak"), "evidence_score": F.lit(15), "suppressed": F.lit(True), "noise_tags": tags("missing_storage_bridge", "weak_recovered_partial"), "breakpoints": tags("missing_storage_bridge")})


def without_repeats(found: DataFrame) -> DataFrame:
    """Every chain; of those on one storage identity, sink and type all but the best (score, then order) are suppressed and
    tagged. A chain without an identity is never a repeat. The best is aggregated and joined back, not ranked in a window."""
    key = ["storage_identity", "sink_file", "sink_line", "vulnerability_type"]
    named = found.where(F.coalesce("storage_identity", F.lit("")) != "")
    best = named.groupBy(*key).agg(F.min(F.struct((-F.col("evidence_score")).alias("score"), "write_id", "sink_id")).alias("_best"))
    joined = found.join(best, key, "left")
    again = F.col("_best").isNotNull() & ~((F.col("_best.write_id") == F.col("write_id")) & (F.col("_best.sink_id") == F.col("sink_id")))
    out = joined.withColumns({"suppressed": F.col("suppressed") | again, "noise_tags": F.when(again, F.array_append("noise_tags", F.lit("duplicate_storage_sink"))).otherwise(F.col("noise_tags"))})
    return out.select(*found.columns)


def chain_order() -> list:
    """Whole chains before partial ones, then score, severity, file and line, all falling; ids break ties."""
    kind = F.when(F.col("chain_kind") == "cross_request", 2).otherwise(1)
    return [kind.desc(), F.col("evidence_score").desc(), verdicts.severity_rank(F.col("severity")).desc(), F.col("sink_file").desc(), F.col("sink_line").desc(), F.col("chain_id")]


def summary(found: DataFrame) -> DataFrame:
    """measure, key, n: chains by kind, quality, suppression, tag and breakpoint."""
    entry = lambda measure, key: F.struct(F.lit(measure).alias("measure"), key.alias("key"))
    plain = [("chain_kind", F.col("chain_kind")), ("evidence_quality", F.col("evidence_quality")), ("suppressed", F.col("suppressed").cast("string")), ("match_quality", F.col("match_quality"))]
    tags, breaks = F.transform("noise_tags", lambda x: entry("noise_tag", x)), F.transform("breakpoints", lambda x: entry("breakpoint", x))
    entries = F.concat(F.array(*(entry(m, c) for m, c in plain)), tags, breaks)
    return found.select(F.explode(entries).alias("e")).groupBy("e.measure", "e.key").agg(F.count("*").alias("n"))
