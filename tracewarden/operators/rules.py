"""Rule scan: rules over source lines, the filter funnel, one hit a line, order of work.

Rules are a small table (at most MOST_RULES, checked); lines are the large one. One expression finds the literals of all rules
in a line, and only the rules that those allow are tested on it, so what a line costs hardly grows with the rules. Rules whose
matches begin with their literals are told by that expression itself; rules that require no literal are foldable predicates of
the same projection.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions import fixed, paths, verdicts
from ..functions.text import any_contains
from . import literals

MOST_RULES = 5_000
STAGES = ("filtered_by_path", "filtered_by_scope", "filtered_by_comment", "filtered_by_dynamic", "filtered_by_extra", "kept")


@dataclass(frozen=True)
class Rule:
    id: str
    function: str
    pattern: str
    language: str
    vulnerability_type: str
    severity: str = "medium"
    #: File endings without dots; none means every file.
    endings: tuple[str, ...] = ()
    needs_dynamic: bool = False
    extra: tuple[str, ...] = ()
    level: str = "L0"
    semantic_tags: tuple[str, ...] = ()
    required_evidence: tuple[str, ...] = ()
    repair_hints: tuple[str, ...] = ()
    description: str = field(default="", compare=False)


SCHEMA = "rule_ord int, rule_id string, function string, pattern string, language string, vulnerability_type string, severity string, needs_dynamic boolean, extra array<string>, level string, semantic_tags array<string>, required_evidence array<string>, repair_hints array<string>"


def table(spark: SparkSession, rules: list[Rule], endings: str = "") -> DataFrame:
    """The rules as a table, numbered in their order, with their endings if a column for them is named."""
    rows = [(i, r.id, r.function, r.pattern, r.language, r.vulnerability_type, r.severity, r.needs_dynamic, list(r.extra), r.level, list(r.semantic_tags), list(r.required_evidence), list(r.repair_hints)) for i, r in enumerate(rules)]
    if not endings:
        return spark.createDataFrame(rows, SCHEMA)
    return spark.createDataFrame([(*row, list(r.endings)) for row, r in zip(rows, rules, strict=True)], f"{SCHEMA}, {endings} array<string>")


def load(rules: DataFrame) -> list[Rule]:
    """Rules from any table with the columns of SCHEMA and endings array<string>, in order of rule_ord."""
    rows = rules.orderBy("rule_ord").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [Rule(r["rule_id"], r["function"], r["pattern"], r["language"], r["vulnerability_type"], r["severity"], tuple(r["endings"]), r["needs_dynamic"], tuple(r["extra"]), r["level"], tuple(r["semantic_tags"]), tuple(r["required_evidence"]), tuple(r["repair_hints"])) for r in rows]


@F.pandas_udf(T.BooleanType())
def compiles(patterns: pd.Series) -> pd.Series:
    """Whether each pattern is a regular expression; for rule tables only, never for lines."""

    def fits(pattern: str) -> bool:
        try:
            re.compile(pattern)
        except re.error:
            return False
        return True

    return patterns.fillna("").map(fits).astype(bool)


def violations(rules: DataFrame) -> DataFrame:
    """rule_id and problem of each rule that may not be saved: no id, repeated id, no function, no pattern, bad severity, a
    pattern or an extra pattern that doesn't compile."""
    blank = lambda c: F.btrim(F.coalesce(F.col(c), F.lit(""))) == ""
    again = rules.groupBy("rule_id").count().where("count > 1").select("rule_id", F.lit("repeated id").alias("problem"))
    cases = [(blank("rule_id"), "no id"), (blank("function"), "no function"), (blank("pattern"), "no pattern"), (~F.coalesce(F.col("severity").isin(*fixed.SEVERITIES), F.lit(False)), "bad severity")]
    patterns = rules.select("rule_id", F.explode(F.concat(F.array(F.struct(F.lit("bad pattern").alias("problem"), "pattern")), F.transform(F.coalesce("extra", F.array().cast("array<string>")), lambda x: F.struct(F.lit("bad extra pattern").alias("problem"), x.alias("pattern"))))).alias("p"))
    broken = patterns.where(~compiles("p.pattern")).select("rule_id", "p.problem").distinct()
    return rules.select("rule_id", F.explode(F.array_compact(F.array(*(F.when(c, w) for c, w in cases)))).alias("problem")).unionByName(again).unionByName(broken)


def _may_match(pattern: str) -> Column:
    """Whether code holds a sign that each match of the pattern does, which costs less than a search in vain."""
    own = literals.signs(pattern)
    return any_contains(F.col("code"), tuple(sorted(own))) if own else F.lit(True)


def matched(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each rule that matches a line(file, line, code): the line's columns, rule_ord, rule columns, column (of the
    first match, from 0) and matched_text. Patterns see Unicode letters as word characters."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    index = literals.index([r.pattern for r in rules])
    sure = literals.numbers(F.col("_met"), index.sure)
    allowed = F.array_except(literals.numbers(F.col("_met"), index.maybe), sure)
    parts, by_endings = [], defaultdict(list)
    for i in index.rest:
        by_endings[rules[i].endings].append(i)
    for endings, own in by_endings.items():
        found = F.array_compact(F.array(*(F.when(_may_match(rules[i].pattern) & F.rlike("code", F.lit(f"(?U){rules[i].pattern}")), F.lit(i)) for i in own)))
        none = F.array().cast("array<int>")
        parts.append(F.when(paths.suffix(F.col("file")).isin(*endings), found).otherwise(none) if endings else found)
    told = F.transform(F.concat(sure, *parts), lambda i: F.struct(i.alias("rule_ord"), F.lit(True).alias("_told")))
    untold = F.transform(allowed, lambda i: F.struct(i.alias("rule_ord"), F.lit(False).alias("_told")))
    # endings are worked out for a line, not for each rule
    spread = lines.withColumns({"_met": literals.met(F.col("code"), index), "_suffix": paths.suffix(F.col("file"))}).withColumn("_rule", F.explode(F.concat(told, untold)))
    known = table(lines.sparkSession, rules, "_endings")
    pattern = F.concat(F.lit("(?U)"), F.col("pattern"))
    hits = spread.select(*lines.columns, "_suffix", "_rule.*").join(F.broadcast(known), "rule_ord").where((F.size("_endings") == 0) | F.array_contains("_endings", F.col("_suffix")))
    hits = hits.where(F.col("_told") | F.call_function("rlike", F.col("code"), pattern)).drop("_endings", "_suffix", "_told")
    # what stands before the first match; an empty match at the start parts nothing off
    before = F.when(F.call_function("regexp_instr", F.col("code"), pattern) == 1, 0).otherwise(F.char_length(F.get(F.split("code", pattern, F.lit(2)), F.lit(0))))
    return hits.withColumn("matched_text", F.call_function("regexp_extract", F.col("code"), pattern, F.lit(0))).withColumn("column", before)


def is_dynamic(code: Column) -> Column:
    return F.rlike(F.coalesce(code, F.lit("")), F.lit("(?i)" + "|".join(fixed.DYNAMIC_HINTS)))


def has_extra(code: Column, extra: Column) -> Column:
    """Whether code matches one of a rule's extra patterns; a rule without any passes."""
    return (F.size(extra) == 0) | F.exists(extra, lambda p: F.call_function("rlike", code, p))


def staged(hits: DataFrame, target: str | None = None, in_code: Column | None = None, override: Column | None = None) -> DataFrame:
    """hits with stage: the filter that drops them, or kept. in_code: false in a comment or string. override: where it
    isn't null, it decides instead of the dynamic and extra filters."""
    override = F.lit(None).cast("boolean") if override is None else override
    static = F.col("needs_dynamic") & ~is_dynamic(F.col("code"))
    stage = (
        F.when(paths.skip_reason(F.col("file")).isNotNull(), "filtered_by_path")
        .when(~paths.in_scope(F.col("file"), target), "filtered_by_scope")
        .when(F.lit(False) if in_code is None else ~in_code, "filtered_by_comment")
        .when(F.coalesce(~override, static), "filtered_by_dynamic")
        .when(override.isNull() & ~has_extra(F.col("code"), F.col("extra")), "filtered_by_extra")
    )
    return hits.withColumn("stage", stage.otherwise("kept"))


def funnel(hits: DataFrame) -> DataFrame:
    """One row: all hits and those that each stage took, in one pass."""
    return hits.agg(F.count("*").alias("rg_raw"), *(F.count_if(F.col("stage") == s).alias(s) for s in STAGES))


def skipped(rules: DataFrame, kept: DataFrame) -> DataFrame:
    """Rules without a kept hit."""
    return rules.join(kept.select("rule_id").distinct(), "rule_id", "left_anti").withColumn("reason", F.lit("no_rg_match"))


def one_a_line(kept: DataFrame) -> DataFrame:
    """Of the hits on a line the most severe, the first rule of equal ones: an aggregation, so a crowded line is summed first."""
    rank = F.struct((-verdicts.severity_rank(F.col("severity"))).alias("s"), F.col("rule_ord"))
    best = kept.groupBy("file", "line").agg(F.min_by(F.struct(*(c for c in kept.columns if c not in ("file", "line"))), rank).alias("best"))
    return best.select("file", "line", "best.*")


def work_order() -> list[Column]:
    """Severe first, then shallow files, then files from the end of the alphabet, then lines."""
    return [verdicts.severity_rank(F.col("severity")).desc(), F.size(F.split("file", "/")).asc(), F.col("file").desc(), F.col("line").asc()]


def output_order(*ties: Column) -> list[Column]:
    """Chains as they are written: by level, severity and whether they have a call chain, all falling; then as they came (ties)."""
    return [verdicts.level_rank(F.col("level")).desc(), F.coalesce(verdicts.severity_rank(F.col("severity")), F.lit(0)).desc(), F.coalesce("has_call_chain", F.lit(False)).desc(), *ties]


def model_needed(impact: Column, enabled: Column | bool = True) -> Column:
    """Whether a model has to look for callers: if it may, and no target in impact (JSON text) has any."""
    targets = F.map_values(F.coalesce(F.from_json(impact, "targets map<string, struct<callers: array<string>>>")["targets"], F.create_map().cast("map<string, struct<callers: array<string>>>")))
    has = F.exists(targets, lambda x: F.coalesce(F.size(x["callers"]) > 0, F.lit(False)))
    return (F.lit(enabled) if isinstance(enabled, bool) else enabled) & ~F.coalesce(has, F.lit(False))


def chain_id(hits: DataFrame) -> Column:
    return F.concat(F.lit("C-"), F.left(F.sha1(F.concat_ws(":", "language", "vulnerability_type", "rule_id", "file", F.col("line").cast("string"), "code")), F.lit(12)))


def overview(rules: DataFrame, top: int = 4) -> DataFrame:
    """For each language its rules, kinds, and its `top` commonest kinds."""
    kinds = rules.groupBy("language", "vulnerability_type").agg(F.count("*").alias("n"))
    ranked = kinds.withColumn("place", F.row_number().over(W.partitionBy("language").orderBy(F.col("n").desc(), "vulnerability_type")))
    return ranked.groupBy("language").agg(
        F.sum("n").alias("rules"),
        F.count("*").alias("kinds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= top, F.struct("place", F.concat_ws(":", "vulnerability_type", F.col("n").cast("string")).alias("shown"))))), lambda x: x["shown"]), ", ").alias("top"),
    )


def languages(stack: DataFrame) -> DataFrame:
    """project, language, first for the technologies (project, place, technology) of project profiles."""
    from ..functions.text import lookup

    named = stack.select("project", "place", lookup(F.lower(F.btrim("technology")), fixed.TECHNOLOGIES).alias("language")).where("language is not null")
    return named.groupBy("project", "language").agg(F.min("place").alias("first"))


def grep(lines: DataFrame, pattern: str, ignore_case: bool = False, fixed_text: bool = False, word: bool = False, endings: tuple[str, ...] = (), globs: tuple[str, ...] = ()) -> DataFrame:
    """Lines that match, with n_matches, of files with one of the endings, if any, that fit one of the globs, if any."""
    own = ("\\Q" + pattern + "\\E") if fixed_text else pattern
    own = ("(?i)" if ignore_case else "") + (f"\\b(?:{own})\\b" if word else own)
    return grep_scope(lines, endings, globs).where(F.rlike("code", F.lit(own))).withColumn("n_matches", F.regexp_count("code", F.lit(own)))


def grep_scope(lines: DataFrame, endings: tuple[str, ...] = (), globs: tuple[str, ...] = ()) -> DataFrame:
    if endings:
        lines = lines.where(paths.suffix(F.col("file")).isin(*endings))
    if globs:
        lines = lines.where(reduce(or_, (paths.glob(F.col("file"), g) for g in globs)))
    return lines


def grep_page(found: DataFrame, most: int = 30) -> DataFrame:
    """The first results by file and line."""
    return found.orderBy("file", "line").limit(most)


def grep_count(found: DataFrame) -> DataFrame:
    """One row: lines and matches within them."""
    return found.agg(F.count("*").alias("lines"), F.coalesce(F.sum("n_matches"), F.lit(0)).cast("long").alias("matches"))


def grep_files(files: DataFrame, most: int = 100) -> DataFrame:
    """The first file names, each once."""
    return files.select("file").distinct().orderBy("file").limit(most)


def context(lines: DataFrame, hit: Column, around: int) -> DataFrame:
    """Lines within `around` lines of one for which hit holds, in the same file."""
    near = F.max(F.when(hit, 1)).over(W.partitionBy("file").orderBy("line").rangeBetween(-around, around))
    return lines.withColumn("_near", near).where("_near = 1").drop("_near")
