"""Second opinions: targets and results of the checker, human marks, quality of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, verdicts
from ..functions.text import stripped

TRACKS = ("codex", "manual", "cc")


def targets(findings: DataFrame, chain_id: str | None = None) -> DataFrame:
    """Vulnerable findings, or the one with the given id; that it exists is an assertion of the job."""
    if chain_id is None:
        return findings.where(F.lower(F.coalesce("verdict", F.lit(""))) == "vulnerable")
    one = findings.where(F.col("chain_id") == chain_id)
    if one.isEmpty():
        raise ValueError(f"no finding {chain_id}")
    return one


def checked(answers: DataFrame) -> DataFrame:
    """Checker results of answers(finding_id, verdict, confidence, concrete_payload, severity_revised as texts): unknown
    verdicts need context, a confirmation without a payload is refuted at 0.7 at most."""
    told = F.lower(stripped(F.coalesce("verdict", F.lit("need_context"))))
    verdict = F.when(told.isin(*fixed.CHECKER_VERDICTS), told).otherwise("need_context")
    payload = F.nullif(stripped(F.col("concrete_payload")), F.lit(""))
    sure = F.coalesce(verdicts.confidence(F.col("confidence")), F.lit(0.5))
    empty = (verdict == "confirmed") & payload.isNull()
    severity = F.lower(stripped(F.col("severity_revised")))
    known = [c for c in answers.columns if c not in ("verdict", "confidence", "concrete_payload", "severity_revised")]
    return answers.select(*known, F.when(empty, "refuted").otherwise(verdict).alias("verdict"), F.when(empty, F.least(sure, F.lit(0.7))).otherwise(sure).alias("confidence"), payload.alias("concrete_payload"), F.when(severity.isin(*fixed.SEVERITIES), severity).alias("severity_revised"))


def checker_summary(results: DataFrame, targets: int, failed: int, partial: bool = False) -> DataFrame:
    """One row: counts by verdict and the status of the run."""
    count = F.count("*")
    status = F.when(F.lit(targets == 0), "no_vulnerable_findings").when((count == 0) & F.lit(failed > 0), "error").when(F.lit(partial or failed > 0), "partial").otherwise("ok")
    return results.agg(status.alias("status"), F.lit(targets).cast("long").alias("total_targets"), count.alias("total_checked"), *(F.count_if(F.col("verdict") == v).alias(v) for v in fixed.CHECKER_VERDICTS), F.lit(failed).cast("long").alias("failed"))


def normal_marks(marks: DataFrame) -> DataFrame:
    """Marks with every track's verdict and review as texts; old fields (user_verdict, note) go to the manual track where it
    is empty; empty marks go. marks(chain_id, favorite, <track>_verdict, <track>_review, user_verdict, note)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = {f"{t}_{k}": blank(f"{t}_{k}") for t in TRACKS for k in ("verdict", "review")}
    old = {"manual_verdict": F.coalesce(F.nullif("manual_verdict", F.lit("")), blank("user_verdict")), "manual_review": F.coalesce(F.nullif("manual_review", F.lit("")), blank("note"))}
    rows = marks.withColumns(own | old | {"favorite": F.coalesce("favorite", F.lit(False))})
    filled = F.col("favorite")
    for name in own:
        filled = filled | (F.col(name) != "")
    return rows.where(filled).select("chain_id", "favorite", *own)


def upsert(marks: DataFrame, changes: DataFrame) -> DataFrame:
    """marks after changes(chain_id, track, verdict, review, favorite; null keeps, verdict clear empties), one change a chain
    and track: the changes are pivoted to the marks' columns, joined once, and marks left empty go."""
    flat = {}
    for t in TRACKS:
        own = F.col("track") == t
        flat[f"{t}_verdict"] = F.max(F.when(own, F.when(F.col("verdict") == "clear", "").otherwise(F.col("verdict")))).alias(f"_{t}_verdict")
        flat[f"{t}_review"] = F.max(F.when(own, F.col("review"))).alias(f"_{t}_review")
    wide = changes.groupBy("chain_id").agg(*flat.values(), F.max("favorite").alias("_favorite"))
    rows = marks.join(wide, "chain_id", "full")
    merged = rows.select("chain_id", F.coalesce("_favorite", "favorite").alias("favorite"), *(F.coalesce(f"_{c}", c).alias(c) for c in flat))
    return normal_marks(merged.withColumns({"user_verdict": F.lit(None).cast("string"), "note": F.lit(None).cast("string")}))


def with_marks(findings: DataFrame, marks: DataFrame, types: list[str] | None = None, favorites: bool = False, track: str = "manual", wanted: list[str] | None = None) -> DataFrame:
    """Findings with their marks, filtered by type, favourite and a track's verdicts; none stands for unmarked."""
    rows = findings.join(marks, "chain_id", "left")
    if types:
        rows = rows.where(F.col("vulnerability_type").isin(*types))
    if favorites:
        rows = rows.where(F.coalesce("favorite", F.lit(False)))
    if wanted:
        rows = rows.where(F.coalesce(F.nullif(F.col(f"{track}_verdict"), F.lit("")), F.lit("none")).isin(*wanted))
    return rows


def quality(vulnerable: DataFrame, marks: DataFrame, missed: int | None = None) -> DataFrame:
    """One row: marks of vulnerable findings by verdict, precision, recall and F1 (null where undefined). missed: known
    misses; the count is a parameter because it comes from the scans, not from marks."""
    own = marks.join(vulnerable.select("chain_id").distinct(), "chain_id", "left_semi")
    verdict = F.coalesce(*(F.nullif(F.col(f"{t}_verdict"), F.lit("")) for t in ("manual", "codex")))
    n = lambda v: F.count_if(verdict == v)
    counts = own.agg(n("true_positive").alias("true_positives"), n("false_positive").alias("false_positives"), n("uncertain").alias("uncertain"), F.lit(missed or 0).cast("long").alias("missed"))
    precision = F.try_divide("true_positives", F.col("true_positives") + F.col("false_positives"))
    recall = F.try_divide("true_positives", F.col("true_positives") + F.col("missed"))
    return counts.withColumns({"precision": precision, "recall": recall}).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
