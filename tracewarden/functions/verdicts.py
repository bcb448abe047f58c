"""Column functions that coerce loosely written findings: confidence, verdict, severity, missing evidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .text import any_contains, first_true, lookup, stripped


def severity_rank(severity: Column) -> Column:
    """4 critical to 1 low, 0 for anything else."""
    return lookup(severity, fixed.SEVERITIES, F.lit(0))


def level(value: Column) -> Column:
    """L0, L1 or L2; anything else is L0."""
    upper = F.upper(F.coalesce(value, F.lit("L0")))
    return F.when(upper.isin(*fixed.LEVELS), upper).otherwise("L0")


def level_rank(value: Column) -> Column:
    return lookup(level(value), fixed.LEVELS)


def confidence(value: Column, default: float = 0.5) -> Column:
    """A confidence from text: a word, a sign, a percentage or a number; out of range it is the default."""
    key = F.translate(F.lower(stripped(value)), "- /", "___")
    percent = F.regexp_extract(key, r"^(.*)%$", 1).try_cast("double") / 100
    signs = first_true([(F.contains(value, F.lit(w)), v) for w, v in fixed.CONFIDENCE_SIGNS.items()])
    number = F.coalesce(lookup(key, fixed.CONFIDENCES), signs, F.when(F.endswith(key, F.lit("%")), percent).otherwise(key.try_cast("double")), F.lit(default))
    scaled = F.when((number > 1) & (number <= 100), number / 100).otherwise(number)
    return F.when((scaled >= 0) & (scaled <= 1), scaled).otherwise(F.lit(default))


def verdict(value: Column, careful: bool = False) -> Column:
    """vulnerable, safe or uncertain. A text with a sign of safety is safe, even `unsafe`; careful takes that back."""
    text = F.lower(stripped(F.coalesce(value, F.lit("uncertain"))))
    if careful:
        text = F.regexp_replace(text, "unsafe", "vulnerable")
    return first_true([(text.isin(*fixed.VERDICTS), text), (any_contains(text, fixed.SAFE_SIGNS), "safe"), (any_contains(text, fixed.VULNERABLE_SIGNS), "vulnerable")], "uncertain")


def guarded(verdict_: Column, confidence_: Column, missing: Column) -> tuple[Column, Column]:
    """Verdict and confidence after the guard rails: vulnerable needs a confidence of 0.5 and nothing missing."""
    weak = (verdict_ == "vulnerable") & (confidence_ < 0.5)
    open_ = (verdict_ == "vulnerable") & ~weak & (F.size(missing) > 0)
    return F.when(weak | open_, "uncertain").otherwise(verdict_), F.when(open_, F.least(confidence_, F.lit(0.6))).otherwise(confidence_)


def breakpoint_of(value: Column) -> Column:
    """The missing kind that a free text names; null if it names none."""
    text = F.lower(stripped(F.coalesce(value, F.lit(""))))
    exact = [(text.isin(*fixed.BREAKPOINTS), text), (text.isin(*fixed.EVIDENCE_BREAKPOINTS), lookup(text, fixed.EVIDENCE_BREAKPOINTS))]
    return first_true(exact + [(any_contains(text, words), kind) for kind, words in fixed.BREAKPOINT_WORDS])


def cwe(vulnerability_type: Column) -> Column:
    return lookup(vulnerability_type, fixed.CWES, F.lit(fixed.UNKNOWN_CWE))


def clamped(value: Column, least: int, most: int, default: int) -> Column:
    """A whole-number option from text within bounds; the default where it is none."""
    number = value.try_cast("long")
    return F.when(number.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), number))).cast("int")


def text_items(value: Column) -> Column:
    """A list from an array of texts: trimmed, without empty ones."""
    return F.filter(F.transform(F.coalesce(value, F.array().cast("array<string>")), lambda x: stripped(x)), lambda x: x.isNotNull() & (x != ""))


def once(values: Column) -> Column:
    """Trimmed values without empty ones, each at its first place."""
    return F.array_distinct(text_items(values))


def publishable(finding_title: Column, stopped: Column, principle: Column, n_evidence: Column, n_missing: Column) -> Column:
    """False for failed calls and for placeholders without any reasoning."""
    title = stripped(F.coalesce(finding_title, F.lit("")))
    failed = (stripped(F.coalesce(stopped, F.lit(""))) == "llm_error") | F.startswith(title, F.lit("LLM 调用失败"))
    hollow = (title == "tool-loop exhausted") & (F.coalesce(principle, F.lit("")) == "") & (F.coalesce(n_evidence, F.lit(0)) == 0) & (F.coalesce(n_missing, F.lit(0)) == 0)
    return ~(failed | hollow)
