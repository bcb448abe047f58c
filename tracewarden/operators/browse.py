"""Artifact pages: filters, keyword, offset and limit over findings, chains and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Default and largest page sizes by kind of artifact.
PAGES = {"audit": (50, 500), "jsonl": (100, 1_000), "markdown": (30, 300), "logs": (30, 200), "events": (500, 5_000), "console": (2_000, 20_000)}


def page_size(kind: str, asked: int | None = None) -> int:
    default, most = PAGES[kind]
    if asked is not None and asked > most:
        raise ValueError(f"at most {most} rows of {kind}")
    return default if asked is None else asked


def equal(column: str, wanted: str | None) -> Column:
    return F.lit(True) if not wanted else F.lower(F.coalesce(F.col(column), F.lit(""))) == wanted.lower()


def keyword(columns: list[str], word: str | None) -> Column:
    """Whether the lower-case word is in one of the columns' values."""
    if not word:
        return F.lit(True)
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(word.lower()))
    return found


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows in order from offset on; a limit of 0 or less means all the rest."""
    out = rows.orderBy(*order).offset(offset)
    return out.limit(limit) if limit > 0 else out


def findings(rows: DataFrame, order: list[Column], severity: str | None = None, verdict: str | None = None, word: str | None = None, within: list[str] | None = None, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The number of publishable findings that fit, as a one-row table, and a page of them."""
    fit = rows.where("publishable").where(equal("severity", severity) & equal("verdict", verdict) & keyword(within or rows.columns, word))
    return fit.agg(F.count("*").alias("total")), page(fit, order, offset, limit)
