"""The registry of queries: a function over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


def cases(pairs, otherwise: str = "NULL") -> str:
    """CASE over (condition, SQL value) pairs."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def mapped(column: str, table: dict, otherwise: str = "NULL") -> str:
    show = lambda v: quoted(v) if isinstance(v, str) else str(v)
    return cases([(f"{column} = {quoted(k)}", show(v)) for k, v in table.items()], otherwise)
