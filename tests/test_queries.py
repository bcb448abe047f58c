"""Every query with SQL gives DuckDB's rows on the small tables; the others run."""

from __future__ import annotations

import collections

import duckdb
import pytest

from tracewarden.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf('0.001')}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    found = QUERIES[name](spark, sf("0.001"))
    rows = found.collect()
    if name not in ORACLES:
        assert rows
        return
    expected = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in found.schema} == {c: str(t) for c, t in zip(expected.columns, expected.types, strict=True)}
    order = sorted(found.columns)
    own = collections.Counter(tuple(r[c] for c in order) for r in rows)
    at = [expected.columns.index(c) for c in order]
    assert own == collections.Counter(tuple(r[i] for i in at) for r in expected.fetchall())
