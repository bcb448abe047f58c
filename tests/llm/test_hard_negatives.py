"""Hard negatives against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import hard_negatives, queries


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    """rows: (vec_id, embedding, label), one a vec_id."""
    fit = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        ints = [math.floor(scale * x) for x in e]
        if sum(x * x for x in ints) < 2**62:
            fit[i] = (label, ints)
    out = []
    for a in (i for i in fit if i % every == 0):
        label, own = fit[a]
        score = {i: sum(x * y for x, y in zip(own, v, strict=False)) for i, (_, v) in fit.items() if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if fit[i][0] == label][:positives]:
            fits = [i for i in ranked if fit[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits[:negatives])]
    return sorted(out)


def found(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def test_query(spark, sf):
    at = sf("0.001")
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in pq.read_table(f"{at}/embeddings.parquet").to_pylist()]
    expected = brute(rows)
    assert len(expected) > 100 and found(queries.op12_hard_negatives(spark, at)) == expected


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(3) for c in ("ints", "own", "block", "range", "number")}).repartition(3)


@pytest.mark.parametrize("decay", [1.0, 0.6])
def test_small_blocks(spark, monkeypatch, decay):
    """Many blocks, ties, repeated vectors, a label with most rows, and spectra that let rows go early."""
    monkeypatch.setattr(hard_negatives, "DATA_ROWS", 50)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 7)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 24)) * decay ** np.arange(24) + 0.3
    x[200:260] = x[100:160]
    rows = [(i, v.tolist(), int(rng.integers(0, 5)) if i % 3 else 1) for i, v in enumerate(x)]
    expected = brute(rows, every=20)
    assert expected and found(hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 20 == 0)) == expected


def test_edges(spark):
    e = [0.5, 0.25, -0.125]
    rows = [(0, e, 1), (1, e, 1), (2, [0.4, 0.2, -0.1], 2), (3, [0.3, 0.3], 2), (4, [], 2), (5, None, 2), (6, e, None), (None, e, 2), (8, [None, 1.0, 1.0], 2), (9, [math.nan, 1.0], 2), (11, [math.inf], 2)]
    rows += [(20, [-x for x in e], 1), (40, [0.0, 0.0, 0.0], 1), (60, e, 7), (12, [1e300, 1.0], 2), (13, [4e6] * 3, 2), (14, [0.3, 0.2, 0.0], 3), (80, [3e6] * 3, 1), (81, [3e6, 3e6, 2.9e6], 1)]
    expected = brute(rows, every=20)
    assert expected and found(hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 20 == 0)) == expected
    # of rows of one vec_id the smallest label counts
    again = [*rows, (2, e, 9), (2, [0.4, 0.2, -0.1], 2)]
    assert found(hard_negatives.hard_negatives(table(spark, again), F.col("vec_id") % 20 == 0)) == expected


def test_empty_tables(spark):
    for rows in ([], [(0, None, 1)], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, [], 1), (1, [], 1), (2, [], 2)]):
        assert found(hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0)) == brute(rows)


def test_bounds_hold():
    """No row of the exact answer goes early, and on a steep spectrum few are verified."""
    rng = np.random.default_rng(9)
    x = np.floor(256 * rng.standard_normal((600, 32)) * 0.7 ** np.arange(32)).astype(np.int64)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1]
    block = lambda a: hard_negatives._Block({"rows": len(a), "ids": np.arange(len(a)).tobytes(), "own": np.zeros(len(a), np.int64).tobytes(), "ints": a.astype(np.int32).tobytes(), "low": b"", "high": b""}, "", axes)
    a, d, scores = block(x[:20]), block(x[20:]), x[:20] @ x[20:].T
    verified, real = [], hard_negatives._products
    low, high = np.full(20, 1000), np.full(20, 150_000)
    try:
        hard_negatives._products = lambda p, q, i, j: (verified.append(len(i)) if p.dtype == np.int64 else None, real(p, q, i, j))[1]
        (i, j, score), = hard_negatives.best(a, d, np.ones((20, 580), bool), [6, 12], [(low, high)], 10)
    finally:
        hard_negatives._products = real
    for row in range(20):
        fits = sorted((-s, k) for k, s in enumerate(scores[row].tolist()) if 1000 <= s <= 150_000)[:10]
        assert list(zip((-score[i == row]).tolist(), j[i == row].tolist(), strict=True)) == fits
    assert sum(verified) < 0.2 * scores.size
