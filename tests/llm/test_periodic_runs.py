"""Periodic runs against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import words
from pyspark.sql import functions as F

from tracewarden.llm import periodic_runs, queries


def brute(own, least=12):
    """(start, length, period) of all runs, and the words that stay."""
    best = {}
    for q in range(1, len(own) // 2 + 1):
        i = 0
        while i < len(own) - q:
            start = i
            while i < len(own) - q and own[i] == own[i + q]:
                i += 1
            if i - start >= max(q, least - q):
                best.setdefault((start, i + q), q)
            i += i == start
    found = sorted((s, e - s, q) for (s, e), q in best.items())
    found.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return found, [w for i, w in enumerate(own) if i not in gone]


def test_query(spark, sf):
    at, periodic = sf("0.001"), 0
    docs = pq.read_table(f"{at}/documents.parquet").to_pylist()
    found = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, at).collect()}
    assert len(found) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d in docs:
        own, h = words(d["text"]), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and own:
            g = h // 10
            a = g % len(own)
            p = 1 + (len(own) - a) // (3 + g % 8)
            own = [own[a + (i - a) % p] if i >= a else w for i, w in enumerate(own)]
        runs, kept = brute(own)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        milli = 1000 * top[1] // top[2] if runs else None
        r, periodic = found[d["doc_id"]], periodic + bool(runs)
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *top, milli)
        assert (r["runs_sha256"], r["collapsed_sha256"]) == (sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept)))
    assert periodic > 5


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_segments(least):
    rng = random.Random(1)
    for _ in range(500):
        segments = []
        for _ in range(rng.randint(1, 4)):
            n, pattern = rng.randint(1, 60), [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 12))]
            segments.append([pattern[i % len(pattern)] if rng.random() < 0.97 else 9 for i in range(n)])
        bounds = np.append(0, np.cumsum([len(s) for s in segments]))
        s, e, q = periodic_runs.runs(np.array(sum(segments, []), np.uint64), bounds, least)
        expected = [(a + int(o), n, p) for o, own in zip(bounds, segments, strict=False) for a, n, p in brute(own, least)[0]]
        assert list(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)) == sorted(expected, key=lambda r: (r[0], r[2]))


def test_hashes_that_collide(monkeypatch):
    """Where prefix hashes err, segments are gone through without them; words that share a hash are told apart."""
    monkeypatch.setattr(periodic_runs, "mix", lambda x: x * np.uint64(0))
    own = [1, 2, 3] * 6 + [5, 1, 2] + [7, 8] * 9
    s, e, q = periodic_runs.runs(np.array(own * 2, np.uint64), np.array([0, len(own), 2 * len(own)]))
    one = brute(own)[0]
    assert list(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)) == one + [(a + len(own), n, p) for a, n, p in one]
    data = np.frombuffer(b"aa bb aa", np.uint8)
    assert periodic_runs._distinct(data, np.array([0, 3, 6]), np.array([2, 5, 8]), np.zeros(3, np.uint64)).tolist() == [0, 1, 0]


@pytest.mark.parametrize("piece", [1 << 19, 200])
def test_edges(spark, monkeypatch, piece):
    monkeypatch.setattr(periodic_runs, "PIECE_BYTES", piece)
    rng = random.Random(13)
    texts = [None, "", " \n\t ", "a", "a " * 11, "a " * 12, "a " * 13, "x y " * 3, "x y " * 6, "日本 ÀB\n" * 9, "A a " * 8, " ".join("abcdefghijklm" * 2), "a b c d e f g " * 2]
    for i in range(60):
        own = [f"w{rng.randrange(3 + i)}" for _ in range(rng.choice([10, 50, 200]))]
        at, p = rng.randrange(len(own)), rng.randint(1, 15)
        own[at:at] = (own[:p] * 6)[: rng.randint(1, 6) * p]
        texts.append("".join(w + rng.choice([" ", "\n", "\t\t"]) for w in own))
    long = [f"w{rng.randrange(5_000)}" for _ in range(3_000)]
    texts += [" ".join(long * 7), "z " * 30_000, texts[15], texts[15]]
    docs = spark.createDataFrame([(i, t, 4, 4) for i, t in enumerate(texts)], "doc_id long, text string, runs int, row int").repartition(3)
    out = periodic_runs.periodic_runs(docs, "doc_id", "row", "runs").collect()
    assert len(out) == len(texts) and all(r["row"] == 4 for r in out)
    for r in out:
        own = words(texts[r["doc_id"]])
        if len(own) > 20_000:  # known answers: one run
            q = 1 if own[0] == "z" else 3_000
            assert [tuple(x) for x in r["runs"]] == [(0, len(own), q)] and r["collapsed"] == " ".join(own[:q])
            continue
        runs, kept = brute(own)
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (len(own), runs, " ".join(kept))


def test_mask(spark):
    """Only words of repeated 6-grams come to Main-Lorentz."""
    own = [f"w{i}" for i in range(100)]
    own[50:58] = own[10:18]
    hashes = np.array([hash(w) for w in own], np.int64).astype(np.uint64)
    a, b = periodic_runs.masked(hashes, np.array([0, 100]), 6)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(10, 18), (50, 58)]
    assert not len(periodic_runs.masked(hashes, np.array([0, 50, 100]), 6)[0])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(docs, "doc_id").collect() == [] and periodic_runs.planted(docs).collect() == []
    assert periodic_runs.periodic_runs(docs.select(F.lit(1).alias("doc_id"), F.lit("a").alias("text")), "doc_id").count() == 0
