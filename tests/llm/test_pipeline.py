"""The corpus pipeline against plain versions of its stages, each on the stage's own input."""

from __future__ import annotations

import threading
from collections import Counter, defaultdict

import brute
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tracewarden.llm import language_id, queries, shared
from tracewarden.llm.line_dedup import MIN_SITES
from tracewarden.llm.shared import stored


@pytest.fixture(scope="module")
def steps(spark, sf):
    """What each stage gets and gives, as rows."""
    docs = spark.read.parquet(f"{sf('0.001')}/documents.parquet")
    out = [[r.asDict() for r in docs.collect()]]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf("0.001")), name)
        out.append([r.asDict() for r in docs.collect()])
    return out


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash", "mixing", "packing"]


def test_all_but_the_last_keep_the_columns(steps, sf):
    names = pq.read_schema(f"{sf('0.001')}/documents.parquet").names
    assert all(list(rows[0]) == names for rows in steps[:-1])


def test_language_id(steps):
    before, after = steps[:2]
    learned = [(r["text"], r["lang"]) for r in before if not _held(r["doc_id"])]
    found = brute.language(learned, [r["text"] for r in before])
    expected = {r["doc_id"]: lang for r, (lang, score) in zip(before, found, strict=True) if lang != "und" and score >= corpus_pipeline.MIN_SCORE}
    assert {r["doc_id"]: r["lang"] for r in after} == expected
    assert len(after) >= 0.97 * len(before)  # clean documents stay


def _held(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_line_dedup(steps):
    before, after = steps[1:3]
    expected = brute.line_dedup([(r["doc_id"], r["text"], r["source"]) for r in before], MIN_SITES)
    kept = {i: text for i, (n, gone, text) in expected.items() if not n or gone < n}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after} == {i: (t, len(t)) for i, t in kept.items()}


def test_minhash(steps):
    before, after = steps[2:4]
    expected = brute.near_duplicates([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, c) in expected.items() if i == c)


def test_mixing(steps):
    before, after = steps[3:5]
    expected = brute.mixing([(r["doc_id"], r["text"], r["source"]) for r in before])
    assert Counter(r["doc_id"] for r in after) == Counter({i: taken // size for i, (size, _, _, taken) in expected.items() if taken})


def test_packing(steps):
    before, after = steps[4:6]
    path = queries.vocabulary("word_bpe_49k.json")
    once = {r["doc_id"]: r["text"] for r in before}
    pieces, copies = brute.packed_ids(once.items(), path), Counter(r["doc_id"] for r in before)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after) == Counter({(i, k, *v): copies[i] for (i, k), v in pieces.items()})
    own = defaultdict(int)
    for r in after:
        own[r["sequence_id"]] += r["length"]
    assert max(own.values()) <= 2048
    assert len({(r["sequence_id"], r["offset"]) for r in after}) == len(after)


def test_everything_survives_nothing(spark, sf, tmp_path):
    """Empty tables stay empty. Of rows with nulls, two have a letter, one of them twice, and each is taken once."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    some = [(None, None, None, None, None), (None, "a b", None, None, None), (1, "", "en", None, 0), (2, "the cat sat", "en", "s", 11), (2, "the cat sat", "en", "s", 11)]
    for rows, expected in (([], []), (some, [None, 2])):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, str(tmp_path)), name)
        assert sorted((r["doc_id"] for r in docs.collect()), key=str, reverse=True) == expected


def test_runs_side_by_side(spark, sf):
    """Two runs in threads of one driver, beside a table that neither has written: the same rows, and nothing of the others is deleted."""
    at, results = sf("0.001"), {}
    other = shared.stored(spark.range(10), "other")

    def go(n):
        results[n] = sorted(map(tuple, corpus_pipeline.run(spark, at).collect()), key=repr)

    threads = [threading.Thread(target=go, args=(n,)) for n in (0, 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert results[0] and results[0] == results[1] and other.count() == 10
