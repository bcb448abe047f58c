"""Every registered corpus query over a whole small table, against plain Python."""

from __future__ import annotations

import zlib
from collections import defaultdict

import brute
import pyarrow.parquet as pq
import pytest

from tracewarden.llm import queries, token_counts
from tracewarden.llm.line_dedup import MIN_SITES


@pytest.fixture(scope="module")
def at(sf):
    return sf("0.001")


@pytest.fixture(scope="module")
def docs(at):
    return pq.read_table(f"{at}/documents.parquet").to_pylist()


def rows(query, spark, at):
    return [r.asDict() for r in query(spark, at).collect()]


def test_line_dedup(spark, at, docs):
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in rows(queries.op1_line_dedup, spark, at)}
    expected = brute.line_dedup([(d["doc_id"], d["text"], d["source"]) for d in docs], MIN_SITES)
    assert found == {k: (n, gone, None if t is None else brute.sha(t)) for k, (n, gone, t) in expected.items()}


def test_substring_dedup(spark, at, docs):
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(queries.op2_substring_dedup, spark, at)}
    expected = brute.substring_dedup([(d["doc_id"], d["text"]) for d in docs])
    assert found == {k: (n, gone, brute.sha(t)) for k, (n, gone, t) in expected.items()}
    assert any(v[1] for v in found.values())


def test_embedding_dedup(spark, at):
    table = pq.read_table(f"{at}/embeddings.parquet").to_pylist()
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(queries.op3_embedding_dedup, spark, at)}
    assert found == brute.embedding_dedup([(r["vec_id"], r["embedding"], r["label"]) for r in table])


def test_mixing(spark, at, docs):
    found = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in rows(queries.op4_mixing, spark, at)}
    expected = brute.mixing([(d["doc_id"], d["text"], d["source"]) for d in docs])
    assert {k: v[:2] + v[3:] for k, v in found.items()} == {k: v[:2] + v[3:] for k, v in expected.items()}
    assert {k: v[2] for k, v in found.items()} == pytest.approx({k: v[2] for k, v in expected.items()})
    taken, target, largest = defaultdict(int), {}, max(v[0] for v in found.values())
    for d in docs:
        taken[d["source"]] += found[d["doc_id"]][3]
        target[d["source"]] = found[d["doc_id"]][2]
    assert all(abs(taken[s] - target[s]) <= largest for s in target)


def test_language_id(spark, at, docs):
    found = {r["doc_id"]: r for r in rows(queries.op5_language_id, spark, at)}
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0 for d in docs}
    assert {k: r["held_out"] for k, r in found.items()} == held
    expected = brute.language([(d["text"], d["lang"]) for d in docs if not held[d["doc_id"]]], [d["text"] for d in docs])
    for d, (lang, score) in zip(docs, expected, strict=True):
        assert found[d["doc_id"]]["lang_pred"] == lang and found[d["doc_id"]]["score"] == pytest.approx(score, abs=1e-9)
    asked = [d for d in docs if held[d["doc_id"]]]
    assert sum(found[d["doc_id"]]["lang_pred"] == d["lang"] for d in asked) >= 0.95 * len(asked)


def test_minhash(spark, at, docs):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(queries.op6_minhash, spark, at)}
    assert found == brute.near_duplicates([(d["doc_id"], d["text"]) for d in docs])
    assert any(k != c for k, (_, c) in found.items())


def test_exact_dedup(spark, at, docs):
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(queries.op7_exact_dedup, spark, at)}
    assert found == brute.exact([(d["doc_id"], d["text"]) for d in docs])


def test_packing(spark, at, docs):
    found = rows(queries.op8_packing, spark, at)
    pieces = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found}
    assert len(pieces) == len(found)
    assert pieces == brute.packed_ids([(d["doc_id"], d["text"]) for d in docs], queries.vocabulary("word_bpe_49k.json"))
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    least = -(-sum(r["length"] for r in found) // 2048)
    assert len(sequences) <= 1.01 * least + 2
    assert len(sequences) <= brute.sequences([r["length"] for r in found])


def test_token_counts(spark, at, docs):
    vocabulary = token_counts.Vocabulary.load(queries.vocabulary("piece_bpe_32k.model"))
    found = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in rows(queries.op9_token_counts, spark, at)}
    for d in docs:
        assert found[d["doc_id"]] == brute.token_count(d["text"], vocabulary)
    assert set(found) == {d["doc_id"] for d in docs}


def test_warc(spark, at):
    pages = pq.read_table(f"{at}/pages.parquet").to_pylist()
    found = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(queries.op10_warc, spark, at)}
    assert found == brute.warc([(p["page_id"], p["html"]) for p in pages])
