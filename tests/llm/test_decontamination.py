"""Benchmark decontamination against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest
from brute import lower
from pyspark.sql import functions as F

from tracewarden.llm import decontamination, queries

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, width=10):
    """(n_words, hit words, items) of each text."""
    grams = {}
    for item, text in items:
        own = PLAIN.findall(lower(text))
        for p in range(max(1, len(own) - width + 1) if own else 0):
            grams.setdefault(tuple(own[p : p + width]), set()).add(item)
    lengths, out = sorted({len(g) for g in grams}), []
    for text in docs:
        own, hit, met = PLAIN.findall(lower(text)), set(), set()
        for k in lengths:
            for p in range(len(own) - k + 1):
                if (items_of := grams.get(tuple(own[p : p + k]))) is not None:
                    hit |= set(range(p, p + k))
                    met |= items_of
        out.append((len(own), hit, met - {None}))
    return out


def test_query(spark, sf):
    at = sf("0.001")
    docs, items = (pq.read_table(f"{at}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    found = {r["doc_id"]: r for r in queries.op11_decontamination(spark, at).collect()}
    assert len(found) == len(docs)
    for d, (n, hit, met) in zip(docs, brute([d["text"] for d in docs], [(i["item_id"], i["text"]) for i in items]), strict=True):
        digest = hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest()
        r = found[d["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, len(hit), len(met), digest, bool(hit))
    assert any(r["contaminated"] for r in found.values()) and not all(r["contaminated"] for r in found.values())


@pytest.fixture(scope="module")
def messy():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)] + ["Zürich", "日本", "ÀB", "1", "don't", "a-b"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 11, 40])))) for i in range(40)]
    items += [(3, items[7][1] + "!"), (None, "only here nameless words stand"), (50, None), (51, ""), (52, "... !!"), (53, items[11][1].upper()), (54, "short one")]
    texts = [None, "", " \n ", "...", "w1", "SHORT  One", "short\x00one", "only here nameless words stand", "w1 w2"]
    for i in range(60):
        own = rng.choices(vocabulary, k=rng.choice([5, 30, 90]))
        if i % 3 == 0:
            own[2:2] = PLAIN.findall(lower(rng.choice(items)[1]))
        texts.append("".join(w + rng.choice([" ", ", ", "\n\n", " -- "]) for w in own))
    long = rng.choices(vocabulary, k=200_000)  # several pieces, with an item across each cut
    whole = max((x[1] or "" for x in items), key=len).split()
    for at in range(500, 200_000, 1_000):
        long[at : at + len(whole)] = whole
    texts += [" ".join(long), "w1," * 90_000, texts[12], texts[12]]
    return items, texts


@pytest.mark.parametrize("part_words", [decontamination.PART_WORDS, 150])
def test_edges(spark, messy, part_words):
    items, texts = messy
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int").repartition(3)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_words long").withColumns({c: F.lit(5) for c in ("_words0", "items", "hit")}).repartition(3)
    out = decontamination.contamination(docs, bench, "doc_id", "hit", "items", part_words=part_words).collect()
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["n_items"], r["contaminated"]) for r in out}
    assert len(out) == len(texts) and all(r["hit"] == 5 for r in out)
    assert found == {i: (n, len(hit), sorted(met), len(met), bool(hit)) for i, (n, hit, met) in enumerate(brute(texts, items))}
    assert sum(x[4] for x in found.values()) > 10


def test_removal(spark, messy):
    items, texts = messy
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    expected = brute(texts, items)
    whole = decontamination.decontaminate(docs, bench, "documents")
    assert whole.columns == docs.columns
    assert sorted(r["doc_id"] for r in whole.collect()) == [i for i, (_, hit, _) in enumerate(expected) if not hit]
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, bench).collect()}
    for i, (_, hit, _) in enumerate(expected):
        if not hit:
            assert cut[i] == texts[i]
        else:
            own = PLAIN.findall(lower(texts[i]))
            assert PLAIN.findall(lower(cut[i])) == [w for k, w in enumerate(own) if k not in hit]
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, bench, "lines")


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.contamination(docs.where("false"), bench, "doc_id").collect() == []
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(docs, bench.where("false"), "doc_id").collect()] == [(2, 0, [])]


def test_hashes_that_collide():
    """Texts that share a hash stand in different layers and are told apart by their bytes."""
    rows = [{"item_id": i, "words": w, "n": 2} for i, w in enumerate([b"a b", b"c d", b"a b"])]
    real = decontamination.rolling
    try:
        decontamination.rolling = lambda words, k: real(words, k) * 0 + 5
        grams = decontamination.GramSet(rows, 2)
        data = decontamination.np.frombuffer(b"x c d a b y", decontamination.np.uint8)
        starts, ends, first = decontamination.word_spans(data, decontamination.np.array([0, len(data)]))
        hit, _, items = grams.find(data, starts, ends, first)
    finally:
        decontamination.rolling = real
    assert hit.tolist() == [False, True, True, True, True, False] and sorted(items.tolist()) == [0, 1, 2]
