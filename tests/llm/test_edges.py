"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import gzip
import io
import math
import random
import struct
import zipfile
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import cells, embedding_dedup, exact_dedup, language_id, line_dedup, minhash, mixing, packing, queries, shared, substring_dedup, token_counts, warc_zip

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHES = ("row", "line", "n", "key", "bands", "signature", "component", "digest", "size", "piece", "repeated", "n_lines", "rank", "site")


def messy() -> list[tuple]:
    """90 documents with unique ids: shared passages, exact and near copies, odd white space and letters."""
    rng = random.Random(5)
    few = ["The", "cat", "sat", "ON", "naïve", "ÀB", "Zürich", "x" * 70, "日本", "--", "a", "b", "don't", "1.5"]
    many = [f"w{i}" for i in range(4_000)]
    passage = " ".join(rng.choices(many, k=25))
    texts: list[str | None] = [None, "", " \n\t \x0b", "one", "ONE", "one two three", ".", "a b c d e", "A B C D E", passage, f"x {passage} y\n\n{passage}"]
    for i in range(70):
        own = rng.choices(few if i % 3 else many, k=rng.choice([0, 1, 4, 5, 6, 19, 20, 21, 45, 60]))
        if i % 7 == 0:
            own += passage.split()
        texts.append("".join(w + rng.choice([" ", "\n", "\t", "  ", "\r\n"]) for w in own))
    for i in range(8):
        own = texts[20 + 5 * i].split()
        own[len(own) // 2 : len(own) // 2 + 1] = ["changed"]
        texts.append(" ".join(own))
    texts.append(" ".join(rng.choices(many, k=30_000)))
    return [(3 * i + 1, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "d", "É", None]), None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs():
    return messy()


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return df.withColumns({c: F.lit(7) for c in CLASHES})


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_line_dedup(spark, docs):
    out = line_dedup.remove_boilerplate(frame(spark, docs).drop("n_lines"), 3)
    assert by_id(out, "n_lines", "n_removed", "text") == brute.line_dedup([(d[0], d[1], d[3]) for d in docs], 3)
    assert {"row", "line", "site"} <= set(out.columns)


def test_line_dedup_near_the_threshold(spark):
    """Sketches are exact enough at any spread: the exact counts decide near it."""
    lines = [(100 * s + k, f"common\nspread {k}", None, f"s{s}", None) for s in range(40) for k in range(10) if s < 16 + k]
    out = line_dedup.remove_boilerplate(spark.createDataFrame(lines, SCHEMA), 20)
    assert by_id(out, "n_lines", "n_removed", "text") == brute.line_dedup([(d[0], d[1], d[3]) for d in lines], 20)


def test_substring_dedup(spark, docs):
    out = by_id(substring_dedup.remove_repeats(frame(spark, docs)), "n_words", "n_removed", "text")
    assert out == brute.substring_dedup([(d[0], d[1]) for d in docs])


def test_blocks_of_many_tasks_and_rows(monkeypatch):
    """Row numbers stay in 63 bits for any task, and a block closes by rows too."""
    rows = [(i, None if i % 3 else "a b") for i in range(700)]
    part = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows]), "text": pa.array([r[1] for r in rows])})
    monkeypatch.setattr(substring_dedup, "ROW_BITS", 6)
    monkeypatch.setattr(substring_dedup.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: (1 << 27) - 1})()))
    blocks = [b.to_pylist()[0] for b in substring_dedup._blocks(iter([part, part]))]
    assert [len(b["doc_ids"]) for b in blocks] == [64] * 21 + [56] and len({b["block"] for b in blocks}) == 22
    assert sum((b["doc_ids"] for b in blocks), []) == [r[0] for r in rows] * 2
    assert max(b["block"] for b in blocks) << 16 < 1 << 63


def test_line_dedup_leaves_other_columns(spark):
    rows = [(i, f"common\nown {i}", None, f"s{i}", None) for i in range(6)]
    own = {"_id": 99, "_key": 98, "_gone": 97, "_out": 96, "_id0": 95, "_KEY0": 94, "line": 93}
    out = line_dedup.remove_boilerplate(spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in own.items()}), 3).collect()
    assert len(out) == 6 and all(r[k] == v for r in out for k, v in own.items())
    assert sorted(r["n_removed"] for r in out) == [0, 1, 1, 1, 1, 1]


def test_mixture_keeps_other_columns(spark):
    rows = [(i, "a b c", None, f"s{i % 2}", None) for i in range(8)]
    own = {"row": 9, "copies": 8, "_copy": 7, "_row0": 6, "size": 5}
    out = mixing.mixture(spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in own.items()}))
    assert out.columns == [f.split()[0] for f in SCHEMA.split(", ")] + list(own)
    found = out.collect()
    assert found and all(r[k] == v for r in found for k, v in own.items())


def test_predict_keeps_a_column_named_text(spark):
    df = spark.createDataFrame([(1, "the cat", "en", "kept")], "doc_id long, text string, lang string, _text string")
    for model in (language_id.learn(df), None):
        assert language_id.predict(df, model, "doc_id", "_text").first()["_text"] == "kept"


def test_mixing(spark, docs):
    out = by_id(mixing.mix_sources(frame(spark, docs)), "size", "source_size", "target", "taken")
    expected = brute.mixing([(d[0], d[1], d[3]) for d in docs])
    assert {k: v[:2] + v[3:] for k, v in out.items()} == {k: v[:2] + v[3:] for k, v in expected.items()}
    assert {k: v[2] for k, v in out.items()} == pytest.approx({k: v[2] for k, v in expected.items()})


def test_language_id(spark, docs):
    df = frame(spark, docs)
    out = by_id(language_id.predict(df, language_id.learn(df), "doc_id"), "lang_pred", "score")
    expected = brute.language([(d[1], d[2]) for d in docs], [d[1] for d in docs])
    assert {d[0]: e[0] for d, e in zip(docs, expected, strict=True)} == {k: v[0] for k, v in out.items()}
    assert all(out[d[0]][1] == pytest.approx(e[1]) and 0 <= e[1] <= 1 for d, e in zip(docs, expected, strict=True))
    assert all(out[d[0]][0] == "und" for d in docs[:3] + docs[6:7])
    nobody = language_id.learn(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.predict(df, nobody, "doc_id").collect()} == {"und"}


def test_minhash(spark, docs):
    out = by_id(minhash.near_duplicates(frame(spark, docs)), "n_shingles", "component_id")
    assert out == brute.near_duplicates([(d[0], d[1]) for d in docs])


def test_minhash_keeps_links_between_different_texts(spark):
    """A chain of near copies and a large group of them: each component is whole though few members are like its smallest."""
    rng = random.Random(3)
    base, rows = [f"w{rng.randrange(9_999)}" for _ in range(100)], []
    for i in range(60):
        base[(7 * i) % 100] = f"z{i}"
        rows.append((i, " ".join(base), None, None, None))
    shared = [f"v{k}" for k in range(120)]
    for i in range(120):
        own = list(shared)
        own[i % 110 + 5] = f"u{i}"
        own[(i * 37) % 110 + 5] = f"t{i}"
        rows.append((1_000 + i, " ".join(own), None, None, None))
    out = by_id(minhash.near_duplicates(frame(spark, rows)), "n_shingles", "component_id")
    assert out == brute.near_duplicates([(d[0], d[1]) for d in rows])


def test_minhash_hot_bucket(spark, monkeypatch):
    """Copies changed so much that many are linked with none: buckets hold many components, dealt over several chunks."""
    monkeypatch.setattr(cells, "HELD", 16)
    monkeypatch.setattr(minhash, "HELD", 16)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(220):
        own = list(base)
        for k in range(rng.choice([1, 1, 2, 3, 4])):
            own[rng.randrange(90)] = f"c{i}x{k}"
        rows.append((i, " ".join(own), None, None, None))
    out = by_id(minhash.near_duplicates(frame(spark, rows)), "n_shingles", "component_id")
    assert out == brute.near_duplicates([(d[0], d[1]) for d in rows])
    assert len({c for _, c in out.values()}) > 10


def test_exact_dedup(spark, docs):
    rows = docs + docs[:5]
    out = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[brute.lower(t)].append(i)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in out) == Counter((i, max(g), len(g)) for g in by.values() for i in g)
    assert sum(r["kept"] for r in out) == len(by)


def test_packing(spark, docs):
    path = queries.vocabulary("word_bpe_49k.json")
    out = packing.pack(frame(spark, docs), path, 64).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == brute.packed_ids([(d[0], d[1]) for d in docs], path, 64)
    own = defaultdict(list)
    for r in out:
        own[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 64 and all(a == sum(n for _, n in sorted(x)[:k]) for k, (a, _) in enumerate(sorted(x))) for x in own.values())


def fewest(pieces: tuple[int, ...], capacity: int) -> int:
    """The least number of sequences for pieces above a third of capacity, of which two fit at most: every choice tried."""
    if not pieces:
        return 0
    first, rest = pieces[0], pieces[1:]
    return 1 + min([fewest(rest, capacity), *(fewest(rest[:k] + rest[k + 1 :], capacity) for k in range(len(rest)) if first + rest[k] <= capacity)])


@pytest.mark.parametrize("seed", range(40))
def test_packing_of_large_pieces_takes_the_fewest_sequences(seed):
    rng = np.random.default_rng(seed)
    pieces = sorted(rng.integers(34, 100, rng.integers(1, 9)).tolist(), reverse=True)
    kinds = packing.plan(dict(Counter(pieces)), 100)
    assert sum(n for _, n in kinds) == fewest(tuple(pieces), 100)
    assert all(sum(a * b for a, b in kind) <= 100 for kind, _ in kinds)


@pytest.mark.parametrize("seed", range(8))
def test_packing_plan_places_every_piece(seed):
    rng = random.Random(seed)
    counts = {n: rng.choice([1, 2, 3, 50, 1_000]) for n in rng.sample(range(1, 2_049), rng.choice([1, 3, 40, 400]))}
    kinds = packing.plan(counts)
    assert all(sum(a * b for a, b in kind) <= 2_048 for kind, _ in kinds)
    used = Counter()
    for kind, n in kinds:
        for length, each in kind:
            used[length] += each * n
    assert used == counts


def test_token_counts(spark, docs):
    path = queries.vocabulary("piece_bpe_32k.model")
    out = by_id(token_counts.token_counts(frame(spark, docs), path), "n_pretokens", "n_tokens")
    vocabulary = token_counts.Vocabulary.load(path)
    assert out == {d[0]: brute.token_count(d[1], vocabulary) for d in docs}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 16))
    rows = [(10 * i + k, [float(x) for x in base[i] + 0.05 * k * rng.standard_normal(16)], i % 3) for i in range(12) for k in range(5)]
    rows += [(500 + i, [float(x) for x in base[0]], 0) for i in range(4)] + [(510, [2.0 * float(x) for x in base[0]], 0), (511, [float(x) for x in base[0]], None)]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 16, 1), (603, [math.nan] + [1.0] * 15, 1), (604, [math.inf] * 16, 1), (605, [None] + [1.0] * 15, 1), (606, [1.0], 1), (607, [3.0], 1), (608, [-1.0], 1), (609, [1e-200] * 16, 1), (610, [-0.0] + [1.0] * 15, 2), (611, [0.0] + [1.0] * 15, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("group", "digest", "a", "rep", "copies")})
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_duplicates(df).collect()}
    assert out == brute.embedding_dedup(rows)
    assert out[510][0] >= 4 and out[606] == (1, 606)


def test_embedding_labels_are_told_from_values(spark):
    rows = [(1, [2.0], "x,1.0"), (2, [1.0, 2.0], "x"), (3, [2.0, 4.0], "x"), (4, [1.0, 2.0], "1,x")]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert out == {1: (0, 1), 2: (1, 2), 3: (1, 2), 4: (0, 4)}


def test_embedding_clusters(spark, monkeypatch):
    """Clusters of near copies, dealt over several chunks of a cell: links, counted with copies, and components are whole."""
    monkeypatch.setattr(cells, "HELD", 16)
    monkeypatch.setattr(embedding_dedup, "HELD", 16)
    rng = np.random.default_rng(4)
    base, rows = rng.standard_normal((3, 24)), []
    for i in range(360):
        v = base[i % 3] + rng.choice([0.02, 0.1, 0.16]) * rng.standard_normal(24)
        rows.append((i, [float(x) for x in v], i % 3 // 2))
    rows += [(1_000 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 7)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert out == brute.embedding_dedup(rows)
    assert len({c for _, c in out.values()}) > 3


def test_embedding_vectors_of_one_id(spark):
    """Rows of one vec_id are one vector to components, whatever their values."""
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])]
    out = embedding_dedup.embedding_duplicates(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()) == [(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_language_of_long_words(spark):
    """Runs of a script without spaces: none is left out of the counts, and their language is learned."""
    rng = random.Random(9)
    run = lambda letters, n: "".join(rng.choices(letters, k=n))
    han, kana, latin = "的一是不了人我在有他这中大来上国", "あいうえおかきくけこさしすせそ", "abcdefghij"
    known = [run(han, 400), run(latin, 300), run(kana, 70_000)]
    learned = [(known[0], "zh"), (f"{known[0]} {run(han, 86)}。 {run(han, 20)}", "zh"), (known[2], "ja"), (f"«{run(kana, 258)}» {run(kana, 256)}", "ja"), (f"{known[1]} {run(latin, 5)}", "en")]
    asked = [*known, run(han, 900), run(kana, 300), run(latin, 500), run(han, 5), f"{run(latin, 900)} {known[0]} {run(kana, 86)}", run("xyz", 300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    model = language_id.learn(spark.createDataFrame(learned, "text string, lang string").repartition(3))
    assert model.languages == ["en", "ja", "zh"]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model, "doc_id").collect()}
    for i, (lang, score) in enumerate(brute.language(learned, asked)):
        assert found[i] == (lang, pytest.approx(score, abs=1e-9))


def test_language_places_are_shared(spark):
    """A hot language leaves a rare one its words and n-grams where the bounds bind."""
    rng = random.Random(3)
    few = sorted({"".join(rng.choices("uvwxyz", k=5)) for _ in range(40)})
    many = sorted({"".join(rng.choices("abcdefgh", k=6)) for _ in range(1_000)})
    learned = [(" ".join(many[: 1 + i * 10]), "en") for i in range(100)] * 2 + [(" ".join(few), "es")]
    df = spark.createDataFrame(learned, "text string, lang string")
    model = language_id.learn(df, max_words=200, max_grams=300)
    assert len(model.words) == 200 and set(few) <= set(model.words) and set(many[:100]) <= set(model.words)
    assert len(model.grams) == 300 and min(sum(bool(set(g) & set(x)) for g in model.grams) for x in ("uvwxyz", "abcdefgh")) > 120
    asked = spark.createDataFrame([(1, few[0]), (2, "uvwxyuz"), (3, many[0])], "doc_id long, text string")
    assert by_id(language_id.predict(asked, model, "doc_id"), "lang_pred") == {1: ("es",), 2: ("es",), 3: ("en",)}
    langs = spark.range(language_id.MAX_LANGUAGES + 1).select(F.lit("word").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        language_id.learn(langs)
    assert len(language_id.learn(langs.where("id > 0")).languages) == language_id.MAX_LANGUAGES


def test_warc(spark):
    pages = [(1, None), (2, ""), (3, "<p>é</p>"), (4, "<p>é</p>"), (5, "x\r\n\r\ny"), (6, "<P>é</P>"), (7, "z" * 5_000_000), (8, "z" * 5_000_000)]
    df = spark.createDataFrame([(i, f"http://a/{i}?q=é b\r\n" if i % 2 else None, h, 0) for i, h in pages], "page_id long, url string, html string, payload int").repartition(3)
    out = warc_zip.archive(spark, df).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out} == brute.warc(pages)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in out if r["record_type"] == "response"} == {i: h or "" for i, h in pages if i in (2, 4, 5, 6, 8)}
    least = {r["page_id"]: r["record_type"] for r in warc_zip.archive(spark, df, 100).collect()}
    assert {i for i, t in least.items() if t == "revisit"} == {7}


def test_zip_directories():
    """Central directory entries with ZIP64 sizes and offsets, comments and compressed members."""

    class Bytes:
        def __init__(self, data):
            self.data = data

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            return self.data[at : at + n]

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("archive/data.warc.gz"), b"records")
        z.writestr("squeezed", b"a" * 999, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    found = warc_zip.members(Bytes(out.getvalue()))
    assert set(found) == {"archive/data.warc.gz"}
    at, n = found["archive/data.warc.gz"]
    assert out.getvalue()[at : at + n] == b"records"
    local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, 0, 0, 0, 1, 0) + b"m" + b"payload"
    extra = struct.pack("<HHQQQ", 1, 24, 7, 7, 0)
    central = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"m" + extra
    end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<IIQI", 0x07064B50, 0, len(local) + len(central), 1)
    end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = local + central + end64 + locator + end
    at, n = warc_zip.members(Bytes(data))["m"]
    assert data[at : at + n] == b"payload"
    with pytest.raises(ValueError):
        warc_zip.members(Bytes(b"no archive"))


def test_packages_of_several_archives(spark, tmp_path):
    """The reader goes by the members it finds, and by the index's names."""
    parts, index = {}, {"a": [], "b": []}
    for i in range(6):
        name = f"{'xy'[i % 2]} part.warc.gz"
        data = parts.setdefault(name, bytearray())
        zipped = gzip.compress(warc_zip.record(i, None, f"<p>{i}</p>".encode(), None))
        index["ab"[i // 3]].append(f"{len(data)} {len(zipped)} {name}\n")
        data += zipped
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(f"archive/{name}"), bytes(data))
        for name, lines in index.items():
            z.writestr(zipfile.ZipInfo(f"indexes/{name}.cdx"), "".join(lines))
    packages = spark.createDataFrame([(f"file://{tmp_path}/p.zip", 999)], "path string, bytes long")
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in warc_zip.read_packages(packages).collect()} == {i: f"<p>{i}</p>" for i in range(6)}


def test_substring_dedup_with_few_buckets(spark, docs, monkeypatch):
    """More text than the table's buckets were meant for."""
    monkeypatch.setattr(substring_dedup, "TABLE_BYTES", 1)
    monkeypatch.setattr(substring_dedup, "MOST_BUCKETS", 3)
    out = by_id(substring_dedup.remove_repeats(frame(spark, docs)), "n_words", "n_removed", "text")
    assert out == brute.substring_dedup([(d[0], d[1]) for d in docs])


@pytest.mark.parametrize("size", [1, 16, 64, 100_000])
def test_long_texts_come_in_parts(docs, monkeypatch, size):
    """Texts cut into runs, and tables of words that start anew, change nothing."""
    texts = [d[1] for d in docs]
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "row": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    for module, words in ((packing, 50), (token_counts, 50)):
        monkeypatch.setattr(module, "TEXT_BYTES", size)
        monkeypatch.setattr(module, "CACHE_WORDS", words)
    path, pieces = queries.vocabulary("word_bpe_49k.json"), {}
    for out in packing._pieces(path, 64)(iter([rows])):
        pieces |= {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out.to_pylist()}
    assert pieces == brute.packed_ids(enumerate(texts), path, 64)
    path = queries.vocabulary("piece_bpe_32k.model")
    vocabulary = token_counts.Vocabulary.load(path)
    counted = [r for out in token_counts._count(path)(iter([rows.select(["doc_id", "text"])])) for r in out.to_pylist()]
    assert {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in counted} == {i: brute.token_count(t, vocabulary) for i, t in enumerate(texts)}
    runs = [(r.tolist(), bytes(data), b.tolist()) for r, data, b in shared.text_groups(rows.column("text"), size)]
    whole = defaultdict(bytes)
    for own, data, bounds in runs:
        for i, a, b in zip(own, bounds[:-1], bounds[1:], strict=True):
            whole[i] += data[a:b]
    assert dict(whole) == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_null_ids_and_repeated_rows(spark):
    """Every row gives a row; what a null id means is in each docstring."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long, None, None, None), (5, long, "en", "a", 1), (5, long, "en", "a", 1), (None, None, None, None, None), (6, long.upper(), "en", "b", 1)]
    df = frame(spark, rows, 1)
    assert Counter(r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()) == {0: 3, 40: 2}
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(df).collect()) == [("5", "5", True), ("5", "5", True), ("6", "5", False), ("None", "None", True), ("None", "None", True)]
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(df).collect()) == {(None, 6, 4, False): 1, (5, 6, 4, False): 2, (6, 6, 4, True): 1, (None, None, 1, True): 1}
    assert len(mixing.mix_sources(df).collect()) == len(token_counts.token_counts(df, queries.vocabulary("piece_bpe_32k.model")).collect()) == 5
    assert len(packing.pack(df, queries.vocabulary("word_bpe_49k.json")).collect()) == 5
    assert len(line_dedup.remove_boilerplate(df.drop("n_lines"), 2).collect()) == 5
    pages = spark.createDataFrame([(None, None, "a"), (None, None, "b"), (4, None, "b"), (4, None, "b")], "page_id long, url string, html string")
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc_zip.archive(spark, pages).collect()) == [("4", "response", None), ("4", "response", None), ("None", "response", None), ("None", "revisit", 4)]
    vectors = spark.createDataFrame([(None, [1.0], 1), (3, [1.0], 1), (3, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((str(r["vec_id"]), r["n_links"], r["kept"]) for r in embedding_dedup.embedding_duplicates(vectors).collect()) == [("3", 1, True), ("3", 1, True), ("None", 0, True)]


def test_minhash_of_repeated_ids(spark):
    """Each text of a doc_id brings its links."""
    x, y, z = ([f"{c}{i}" for i in range(60)] for c in "xyz")
    texts = [(1, x), (1, y), (2, x[:59]), (3, y[1:]), (4, z), (4, y[:59]), (5, z[2:]), (6, ["alone"])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string").repartition(3)
    found = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    path = queries.vocabulary("word_bpe_49k.json")
    assert not line_dedup.remove_boilerplate(none).collect()
    assert not substring_dedup.remove_repeats(none).collect()
    assert not mixing.mix_sources(none).collect()
    assert not language_id.predict(none, language_id.learn(none), "doc_id").collect()
    assert not minhash.near_duplicates(none).collect()
    assert not exact_dedup.exact_duplicates(none).collect()
    assert not packing.pack(none, path).collect()
    assert not token_counts.token_counts(none, queries.vocabulary("piece_bpe_32k.model")).collect()
    assert not embedding_dedup.embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect()
    assert not warc_zip.archive(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect()
