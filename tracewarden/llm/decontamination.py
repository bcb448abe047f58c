"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over training texts.

A-Z become a-z; words are runs of digits, letters a-z and characters from U+0080. A window is WIDTH consecutive words of a
benchmark item; an item of fewer words, but not none, is one window. The set holds window hashes with a filter in front and
the items' bytes; a hit counts after its words are compared byte for byte. Texts pass through their task once and nothing
shuffles. The set is built from at most PART_WORDS words; a larger benchmark is dealt out by hash over several sets, which
scan the texts one after another, so what is broadcast never grows.

Null and empty texts have no words and no hits; long texts go through in pieces that overlap by a window. Benchmark rows
without text or words are ignored, rows of one item_id are one item, and rows without item_id hit words but name no item. Rows of
documents are each judged alone, repeated or not; results replace columns of their names; an empty table gives no rows and
an empty benchmark no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import PIECE_BYTES, rolling, stored, text_groups, unused, word_hashes, word_spans
from .spans import expanded, merged, same_bytes, stretches

WIDTH = 10
#: Benchmark words in one set: some 50 MB with all that belongs to them.
PART_WORDS = 1 << 20
#: Words of a benchmark item in one row; longer items are cut, with an overlap.
CHUNK_WORDS = 1 << 14

NORMAL = np.full(256, 32, np.uint8)
NORMAL[48:58], NORMAL[97:123], NORMAL[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
NORMAL[65:91] = np.arange(97, 123)

_CHUNK = pa.schema([("item_id", pa.int64()), ("words", pa.binary()), ("n", pa.int64())])


def _chunks(width: int):
    table = NORMAL.tobytes()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for item, text in zip(part.column("item_id").to_pylist(), part.column("text"), strict=True):
                words = text.as_py().encode().translate(table).split()
                cut = [words[a : a + CHUNK_WORDS + width - 1] for a in range(0, max(1, len(words) - width + 1), CHUNK_WORDS)]
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut), pa.int64()), pa.array([b" ".join(x) for x in cut]), pa.array([len(x) for x in cut])], schema=_CHUNK)

    return run


class _Layer:
    """Windows of one length, one text for a hash: hashes in order, where the text stands, and the items that hold it."""

    def __init__(self, length: int, hashes: np.ndarray, word: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, hashes))
        hashes, word, items = hashes[order], word[order], items[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])
        self.length, self.items = length, items[new]
        self.hashes, self.first, self.counts = np.unique(hashes[new], return_index=True, return_counts=True)
        self.word = word[np.searchsorted(hashes, self.hashes)]
        self.shift = np.uint64(64 - max(10, min(24, math.ceil(math.log2(len(self.hashes) + 1)) + 4)))
        self.filter = np.zeros(1 << (64 - int(self.shift)), bool)
        self.filter[self.hashes >> self.shift] = True

    def candidates(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows whose hash is here, and where."""
        at = np.flatnonzero(self.filter[grams >> self.shift])
        found = np.searchsorted(self.hashes, grams[at])
        hit = self.hashes[np.minimum(found, len(self.hashes) - 1)] == grams[at]
        return at[hit], found[hit]


class GramSet:
    """All windows of some items."""

    def __init__(self, rows: list, width: int):
        ids = sorted({r["item_id"] for r in rows if r["item_id"] is not None})
        number = {x: i for i, x in enumerate(ids)}
        self.ids = np.array(ids, np.int64)
        sizes = np.array([len(r["words"]) + 1 for r in rows], np.int64)
        self.data = np.frombuffer(b"".join(bytes(r["words"]) + b" " for r in rows), np.uint8)
        self.starts, ends, first = word_spans(self.data, np.append(0, np.cumsum(sizes)))
        self.sizes = ends - self.starts
        hashes, items = word_hashes(self.data, self.starts, ends), np.array([number.get(r["item_id"], len(ids)) for r in rows], np.int64)
        n = np.diff(first)
        self.layers: list[_Layer] = []
        for length in np.unique(np.minimum(n, width)).tolist():
            whole = n >= width if length == width else n == length
            chunk, word = expanded(first[:-1][whole], n[whole] - length + 1)
            owner, grams = items[whole][chunk], rolling(hashes, length)[word]
            while len(word):  # other texts of a hash that is taken go into another layer
                order = np.argsort(grams, kind="stable")
                lead = word[order][np.searchsorted(grams[order], grams)]
                fits = self.equal(self.data, self.starts, self.sizes, word, lead, length)
                self.layers.append(_Layer(length, grams[fits], word[fits], owner[fits]))
                word, owner, grams = word[~fits], owner[~fits], grams[~fits]

    def equal(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, word: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
        """Whether the words from `word` on, in data, are those from `own` on here."""
        out = np.ones(len(word), bool)
        for k in range(length):
            at = np.flatnonzero(out)
            a, b = word[at] + k, own[at] + k
            fits = sizes[a] == self.sizes[b]
            at, a, b = at[fits], a[fits], b[fits]
            fit = at[same_bytes(data, starts[a], self.data, self.starts[b], sizes[a])] if len(at) else at
            out = np.zeros(len(word), bool)
            out[fit] = True
        return out

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words of the rows are hit; rows and items that meet, each pair once."""
        hashes, edges = word_hashes(data, starts, ends), np.zeros(len(starts) + 1, np.int64)
        met = [np.zeros(0, np.int64)]
        for layer in self.layers:
            if len(hashes) < layer.length:
                continue
            at, own = layer.candidates(rolling(hashes, layer.length))
            row = np.searchsorted(first, at, "right") - 1
            inside = at + layer.length <= first[row + 1]
            at, own, row = at[inside], own[inside], row[inside]
            fits = self.equal(data, starts, ends - starts, at, layer.word[own], layer.length)
            at, own, row = at[fits], own[fits], row[fits]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + layer.length, -1)
            pairs = np.unique(row * len(layer.hashes) + own)
            row, own = pairs // len(layer.hashes), pairs % len(layer.hashes)
            which, place = expanded(layer.first[own], layer.counts[own])
            met.append(np.unique(row[which] * (len(self.ids) + 1) + layer.items[place]))
        pairs = np.unique(np.concatenate(met))
        row, item = pairs // (len(self.ids) + 1), pairs % (len(self.ids) + 1)
        named = item < len(self.ids)
        return np.cumsum(edges[:-1]) > 0, row[named], self.ids[item[named]]


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Values by row, in the order given, as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=n))).astype(np.int32)), pa.array(values, pa.int64()))


def _scan(grams: Broadcast, text: str, found: list[str], width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: GramSet = grams.value
        for part in parts:
            n, total = part.num_rows, np.zeros(part.num_rows, np.int64)
            # what earlier sets have found
            spans, items = (part.column(c) for c in found[1:])
            at = np.repeat(np.arange(n), spans.value_lengths().to_numpy(zero_copy_only=False))
            flat = spans.flatten().to_numpy(zero_copy_only=False)
            hits = [(at[::2], flat[::2], flat[1::2])]
            met = [(np.repeat(np.arange(n), items.value_lengths().to_numpy(zero_copy_only=False)), items.flatten().to_numpy(zero_copy_only=False))]
            tail, last = np.zeros(0, np.uint8), -1
            for rows, data, bounds in text_groups(part.column(text), PIECE_BYTES):
                data, before = NORMAL[data], 0
                if rows[0] == last:  # the text goes on: its last words come first again
                    data, bounds = np.concatenate([tail, data]), np.array([0, len(tail) + len(data)])
                    before = max(0, int(total[last]) - (width - 1))
                starts, ends, first = word_spans(data, bounds)
                hit, row, item = table.find(data, starts, ends, first)
                a, b = stretches(hit, first)
                own = np.searchsorted(first, a, "right") - 1
                hits.append((rows[own], a - first[own] + before, b - first[own] + before))
                met.append((rows[row], item))
                total[rows] = np.diff(first) + before
                last = int(rows[-1])
                of = starts[first[-2] :][1 - width :] if width > 1 else starts[:0]
                tail = np.append(data[of[0] : bounds[-1]], np.uint8(32)) if len(of) else np.zeros(0, np.uint8)
            row, a, b = merged(*(np.concatenate(x) for x in zip(*hits, strict=True)))
            both = pd.DataFrame(dict(zip("ri", (np.concatenate(x) for x in zip(*met, strict=True)), strict=True))).drop_duplicates().sort_values(["r", "i"])
            columns = [pa.array(total), _lists(np.repeat(row, 2), np.stack([a, b], 1).ravel(), n), _lists(both["r"].to_numpy(), both["i"].to_numpy(), n)]
            rest = [(x, part.column(x)) for x in part.schema.names if x not in found]
            yield pa.RecordBatch.from_arrays([x for _, x in rest] + columns, names=[x for x, _ in rest] + found)

    return run


def _found(docs: DataFrame, benchmark: DataFrame, text: str, width: int, part_words: int) -> tuple[DataFrame, list[str]]:
    """docs with the number of words, hit words as numbers start, end, start, end ..., and items."""
    spark, names = docs.sparkSession, []
    for stem in ("words", "spans", "items"):
        names.append(unused([*docs.columns, *names], stem))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chunks = stored(items.mapInArrow(_chunks(width), "item_id long, words binary, n long"), "benchmark_words")
    parts = max(1, math.ceil((chunks.agg(F.sum("n")).first()[0] or 0) / part_words))
    out = docs.withColumn(names[0], F.lit(0).cast("long")).withColumns({c: F.array().cast("array<long>") for c in names[1:]})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    for part in range(parts):
        if part:
            out = stored(out, "scanned")
        rows = chunks.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)) == part).collect()  # some part_words words
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(GramSet(rows, width)), text, names, width), schema)
    return out, names


def contamination(docs: DataFrame, benchmark: DataFrame, *keep: str, width: int = WIDTH, part_words: int = PART_WORDS) -> DataFrame:
    """For each row of docs(text, ...) the columns to keep and n_words, n_hit, items (ids of those with occurring windows, in
    order), n_items, contaminated; benchmark(item_id, text)."""
    out, (words, spans, items) = _found(docs.select("text", *(c for c in keep if c != "text")), benchmark, "text", width, part_words)
    lengths = F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: x - n)  # end - (start - (end - start ...))
    new = {"n_words": F.col(words), "n_hit": lengths, "items": F.col(items), "n_items": F.size(items).cast("long"), "contaminated": F.size(spans) > 0}
    return out.select(*(c for c in keep if c not in new), *(v.alias(k) for k, v in new.items()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", width: int = WIDTH, part_words: int = PART_WORDS) -> DataFrame:
    """docs(text, ...) without contaminated documents (remove="documents"), or with the text from the first to the last byte
    of each stretch of hit words cut out (remove="spans"). All columns stay."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be spans or documents")
    out, (_, spans, _) = _found(docs, benchmark, "text", width, part_words)
    if remove == "documents":
        return out.where(F.size(spans) == 0).select(*(f"`{c}`" for c in docs.columns))

    @F.pandas_udf("string")
    def cut(text: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _without(t, h) for t, h in zip(text, hits, strict=True)], dtype=object)

    hit = F.size(spans) > 0
    return out.withColumn("text", F.when(hit, cut(F.when(hit, F.col("text")), F.when(hit, F.col(spans)))).otherwise(F.col("text"))).select(*(f"`{c}`" for c in docs.columns))


def _without(text: str, hits: np.ndarray) -> str:
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = word_spans(NORMAL[data], np.array([0, len(data)]))
    keep, at = [], 0
    for a, b in zip(hits[::2], hits[1::2], strict=True):
        keep.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*keep, raw[at:]]).decode()
