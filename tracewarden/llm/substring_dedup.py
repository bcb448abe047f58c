"""Substring dedup by de Bruijn compaction.

Words are runs of other than white space, unchanged. An edge is a window of `width` consecutive words of one document; two
edges are neighbours where one follows the other. The work goes through in rounds between blocks of whole documents and
buckets of edge hashes, so what moves is small beside the texts, and texts themselves never shuffle:

1. Blocks send each distinct edge as 32 bits (with the bucket about 40 to 50 in all) and learn which other blocks may have too.
2. They send those edges in full, with the word before and the word after; an edge is nonbranching to the right if all
   its occurrences are followed by the same word, to the left if all are preceded by the same word.
3. Consecutive repeated edges compact into one path where every link is nonbranching on both sides. So all occurrences of a
   path are whole, and the first occurrence of the path is the first one of each of its edges. Paths meet in a Spark join;
   a digest of the bytes of all words of the span at the source coordinate and at each other one, by another hash than
   that of edges, must agree.

Words covered by an occurrence other than the first (smallest doc_id, then start; a null doc_id is below all others, and
of rows repeated with one doc_id the one stored first) are removed. Windows are judged on the input. Null and empty texts
have no words; texts shorter than a window keep theirs; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import fresh_path, mix, rolling, stored, text_buffers, word_hashes, word_spans

WIDTH = 20
#: Text of a block, of a table bucket of blocks, and edges of a hash bucket.
BLOCK_BYTES, TABLE_BYTES, BUCKET_EDGES = 4 << 20, 16 << 20, 2_000_000
#: Spark refuses more than 100,000 table buckets; beyond this many they grow instead.
MOST_BUCKETS = 50_000
#: Rows of a block and blocks of a task are numbered below 2 to these; 27 bits remain for tasks.
ROW_BITS, TASK_BITS = 16, 20
NULL_ID = -(1 << 63)

_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("bounds", pa.list_(pa.int64())), ("data", pa.binary())])


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId() << TASK_BITS, 0
    ids: list = []
    sizes: list[int] = []
    pieces: list[bytes] = []

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([task + n], pa.int64()), pa.array([ids], _BLOCK[1].type), pa.array([np.cumsum([0, *sizes]).tolist()], _BLOCK[2].type), pa.array([b"".join(pieces)], pa.binary())], schema=_BLOCK)

    total = 0
    for part in parts:
        data, offsets = text_buffers(part.column("text"))
        doc_ids, at = part.column("doc_id").to_pylist(), 0
        while at < len(doc_ids):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES - total, "right")) - 1)
            to = min(to, at + (1 << ROW_BITS) - len(ids))
            if to == at or (total and offsets[to] - offsets[at] + total > BLOCK_BYTES):
                yield close()
                ids, sizes, pieces, total, n = [], [], [], 0, n + 1
                continue
            ids += doc_ids[at:to]
            sizes += np.diff(offsets[at : to + 1]).tolist()
            pieces.append(data[offsets[at] : offsets[to]].tobytes())
            total += int(offsets[to] - offsets[at])
            at = to
    if ids:
        yield close()


class Edges:
    """The edges of one block: hash and start word of each, distinct hashes in order, and what bucket each falls into."""

    def __init__(self, row, width: int, bits: int):
        self.bounds = np.array(row["bounds"], np.int64)
        data = np.frombuffer(row["data"], np.uint8)
        self.starts, self.ends, self.first = word_spans(data, self.bounds)
        self.data, self.words = data, word_hashes(data, self.starts, self.ends)
        rolled = rolling(self.words, width)
        # starts of windows that end in the same document
        counts = np.diff(self.first)
        last = np.repeat(self.first[1:], counts)
        self.at = np.flatnonzero(np.arange(len(rolled)) + width <= last[: len(rolled)])
        hashes = rolled[self.at]
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        self.distinct = ranked[new]
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.count = np.diff(np.append(np.flatnonzero(new), len(ranked)))
        self.last = last
        self.bits = bits

    def buckets(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Bucket and bounds of its run in sorted hashes."""
        if not len(hashes):
            return
        own = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(hashes)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(own[a]), a, b

    def repeated(self, answers) -> np.ndarray:
        """Of the distinct edges, those that occur twice here or may occur elsewhere."""
        out, by = self.count > 1, {x["bucket"]: x["answer"] for x in answers or ()}
        for bucket, a, b in self.buckets(self.distinct):
            out[a:b] |= np.unpackbits(np.frombuffer(by[bucket], np.uint8), count=b - a).astype(bool)
        return out

    def neighbours(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Repeated distinct edges, and the word before and after each (32 bits, never 0) or 0 if they differ or there is none."""
        own = repeated[self.inverse]
        at, edge = self.at[own], (np.cumsum(repeated) - 1)[self.inverse[own]]
        short = (self.words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        after, before = np.zeros(len(at), np.uint32), np.zeros(len(at), np.uint32)
        end = at + self.width
        has = end < self.last[at]
        after[has] = short[end[has]]
        begin = np.repeat(self.first[:-1], np.diff(self.first))
        has = at > begin[at]
        before[has] = short[at[has] - 1]
        order = np.argsort(edge, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(edge[order]) > 0])) if len(order) else np.zeros(0, np.int64)
        agreed = []
        for x in (before[order], after[order]):
            lo, hi = (np.minimum.reduceat(x, cuts), np.maximum.reduceat(x, cuts)) if len(x) else (x, x)
            agreed.append(np.where(lo == hi, lo, 0).astype(np.uint32))
        return self.distinct[repeated], agreed[0], agreed[1]

    width = WIDTH


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for part in parts:
        for i in range(part.num_rows):
            yield {n: part.column(n)[i].as_py() for n in part.schema.names}


_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("ask", pa.binary())])


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, _ASK, strict=True)], schema=_ASK)


def _ask_edges(width: int, bits: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(parts):
            edges = Edges(row, width, bits)
            short = edges.distinct.astype(np.uint32)
            yield _asked([(k, row["block"], short[a:b].tobytes()) for k, a, b in edges.buckets(edges.distinct)])

    return run


def _ask_neighbours(width: int, bits: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(parts):
            edges = Edges(row, width, bits)
            edges.width = width
            hashes, before, after = edges.neighbours(edges.repeated(row["repeated"]))
            yield _asked([(k, row["block"], hashes[a:b].tobytes() + before[a:b].tobytes() + after[a:b].tobytes()) for k, a, b in edges.buckets(hashes)])

    return run


def _elsewhere(asks: list[bytes]) -> list[bytes]:
    """For each block's edges of a bucket: which another block has too."""
    own = [np.frombuffer(x, np.uint32) for x in asks]
    ranked = np.sort(np.concatenate(own))
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    out = []
    for x in own:
        at = np.searchsorted(twice, x)
        at[at == len(twice)] = 0
        out.append(np.packbits(twice[at] == x if len(twice) else np.zeros(len(x), bool)).tobytes())
    return out


def _nonbranching(asks: list[bytes]) -> list[bytes]:
    """For each block's edges of a bucket: one bit if always preceded by one word, and another if always followed by one."""
    sizes = [len(x) // 16 for x in asks]
    hashes = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(asks, sizes, strict=True)])
    before = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(asks, sizes, strict=True)])
    after = np.concatenate([np.frombuffer(x, np.uint32, n, 12 * n) for x, n in zip(asks, sizes, strict=True)])
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate([[True], np.diff(hashes[order]) != 0])
    cuts, edge = np.flatnonzero(new), np.cumsum(new) - 1
    flags = []
    for x in (before, after):
        lo, hi = np.minimum.reduceat(x[order], cuts), np.maximum.reduceat(x[order], cuts)
        flag = np.empty(len(x), bool)
        flag[order] = ((lo == hi) & (lo > 0))[edge]
        flags.append(flag)
    ends = np.cumsum(sizes)
    return [b"".join(np.packbits(f[e - n : e]).tobytes() for f in flags) for e, n in zip(ends, sizes, strict=True)]


def _answer(asks: DataFrame, answer) -> DataFrame:
    """block and its answers: array of (bucket, answer)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks, held = None, [], []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * len(blocks), pa.int32()), "answer": pa.array(answer(held), pa.binary())})

        for row in _rows(parts):
            if row["bucket"] != bucket and held:
                yield close()
                blocks, held = [], []
            bucket = row["bucket"]
            blocks.append(row["block"])
            held.append(row["ask"])
        if held:
            yield close()

    answers = asks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "block long, bucket int, answer binary")
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))


_PATH = pa.schema([("first_edge", pa.int64()), ("digest", pa.int64()), ("edges", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("block", pa.int64())])


def _paths(width: int, bits: int):
    """Compacted paths of a block: first edge, digest of all words, length in edges, and where it starts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(parts):
            edges = Edges(row, width, bits)
            repeated = edges.repeated(row["repeated"])
            hashes = edges.distinct[repeated]
            left, right = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
            by = {x["bucket"]: np.frombuffer(x["answer"], np.uint8) for x in row["branching"] or ()}
            for bucket, a, b in edges.buckets(hashes):
                size = (b - a + 7) // 8
                left[a:b] = np.unpackbits(by[bucket][:size], count=b - a).astype(bool)
                right[a:b] = np.unpackbits(by[bucket][size:], count=b - a).astype(bool)
            own = repeated[edges.inverse]
            at, edge = edges.at[own], (np.cumsum(repeated) - 1)[edges.inverse[own]]
            if not len(at):
                continue
            doc = np.searchsorted(edges.first, at, "right") - 1
            linked = (np.diff(at) == 1) & (np.diff(doc) == 0) & right[edge[:-1]] & left[edge[1:]]
            begins = np.flatnonzero(np.concatenate([[True], ~linked]))
            n = np.diff(np.append(begins, len(at)))
            # another hash of each word's bytes, summed with powers, so that a span's digest comes from two sums
            power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(edges.words), 0x2545F4914F6CDD1D, np.uint64)]))
            back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(edges.words), pow(0x2545F4914F6CDD1D, -1, 1 << 64), np.uint64)]))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_hashes(edges.data, edges.starts, edges.ends, other=True) * power[:-1])])
            start = at[begins]
            digest = mix((sums[start + n + width - 1] - sums[start]) * back[start])
            ids = np.array([NULL_ID if x is None else x for x in row["doc_ids"]], np.int64)[doc[begins]]
            columns = [hashes[edge[begins]].view(np.int64), digest.view(np.int64), n, ids, (row["block"] << ROW_BITS) + doc[begins], start - edges.first[doc[begins]], np.full(len(n), row["block"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _PATH, strict=True)], schema=_PATH)

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def _removed(width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(parts):
            spans: dict[int, list] = {}
            for x in row["spans"] or ():
                spans.setdefault(x["row"] & ((1 << ROW_BITS) - 1), []).append((x["start"], x["edges"] + width - 1))
            out = []
            for i, doc_id in enumerate(row["doc_ids"]):
                words = row["data"][row["bounds"][i] : row["bounds"][i + 1]].split()
                n, gone = len(words), 0
                if i in spans:
                    edge = np.zeros(n + 1, np.int32)
                    at = np.array(spans[i])
                    np.add.at(edge, at[:, 0], 1)
                    np.add.at(edge, at[:, 0] + at[:, 1], -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = n - int(keep.sum())
                    words = compress(words, keep.tolist())
                out.append((doc_id, n, gone, b" ".join(words).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)

    return run


def repeated_spans(blocks: DataFrame, words: int, width: int = WIDTH) -> DataFrame:
    """Every occurrence of a path that isn't the first: block, row, start (word), edges, source_row, source_start."""
    bits = max(0, (max(1, words) // BUCKET_EDGES).bit_length())
    asked = blocks.select("block", "bounds", "data").mapInArrow(_ask_edges(width, bits), "bucket int, block long, ask binary")
    repeated = stored(_answer(asked, _elsewhere).withColumnRenamed("answers", "repeated"), "repeated")
    known = blocks.select("block", "doc_ids", "bounds", "data").join(repeated.hint("merge"), "block", "left")
    asked = known.mapInArrow(_ask_neighbours(width, bits), "bucket int, block long, ask binary")
    branching = stored(_answer(asked, _nonbranching).withColumnRenamed("answers", "branching"), "branching")
    paths = known.join(branching.hint("merge"), "block", "left").mapInArrow(_paths(width, bits), "first_edge long, digest long, edges long, doc_id long, row long, start long, block long")
    paths = stored(paths, "paths")
    key = ["first_edge", "digest", "edges"]
    sources = paths.groupBy(*key).agg(F.min(F.struct("doc_id", "row", "start")).alias("source"), F.count("*").alias("occurrences")).where("occurrences > 1")
    sources = stored(sources, "sources")  # read anew, it is small enough to broadcast or a hot path's rows are split
    again = paths.join(sources, key).where((F.col("row") != F.col("source.row")) | (F.col("start") != F.col("source.start")))
    return again.select("block", "row", "start", "edges", F.col("source.row").alias("source_row"), F.col("source.start").alias("source_start"))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_removed, text (kept words joined by one space)."""
    spark = docs.sparkSession
    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks, "block long, doc_ids array<long>, bounds array<long>, data binary")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # bucketed by block, so that no join with what blocks learn ever shuffles a text
    name = f"blocks_{uuid.uuid4().hex}"
    writer = packed.write.format("parquet").option("compression", "zstd").option("path", fresh_path(spark, "blocks"))
    writer.bucketBy(min(MOST_BUCKETS, max(1, -(-size // TABLE_BYTES))), "block").sortBy("block").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalogue's entry only; the plan and the files stay
    spans = repeated_spans(blocks, size // 4, width)
    spans = stored(spans.groupBy("block").agg(F.collect_list(F.struct("row", "start", "edges")).alias("spans")), "spans")
    final = blocks.select("block", "doc_ids", "bounds", "data").join(spans.hint("merge"), "block", "left")
    return final.mapInArrow(_removed(width), "doc_id long, n_words long, n_removed long, text string")
