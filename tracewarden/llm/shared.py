"""Helpers every corpus operator uses: tables in the shared folder, block readers, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space that separates words: the characters space and U+0009 to U+000D.
SPACES = "\\x20\\x09-\\x0D"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time; bounds the memory of the hashing arrays.
PIECE_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only in local mode, where all share one machine, may it be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not getattr(shared_dir, "own", None):
            shared_dir.own = "file://" + tempfile.mkdtemp(prefix="tracewarden-")
        folder = shared_dir.own
    return folder.rstrip("/")


#: Folders that the run around this code has named, oldest first; none outside a run. Each thread has its own.
_RUN: ContextVar[list[str] | None] = ContextVar("run", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    path, run = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", _RUN.get()
    if run is not None:
        run.append(path)
    return path


@contextmanager
def run_tables() -> Iterator[list[str]]:
    """The list of the folders that are named within, by this thread and until the end of the block."""
    token = _RUN.set([])
    try:
        yield _RUN.get()
    finally:
        _RUN.reset(token)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes a run's tables. Whatever still reads them must have been written out before."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(columns: list[str], stem: str) -> str:
    """A column name that none of the columns has, in any case."""
    taken = {c.lower() for c in columns}
    return next(x for i in range(len(taken) + 1) if (x := f"_{stem}{i}") not in taken)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column; nulls have length 0."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_groups(column: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """rows, data, bounds: runs of texts of at most `most` bytes in all. A longer text comes in several runs, cut at white space,
    so that what is derived from its words stays small; only a word longer than `most` is longer itself."""
    data, offsets = text_buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        a, b = int(offsets[at]), int(offsets[to])
        while b - a > most:  # a single text
            cut = _cut(data, a, a + most, b)
            yield np.array([at]), data[a:cut], np.array([0, cut - a])
            a = cut
        bounds = offsets[at : to + 1] - a
        bounds[0] = 0
        yield np.arange(at, to), data[a:b], bounds
        at = to


def _cut(data: np.ndarray, a: int, at: int, b: int) -> int:
    """A place in data[a:b] to cut: after the last white space before `at`, or else after the first one behind it."""
    before = np.flatnonzero(IS_SPACE[data[a:at]])
    if len(before):
        return a + int(before[-1]) + 1
    while at < b:
        behind = np.flatnonzero(IS_SPACE[data[at : min(b, at + PIECE_BYTES)]])
        if len(behind):
            return at + int(behind[0]) + 1
        at += PIECE_BYTES
    return b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15 - 2  # 3 modulo 8, so that words that differ in order differ in nearly all bits
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_OTHER = mix(np.arange(1_001, 1_257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_TABLES: dict[str, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    have = _TABLES.get(str(base))
    if have is None or len(have) < n:
        have = _TABLES[str(base)] = _powers(base, max(n, PIECE_BYTES))
    return have if n <= PIECE_BYTES else have[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all words, and for each row the index of its first word (length rows + 1)."""
    solid = ~IS_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, other: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z as a-z if lower; another hash if other), a piece of words at a time."""
    out = np.empty(len(starts), np.uint64)
    values = _LOWER if lower else _OTHER if other else _BYTE
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES, "right")))
        a, b = int(starts[at]), int(ends[to - 1])
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[data[a:b]] * _table(_BASE, b - a)[: b - a], out=sums[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        out[at:to] = mix((sums[e] - sums[s]) * _table(_INVERSE, b - a)[s])
        at = to
    return out


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of spans."""
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class WordTable:
    """Rows of distinct words by their 64-bit hash, in sorted arrays: some 12 bytes a word, whatever its length."""

    def __init__(self):
        self.keys, self.rows, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each word, and for each new row, in order, the place of such a word. New rows follow the old ones."""
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        distinct = ranked[new]
        at = np.searchsorted(self.keys, distinct)
        hit = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        hit[inside] = self.keys[at[inside]] == distinct[inside]
        own, missing = np.empty(len(distinct), np.int32), ~hit
        own[hit] = self.rows[at[hit]]
        own[missing] = np.arange(self.size, self.size + missing.sum(), dtype=np.int32)
        self.size += int(missing.sum())
        self.keys, self.rows = np.insert(self.keys, at[missing], distinct[missing]), np.insert(self.rows, at[missing], own[missing])
        rows = np.empty(len(ranked), np.int32)
        rows[order] = own[np.cumsum(new) - 1]
        return rows, order[new][missing]


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes, by doubling; length max(0, n - k + 1)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, step, power = 0xD6E8FEB86659FD93, 1, words
    total, done = None, 0
    while True:
        if k & step:
            piece = power[done : done + n]
            total = piece.copy() if total is None else total * np.uint64(pow(base, step, 1 << 64)) + piece
            done += step
        step *= 2
        if step > k:
            return mix(total)
        half = step // 2
        power = power[: len(power) - half] * np.uint64(pow(base, half, 1 << 64)) + power[half:]


def batches(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)
