"""Hard-negative mining by orthogonal PCA rotation.

Vectors are turned into integers, floor(scale * component), and a score is an integer inner product. All of them are rotated to
the principal axes of their second moments, so that the first axes hold most of every product: anchors meet blocks of rows,
partial products grow by stages of axes, and the norms of what is left, plus slack for rounding, bound each score from
both sides. Rows whose bound falls short of what others surely reach go early; only the survivors' products are computed, in
integers.

Anchors are a stated set of queries against all rows: both are packed into blocks of bounded size and joined by the number of
a block; each pair of blocks gives the few best rows of each anchor, and windows pick among those. The first pass finds positives
(blocks meet where they share a label), the second the negatives in the range that each positive allows.

Rows with a null vec_id, label or vector, or a null or non-finite component, take no part, nor do those whose integer norm is 2^31 or
above (their scores might not fit a long). Shorter vectors count as if zeros followed; an empty one scores 0. Of rows of one
vec_id the smallest (label, vector) takes part. Ties go by vec_id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import stored

#: Rows of a block of data and of anchors.
DATA_ROWS, ANCHOR_ROWS = 4096, 256
#: What the axes left out at the end of each stage may hold of all squares; a last stage is the integer product.
LEFT = (0.25, 0.05)
#: Relative to the product of norms: far above the rounding of rotation and sums in double precision.
SLACK = 1e-9
#: Survivors above this share are carried on as a whole block.
DENSE = 0.125

_MOMENTS = "i int, j int, n double"


def _moments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of components; directions only, so that no row outweighs the rest."""
    total = np.zeros((0, 0))
    for part in parts:
        x = _matrix(part.column("ints"))
        if x.shape[1] > len(total):
            wider = np.zeros((x.shape[1],) * 2)
            wider[: len(total), : len(total)] = total
            total = wider
        x = x / np.maximum(1, np.linalg.norm(x, axis=1, keepdims=True))
        total[: x.shape[1], : x.shape[1]] += x.T @ x
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "n"])


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Integer lists as rows of doubles, zeros behind shorter ones."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width or max(sizes, default=0)), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def rotation(vectors: DataFrame) -> tuple[np.ndarray, list[int]]:
    """An orthogonal matrix for vectors(ints) with the principal axes first, and the axes at which stages end. Its size depends
    on the number of components alone."""
    sums = vectors.mapInArrow(_moments, _MOMENTS).groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    dim = max((max(r["i"], r["j"]) + 1 for r in sums), default=1)
    moments = np.zeros((dim, dim))
    for r in sums:
        moments[r["i"], r["j"]] = r["n"]
    values, axes = np.linalg.eigh((moments + moments.T) / 2)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    left = 1 - np.cumsum(values) / max(values.sum(), 1e-300)
    return axes, sorted({min(dim, int(np.argmax(left <= share)) + 1) for share in LEFT})


_BLOCK = pa.schema([("block", pa.int64()), ("labels", pa.list_(pa.int64())), ("rows", pa.int32()), ("ids", pa.binary()), ("own", pa.binary()), ("ints", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_BLOCK_SQL = "block long, labels array<long>, rows int, ids binary, own binary, ints binary, low binary, high binary"


def _packed(most: int, width: int):
    """Rows in order as blocks of at most `most`; limits(low, high) of a row are lists of equal lengths, or absent."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block, held
            table = pa.Table.from_batches(held).combine_chunks()
            at = 0
            while table.num_rows - at >= (1 if last else most):
                rows = table.slice(at, most).combine_chunks().to_batches()[0]
                at += rows.num_rows
                label = rows.column("label").to_numpy()
                limits = [_matrix(rows.column(c)).tobytes() if c in rows.schema.names else b"" for c in ("low", "high")]
                values = [block, np.unique(label).tolist(), rows.num_rows, rows.column("vec_id").to_numpy().tobytes(), label.tobytes(), _matrix(rows.column("ints"), width).astype(np.int32).tobytes(), *limits]
                yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, _BLOCK, strict=True)], schema=_BLOCK)
                block += 1
            held = table.slice(at).to_batches()

        for part in parts:
            held.append(part)
            if sum(x.num_rows for x in held) >= most:
                yield from blocks(False)
        if held:
            yield from blocks(True)

    return run


class _Block:
    """A block as arrays, with its rows on the principal axes."""

    def __init__(self, row: dict, prefix: str, axes: np.ndarray):
        read = lambda c, kind: np.frombuffer(row[f"{prefix}{c}"], kind)
        n = row[f"{prefix}rows"]
        self.ids, self.label, self.ints = read("ids", np.int64), read("own", np.int64), read("ints", np.int32).astype(np.int64).reshape(n, -1)
        self.low, self.high = read("low", np.int64).reshape(n, -1), read("high", np.int64).reshape(n, -1)
        x = self.ints.astype(float)
        self.axes = x @ axes
        self.norm = np.linalg.norm(x, axis=1)
        # norms of what is left behind each axis, with a little more for their rounding
        squares = np.cumsum(self.axes[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.left = np.concatenate([np.sqrt(squares), np.zeros((n, 1))], axis=1) * (1 + 1e-9)


def _reach(a: _Block, d: _Block, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors of what the products of the axes from `at` on, and rounding, can add: left * left + norm * norm."""
    return np.stack([a.left[:, at], SLACK * a.norm], axis=1), np.stack([d.left[:, at], d.norm], axis=1)


def best(a: _Block, d: _Block, allowed: np.ndarray, stops: list[int], ranges: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the ranges (low, high) of all anchors: anchors i, rows j and scores of the k best allowed rows with
    low <= score <= high, smaller ids first among equals. A row goes as soon as its bounds leave the range, or k rows are surely better."""
    partial = a.axes[:, : stops[0]] @ d.axes[:, : stops[0]].T
    x, y = _reach(a, d, stops[0])
    reach = x @ y.T
    lower, upper = partial - reach, partial + reach
    lower[~allowed], upper[~allowed] = np.nan, np.nan  # in no range
    for low, high in ranges:
        sure = np.where((lower >= low[:, None]) & (upper <= high[:, None]), lower, -np.inf)
        least = np.partition(sure, sure.shape[1] - k, axis=1)[:, sure.shape[1] - k] if sure.shape[1] >= k else np.full(len(low), -np.inf)
        i, j = np.nonzero((upper >= np.maximum(low, least)[:, None]) & (lower <= high[:, None]))
        yield _verified(a, d, i, j, partial, stops, low, high, k)


def _verified(a: _Block, d: _Block, i: np.ndarray, j: np.ndarray, first: np.ndarray, stops: list[int], low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    partial = first[i, j]
    for done, at in zip(stops, stops[1:], strict=False):
        if len(i) > DENSE * first.size:
            partial = partial + (a.axes[:, done:at] @ d.axes[:, done:at].T)[i, j]
        else:
            partial = partial + _products(a.axes[:, done:at], d.axes[:, done:at], i, j)
        x, y = _reach(a, d, at)
        reach = _products(x, y, i, j)
        lower, upper = partial - reach, partial + reach
        sure = (lower >= low[i]) & (upper <= high[i])
        least = _kth(i[sure], lower[sure], k, len(a.ids))
        keep = (upper >= np.maximum(low, least)[i]) & (lower <= high[i])
        i, j, partial = i[keep], j[keep], partial[keep]
    score = _products(a.ints, d.ints, i, j)
    keep = (score >= low[i]) & (score <= high[i])
    i, j, score = i[keep], j[keep], score[keep]
    order = np.lexsort((d.ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], score[keep]


def _products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), x.dtype)
    for at in range(0, len(i), 1 << 14):
        out[at : at + (1 << 14)] = np.einsum("ij,ij->i", x[i[at : at + (1 << 14)]], y[j[at : at + (1 << 14)]])
    return out


def _kth(i: np.ndarray, value: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th largest value of each i below n; minus infinity where there are fewer."""
    out = np.full(n, -np.inf)
    ends = np.searchsorted(i, np.arange(1, n + 1))
    for row, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)):
        if b - a >= k:
            out[row] = np.partition(value[a:b], b - a - k)[b - a - k]
    return out


_FOUND = pa.schema([("anchor_id", pa.int64()), ("range", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "anchor_id long, range int, vec_id long, score long"
_ALL = 1 << 62


def _mined(model: Broadcast, k: int, same: bool):
    """The best rows of a block of data for each anchor of another: of its own label and but itself, without limits, or of
    other labels within each of its ranges."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, stops = model.value
        for part in parts:
            for row in (part.slice(x, 1).to_pylist()[0] for x in range(part.num_rows)):
                a, d = _Block(row, "a_", axes), _Block(row, "d_", axes)
                equal = a.label[:, None] == d.label[None, :]
                allowed = equal & (a.ids[:, None] != d.ids[None, :]) if same else ~equal
                whole = np.full(len(a.ids), _ALL)
                ranges = [(-whole, whole)] if same else list(zip(a.low.T, a.high.T, strict=True))
                for r, (i, j, score) in enumerate(best(a, d, allowed, stops, ranges, k)):
                    yield pa.RecordBatch.from_arrays([pa.array(a.ids[i]), pa.array(np.full(len(i), r, np.int32)), pa.array(d.ids[j]), pa.array(score)], schema=_FOUND)

    return run


def _met(anchors: DataFrame, data: DataFrame, same: bool) -> DataFrame:
    """Pairs of blocks: those that share a label, or all of them. Pairs are dealt out by the block of data; nothing is broadcast."""
    parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, d = (x.select(*(F.col(c).alias(f"{p}{c}") for c in x.columns)) for x, p in ((anchors, "a_"), (data, "d_")))
    if same:
        mine, theirs = (x.select(f"{p}block", F.explode(f"{p}labels").alias("label")) for x, p in ((a, "a_"), (d, "d_")))
        a = mine.join(theirs, "label").select("a_block", "d_block").distinct().join(a.hint("merge"), "a_block")
        key = "d_block"
    else:
        # as many numbers as blocks of data; each block of anchors goes to all of them
        key, n = "number", max(1, data.count())
        a, d = a.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), d.withColumn(key, F.pmod(F.xxhash64("d_block"), F.lit(n)).cast("int"))
    return a.repartition(parts, key).join(d.repartition(parts, key).hint("merge"), key)


def hard_negatives(table: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256) -> DataFrame:
    """For each anchor of table(vec_id, embedding, label), where `anchor` holds of vec_id, and each of its first positives:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the first negatives whose score is low to
    high percent of the positive's."""
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale)).alias("ints"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    short = F.aggregate("embedding", F.lit(0.0), lambda n, x: n + F.pow(F.floor(x * scale).cast("double"), 2)) < 2.0**62
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fit & short, F.lit(False))).drop("embedding")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "ints")).alias("row")).select("vec_id", "row.*")
    rows = stored(rows, "vectors")
    axes, stops = rotation(rows)
    model, width = spark.sparkContext.broadcast((axes, stops)), len(axes)
    data = stored(rows.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id").mapInArrow(_packed(DATA_ROWS, width), _BLOCK_SQL), "blocks")
    asks = rows.where(anchor)
    first = stored(asks.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id").mapInArrow(_packed(ANCHOR_ROWS, width), _BLOCK_SQL), "anchors")
    found = _met(first, data, True).mapInArrow(_mined(model, positives, True), _FOUND_SQL)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    chosen = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    chosen = stored(chosen.select("anchor_id", (F.col("n") - 1).alias("range"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 100 * score between low and high times the positive's, in whole numbers
    limits = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("range", "positive_score"))).alias("own"))
    # anchors with fewer positives get ranges that nothing is in
    per = lambda share, up: F.concat(F.transform("own", lambda x: _hundredths(x["positive_score"], share, up)), F.array_repeat(F.lit(int(up)).cast("long"), positives - F.size("own")))
    asks = asks.join(limits, "vec_id").select("vec_id", "label", "ints", per(low, True).alias("low"), per(high, False).alias("high"))
    second = stored(asks.repartition("vec_id").mapInArrow(_packed(ANCHOR_ROWS, width), _BLOCK_SQL), "ranges")
    found = _met(second, data, False).mapInArrow(_mined(model, negatives, False), _FOUND_SQL)
    order = Window.partitionBy("anchor_id", "range").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(chosen, ["anchor_id", "range"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _hundredths(score: Column, percent: int, up: bool) -> Column:
    """score * percent / 100, rounded up or down, in longs throughout."""
    rest, div = F.pmod(score, F.lit(100)), lambda x: F.call_function("div", x, F.lit(100))
    return div(score - rest) * percent + div(rest * percent + (99 if up else 0))
