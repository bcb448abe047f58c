"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct shingles of five words, A-Z lower-cased; with fewer words, the whole sequence. HASHES
minima of the set give BANDS band keys; of each minimum only the low BITS bits are kept, packed into a signature. Documents
that share a band key are candidates; the signatures' equal bit groups, corrected for chance, estimate their similarity,
and candidates whose estimate is not far below the threshold are confirmed on their full sets by 100 * intersection >=
threshold * union. A pair at 0.75 shares no band with probability 6e-6 and falls below the estimate's margin with 3e-6.

Equal sets form one class, of which one document is compared. A document is first compared with a few of its band buckets'
smallest classes; then, in buckets that still hold several components, all signatures of different components are compared
in blocks, so no link between components is lost and no bucket is expanded into pairs.

Null and empty texts, and texts of white space only, have no set, n_shingles 0, and link with nothing; so do rows with a
null doc_id. Rows of one doc_id are one document to components, and each of its texts brings its own links. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bloom
from .cells import HELD, HELD_BYTES, Joined, both_sides, compared, fixed_width
from .components import components
from .shared import mix, rolling, stored, text_buffers, word_hashes, word_spans

WORDS, THRESHOLD = 5, 75
HASHES, BANDS, BITS = 128, 32, 4
#: Bucket minima that a document is compared with first, each the smallest of BANDS / STARS buckets.
STARS = 4
#: Of the estimate: 4.5 standard deviations at the threshold.
MARGIN = 0.18
#: Text bytes whose shingles are worked on together.
WORK_BYTES = 1 << 19

_RNG = np.random.default_rng(7_919)
_ODD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2)
_LOW = np.uint64(0x1111111111111111)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, the distinct shingle hashes of its rows in order (sorted in each), and bounds."""
    data, offsets = text_buffers(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + WORK_BYTES, "right")) - 1)
        part, bounds = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        starts, ends, first = word_spans(part, bounds)
        hashes = word_hashes(part, starts, ends, lower=True)
        rolled = rolling(hashes, words)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                own = np.sort(rolled[a : b - words + 1])
                sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif b > a:
                sets.append(mix(rolling(hashes[a:b], b - a) + np.uint64(b - a)))
            else:
                sets.append(hashes[:0])
        yield at, np.concatenate(sets), np.cumsum([0, *map(len, sets)])
        at = to


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])


def sketch(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (sets x BANDS) and packed signatures (sets x HASHES * BITS / 8) of non-empty sets."""
    minima = np.empty((len(bounds) - 1, HASHES), np.uint64)
    for k in range(HASHES):
        minima[:, k] = np.minimum.reduceat((values ^ _XOR[k]) * _ODD[k], bounds[:-1])
    rows = minima.reshape(len(minima), BANDS, HASHES // BANDS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        keys = mix(keys + rows[:, :, k])
    low = (minima & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return keys, (low[:, 0::2] << 4) | low[:, 1::2]


def digests(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each non-empty set, which with its size tell it from others."""
    return np.add.reduceat(mix(values), starts), np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), starts)


def _sketches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at, values, bounds in shingle_sets(part.column("text")):
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            digest = np.zeros((2, len(n)), np.uint64)
            bands, signatures = [None] * len(n), [None] * len(n)
            if len(some):
                starts = bounds[:-1][some]
                digest[:, some] = digests(values, starts)
                keys, packed = sketch(values, np.append(starts, bounds[-1]))
                for i, k, s in zip(some.tolist(), keys.view(np.int64), packed, strict=True):
                    bands[i], signatures[i] = k, s.tobytes()
            columns = [part.column("doc_id").slice(at, len(n)), n, digest[0].view(np.int64), digest[1].view(np.int64), bands, signatures]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, _SKETCH, strict=True)], schema=_SKETCH)


def _sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at, values, bounds in shingle_sets(part.column("text")):
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            d1, d2 = digests(values, bounds[:-1][some])
            blobs = [values[bounds[i] : bounds[i + 1]].tobytes() for i in some.tolist()]
            ids = part.column("doc_id").slice(at, len(n)).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n[some], pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(blobs, pa.binary())], names=["doc_id", "n", "d1", "d2", "shingles"])


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures (rows of uint64), by counting the bit groups that differ."""
    x = left ^ right
    x = x | (x >> np.uint64(1))
    x = (x | (x >> np.uint64(2))) & _LOW
    equal = 1 - np.bitwise_count(x).sum(axis=-1) / HASHES
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def _likely(least: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                ok = likeness(*(fixed_width(part.column(c), "uint64") for c in ("left", "right"))) >= least
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return run


def _confirmed(threshold: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ok = []
            for x, y in zip(part.column("left"), part.column("right"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def class_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """class, shingles of the wanted classes. Texts never shuffle: a filter of the documents that stand for the classes
    picks those that are shingled again, and their sets move."""
    wanted = stored(classes.join(wanted, "class", "left_semi").withColumnRenamed("rep", "doc_id"), "wanted")
    near = bloom.among(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", wanted.select("doc_id"), wanted.count())
    sets = near.select("doc_id", "text").mapInArrow(_sets, "doc_id long, n long, d1 long, d2 long, shingles binary")
    return stored(sets.join(wanted, ["doc_id", "n", "d1", "d2"]).dropDuplicates(["class"]).select("class", "shingles"), "sets")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs of classes (a, b) whose full sets reach the threshold."""
    pairs = stored(pairs, "candidates")
    sets = class_sets(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), classes, docs)
    for own, name in (("a", "left"), ("b", "right")):
        pairs = pairs.join(sets.select(F.col("class").alias(own), F.col("shingles").alias(name)), own)
    return stored(pairs.select("a", "b", "left", "right").mapInArrow(_confirmed(threshold), "a long, b long"), "confirmed")


class _Bucket:
    """Classes of one bucket: queries are compared with the classes held. A pair is looked at if the classes are in different
    components, their set sizes allow the threshold, their signatures are alike enough, and no earlier band has both."""

    def __init__(self, threshold: int):
        self.threshold, self.data = threshold, None

    def hold(self, own: list[np.ndarray]) -> None:
        self.data = [np.concatenate(x) for x in zip(self.data, own, strict=True)] if self.data else [np.array(x) for x in own]

    def candidates(self, own: list[np.ndarray], i: int, component: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the data that query i is to be compared with, likest first, and their estimates."""
        classes, components, n, band, signatures, bands = self.data[:6]
        a = self.threshold
        other = np.flatnonzero((components != component) & (classes > own[0][i]) & (100 * n >= a * own[2][i]) & (a * n <= 100 * own[2][i]))
        if not len(other):
            return other, np.zeros(0)
        alike = likeness(signatures[other], own[4][i])
        keep = alike >= a / 100 - MARGIN
        other, alike = other[keep], alike[keep]
        before = int(own[3][i])
        if before and len(other):
            keep = ~(bands[other, :before] == own[5][i, :before]).any(axis=1)
            other, alike = other[keep], alike[keep]
        order = np.argsort(-alike, kind="stable")
        return other[order], alike[order]


class _Open(_Bucket):
    """Which classes of a bucket have a candidate there."""

    def __init__(self, threshold: int):
        super().__init__(threshold)
        self.found = set()

    def ask(self, own: list[np.ndarray]) -> list[np.ndarray]:
        asked = []
        for i in range(len(own[0])):
            found, _ = self.candidates(own, i, int(own[1][i]))
            if len(found):
                asked.append(int(own[0][i]))
                self.found.update(self.data[0][found].tolist())
        return [np.array(asked, np.int64)]

    def close(self) -> list[np.ndarray]:
        return [np.array(sorted(self.found), np.int64)]


class _Confirm(_Bucket):
    """Links of a bucket, confirmed on full sets. Components that a link joins are one from then on, so of the links between
    two components only one is looked for."""

    joined: Joined | None = None

    def ask(self, own: list[np.ndarray]) -> list[np.ndarray]:
        self.joined = self.joined or Joined(self.data[1])
        a, b = [], []
        for i in range(len(own[0])):
            component = self.joined.of(int(own[1][i]))
            left, _ = self.candidates(own, i, component)
            step, mine = 16, np.frombuffer(own[6][i], np.uint64)
            while len(left):
                some, left = left[:step], left[step:]
                both = self.shared(mine, some)
                hits = some[100 * both >= self.threshold * (len(mine) + self.data[2][some] - both)]
                for j in self.joined.join(component, hits).tolist():
                    a.append(int(own[0][i]))
                    b.append(int(self.data[0][j]))
                component = self.joined.of(component)
                left, step = left[self.data[1][left] != component], step * 2
        return [np.array(a, np.int64), np.array(b, np.int64)]

    def shared(self, mine: np.ndarray, some: np.ndarray) -> np.ndarray:
        """How many shingles each of some classes shares with one set."""
        sets = [np.frombuffer(self.data[6][j], np.uint64) for j in some.tolist()]
        flat = np.concatenate(sets)
        at = np.searchsorted(mine, flat)
        at[at == len(mine)] = 0
        return np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum([0, *map(len, sets[:-1])]))

    def close(self) -> list[np.ndarray]:
        return [np.zeros(0, np.int64)] * 2


_COMPARED = ["class", "component", "n", "band", "signature", "bands"]


def _arrays(part: pa.RecordBatch) -> list[np.ndarray]:
    return [*(part.column(c).to_numpy() for c in _COMPARED[:4]), fixed_width(part.column("signature"), "uint64"), part.column("bands").flatten().to_numpy().reshape(-1, BANDS)]


def links_across(buckets: DataFrame, reps: DataFrame, known: DataFrame, classes: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """a, b: links that join what is still apart. buckets: key, band, class, members; reps: class, n, bands, signature; known:
    node, component. Buckets that hold several components are compared by signatures first. Only classes with a candidate
    then come with their sets, so what moves is a row for each class and bucket, not for each pair."""
    held = buckets.join(known.withColumnRenamed("node", "class"), "class", "left")
    held = stored(held.withColumn("component", F.coalesce("component", "class")), "held")
    mixed = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    cells = stored(held.join(mixed, "key", "left_semi").join(reps, "class"), "mixed")
    found = compared(both_sides(cells, ["key", *_COMPARED], F.col("members"), F.col("class")), ["key", "chunk"], _arrays, lambda: _Open(threshold), "class long", ["key"])
    found = stored(found.distinct(), "open")
    sets = class_sets(found.select("class").distinct(), classes, docs)
    rows = cells.join(found, ["key", "class"]).join(sets, "class")
    size = found.join(reps.select("class", "n"), "class").groupBy("key").agg(F.greatest(F.count("*"), F.sum("n") * 8 / HELD_BYTES * HELD).cast("long").alias("size"))
    rows = both_sides(rows.join(size, "key"), ["key", *_COMPARED, "shingles"], F.col("size"), F.col("class"))
    arrays = lambda part: [*_arrays(part), np.array(part.column("shingles").to_pylist(), object)]
    return stored(compared(rows, ["key", "chunk"], arrays, lambda: _Confirm(threshold), "a long, b long"), "across")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept."""
    least = threshold / 100 - MARGIN
    rows = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketches, "doc_id long, n long, d1 long, d2 long, bands array<long>, signature binary"), "sketches")
    some = rows.where("n > 0 and doc_id is not null")
    classes = stored(some.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")).withColumn("class", F.monotonically_increasing_id()), "classes")
    reps = some.join(classes.withColumnRenamed("rep", "doc_id"), ["n", "d1", "d2", "doc_id"]).dropDuplicates(["class"])
    reps = stored(reps.select("class", "n", "bands", "signature"), "reps")
    keyed = reps.select("class", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.min("class").alias("low"), F.count("*").alias("members")).where("members > 1")
    buckets = stored(keyed.join(shared, "key"), "buckets")
    signatures = reps.select("class", "signature")
    lowest = buckets.where("low <> class").groupBy("class", F.floor(F.col("band") * STARS / BANDS)).agg(F.min("low").alias("low"))
    stars = lowest.select(F.col("low").alias("a"), F.col("class").alias("b")).distinct()
    for own, name in (("a", "left"), ("b", "right")):
        stars = stars.join(signatures.select(F.col("class").alias(own), F.col("signature").alias(name)), own)
    first = confirm(stars.select("a", "b", "left", "right").mapInArrow(_likely(least), "a long, b long"), classes, docs, threshold)
    known = components(first)
    second = links_across(buckets, reps, known, classes, docs, threshold)
    same = some.join(classes, ["n", "d1", "d2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    linked = first.unionByName(second)
    for own in "ab":
        linked = linked.join(classes.select(F.col("class").alias(own), F.col("rep").alias(f"rep_{own}")), own)
    found = components(linked.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).unionByName(same))
    out = rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
