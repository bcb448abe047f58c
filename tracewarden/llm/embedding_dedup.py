"""Near-duplicate embeddings by collision-counting projections.

Unit vectors are projected on SETS * EACH random directions. Vectors of cosine c are sqrt(2 - 2c) apart, and so are their
projections on average, so a window of REACH times that around a query's projection misses a true partner with probability
0.0027 per direction; a pair whose windows collide in all but SETS - 1 directions is verified by its cosine in double
precision. A true pair is lost with probability below 1e-6 (the recall that the count is calibrated for). As at most
SETS - 1 misses fall into SETS sets, one set at least has none: pairs are therefore looked for set by set, in cells of its
first directions, in sorted order of the next.

Only vectors of equal, non-null labels and equal length are compared. A vector that is null, empty, zero, or holds a null
or non-finite component links with nothing, nor does one with a null vec_id. Equal vectors of a label form one class, of which one
is compared; its copies link with one another and with its partners. Rows of one vec_id are one vector to components, and
each counts as a row to others' n_links. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .cells import HELD, HELD_BYTES, Joined, compared, dealt, fixed_width
from .components import components
from .shared import stored

THRESHOLD, SETS, EACH, REACH = 0.98, 5, 8, 3.0
#: Half precision keeps projections below 8 within this.
ROUNDING = 0.004
SEED = 20_240_601


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, SETS * EACH))


def window(threshold: float) -> float:
    return REACH * math.sqrt(max(0.0, 2 - 2 * threshold))


def projections(x: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows of x on all directions, in half precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ directions(x.shape[1])).astype(np.float16)


def _vectors(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of vectors of one length, and the vectors as a matrix."""
    lists = part.column("embedding")
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[starts[rows][:, None] + np.arange(dim)]


_SIDES = pa.schema([("group", pa.int64()), ("set", pa.int32()), ("cell", pa.int64()), ("side", pa.int32()), ("vec_id", pa.int64()), ("projections", pa.binary())])


def _cells(width: float, grid: int, asked: bool):
    """Each vector's own cell in every set as data or, if asked, the cells that its windows touch as queries."""
    corners = np.array(np.meshgrid(*[[0, 1]] * grid)).reshape(grid, -1).T

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, groups = part.column("vec_id").to_numpy(), part.column("group").to_numpy()
            for rows, x in _vectors(part):
                half, n = projections(x), len(rows)
                payload = pa.array([r.tobytes() for r in half], pa.binary())
                for s in range(SETS):
                    own = half[:, s * EACH : s * EACH + grid].astype(float)
                    low = np.floor((own - width) / (2 * width))
                    for cell in (low + c for c in corners) if asked else (np.floor(own / (2 * width)),):
                        key = np.zeros(n, np.int64)
                        for k in range(grid):
                            key = key * 4096 + (cell[:, k].astype(np.int64) + 2048)
                        columns = [groups[rows], np.full(n, s), key, np.full(n, int(asked)), ids[rows], payload]
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, _SIDES, strict=True)], schema=_SIDES)

    return run


class _Cell:
    """Vectors of one cell: pairs (query below data) whose windows collide in all directions of the cell's set, in no earlier
    set that way, and often enough in all."""

    LEAST = SETS * EACH - (SETS - 1)

    def __init__(self, width: float):
        self.width, self.data = width, None

    def hold(self, own: list[np.ndarray]) -> None:
        self.data = [np.concatenate(x) for x in zip(self.data, own, strict=True)] if self.data else [np.array(x) for x in own]

    def start(self) -> None:
        """Once all data are there: sorts them by the last direction of the set."""
        self.set = int(self.data[2][0])
        self.by = (self.set + 1) * EACH - 1
        order = np.argsort(self.data[1][:, self.by], kind="stable")
        self.data = [x[order] for x in self.data]

    def pairs(self, own: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of data, a block of neighbouring queries at a time."""
        if not hasattr(self, "by"):
            self.start()
        by, width, first = self.by, self.width, self.set * EACH
        asks = np.argsort(own[1][:, by], kind="stable")
        d, q = self.data[1], own[1][asks]
        for at in range(0, len(asks), 128):
            block = q[at : at + 128]
            lo, hi = np.searchsorted(d[:, by], block[0, by] - width), np.searchsorted(d[:, by], block[-1, by] + width, "right")
            near = d[lo:hi]
            i, j = np.nonzero(np.abs(block[:, by][:, None] - near[:, by]) <= width)
            keep = own[0][asks[at + i]] < self.data[0][lo + j]
            i, j = i[keep], j[keep]
            for k in range(first, by):
                keep = np.abs(block[i, k] - near[j, k]) <= width
                i, j = i[keep], j[keep]
            for a in range(0, len(i), 1 << 16):
                x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                hits = np.abs(block[x] - near[y]) <= width
                keep = (hits.sum(axis=1) >= self.LEAST) & ~hits.reshape(-1, SETS, EACH).all(axis=2)[:, : self.set].any(axis=1)
                yield asks[at + x[keep]], lo + y[keep]


class _Open(_Cell):
    """Which vectors of a cell have a candidate there, as query (1) or as data (0)."""

    def ask(self, own: list[np.ndarray]) -> list[np.ndarray]:
        asked = np.zeros(len(own[0]), bool)
        for i, j in self.pairs(own):
            asked[i] = True
            self.found[j] = True
        return [own[0][asked], np.ones(asked.sum(), np.int64)]

    def start(self) -> None:
        super().start()
        self.found = np.zeros(len(self.data[0]), bool)

    def close(self) -> list[np.ndarray]:
        if not hasattr(self, "found"):
            return [np.zeros(0, np.int64)] * 2
        return [self.data[0][self.found], np.zeros(self.found.sum(), np.int64)]


class _Confirm(_Cell):
    """Candidates of a cell by their cosines: rows (a, a, linked rows) and, of the links, those that join what is apart as
    rows (a, b, 0). Columns: ids, projections, set, vectors, copies."""

    def __init__(self, width: float, threshold: float):
        super().__init__(width)
        self.threshold = threshold

    def start(self) -> None:
        super().start()
        self.vectors = self.scaled(self.data[3])
        self.joined, self.linked = Joined(self.data[0].copy()), np.zeros(len(self.data[0]), np.int64)

    @staticmethod
    def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack(vectors)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x, np.einsum("ij,ij->i", x, x)

    def ask(self, own: list[np.ndarray]) -> list[np.ndarray]:
        x, norms = self.scaled(own[3])
        linked, a, b = np.zeros(len(own[0]), np.int64), [], []
        for i, j in self.pairs(own):
            keep = np.zeros(len(i), bool)
            for at in range(0, len(i), 1 << 14):
                p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                keep[at : at + (1 << 14)] = np.einsum("ij,ij->i", x[p], self.vectors[0][q]) / np.sqrt(norms[p] * self.vectors[1][q]) >= self.threshold
            i, j = i[keep], j[keep]
            np.add.at(linked, i, self.data[4][j])
            np.add.at(self.linked, j, own[4][i])
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            for places in np.split(j, np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
                query = int(own[0][i[0]])
                i = i[len(places) :]
                for k in self.joined.join(self.joined.of(query), places).tolist():
                    a.append(query)
                    b.append(int(self.data[0][k]))
        some = np.flatnonzero(linked)
        return [np.concatenate([own[0][some], np.array(a, np.int64)]), np.concatenate([own[0][some], np.array(b, np.int64)]), np.concatenate([linked[some], np.zeros(len(a), np.int64)])]

    def close(self) -> list[np.ndarray]:
        if not hasattr(self, "linked"):
            return [np.zeros(0, np.int64)] * 3
        some = self.linked > 0
        return [self.data[0][some], self.data[0][some], self.linked[some]]


def near_links(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For reps(vec_id, group, embedding, copies), distinct vectors of which only those of one group are compared: rows
    (a, a, n) whose n sum to the rows linked to a, and rows (a, b, 0) of links that connect all that is linked."""
    width = window(threshold) + ROUNDING
    counts = reps.groupBy("group").count()
    most = counts.agg(F.max("count")).first()[0] or 0
    # cells of the commonest group should fit into what a task holds: another direction cuts them to 0.4 at most
    grid = min(EACH - 2, max(2, math.ceil(math.log(max(1, most / HELD), 2.5))))
    schema, key = "group long, set int, cell long, side int, vec_id long, projections binary", ["group", "set", "cell"]
    data, asked = (reps.select("vec_id", "group", "embedding").mapInArrow(_cells(width, grid, x), schema) for x in (False, True))
    # near copies fall into one cell however fine the grid: crowded cells are counted and dealt over several tasks
    crowded = stored(data.groupBy(*key).count().where(F.col("count") > HELD), "crowded")
    own, visits = dealt(F.coalesce("count", F.lit(1)), F.col("vec_id"))
    sides = [x.join(crowded, key, "left").withColumn("chunk", chunk).drop("count") for x, chunk in ((data, own), (asked, visits))]
    arrays = lambda part: [part.column("vec_id").to_numpy(), fixed_width(part.column("projections"), "float16").astype(np.float32), part.column("set").to_numpy()]
    found = compared(sides[0].unionByName(sides[1]), [*key, "chunk"], arrays, lambda: _Open(width), "vec_id long, side long", key)
    found = stored(found.distinct(), "open")
    size = F.greatest(F.count("*"), F.count("*") * F.max(F.size("embedding")) * 8 / HELD_BYTES * HELD).cast("long")
    rows = stored(found.join(reps, ["vec_id", "group"]), "open_vectors")
    rows = rows.join(rows.where("side = 0").groupBy(*key).agg(size.alias("size")), key)
    own, visits = dealt(F.col("size"), F.col("vec_id"))
    rows = rows.where("side = 0").withColumn("chunk", own).unionByName(rows.where("side = 1").withColumn("chunk", visits))
    return stored(compared(rows.drop("size"), [*key, "chunk"], _whole, lambda: _Confirm(width, threshold), "a long, b long, n long"), "near_links")


def _whole(part: pa.RecordBatch) -> list[np.ndarray]:
    vectors, on = np.empty(part.num_rows, object), np.empty((part.num_rows, SETS * EACH), np.float32)
    for rows, x in _vectors(part):
        on[rows] = projections(x)
        for i, v in zip(rows.tolist(), x, strict=True):
            vectors[i] = v
    return [part.column("vec_id").to_numpy(), on, part.column("set").to_numpy(), vectors, part.column("copies").to_numpy()]


def embedding_duplicates(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of table(vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    rows = table.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fit, F.lit(False)))
    # -0.0 and 0.0 are one number here; the group is the label and the length
    whole = rows.where("fit").withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    whole = whole.withColumns({"group": F.xxhash64("label", F.size("embedding")), "digest": F.sha2(F.concat_ws(",", F.length("label").cast("string"), "label", F.transform("embedding", lambda x: x.cast("string"))), 256)})
    whole = stored(whole, "vectors")
    classes = stored(whole.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    member = whole.select("vec_id", "digest").join(classes, "digest").select("vec_id", "rep", "copies", "digest")
    reps = whole.join(classes.withColumnRenamed("rep", "vec_id"), ["digest", "vec_id"]).dropDuplicates(["digest"])
    # rows of one vec_id may be of several classes, so classes have numbers of their own
    reps = stored(reps.select(F.monotonically_increasing_id().alias("class"), "vec_id", "group", "embedding", "digest", "copies"), "reps")
    links = near_links(reps.select(F.col("class").alias("vec_id"), "group", "embedding", "copies"), threshold)
    rep = reps.select("class", F.col("vec_id").alias("rep"))
    joined = links.where("a <> b").select("a", "b")
    for own in "ab":
        joined = joined.join(rep.select(F.col("class").alias(own), F.col("rep").alias(f"rep_{own}")), own)
    several = member.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("vec_id", "a")
    same = member.join(several, "vec_id").select("a", F.col("rep").alias("b"))
    found = components(joined.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).unionByName(same))
    degree = links.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others")).join(reps.select("class", "digest"), "class").drop("class")
    out = member.join(degree, "digest", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("vec_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rest = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
