"""Comparing the rows of a cell without a join: data rows are held, query rows stream past them in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Data rows, or bytes of them, that a task holds at once; a larger cell is dealt over several, and its queries go to each.
HELD, HELD_BYTES = 4096, 16 << 20


class Cell(Protocol):
    def hold(self, own: list[np.ndarray]) -> None:
        """Data rows, which come before all queries."""

    def ask(self, own: list[np.ndarray]) -> list[np.ndarray]:
        """The output columns for some queries."""

    def close(self) -> list[np.ndarray]:
        """More output at the end."""


class Joined:
    """The components of held rows, as links join them; labels are changed in place."""

    def __init__(self, labels: np.ndarray):
        self.labels, self.now = labels, {}

    def of(self, component: int) -> int:
        while component in self.now:
            component = self.now[component]
        return component

    def join(self, component: int, places: np.ndarray) -> np.ndarray:
        """One of the places for each other component there; all become one with `component`."""
        found, first = np.unique(self.labels[places], return_index=True)
        other = found != component
        if not other.any():
            return places[:0]
        least = min(component, int(found[0]))
        gone = [x for x in [component, *found[other].tolist()] if x != least]
        self.now.update(dict.fromkeys(gone, least))
        self.labels[np.isin(self.labels, gone)] = least
        return places[first[other]]


def fixed_width(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column whose values have one length as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros((0, 0), kind)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.ascontiguousarray(data).view(kind).reshape(len(column), -1)


def compared(rows: DataFrame, keys: list[str], arrays: Callable[[pa.RecordBatch], list[np.ndarray]], make: Callable[[], Cell], schema: str, out_keys: list[str] | None = None) -> DataFrame:
    """What a Cell made for each cell (distinct keys) puts out, with the out_keys of the cell. rows has keys, the integer
    `side` (0 data, 1 query) and what arrays() turns into arrays with a row for each row. All output columns are longs."""
    spread = rows.repartition(*keys).sortWithinPartitions(*keys, "side")
    own_keys = [keys.index(k) for k in out_keys or ()]
    names = [*(out_keys or ()), *(c.split()[0] for c in schema.split(","))]
    width = len(names) - len(own_keys)

    def batch(found: list[tuple[tuple, list[np.ndarray]]]) -> pa.RecordBatch:
        columns = [[np.full(len(x[0]), key[k], np.int64) for key, x in found] for k in own_keys]
        columns += [[x[i] for _, x in found] for i in range(width)]
        return pa.RecordBatch.from_pydict({n: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for n, c in zip(names, columns, strict=True)})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cell = None, None
        for part in parts:
            if not part.num_rows:
                continue
            values = [part.column(k).to_numpy(zero_copy_only=False) for k in [*keys, "side"]]
            change = np.zeros(part.num_rows, bool)
            for v in values:
                change[1:] |= v[1:] != v[:-1]
            own, found = arrays(part), []
            bounds = [0, *np.flatnonzero(change), part.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                key, segment = tuple(v[a] for v in values[:-1]), [x[a:b] for x in own]
                if key != current:
                    if cell:
                        found.append((current, cell.close()))
                    current, cell = key, None
                if values[-1][a] == 0:
                    cell = cell or make()
                    cell.hold(segment)
                elif cell:
                    found.append((key, cell.ask(segment)))
            yield batch(found)
        if cell:
            yield batch([(current, cell.close())])

    return spread.mapInArrow(run, ", ".join([*(f"{k} long" for k in out_keys or ()), schema]))


def both_sides(rows: DataFrame, columns: list[str], count: Column, row: Column) -> DataFrame:
    """Each row as data in a chunk of its cell of `count` rows, and as a query of all of the cell's chunks."""
    own, visits = dealt(count, row)
    return rows.select(*columns, F.lit(0).alias("side"), own.alias("chunk")).unionByName(rows.select(*columns, F.lit(1).alias("side"), visits.alias("chunk")))


def dealt(count: Column, row: Column) -> tuple[Column, Column]:
    """The chunk of a data row, and the chunks that a query visits, for a cell of `count` rows."""
    chunks = F.greatest(F.lit(1), F.ceil(count / HELD)).cast("int")
    return F.pmod(F.xxhash64(row), chunks).cast("int"), F.explode(F.sequence(F.lit(0), chunks - 1))
