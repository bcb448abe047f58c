"""Best-fit packing by linear grouping.

Documents become token ids, are cut into pieces only where longer than a sequence, and the pieces are packed. Lengths are
small integers, so the number of pieces of each length (at most `capacity` numbers, whatever the table) is all the plan
needs: large lengths are rounded up within groups of equal cardinality, few-size configurations are chosen for the rounded
sizes, actual lengths take the places, and small lengths go best-fit into what is left. Pieces then find their place by
their rank within their length, which is computed on Spark. Null text is the empty text (one token, the end id); repeated
rows are documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .order import bucketed_total
from .shared import WordTable, slices, stored, text_groups, word_hashes, word_spans

CAPACITY = 2048
#: Sizes that large lengths are rounded to, and the least share of a sequence that makes a length large.
GROUPS, LARGE = 200, 1 / 3
END = b"\0\0\0\0"
#: Words whose ids a worker keeps, some 30 bytes each, and the longest such word in bytes.
CACHE_WORDS, CACHE_BYTES = 1_000_000, 64
#: Text that is looked at together.
TEXT_BYTES = 2 << 20

_PIECES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class WordTokenizer:
    """Token ids of texts, word by word. The vocabulary drops white space and case and no token spans white space, so a
    text's ids are its words' ids one after the other; words repeat, so most are looked up. Words that differ by A-Z or by
    a last stop or comma share a base. New bases are encoded many in one text, with a mark between them that is always a
    token of its own."""

    MARK, TOGETHER = b"|", 250

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        stop, comma, mark = (self._ids([m])[0] for m in (b".", b",", self.MARK))
        self.mark, self.last = int(mark[0]), {ord("."): int(stop[0]), ord(","): int(comma[0])}
        self.forget()

    def forget(self) -> None:
        self.table, self.flat, self.offsets = WordTable(), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _ids(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        between = b" " + self.MARK + b" "
        for at in range(0, len(words), self.TOGETHER):
            some = words[at : at + self.TOGETHER]
            own = self._ids([between.join(some)])[0]
            cuts = np.flatnonzero(own == self.mark)
            if len(cuts) == len(some) - 1:
                ids.append(np.delete(own, cuts))
                sizes.append(np.diff(cuts, prepend=-1, append=len(own)) - 1)
            else:  # a word has the mark itself
                each = self._ids(some)
                ids += each
                sizes.append(np.array(list(map(len, each))))
        return np.concatenate(ids), np.concatenate(sizes)

    def keep(self, words: list[bytes]) -> None:
        ids, sizes = self.encode(words)
        self.flat, self.offsets = np.concatenate([self.flat, ids]), np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])

    def ids(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Row and ids, in order; a very long text comes in several parts."""
        for rows, data, bounds in text_groups(column, TEXT_BYTES):
            starts, ends, first = word_spans(data, bounds)
            # bases end before a last stop or comma that follows A-Z, a-z or 0-9
            tail = data[ends - 1]
            bare = ((tail == ord(".")) | (tail == ord(","))) & _ALNUM[data[ends - 2]] & (ends - starts > 1)
            last = np.where(bare, np.where(tail == ord("."), self.last[ord(".")], self.last[ord(",")]), 0).astype("<u4")
            ends = ends - bare
            if self.table.size > CACHE_WORDS:
                self.forget()
            short = ends - starts <= CACHE_BYTES
            own = np.empty(len(starts), np.int64)
            own[short], new = self.table.find(word_hashes(data, starts[short], ends[short], lower=True))
            self.keep(slices(data, starts[short][new], ends[short][new]))
            flat, offsets = self.flat, self.offsets
            if not short.all():
                ids, sizes = self.encode(slices(data, starts[~short], ends[~short]))
                own[~short] = np.arange(len(offsets) - 1, len(offsets) - 1 + len(sizes))
                flat, offsets = np.concatenate([flat, ids]), np.concatenate([offsets, offsets[-1] + np.cumsum(sizes)])
            sizes = offsets[own + 1] - offsets[own]
            to = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes + bare)])
            out = np.empty(to[-1], "<u4")
            out[to[1:][bare] - 1] = last[bare]
            place = np.repeat(to[:-1], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out[place] = flat[np.repeat(offsets[own] - to[:-1], sizes) + place]
            for row, a, b in zip(rows.tolist(), to[first[:-1]].tolist(), to[first[1:]].tolist(), strict=True):
                yield row, out[a:b]


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_TOKENIZERS: dict[str, WordTokenizer] = {}


def _pieces(path: str, capacity: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, WordTokenizer(path))
        for part in parts:
            rows, pieces, starts, lengths, checks = [], [], [], [], []
            now, held, piece = -1, b"", 0

            def cut(end: bool) -> None:
                nonlocal held, piece
                at = 0
                while len(held) - at >= 4 * capacity or (end and at < len(held)):
                    own = held[at : at + 4 * capacity]
                    rows.append(now)
                    pieces.append(piece)
                    starts.append(piece * capacity)
                    lengths.append(len(own) // 4)
                    checks.append(zlib.crc32(own))
                    at, piece = at + len(own), piece + 1
                held = held[at:]

            for row, ids in tokenizer.ids(part.column(2)):
                if row != now and now >= 0:
                    held += END
                    cut(True)
                if row != now:
                    now, held, piece = row, b"", 0
                held += ids.tobytes()
                cut(False)
            if now >= 0:
                held += END
                cut(True)
            by = pa.array(rows, pa.int64())
            columns = [part.column(0).take(by), part.column(1).take(by), pieces, starts, lengths, checks]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, row (one for each input row), piece, start, length, ids_crc32."""
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(_pieces(path, capacity), "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], capacity: int) -> list[tuple[int, ...]]:
    """All multisets of sizes that fit: how many of each. sizes are distinct and few."""
    found: list[tuple[int, ...]] = []

    def extend(i: int, left: int, have: list[int]) -> None:
        if i == len(sizes):
            found.append(tuple(have))
            return
        for n in range(left // sizes[i] + 1):
            extend(i + 1, left - n * sizes[i], [*have, n])

    extend(0, capacity, [])
    return [x for x in found if any(x)]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Kinds of sequences for counts (length -> pieces): each ((length, how many), ...) and how many sequences are of it.

    Above a third of capacity at most two pieces fit, and then taking the fullest configuration that holds the largest size
    left is optimal for the rounded sizes: let a be that size and b the largest partner that fits it. Where an optimal packing
    has a with c and b with d, b >= c, so d fits c because it fits b, and a with b and c with d is as good; where a or b stands
    alone, putting them together costs nothing. With at most `groups` large pieces nothing is rounded."""
    out: dict[tuple, int] = {}
    big = sorted((x for x in counts if x > capacity * large and counts[x] > 0), reverse=True)
    total = sum(counts[x] for x in big)
    # equal-cardinality groups, large to small; a length may be dealt over two groups
    sized: list[list[list[int]]] = []  # for each group, [length, pieces] in falling order
    room, each = 0, max(1, -(-total // groups))
    for length in big:
        n = counts[length]
        while n:
            if not room:
                sized.append([])
                room = each
            sized[-1].append([length, k := min(n, room)])
            n, room = n - k, room - k
    merged: dict[int, list[list[int]]] = {}
    for g in sized:
        merged.setdefault(g[0][0], []).extend(g)
    sizes = sorted(merged, reverse=True)
    left = [sum(n for _, n in merged[s]) for s in sizes]
    # the fullest configuration of what is left that holds the largest size left
    options = sorted(configurations(sizes, capacity), key=lambda c: (-sum(n * s for n, s in zip(c, sizes, strict=True)), sum(c), c))
    for i in range(len(sizes)):
        for c in (c for c in options if c[i] and not any(c[:i])):
            m = min(left[j] // c[j] for j in range(i, len(sizes)) if c[j])
            if not m:
                continue
            left = [a - m * b for a, b in zip(left, c, strict=True)]
            # actual lengths take the places, largest first; a new kind begins where a run of equal lengths ends
            queues: dict[int, list[list[int]]] = {}
            for j in range(i, len(sizes)):
                if c[j]:
                    taken, need = [], m * c[j]
                    source = merged[sizes[j]]
                    while need:
                        k = min(need, source[0][1])
                        taken.append([source[0][0], k])
                        source[0][1] -= k
                        need -= k
                        if not source[0][1]:
                            source.pop(0)
                    queues[j] = taken
            while m:
                kind, run = [], m
                for j, q in queues.items():
                    # c[j] places of one size take c[j] * run pieces: equal while the first run lasts, else one sequence at a time
                    run = min(run, q[0][1] // c[j] or 1)
                for j, q in queues.items():
                    need = c[j] * run
                    while need:
                        k = min(need, q[0][1])
                        kind.append((q[0][0], k if run == 1 else k // run))
                        q[0][1] -= k
                        need -= k
                        if not q[0][1]:
                            q.pop(0)
                key = tuple(sorted(kind, reverse=True))
                out[key] = out.get(key, 0) + run
                m -= run
    return best_fit(out, {x: n for x, n in counts.items() if x <= capacity * large and n > 0}, capacity)


def best_fit(kinds: dict[tuple, int], small: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Small lengths, large to small, each into the kind of sequence with the least sufficient room; new sequences after."""
    by_room: list[dict[tuple, int]] = [{} for _ in range(capacity + 1)]
    for kind, n in kinds.items():
        by_room[capacity - sum(a * b for a, b in kind)][kind] = n
    for length in sorted(small, reverse=True):
        n, room = small[length], length
        while n:
            while room < capacity and not by_room[room]:
                room += 1
            fits = room // length
            kind, have = next(iter(by_room[room].items())) if by_room[room] else ((), n)
            if n >= fits:
                fill, bins = fits, min(have, n // fits)
            else:
                fill, bins = n, 1
            n -= fill * bins
            if kind:
                by_room[room][kind] -= bins
                if not by_room[room][kind]:
                    del by_room[room][kind]
            now, rest = (*kind, (length, fill)), room - fill * length
            by_room[rest][now] = by_room[rest].get(now, 0) + bins
            room = max(length, min(room, rest))
    return [(kind, n) for kinds_ in by_room for kind, n in kinds_.items()]


def places(kinds: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """For each length the runs of ranks that kinds take: columns first rank, a sequence's share, first sequence, offset."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for kind, n in kinds:
        offset = 0
        for length, each in kind:
            first = used.get(length, 0)
            rows.setdefault(length, []).append((first, each, sequence, offset))
            used[length] = first + each * n
            offset += each * length
        sequence += n
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(token_pieces(docs, path, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    held = docs.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    spread = F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    ranked = bucketed_total(pieces, ["length"], spread, [F.col("doc_id"), F.col("row"), F.col("piece")], F.lit(1).cast("long"), "rank", sum(counts.values()))
    schema = pa.schema([f for f in _PIECES if f.name != "row"] + [pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())])

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            length, rank = part.column("length").to_numpy(), part.column("rank").to_numpy() - 1
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                runs = held.value[int(length[own[0]])]
                run = runs[np.searchsorted(runs[:, 0], rank[own], "right") - 1]
                within = rank[own] - run[:, 0]
                sequence[own] = run[:, 2] + within // run[:, 1]
                offset[own] = run[:, 3] + within % run[:, 1] * length[own]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in schema.names[:5]), pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
