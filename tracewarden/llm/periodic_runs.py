"""Periodic run detection: repeated k-gram masking, then Main-Lorentz on what is left.

A run is a stretch of consecutive words with smallest period q and length >= max(least, 2 * q) that no neighbouring word extends
keeping period q. All of it lies in two equal, shifted parts of length - q words, and length - q is at least half of least,
so every word of a run stands in a k-gram, k = least / 2 rounded up, that its document holds twice. Words outside such k-grams can't
join runs; the segments between them are taken apart by Main and Lorentz: halved again and again, and at each centre every
period is tried, for it makes a run across the centre where its extensions to both sides add up to the period. All centres of a
level go through together. Extensions are found by halving on hashes of prefixes; each run is then compared word by word, and
a segment in which the hashes were wrong is gone through without them. Of the periods of one stretch the smallest counts.

Words are runs of other than white space, unchanged, and known by 64-bit hashes; a document's words that share one are compared byte
for byte. Documents are whole in their task and nothing shuffles: a task holds the words of a batch of documents of PIECE_BYTES,
or of one that is larger. Null and empty texts have no words and no runs; rows are judged alone, repeated or not; results replace columns
of their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import PIECE_BYTES, mix, rolling, text_buffers, word_hashes, word_spans
from .spans import expanded, joined, same_bytes, stretches

LEAST = 12
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_BASE = 0x9E3779B97F4A7C15


def masked(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments (from, to) of words within k-grams that their row holds twice; a row's words are first[row] to first[row + 1]."""
    none = np.zeros(0, np.int64)
    if len(hashes) < k:
        return none, none
    at = np.arange(len(hashes) - k + 1)
    row = np.searchsorted(first, at, "right") - 1
    at, row = (x[at + k <= first[row + 1]] for x in (at, row))
    keys = rolling(hashes, k)[at] ^ mix(row.astype(np.uint64))
    order = np.argsort(keys)
    equal = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    edges[at[twice]] += 1
    edges[at[twice] + k] -= 1
    return stretches(np.cumsum(edges[:-1]) > 0, first)


class _Prefixes:
    """Hashes of all stretches of a sequence of words."""

    def __init__(self, words: np.ndarray):
        self.powers = np.full(len(words) + 1, _BASE, np.uint64)
        self.powers[0] = 1
        np.multiply.accumulate(self.powers, out=self.powers)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words + np.uint64(1)) * self.powers[:-1], out=self.sums[1:])

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, ahead: bool) -> np.ndarray:
        """How many words from i and j (i < j) on agree, or before them if not ahead; at most `most`."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        shift = self.powers[j - i]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            n = (low[open_] + high[open_] + 1) // 2
            a, b = i[open_] - (0 if ahead else n), j[open_] - (0 if ahead else n)
            equal = (self.sums[a + n] - self.sums[a]) * shift[open_] == self.sums[b + n] - self.sums[b]
            low[open_[equal]] = n[equal]
            high[open_[~equal]] = n[~equal] - 1


def repetitions(words: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs of segments of words, which bounds separate."""
    prefixes, short = _Prefixes(words), np.zeros(len(words), np.uint64)
    part = (-(-least // 2) + 1) // 2  # one extension at least has so many words
    if len(words) >= part:
        short = np.append(rolling(words, part), np.zeros(part - 1, np.uint64))
    found = [np.zeros((3, 0), np.int64)]
    low, high = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    first, last = low, high
    while True:
        wide = high - low >= least
        low, high, first, last = low[wide], high[wide], first[wide], last[wide]
        if not len(low):
            break
        centre = (low + high) // 2
        for ahead in (True, False):
            node, q = expanded(np.ones(len(low), np.int64), high - centre if ahead else centre - low)
            c, a, z = centre[node], first[node], last[node]
            left, right = (c, c + q) if ahead else (c - q, c)
            # equal short stretches to the right of both, or to the left
            hit = (right + part <= z) & (short[left] == short[np.minimum(right, len(words) - 1)])
            hit |= (left - part >= a) & (short[left - part] == short[right - part])
            left, right, q, a, z = left[hit], right[hit], q[hit], a[hit], z[hit]
            back, on = prefixes.common(left, right, left - a, False), prefixes.common(left, right, z - right, True)
            whole = (back + on >= q) & (back + on + q >= least)
            found.append(np.stack([left[whole] - back[whole], right[whole] + on[whole], q[whole]]))
        low, high, first, last = np.concatenate([low, centre]), np.concatenate([centre, high]), np.concatenate([first, first]), np.concatenate([last, last])
    return _smallest(np.concatenate(found, axis=1))


def _smallest(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its smallest period, by start and then period."""
    found = found[:, np.lexsort((found[2], found[1], found[0]))]
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])
    found = found[:, new]
    return tuple(found[:, np.lexsort((found[2], found[0]))])


def _sound(words: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Whether each run has its period and no neighbour extends it, by the words themselves."""
    raw = words.view(np.uint8)
    fine = same_bytes(raw, 8 * starts, raw, 8 * (starts + periods), 8 * (ends - starts - periods)) if len(starts) else np.zeros(0, bool)
    own = np.searchsorted(bounds, starts, "right")
    before, behind = starts > bounds[own - 1], ends < bounds[own]
    longer = before & (words[starts - 1] == words[starts - 1 + periods])
    longer |= behind & (words[np.minimum(ends, len(words) - 1)] == words[np.minimum(ends, len(words) - 1) - periods])
    return fine & ~longer


def plain_repetitions(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same runs of one segment, a period at a time and without hashes."""
    found = [np.zeros((3, 0), np.int64)]
    for q in range(1, len(words) // 2 + 1):
        a, b = stretches(words[q:] == words[:-q], np.array([0, len(words) - q]))
        keep = (b - a >= q) & (b - a + q >= least)
        found.append(np.stack([a[keep], b[keep] + q, np.full(keep.sum(), q)]))
    return _smallest(np.concatenate(found, axis=1))


def runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs of segments, by start and then period."""
    starts, ends, periods = repetitions(words, bounds, least)
    wrong = np.unique(np.searchsorted(bounds, starts[~_sound(words, bounds, starts, ends, periods)], "right")) - 1
    if not len(wrong):
        return starts, ends, periods
    keep = ~np.isin(np.searchsorted(bounds, starts, "right") - 1, wrong)
    found = [np.stack([starts[keep], ends[keep], periods[keep]])]
    for s in wrong.tolist():
        a, b, q = plain_repetitions(words[bounds[s] : bounds[s + 1]], least)
        found.append(np.stack([a + bounds[s], b + bounds[s], q]))
    return _smallest(np.concatenate(found, axis=1))


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers of the words: equal where their bytes are."""
    _, lead, own = np.unique(hashes, return_index=True, return_inverse=True)
    lead, lengths = lead[own], ends - starts
    fits = lengths == lengths[lead]
    if fits.all():
        fits = same_bytes(data, starts, data, starts[lead], lengths) if len(starts) else fits
    if fits.all():
        return own.astype(np.uint64)
    whole, known = data.tobytes(), {}
    return np.array([known.setdefault(whole[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def _group(data: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Words per row; rows, starts (in the row), lengths and periods of runs; collapsed texts as bytes and offsets."""
    starts, ends, first = word_spans(data, bounds)
    hashes = word_hashes(data, starts, ends)
    a, b = masked(hashes, first, -(-least // 2))
    a, b = (x[b - a >= least] for x in (a, b))
    _, word = expanded(a, b - a)
    own = np.append(0, np.cumsum(b - a))
    s, e, q = runs(_distinct(data, starts[word], ends[word], hashes[word]), own, least) if len(word) else [np.zeros(0, np.int64)] * 3
    shift = (a - own[:-1])[np.searchsorted(own, s, "right") - 1] if len(s) else s
    s, e = s + shift, e + shift
    row = np.searchsorted(first, s, "right") - 1
    edges = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edges, s + q, 1)
    np.add.at(edges, e, -1)
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    text, offsets = joined(data, starts[kept], ends[kept], np.searchsorted(first, kept, "right") - 1, len(bounds) - 1)
    return np.diff(first), [row, s - first[row], e - s, q], text, offsets


def _detect(text: str, names: list[str], least: int, piece: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ends, at = np.cumsum(pc.binary_length(part.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < part.num_rows:
                n = max(1, int(np.searchsorted(ends, piece + (ends[at - 1] if at else 0), "right")) - at)
                own = part.slice(at, n)
                data, offsets = text_buffers(own.column(text))
                words, (row, *values), kept, edges = _group(data, offsets, least)
                counts = np.append(0, np.cumsum(np.bincount(row, minlength=n))).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in values], names=["start", "length", "period"]))
                collapsed = pa.LargeStringArray.from_buffers(n, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())).cast(pa.string())
                rest = [(c, own.column(c)) for c in own.schema.names if c not in (text, *names)]
                yield pa.RecordBatch.from_arrays([x for _, x in rest] + [pa.array(words), found, collapsed], names=[c for c, _ in rest] + names)
                at += n

    return run


def periodic_runs(docs: DataFrame, *keep: str, least: int = LEAST) -> DataFrame:
    """For each row of docs(text, ...) the columns to keep and n_words, runs (start, length, period in words, by start and then period),
    collapsed: the words but those that a run contains after its first period, joined by one space."""
    names = ["n_words", "runs", "collapsed"]
    keep = tuple(c for c in keep if c not in names)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(_detect("_text", names, least, PIECE_BYTES), schema)


def longest(found: Column) -> Column:
    """The run of greatest length; of several the smallest start, then period. Null where there is none."""
    order = F.transform(found, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(order)


def planted(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in which every tenth document by checksum repeats a stretch of its own words to its end: a known share
    of periodic texts, for measurements. Words i >= a become a + (i - a) % p with a, p taken from the checksum."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, own = F.floor(h / 10), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, own).alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", (F.col("g") % F.when(F.col("n") > 0, F.col("n"))).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), 1, rest)
    text = F.array_join(F.concat(F.slice("words", 1, F.col("a")), repeated), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))
