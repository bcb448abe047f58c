"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unseen word falls back to the log frequencies of its character
n-grams, the longest order of which any is known, with shorter orders only where none is. A text's language has the
largest sum; score is the softmax of the mean word score times the square root of the number of words, so it is near 1
where the words agree and near an even split where they don't. Ties go to the first language in code point order. A null
text, or one without a letter, is `und` with score 0. With no labelled rows every text is `und`. Repeated rows are
classified alike; other columns are ignored; an empty table gives no rows.

Words of any length count. One of more than LONG characters, as in scripts without spaces, is known by its digest, and its
n-grams are counted where its text is read, so that no long text is a key. A word starts with a letter; a counted token
that starts with DIGEST or GRAM is a long word or an n-gram of one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from .shared import WordTable, mix, slices, stored, text_groups, unused, word_hashes, word_spans

#: Bounds of the model that is broadcast, whatever the corpus: words and n-grams kept, whose places the languages share, and
#: languages, beyond which learn() raises an error.
MAX_WORDS, MAX_GRAMS, MAX_LANGUAGES = 50_000, 50_000, 256
#: Longest n-gram, and the count that smoothing adds.
ORDER, SMOOTH = 4, 0.5
LONG, DIGEST, GRAM = 256, "#", "+"
#: Words that a task counts before it starts anew, words whose n-grams it counts together, scores that it keeps.
COUNT_WORDS, GRAM_WORDS, CACHE_CELLS = 200_000, 40_000, 2_000_000
#: Text that is looked at together, rows that are sorted by language, characters of a long word that are cut up at a time.
TEXT_BYTES, ROWS, PIECE = 2 << 20, 1_000, 1 << 16

_COUNTS = pa.schema([("lang", pa.string()), ("token", pa.string()), ("n", pa.int64())])


def normals(words: list[bytes]) -> list[str]:
    """Words in lower case without what surrounds the letters; empty if there is none. No word holds a line end."""
    return [w if w.isalpha() else _trimmed(w) for w in b"\n".join(words).decode().lower().split("\n")] if words else []


def _trimmed(text: str) -> str:
    a, b = 0, len(text)
    while a < b and not text[a].isalpha():
        a += 1
    while b > a and not text[b - 1].isalpha():
        b -= 1
    return text[a:b]


def known_as(word: str) -> str:
    return word if len(word) <= LONG else DIGEST + hashlib.sha256(word.encode()).hexdigest()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def gram_keys(points: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit key of the n-gram at each place: up to three characters as they are, a fourth mixed in."""
    n = max(0, len(points) - order + 1)
    key = np.zeros(n, np.uint64)
    for k in range(min(order, 3)):
        key = key << np.uint64(21) | points[k : k + n]
    return mix(key) + points[3 : 3 + n] * np.uint64(0x9E3779B97F4A7C15) if order > 3 else key


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words' characters, a space around each word, the word of each, and where each word ends."""
    points = code_points("".join([f" {w} " for w in words]))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return points, np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes)


def _rows(lang: str, tokens: list[str], counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(lang, len(tokens)), pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], schema=_COUNTS)


class _Words:
    """The words of a language that a task has seen, and how often each."""

    def __init__(self):
        self.table, self.words, self.counts = WordTable(), [], np.zeros(0, np.int64)

    def add(self, texts: pa.Array) -> None:
        for _, data, bounds in text_groups(texts, TEXT_BYTES):
            starts, ends, _ = word_spans(data, bounds)
            own, new = self.table.find(word_hashes(data, starts, ends))
            self.words += slices(data, starts[new], ends[new])
            self.counts = np.bincount(own, minlength=self.table.size) + np.concatenate([self.counts, np.zeros(len(new), np.int64)])

    def totals(self, lang: str) -> Iterator[pa.RecordBatch]:
        """Counts of normal forms; of long words also those of their n-grams."""
        found: Counter = Counter()
        for word, n in zip(normals(self.words), self.counts.tolist(), strict=True):
            if word:
                found[known_as(word)] += n
                if len(word) > LONG:
                    padded = f" {word} "
                    for at in range(0, len(padded), PIECE):
                        piece = padded[at : at + PIECE + ORDER - 1]
                        for order in range(1, ORDER + 1):
                            size = min(PIECE, len(piece) - order + 1)
                            tokens, counts = _summed(code_points(piece), np.arange(max(0, size)), np.full(max(0, size), n), order)
                            yield _rows(lang, [GRAM + t for t in tokens], counts)
        yield _rows(lang, list(found), list(found.values()))


def _count_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, _Words] = {}
    for part in parts:
        for at in range(0, part.num_rows, ROWS):
            some = part.slice(at, ROWS)
            for lang in some.column(0).unique().to_pylist():
                seen.setdefault(lang, _Words()).add(some.column(1).filter(pa.compute.equal(some.column(0), lang)))
        if sum(len(x.words) for x in seen.values()) > COUNT_WORDS:
            for lang, own in seen.items():
                yield from own.totals(lang)
            seen.clear()
    for lang, own in seen.items():
        yield from own.totals(lang)


def _summed(points: np.ndarray, at: np.ndarray, counts: np.ndarray, order: int) -> tuple[list[str], np.ndarray]:
    """The distinct n-grams that start at the given places, and their counts' sums."""
    if not len(at):
        return [], counts[:0]
    keys = gram_keys(points, order)[at]
    by = np.argsort(keys)
    ranked = keys[by]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    text = points[at[by[first]][:, None] + np.arange(order)].astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + order] for i in range(0, len(text), order)], np.add.reduceat(counts[by], first)


def _count_grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[pa.RecordBatch]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in held.items():
            points, word, end = grams([w for x in own for w in x.column(1).to_numpy(zero_copy_only=False)])
            counts = np.concatenate([x.column(2).to_numpy() for x in own])[word]
            left = end[word] - np.arange(len(word))
            for order in range(1, ORDER + 1):
                at = np.flatnonzero(left >= order)
                yield _rows(lang, *_summed(points, at, counts[at], order))
        held.clear()

    compute = pa.compute
    for part in parts:
        ready, digest = compute.starts_with(part.column(1), GRAM), compute.starts_with(part.column(1), DIGEST)
        own = part.filter(ready)
        if own.num_rows:
            yield pa.RecordBatch.from_arrays([own.column(0), compute.utf8_slice_codeunits(own.column(1), 1), own.column(2)], schema=_COUNTS)
        words = part.filter(compute.invert(compute.or_(ready, digest)))
        for lang in words.column(0).unique().to_pylist():
            held.setdefault(lang, []).append(words.filter(compute.equal(words.column(0), lang)))
        size += words.num_rows
        if size > GRAM_WORDS:
            yield from flush()
            size = 0
    yield from flush()


class Model:
    """Log frequencies by language: a column for each known word and n-gram. totals and distinct are of all words (0) and
    n-grams (by order), known or not."""

    def __init__(self, languages: list[str], words: dict[str, np.ndarray], gram: dict[str, np.ndarray], totals: dict[int, np.ndarray], distinct: dict[int, int]):
        self.languages = languages
        self.words = {w: i for i, w in enumerate(words)}
        self.grams = list(gram)
        self.word_scores = self._logs(words, totals[0], distinct.get(0, 0))
        self.gram_keys, self.gram_scores = {}, {}
        for order in range(1, ORDER + 1):
            own = {g: c for g, c in gram.items() if len(g) == order}
            keys = gram_keys(code_points("".join(own)), order)[::order]
            by = np.argsort(keys)
            self.gram_keys[order], self.gram_scores[order] = keys[by], self._logs(own, totals[order], distinct.get(order, 0))[:, by]

    def _logs(self, counts: dict[str, np.ndarray], totals: np.ndarray, distinct: int) -> np.ndarray:
        rows = np.array(list(counts.values()), float).reshape(len(counts), len(self.languages))
        return np.ascontiguousarray(np.log((rows + SMOOTH) / (totals + SMOOTH * (distinct + 1))).T) if counts else rows.T

    def score(self, words: list[str]) -> np.ndarray:
        """A column of scores for each word: its own, else the mean over its longest known n-grams, else zeros."""
        out = np.zeros((len(self.languages), len(words)))
        rows = np.fromiter((self.words.get(known_as(w), -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(rows >= 0)
        out[:, known] = self.word_scores[:, rows[known]]
        left = np.flatnonzero(rows < 0)
        points, word, end = grams([words[i] for i in left])
        room, open_ = end[word] - np.arange(len(word)), np.ones(len(left), bool)
        for order in range(ORDER, 0, -1):
            keys = self.gram_keys[order]
            at = np.flatnonzero((room >= order) & open_[word])
            if not len(keys) or not len(at):
                continue
            own = gram_keys(points, order)[at]
            place = np.searchsorted(keys, own)
            place[place == len(keys)] = 0
            hit = keys[place] == own
            of, place = word[at[hit]], place[hit]
            sizes = np.bincount(of, minlength=len(left))
            done = np.flatnonzero(sizes)
            for i, scores in enumerate(self.gram_scores[order]):
                out[i, left[done]] = np.bincount(of, scores[place], len(left))[done] / sizes[done]
            open_[done] = False
        return out


def _own_places(counts: DataFrame, most: int) -> Column:
    """2 for the commonest tokens of a language, 1 for those of the next level that fit by their hash, which may be a few
    too many, else 0. All languages have equally many places, and what one has no tokens for goes to the others. Counts
    within 5 % are one level."""
    level = F.floor(F.log2("n") * 16)
    levels: dict[str, list[tuple[int, int]]] = {}
    for r in counts.groupBy("lang", level.alias("level")).count().collect():
        levels.setdefault(r["lang"], []).append((r["level"], r["count"]))
    left, cuts = most, {}
    by_size = sorted(levels, key=lambda x: (sum(n for _, n in levels[x]), x))
    for i, lang in enumerate(by_size):
        places = room = min(sum(n for _, n in levels[lang]), left // (len(by_size) - i))
        left -= places
        for at, n in sorted(levels[lang], reverse=True):
            cuts[lang] = (at - 1, 0.0) if room >= n else (at, room / n)
            room -= n
            if room <= 0:
                break
    least, part = (F.element_at(F.create_map(*(F.lit(v) for k, c in cuts.items() for v in (k, c[i]))), F.col("lang")) for i in (0, 1))
    fits = (level == least) & (F.pmod(F.xxhash64("token"), F.lit(1 << 20)) < part * (1 << 20))
    return F.when(level > least, 2).when(fits, 1).otherwise(0)


def _table(counts: DataFrame, most: int, languages: list[str]) -> dict[str, np.ndarray]:
    """The commonest tokens of each language, then the commonest of all, with their counts by language: at most `most` rows
    come to the driver."""
    own = F.max(_own_places(counts, most)).alias("own")
    top = counts.groupBy("token").agg(own, F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    return {r["token"]: np.array([r["by"].get(x, 0) for x in languages], float) for r in top.orderBy(F.desc("own"), F.desc("total"), "token").limit(most).collect()}


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model | None:
    """Counts all given rows with a text and a language; None if there are none. More than MAX_LANGUAGES are an error."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    schema = "lang string, token string, n long"
    counted = stored(rows.mapInArrow(_count_words, schema).groupBy("lang", "token").agg(F.sum("n").alias("n")), "words")
    words = counted.where(F.left("token", F.lit(1)) != GRAM)
    languages = sorted((r["lang"] for r in words.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()), key=lambda x: x.encode())
    if not languages:
        return None
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    gram = stored(counted.select("lang", "token", "n").mapInArrow(_count_grams, schema).groupBy("lang", "token").agg(F.sum("n").alias("n")), "grams")
    sums = {0: words.groupBy("lang").agg(F.sum("n")).collect()}
    for r in gram.groupBy(F.length("token").alias("order"), "lang").agg(F.sum("n").alias("n")).collect():
        sums.setdefault(r["order"], []).append((r["lang"], r["n"]))
    totals = {k: np.array([dict(tuple(x) for x in v).get(y, 0) for y in languages], float) for k, v in sums.items()}
    totals |= {k: np.zeros(len(languages)) for k in range(ORDER + 1) if k not in totals}
    distinct = {0: words.select("token").distinct().count()} | {r[0]: r[1] for r in gram.select("token").distinct().groupBy(F.length("token")).count().collect()}
    return Model(languages, _table(words, max_words, languages), _table(gram, max_grams, languages), totals, distinct)


def predict(docs: DataFrame, model: Model | None, *keep: Column | str, text_col: str = "text") -> DataFrame:
    """keep's columns, lang_pred and score for each row. Of keep's columns none may be called lang_pred or score."""
    kept = docs.select(*keep)
    names = kept.columns
    own = unused(names, "text")
    kept = docs.select(*keep, F.col(text_col).alias(own))
    fields = kept.schema.fields[:-1]
    if model is None:
        return kept.select(*(F.col(f"`{n}`") for n in names), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    most = max(1, CACHE_CELLS // len(model.languages))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        none = np.zeros((len(model.languages), 0))
        table, scores, lettered = WordTable(), none, np.zeros(0, bool)
        for part in parts:
            total, n = np.zeros((len(model.languages), part.num_rows)), np.zeros(part.num_rows, np.int64)
            for rows, data, bounds in text_groups(part.column(len(fields)), TEXT_BYTES):
                if table.size > most:
                    table, scores, lettered = WordTable(), none, lettered[:0]
                starts, ends, first = word_spans(data, bounds)
                own, new = table.find(word_hashes(data, starts, ends))
                texts = normals(slices(data, starts[new], ends[new]))
                has = np.fromiter(map(bool, texts), bool, len(texts))
                fresh = np.zeros((len(model.languages), len(texts)))
                fresh[:, has] = model.score([t for t in texts if t])
                scores, lettered = np.concatenate([scores, fresh], axis=1), np.concatenate([lettered, has])
                doc = np.repeat(np.arange(len(rows)), np.diff(first))
                n[rows] += np.bincount(doc, lettered[own], len(rows)).astype(np.int64)
                for i, of in enumerate(scores):
                    total[i, rows] += np.bincount(doc, of[own], len(rows))
            best = total.argmax(axis=0)
            with np.errstate(invalid="ignore"):
                score = 1 / np.exp((total - total.max(axis=0)) / np.sqrt(np.maximum(n, 1))).sum(axis=0)
            lang = [model.languages[i] if k else "und" for i, k in zip(best.tolist(), n.tolist(), strict=True)]
            columns = [*(part.column(i) for i in range(len(fields))), pa.array(lang, pa.string()), pa.array(np.where(n > 0, score, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double"])
    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents never learned from: a fifth, by the CRC-32 of doc_id as text. A null doc_id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
