"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

A pre-token is a maximal run of characters other than white space, after one word-start mark. Its count is the number of
pieces in its best segmentation: pieces of the vocabulary score the logarithm of Zipf's frequency for their rank, and a
character that no piece covers falls back to its UTF-8 bytes. The forward scores of a prefix don't depend on what follows,
so distinct pre-tokens go into a trie and each node, a shared prefix, is computed once; a terminal keeps its count. Among
equal scores the last piece is the longest. Null and empty texts have no tokens; other columns are ignored; repeated rows
count alike; an empty table gives no rows.

The trie is built from sorted words: a word's nodes are new beyond the prefix it shares with the word before it. All new
nodes of one depth are computed together, and the pieces that end in a node are found by walking back from it through a
trie of the reversed vocabulary, which ends most walks after a few characters. Long words, as scripts without spaces have
them, make a second trie whose nodes are visited depth first: only the path to the current node is held, and what words share
is computed once here too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import WordTable, slices, text_groups, word_hashes, word_spans

MARK = "▁"
#: What one byte of a fallback scores less than the rarest piece.
BYTE_PENALTY = 10.0
#: Pre-tokens of whose counts a worker keeps; beyond, it starts anew, so its memory is bounded.
CACHE_WORDS = 2_000_000
#: Text that is looked at together, and words of one trie.
TEXT_BYTES, TRIE_WORDS = 2 << 20, 20_000
#: Longer pre-tokens (in bytes) stand in a trie that is walked depth first: a matrix of all depths would mostly be empty.
LONG = 64


class Vocabulary:
    """Pieces of a vocabulary file with their scores, and a trie of the reversed pieces: the state after a character is the
    child of the state before, found by state * letters + letter in sorted keys; state 0 is the root."""

    def __init__(self, pieces: list[str]):
        n = sum(1 / r for r in range(1, len(pieces) + 1)) if pieces else 1.0
        self.scores = {p: -math.log((r + 1) * n) for r, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.byte = -math.log((len(pieces) + 1) * n) - BYTE_PENALTY
        alphabet = sorted({c for p in self.scores for c in p})
        letter = {c: i + 1 for i, c in enumerate(alphabet)}
        self.letters = len(alphabet) + 1
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, self.letters)
        children: dict[int, int] = {}
        ends = [math.nan]
        for piece, score in self.scores.items():
            state = 0
            for c in reversed(piece):
                key = state * self.letters + letter[c]
                state = children.setdefault(key, len(ends))
                if state == len(ends):
                    ends.append(math.nan)
            ends[state] = score
        self.ends = np.array(ends)
        order = np.argsort(np.fromiter(children, np.int64, len(children)))
        self.keys = np.append(np.fromiter(children, np.int64, len(children))[order], np.iinfo(np.int64).max)
        self.children = np.append(np.fromiter(children.values(), np.int64, len(children))[order], 0)
        self.root = np.zeros(self.letters, np.int64)  # the first step of all walks
        first = self.keys < self.letters
        self.root[self.keys[first]] = self.children[first]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """The pieces of a sentencepiece model in rank order, without its control and byte pieces."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        return cls([model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))])

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The states after one more character to the left, 0 where no piece ends so."""
        if not len(states):
            return states
        asked = states * self.letters + letters
        at = np.searchsorted(self.keys, asked)
        return np.where(self.keys[at] == asked, self.children[at], 0)

    def count_deep(self, words: list[str]) -> Iterator[int]:
        """The counts of sorted distinct pre-tokens, by one trie of them in depth-first order: the path to a word goes on from the
        prefix that it shares with the word before, and each node on it is computed once."""
        known, longest = self.scores, self.longest
        scores, pieces = [0.0], [0]
        before = ""
        for text in words:
            shared = len(commonprefix((before, text)))
            del scores[shared + 1 :], pieces[shared + 1 :]
            for at in range(shared, len(text)):
                width = len(text[at].encode())
                best, count = scores[at] + self.byte * width, pieces[at] + width
                for start in range(at, max(-1, at - longest), -1):
                    own = known.get(text[start : at + 1])
                    if own is not None and scores[start] + own >= best:
                        best, count = scores[start] + own, pieces[start] + 1
                scores.append(best)
                pieces.append(count)
            before = text
            yield pieces[-1]

    def count_trie(self, words: list[str]) -> np.ndarray:
        """The counts of sorted distinct pre-tokens, by one trie of them. A node stands at the first word that has its prefix;
        `scores` and `pieces` have a row for each depth and a column for each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        depth = int(lengths.max())
        points = np.zeros((depth, len(words)), np.uint32)
        own = np.repeat(np.arange(len(words)), lengths)
        within = np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        points[within, own] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        letters = self.letter[points]
        scores, pieces = np.zeros((depth + 1, len(words))), np.zeros((depth + 1, len(words)), np.int32)
        same = np.ones(len(words), bool)  # as the word before, up to this depth
        same[0] = False
        for d in range(depth):
            same[1:] &= points[d, 1:] == points[d, :-1]
            node = np.flatnonzero(~same & (lengths > d))
            c = points[d, node]
            width = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            best, count = scores[d, node] + self.byte * width, pieces[d, node] + width.astype(np.int32)
            state, back, at = self.root[letters[d, node]], d, np.arange(len(node))
            while True:
                at, state = at[state > 0], state[state > 0]
                if not len(at):
                    break
                start = node[at]
                total = scores[back, start] + self.ends[state]
                better = total >= best[at]  # never where no piece ends
                best[at[better]] = total[better]
                count[at[better]] = pieces[back, start[better]] + 1
                back -= 1
                if back < 0:
                    break
                state = self.step(state, letters[back, start])
            holder = np.maximum.accumulate(np.where(same, 0, np.arange(len(words))))
            scores[d + 1, node], pieces[d + 1, node] = best, count
            scores[d + 1], pieces[d + 1] = scores[d + 1, holder], pieces[d + 1, holder]
        return pieces[lengths, np.arange(len(words))]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The counts of pre-tokens without their mark."""
        out = np.empty(len(words), np.int32)
        short = sorted((w, i) for i, w in enumerate(words) if len(w) <= LONG)
        for at in range(0, len(short), TRIE_WORDS):
            some = short[at : at + TRIE_WORDS]
            out[[i for _, i in some]] = self.count_trie([MARK + w.decode() for w, _ in some])
        deep = sorted((w, i) for i, w in enumerate(words) if len(w) > LONG)
        out[[i for _, i in deep]] = list(self.count_deep([MARK + w.decode() for w, _ in deep]))
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def _count(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _VOCABULARIES.get(path) or _VOCABULARIES.setdefault(path, Vocabulary.load(path))
        table, known = WordTable(), np.zeros(0, np.int32)
        for part in parts:
            words, tokens = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            for rows, data, bounds in text_groups(part.column(1), TEXT_BYTES):
                if table.size > CACHE_WORDS:
                    table, known = WordTable(), known[:0]
                starts, ends, first = word_spans(data, bounds)
                own, new = table.find(word_hashes(data, starts, ends))
                known = np.concatenate([known, vocabulary.counts(slices(data, starts[new], ends[new]))])
                total = np.concatenate([np.zeros(1, np.int64), np.cumsum(known[own], dtype=np.int64)])
                words[rows] += np.diff(first)
                tokens[rows] += np.diff(total[first])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(tokens)], schema=schema)

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for each row, without a shuffle: counts are shared by what a task reads."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count(path), "doc_id long, n_pretokens long, n_tokens long")
