"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def roots(nodes, links):
    """node -> smallest node reachable."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def line_dedup(docs, least):
    """docs: (doc_id, text, source). doc_id -> (n_lines, n_removed, text)."""
    sites, first = defaultdict(set), {}
    for doc_id, text, source in docs:
        for i, line in enumerate((text or "").split("\n")):
            if line := line.strip(" \t\r"):
                sites[line].add(source)
                first[line] = min(first.get(line, (doc_id, i)), (doc_id, i))
    out = {}
    for doc_id, text, _ in docs:
        if text is None:
            out[doc_id] = (0, 0, None)
            continue
        lines = text.split("\n")
        bare = [x.strip(" \t\r") for x in lines]
        gone = {i for i, x in enumerate(bare) if x and len(sites[x]) >= least and first[x] != (doc_id, i)}
        out[doc_id] = (sum(map(bool, bare)), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def substring_dedup(docs, width=20):
    """docs: (doc_id, text). doc_id -> (n_words, n_removed, kept text)."""
    own, first = {i: words(t) for i, t in docs}, {}
    for i in sorted(own):
        for p in range(len(own[i]) - width + 1):
            first.setdefault(tuple(own[i][p : p + width]), (i, p))
    out = {}
    for i, w in own.items():
        keep = [True] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] != (i, p):
                keep[p : p + width] = [False] * width
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out[i] = (len(w), len(w) - len(kept), " ".join(kept))
    return out


def embedding_dedup(rows, least=0.98):
    """rows: (vec_id, embedding, label). vec_id -> (n_links, component_id)."""
    links, fit = defaultdict(set), []
    for i, e, label in rows:
        if label is None or e is None or not len(e) or any(x is None for x in e):
            continue
        v = np.array(e, float)
        if np.isfinite(v).all() and v.any():
            fit.append((i, v / np.linalg.norm(v), label))
    for a in range(len(fit)):
        for b in range(a):
            if fit[a][2] == fit[b][2] and len(fit[a][1]) == len(fit[b][1]) and fit[a][1] @ fit[b][1] >= least:
                links[fit[a][0]].add(fit[b][0])
                links[fit[b][0]].add(fit[a][0])
    root = roots([r[0] for r in rows], [(a, b) for a in links for b in links[a]])
    return {i: (len(links[i]), root[i]) for i, _, _ in rows}


def targets(sizes, weights=(5, 2, 1), epochs=3):
    """sizes: source -> words. source -> target."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in capped)
        level = (total - sum(epochs * sizes[s] for s in capped)) / free if free else 0
        over = {s for s in order if s in capped or epochs * sizes[s] < level * weight[s]}
        if over == capped:
            return {s: float(min(epochs * sizes[s], level * weight[s])) for s in order}
        capped = over


def mixing(docs):
    """docs: (doc_id, text, source). doc_id -> (size, source_size, target, taken)."""
    size = {i: len(words(t)) for i, t, _ in docs}
    total = defaultdict(int)
    for i, _, s in docs:
        total[s] += size[i]
    target, sent, queue = targets(total), defaultdict(int), []
    key = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in size}
    for i, _, s in sorted(docs, key=lambda d: (key[d[0]], d[0])):
        sent[s] += size[i]
        for e in range(3) if size[i] else ():
            at = e * total[s] + sent[s]
            if at - size[i] <= target[s]:
                queue.append((at / target[s], (s is None, s or ""), e, key[i], i))
    taken, spent = defaultdict(int), 0
    for *_, i in sorted(queue):
        spent += size[i]
        if spent > sum(size.values()):
            break
        taken[i] += size[i]
    return {i: (size[i], total[s], target[s], taken[i]) for i, _, s in docs}


def near_duplicates(docs, least=75, k=5):
    """docs: (doc_id, text). doc_id -> (n_shingles, component_id)."""
    sets, by = {}, defaultdict(list)
    for i, t in docs:
        w = words(lower(t))
        sets[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        for x in sets[i]:
            by[x].append(i)
    links = set()
    for i, own in sets.items():
        n = defaultdict(int)
        for x in own:
            for j in by[x]:
                n[j] += 1
        links |= {(i, j) for j, c in n.items() if j != i and 100 * c >= least * (len(own) + len(sets[j]) - c)}
    root = roots(sets, links)
    return {i: (len(sets[i]), root[i]) for i in sets}


def exact(docs):
    """docs: (doc_id, text). doc_id -> (keep_id, group_size, kept, digest)."""
    by = defaultdict(list)
    for i, t in docs:
        by[lower(t)].append(i)
    return {i: (max(g), len(g), i == max(g), sha(t)) for t, g in by.items() for i in g}


def packed_ids(docs, path, capacity=2048):
    """docs: (doc_id, text). (doc_id, piece) -> (start, length, crc)."""
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(path), {}
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out[i, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    return out


def sequences(lengths, capacity=2048):
    """How many sequences plain best fit makes of lengths, large to small."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - n)
    return len(rooms)


def token_count(text, vocabulary, mark="▁", known={}):  # noqa: B006
    """(pre-tokens, tokens) of a text, one distinct pre-token at a time."""
    total, own = 0, words(text)
    for w in own:
        if w in known:
            total += known[w]
            continue
        t = mark + w
        score, count = [0.0], [0]
        for at in range(1, len(t) + 1):
            width = len(t[at - 1].encode())
            best = (score[at - 1] + vocabulary.byte * width, -1, count[at - 1] + width)
            for start in range(max(0, at - vocabulary.longest), at):
                piece = vocabulary.scores.get(t[start:at])
                if piece is not None:
                    best = max(best, (score[start] + piece, at - start, count[start] + 1))
            score.append(best[0])
            count.append(best[2])
        known[w] = count[-1]
        total += count[-1]
    return len(own), total


def language(learned, asked, order=4, smoothing=0.5):
    """learned: (text, lang). asked: texts. (language, score) of each; counts everything, without bounds."""

    def normal(w):
        w = w.lower()
        letters = [i for i, c in enumerate(w) if c.isalpha()]
        return w[letters[0] : letters[-1] + 1] if letters else ""

    def grams(w, n):
        w = f" {w} "
        return [w[i : i + n] for i in range(len(w) - n + 1)]

    langs = sorted({x for t, x in learned if x is not None and t is not None})
    counts = [defaultdict(lambda: np.zeros(len(langs))) for _ in range(order + 1)]
    for text, lang in learned:
        for w in map(normal, words(text)) if lang is not None else ():
            if w:
                counts[0][w][langs.index(lang)] += 1
                for n in range(1, order + 1):
                    for g in grams(w, n):
                        counts[n][g][langs.index(lang)] += 1
    totals = [sum(c.values(), np.zeros(len(langs))) for c in counts]
    log = [{k: np.log((v + smoothing) / (totals[n] + smoothing * (len(c) + 1))) for k, v in c.items()} for n, c in enumerate(counts)]

    def of(w):
        if w in log[0]:
            return log[0][w]
        for n in range(order, 0, -1):
            if found := [log[n][g] for g in grams(w, n) if g in log[n]]:
                return np.mean(found, axis=0)
        return np.zeros(len(langs))

    out = []
    for text in asked:
        scores = [of(w) for w in map(normal, words(text)) if w]
        if not scores or not langs:
            out.append(("und", 0.0))
            continue
        total = np.sum(scores, axis=0)
        best = int(np.argmax(total))
        out.append((langs[best], float(1 / np.exp((total - total[best]) / np.sqrt(len(scores))).sum())))
    return out


def warc(pages):
    """pages: (page_id, html). page_id -> (bytes, digest, type, refers_to)."""
    best = {}
    for i, html in pages:
        best[html or ""] = max(best.get(html or "", i), i)
    out = {}
    for i, html in pages:
        data = (html or "").encode()
        own = best[html or ""] == i
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else best[html or ""])
    return out
