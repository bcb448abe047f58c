"""Packages with each kind of index, and long words of a trie."""

from __future__ import annotations

import gzip
import json
import zipfile

import pytest

from tracewarden.llm import token_counts, warc_zip

PAGES = {i: f"<p>{i}</p>" * (i + 1) for i in range(5)}


def _package(path, index: dict[str, bytes], places: list, packed: bool = True) -> None:
    """An archive of PAGES with the given index members; places gets offset and length of each record."""
    data = b""
    for i, html in PAGES.items():
        raw = warc_zip.record(i, f"http://x/{i}", html.encode(), None)
        raw = gzip.compress(raw, mtime=0) if packed else raw
        places.append((len(data), len(raw)))
        data += raw
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/a.warc.gz", data)
        for name, make in index.items():
            z.writestr(f"indexes/{name}", make(places))


def _cdx(places, head=" CDX N b V S g"):
    letters = head.split()[1:]
    told = lambda i, a, n: {"N": f"x)/{i}", "b": "20000101", "V": str(a), "S": str(n), "g": "a.warc.gz"}
    return "\n".join([head, *(" ".join(told(i, a, n)[x] for x in letters) for i, (a, n) in enumerate(places)), ""]).encode()


def _cdxj(places, folder="", length=True):
    rows = ({"url": f"http://x/{i}", "offset": str(a), "filename": f"{folder}a.warc.gz"} | ({"length": n} if length else {}) for i, (a, n) in enumerate(places))
    return ("!meta {\"format\": \"cdxj\"}\n" + "".join(f"x)/{i} 20000101 {json.dumps(r)}\n" for i, r in enumerate(rows))).encode()


@pytest.mark.parametrize(
    "index",
    [
        {"index.cdx": _cdx},
        {"index.cdx": lambda p: _cdx(p, " CDX g b N V")},
        {"index.cdxj": _cdxj},
        {"index.cdxj": lambda p: _cdxj(p, "archive/", False)},
        {"index.cdx.gz": lambda p: gzip.compress(_cdx(p))},
        {"index.cdx.gz": lambda p: gzip.compress(_cdxj(p)[:60]) + gzip.compress(_cdxj(p)[60:]), "index.idx": lambda p: b"!meta {}\nx)/0 0 1 2\n"},
        {"a.cdxj": _cdxj, "b.cdx": _cdx, "c.cdx.gz": lambda p: gzip.compress(_cdxj(p, "archive/"))},
    ],
    ids=["cdx", "cdx without sizes", "cdxj", "cdxj without lengths", "gzip cdx", "gzip members beside idx", "several"],
)
@pytest.mark.parametrize("packed", [True, False], ids=["gzip records", "plain records"])
def test_every_record_once_by_each_kind_of_index(spark, tmp_path, index, packed):
    _package(tmp_path / "p.zip", index, [], packed)
    packages = spark.createDataFrame([(f"file://{tmp_path}/p.zip", 1)], "path string, bytes long")
    found = warc_zip.read_packages(packages).collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in found) == sorted(PAGES.items())


def test_archives_without_an_index_are_an_error(tmp_path):
    _package(tmp_path / "p.zip", {}, [])
    storage, at = warc_zip.open_storage(f"file://{tmp_path}/p.zip")
    with storage.open_input_file(at) as f, pytest.raises(ValueError, match="no index lists records of archive/a.warc.gz"):
        warc_zip.located(f, warc_zip.members(f))


def test_records_of_others():
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1-2>\r\nContent-Length: 28\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nhey\r\n\r\n"
    assert warc_zip.parse(raw)[:5] == (None, "", "response", None, 3)


PIECES = ["▁", "a", "b", "ab", "aba", "語", "日本", "本語", "▁日", "日"]


class _Counting(dict):
    lookups = 0

    def get(self, *a):
        self.lookups += 1
        return super().get(*a)


def _plain(vocabulary, text):
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        width = len(text[end - 1].encode())
        ways = [(best[end - 1][0] + vocabulary.byte * width, best[end - 1][1] + width)]
        for start in range(end - 1, -1, -1):
            score = vocabulary.scores.get(text[start:end])
            if score is not None and best[start][0] + score >= ways[0][0]:
                ways = [(best[start][0] + score, best[start][1] + 1)]
        best.append(ways[0])
    return best[-1][1]


def test_long_words_count_as_plain_ones_do():
    vocabulary = token_counts.Vocabulary(PIECES)
    words = ["日本語" * 30, "日本語" * 30 + "x", "日本" * 40, "ab" * 50, "aba" * 40, "ab", "語", "z" * 65, "z" * 64, "日本語" * 30 + "é"]
    assert vocabulary.counts([w.encode() for w in words]).tolist() == [_plain(vocabulary, token_counts.MARK + w) for w in words]


def test_shared_prefixes_of_long_words_are_computed_once():
    vocabulary = token_counts.Vocabulary(PIECES)
    vocabulary.scores = counting = _Counting(vocabulary.scores)
    vocabulary.counts([("日本語" * 100).encode()])
    one = counting.lookups
    counting.lookups = 0
    vocabulary.counts([("日本語" * 100 + c).encode() for c in "abcdefghij"])
    assert one < counting.lookups < one + 10 * (vocabulary.longest + 1)
