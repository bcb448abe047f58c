"""WARC records in ZIP packages: written by tasks into the shared folder, read back by byte ranges.

Each package holds stored (uncompressed) members: archives below archive/, with one gzip member per record, and indexes below
indexes/, with a line "offset length name" per record, name being the archive's below archive/. The writer makes one of each. Of pages with equal payloads of at least `least_bytes` bytes the one
with the largest page_id is a response and the others are revisits of it. A null html is the empty payload; a null page_id
is never the response of a group that has another, and is one where all are null; rows repeated with one page_id are all
responses or all revisits; other columns are ignored; an empty table gives no packages and no records.

The reader needs only a package's tail, its central directory (ZIP64 too), its indexes and the ranges asked for. It reads the
indexes of others too: CDX whose first line names its fields, and CDXJ, each plain or gzip; a record that several indexes list
is read once, one without a length ends where the next one of its archive begins. Archives may be gzip by record or plain.
Records of others have no page_id; an archive without any index is an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import fresh_path, stored

ARCHIVES, INDEXES = "archive/", "indexes/"
DATA, INDEX = f"{ARCHIVES}data.warc.gz", f"{INDEXES}index.cdx"
#: A task begins a new package beyond this many bytes; neighbouring records are read together, RECORDS at a time, large ones alone.
PACKAGE_BYTES, RECORDS, READ_BYTES = 32 << 20, 256, 4 << 20
#: Bytes of compressed records that a task reads.
TASK_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"
URN = "urn:x-page:"
GZIP = b"\x1f\x8b"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_storage(uri: str):
    """The Arrow file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; of a revisit only the HTTP head is kept."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=chr(37) + ''.join(chr(c) for c in range(33, 127)))}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def package(records: bytes, index: list[tuple[int, int]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(DATA), records)
        z.writestr(zipfile.ZipInfo(INDEX), "".join(f"{a} {n} {DATA[len(ARCHIVES) :]}\n" for a, n in index))
    return out.getvalue()


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null for a response). Only ids and digests meet by digest, where adaptive execution
    splits a hot one; payloads meet what they refer to by page and digest."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    rows = rows.withColumn("key", F.coalesce("page_id", F.lit(-(1 << 63))))
    keys = stored(rows.where(F.octet_length("payload") >= least_bytes).select("key", "page_id", "digest"), "digests")
    best = stored(keys.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n"), "originals")
    refers = stored(keys.join(best, "digest").where("original is not null and original <> key").select("key", "digest", F.col("original").alias("refers_to")).distinct(), "revisits")
    return rows.join(refers, ["key", "digest"], "left").select("page_id", "url", "payload", "refers_to")


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes packages under folder and returns path, records and bytes of each. A task names its packages afresh, and only those of tasks that
    succeeded are in the result, so a task run twice does no harm."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage, root = open_storage(folder)
        storage.create_dir(root, recursive=True)
        data, index = io.BytesIO(), []

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.zip"
            with storage.open_output_stream(f"{root}/{name}") as f:
                f.write(package(data.getvalue(), index))
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([data.tell()], pa.int64())})

        for part in parts:
            columns = [part.column(n) for n in ("page_id", "url", "payload", "refers_to")]
            for i in range(part.num_rows):
                zipped = gzip.compress(record(*(c[i].as_py() for c in columns)), 1, mtime=0)
                index.append((data.tell(), len(zipped)))
                data.write(zipped)
                if data.tell() > PACKAGE_BYTES:
                    yield close()
                    data, index = io.BytesIO(), []
        if index:
            yield close()

    return stored(with_originals(pages, least_bytes).mapInArrow(run, "path string, records long, bytes long"), "packages")


def members(f) -> dict[str, tuple[int, int]]:
    """Name -> start and length of the bytes of each stored member, from a package's central directory."""
    size = f.size()
    tail_at = max(0, size - (1 << 16) - 22 - 20 - 56)
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        count, length, start = struct.unpack_from("<QQQ", f.read_at(56, at), 32)
    directory, at, out = f.read_at(length, start), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain, names, extras, notes = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + names].decode()
        extra, k = directory[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # ZIP64: only the fields that didn't fit, in this order
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, k + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            k += 4 + width
        if method == 0:
            local = f.read_at(30, header)
            out[name] = (header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        at += 46 + names + extras + notes
    return out


def index_lines(text: str) -> Iterator[tuple[int, int | None, str]]:
    """Offset, length (None where it isn't told) and archive of each record that an index lists: own lines, CDX by the letters of
    its head (V offset, S length, g archive) or CDXJ. Lines that begin with ! are about the index."""
    fields: list[str] = []
    for line in text.splitlines():
        if line.lstrip().startswith("CDX "):
            fields = line.split()[1:]
        elif fields and line:
            told = dict(zip(fields, line.split(" "), strict=False))
            size = told.get("S", "-")
            yield int(told["V"]), int(size) if size.isdigit() else None, told["g"]
        elif "{" in line and not line.startswith("!"):
            told = json.loads(line[line.index("{") :])
            yield int(told["offset"]), int(told["length"]) if told.get("length") else None, told["filename"]
        elif line and not line.startswith("!"):
            offset, size, name = line.split(" ", 2)
            yield int(offset), int(size), name


def located(f, found: dict[str, tuple[int, int]]) -> list[tuple[int, int]]:
    """Start and length of each record of a package in the order of their bytes, from all its indexes; an .idx only says where
    the blocks of another index are."""
    listed: dict[tuple[str, int], int | None] = {}
    for name, (start, size) in sorted(found.items()):
        if name.startswith(INDEXES) and not name.endswith(".idx"):
            raw = f.read_at(size, start)
            for offset, length, archive in index_lines((gzip.decompress(raw) if raw[:2] == GZIP else raw).decode()):
                key = (archive if archive in found else ARCHIVES + archive, offset)
                listed[key] = listed.get(key) or length
    silent = {n for n in found if n.startswith(ARCHIVES) and found[n][1]} - {name for name, _ in listed}
    if silent:
        raise ValueError(f"no index lists records of {', '.join(sorted(silent))}")
    rows = []
    places = sorted(listed)
    for (name, offset), after in zip(places, [*places[1:], ("", 0)], strict=True):
        start, size = found[name]
        rows.append((start + offset, listed[name, offset] or (after[1] if after[0] == name else size) - offset))
    return sorted(rows)


_RANGES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("sizes", pa.list_(pa.int64()))])


def _ranges(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for path in part.column("path").to_pylist():
            storage, at = open_storage(path)
            with storage.open_input_file(at) as f:
                places = located(f, members(f))
            rows: list[tuple[str, int, list[int]]] = []
            end = -1
            for start, n in places:
                if start != end or len(rows[-1][2]) >= RECORDS or n >= READ_BYTES:
                    rows.append((path, start, []))
                rows[-1][2].append(n)
                end = start + n
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, _RANGES, strict=True)], schema=_RANGES)


def parse(raw: bytes) -> tuple[int | None, str, str, int | None, int, str, bytes | None]:
    """page_id, url, record type, refers_to, payload bytes, digest and payload of one record; a damaged one raises."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next((x[16:] for x in http.decode("utf-8", "replace").split("\r\n") if x.startswith("Content-Length: ")), len(payload)))
    number = lambda x: int(n) if (n := x.removeprefix(f"<{URN}").removesuffix(">")).lstrip("-").isdigit() else None
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    digest = fields.get("WARC-Payload-Digest", own).removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or own != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    refers = fields.get("WARC-Refers-To")
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI", ""), fields["WARC-Type"], refers and number(refers), size, digest, payload if fields["WARC-Type"] == "response" else None


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _records(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for path, start, sizes in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            storage, at = open_storage(path)
            with storage.open_input_file(at) as f:
                raw = memoryview(f.read_at(sum(sizes), start))
            ends = list(accumulate(sizes))
            rows = [parse(gzip.decompress(raw[b - n : b]) if raw[b - n : b][:2] == GZIP else bytes(raw[b - n : b])) for b, n in zip(ends, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)


def read_packages(packages: DataFrame) -> DataFrame:
    """Every record of packages(path, bytes): page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload (null for a revisit)."""
    ranges = packages.select("path").mapInArrow(_ranges, "path string, start long, sizes array<long>")
    size = packages.agg(F.sum("bytes")).first()[0] or 0
    spread = ranges.repartition(max(1, -(-size // TASK_BYTES)), "path", "start")
    return spread.mapInArrow(_records, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages as packages into the shared folder and reads all of them back."""
    return read_packages(write_packages(pages, fresh_path(spark, "warc"), least_bytes))
