"""Source trees in two steps: names are listed level by level without what is pruned, then only the files that are kept are opened.

Folders are listed in tasks, a level at a time; a pruned folder is never listed and a symbolic link never followed. Files to be
read are dealt into partitions by their sizes; large ones are read by byte ranges.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .shared import stored

#: Bytes that a partition reads, and bytes of a range of a large file.
PART_BYTES, RANGE_BYTES = 128 << 20, 32 << 20
_ENTRY = "file string, folder boolean, size long, modified timestamp"
#: Rows and bytes after which a task hands on what it has listed or read.
BATCH_ROWS, BATCH_BYTES = 5_000, 4 << 20


def uri(root: str) -> str:
    return root.rstrip("/") if "://" in root else "file://" + os.path.abspath(root.removeprefix("file:"))


def opened_at(root: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a root with a scheme, and the root's path there. Roots are paths as they are named, not escaped, and may hold signs that an address may not."""
    if root.startswith("file:///"):
        return pa.fs.LocalFileSystem(), root.removeprefix("file://")
    return pa.fs.FileSystem.from_uri(quote(root, safe="%:/?#[]@!$&'()*+,;="))


def fixed_part(path: str) -> tuple[str, list[str]]:
    """A path as the folder before its first name with *, ? or { (or before its last name), and the names from there on."""
    *head, last = path.rstrip("/").split("/")
    at = next((i for i, part in enumerate(head) if set("*?{") & set(part)), len(head))
    return "/".join(head[:at]), [*head[at:], last]


def _listed(root: str):
    def batch(names: list[str], found: list[pa.fs.FileInfo]) -> pa.RecordBatch:
        kinds = [x.type == pa.fs.FileType.Directory for x in found]
        columns = [pa.array(names, pa.string()), pa.array(kinds, pa.bool_()), pa.array([x.size or 0 for x in found], pa.int64()), pa.array([x.mtime for x in found], pa.timestamp("us", "UTC"))]
        return pa.RecordBatch.from_arrays(columns, names=["file", "folder", "size", "modified"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened_at(root)
        local = root.startswith("file://")
        names, found = [], []
        for part in parts:
            for folder in part.column(0).to_pylist():
                for x in fs.get_file_info(pa.fs.FileSelector(f"{base}/{folder}" if folder else base)):
                    if x.type in (pa.fs.FileType.File, pa.fs.FileType.Directory) and not (local and os.path.islink(x.path)):
                        names.append(f"{folder}/{x.base_name}" if folder else x.base_name)
                        found.append(x)
                    if len(found) >= BATCH_ROWS:
                        yield batch(names, found)
                        names, found = [], []
        yield batch(names, found)

    return run


def names(spark: SparkSession, root: str, kept: Callable[[Column], Column], start: str = "") -> DataFrame:
    """file (relative to root), size, modified of the files below root/start; only folders whose path is kept are entered. No file is opened."""
    base, levels = uri(root), []
    folders = spark.createDataFrame([(start.strip("/"),)], "file string")
    while True:
        parts = spark.sparkContext.defaultParallelism
        level = stored(folders.repartition(parts).mapInArrow(_listed(base), _ENTRY), "level")
        levels.append(level.where("not folder"))
        folders = level.where("folder").where(kept(F.col("file"))).select("file")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels).select("file", "size", "modified")


def tree_order(file: Column) -> Column:
    """Folders before files at each level, by name without regard to case."""
    parts = F.split(file, "/")
    return F.transform(parts, lambda name, i: F.struct((i == F.size(parts) - 1).alias("last"), F.lower(name).alias("folded"), name.alias("name")))


def _dealt(files: DataFrame) -> DataFrame:
    """files(file, ..., length) in as many partitions as their bytes need."""
    total = files.agg(F.sum("length")).first()[0] or 0
    return files.repartition(max(1, -(-total // PART_BYTES)), *(c for c in ("file", "start") if c in files.columns))


def _opened(root: str, most: int | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened_at(root)
        for part in parts:
            bodies, size, done = [], 0, 0
            for row, file in enumerate(part.column("file"), 1):
                with fs.open_input_stream(f"{base}/{file.as_py()}") as stream:
                    bodies.append(stream.read() if most is None else stream.read(most))
                size += len(bodies[-1])
                if size >= BATCH_BYTES or len(bodies) >= BATCH_ROWS or row == part.num_rows:
                    yield pa.RecordBatch.from_arrays([*part.slice(done, row - done).columns, pa.array(bodies, pa.binary())], names=[*part.schema.names, "content"])
                    bodies, size, done = [], 0, row

    return run


def contents(files: DataFrame, root: str, most: int | None = None) -> DataFrame:
    """files(file, size, ...) with content, their first `most` bytes or all."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", content binary"
    dealt = _dealt(files.withColumn("length", F.col("size") if most is None else F.least("size", F.lit(most)))).drop("length")
    return dealt.mapInArrow(_opened(uri(root), most), schema)


def _whole_lines(source: pa.NativeFile, start: int, end: int) -> bytes | None:
    """The lines of a file that begin from start up to end, or at the end of the file; None if none does."""
    size = source.size()
    source.seek(max(0, start - 1))
    body = source.read(end - max(0, start - 1))
    if start:
        cut = body.find(b"\n")  # the line that began before is an earlier range's
        if cut < 0:
            return None
        body = body[cut + 1 :]
        if not body:
            return body if end == size else None
    while end < size and not body.endswith(b"\n"):
        more = source.read(1 << 16)
        cut = more.find(b"\n")
        body, end = body + (more if cut < 0 else more[: cut + 1]), end + len(more)
        if cut >= 0 or not more:
            break
    return body


def _range_lines(root: str, counted: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened_at(root)
        columns: tuple[list, ...] = ([], [], [], []) if counted else ([], [], [])
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64()) if counted else (pa.string(), pa.int64(), pa.binary())
        size = 0

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "length", "n"] if counted else ["file", "line", "code"])
            for c in columns:
                c.clear()
            return made

        for part in parts:
            for row in part.to_pylist():
                with fs.open_input_file(f"{base}/{row['file']}") as source:
                    body = _whole_lines(source, row["start"], row["start"] + row["length"])
                if counted:
                    found = [[row["file"]], [row["start"]], [row["length"]], [(body or b"").count(b"\n")]]
                else:
                    lines = [] if body is None else body.split(b"\n")
                    if lines and lines[-1] == b"" and row["start"] + row["length"] < row["size"]:
                        lines.pop()  # the next range begins a line
                    found, size = [[row["file"]] * len(lines), range(row["first"], row["first"] + len(lines)), lines], size + len(body or b"")
                for c, more in zip(columns, found, strict=True):
                    c += more
                if len(columns[0]) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch()
                    size = 0
        yield batch()

    return run


def lines(files: DataFrame, root: str, range_bytes: int | None = None) -> DataFrame:
    """file, line (from 1) and code (no line ends; bytes that aren't UTF-8 as U+FFFD) of files(file, size). No task holds more than a range and
    one line: ranges count their line ends first, and those before a range number its lines."""
    base, step = uri(root), range_bytes or RANGE_BYTES
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(step).cast("long"))
    ranges = files.select("file", "size", F.explode(starts).alias("start")).withColumn("length", F.least(F.lit(step).cast("long"), F.col("size") - F.col("start")))
    counts = stored(_dealt(ranges.select("file", "start", "length")).mapInArrow(_range_lines(base, True), "file string, start long, length long, n long"), "ranges")
    before = F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    numbered = counts.withColumn("first", F.coalesce(before, F.lit(0)) + 1).join(files.select("file", "size"), "file").select("file", "start", "length", "first", "size")
    rows = _dealt(numbered).mapInArrow(_range_lines(base, False), "file string, line long, code binary")
    code = F.rtrim(F.make_valid_utf8(F.col("code").cast("string")), F.lit("\r"))
    return rows.select("file", F.col("line").cast("int").alias("line"), code.alias("code"))


def contained(file: str) -> str:
    """A path below a root, with slashes and without dots; a path that leaves the root is an error."""
    parts: list[str] = []
    bare = file.replace("\\", "/")
    for part in bare.split("/"):
        if part == "..":
            if not parts:
                raise ValueError(f"{file} is outside the tree")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    if bare.startswith("/") or not parts:
        raise ValueError(f"{file} is outside the tree")
    return "/".join(parts)
