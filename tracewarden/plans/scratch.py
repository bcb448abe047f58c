"""Folders and file trees that queries write before they read them back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.shared import scratch
from ..sources.walk import opened_at

__all__ = ["scratch", "write_tree"]

#: Rows with whole texts that a Python worker holds at a time.
BATCH_ROWS = 250


def write_tree(rows: DataFrame, root: str, dealt: bool = False) -> int:
    """Writes a file for each row (file, body) below root, each in the task that holds the row, and returns how many. A null
    body is an empty file. A task that runs again writes the same files. Many files from a table of few bytes, which Spark reads in few
    tasks, are dealt over all cores first."""
    if dealt:
        rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened_at(root)
        made: set[str] = set()
        for part in parts:
            for file, body in zip(part.column(0), part.column(1), strict=True):  # one text at a time
                path = f"{base}/{file.as_py()}"
                folder = path.rsplit("/", 1)[0]
                if folder not in made:
                    if len(made) == 10_000:
                        made.clear()
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(path) as out:
                    if body.is_valid:
                        out.write(body.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64())], names=["n"])

    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, BATCH_ROWS)
    try:
        return rows.select("file", "body").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
    finally:
        conf.set(key, before)
