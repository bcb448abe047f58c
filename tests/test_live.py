"""Streams that run while rows arrive."""

from __future__ import annotations

import os
import time

from tracewarden.streaming import events


def test_a_run_ends_once_behind_its_lines(spark, tmp_path):
    log, ended, out = (str(tmp_path / n) for n in ("log", "ended", "out"))
    put = lambda rows, schema, at: spark.createDataFrame(rows, schema).write.mode("append").json(at)
    put([("a", "1"), ("b", "1")], "run string, value string", log)
    put([], "run string, status string, n_lines long", ended)
    lines = spark.readStream.schema("run string, value string").json(log)
    said = spark.readStream.schema("run string, status string, n_lines long").json(ended)
    read = lambda: sorted(tuple(r) for r in spark.read.schema("run string, type string, data string").parquet(out).collect())
    query = events.to_table(events.followed(lines, said, wait_ms=8_000), out, str(tmp_path / "place"), every="1 second")

    def wait(*rows):
        till = time.time() + 30
        while not (os.path.isdir(out) and set(rows) <= set(read())) and time.time() < till:
            time.sleep(0.5)
        assert set(rows) <= set(read())

    try:
        wait(("a", "line", "1"), ("b", "line", "1"))
        put([("a", "done", 2), ("b", "failed", 1)], "run string, status string, n_lines long", ended)
        wait(("b", "end", "failed"))
        put([("a", "2")], "run string, value string", log)
        wait(("a", "line", "2"), ("a", "end", "done"))
        put([("a", "done", 2), ("c", "lost", 5)], "run string, status string, n_lines long", ended)  # told again; and a run whose lines never come
        wait(("c", "end", "lost"))
    finally:
        query.stop()
    assert read() == [("a", "end", "done"), ("a", "line", "1"), ("a", "line", "2"), ("b", "end", "failed"), ("b", "line", "1"), ("c", "end", "lost")]


def test_ticks_claim_once(spark, tmp_path):
    claims, place = str(tmp_path / "claims"), str(tmp_path / "place")
    scans = spark.createDataFrame([("s1", "pending", "2020-01-01T00:00:00"), ("s2", "running", "2020-01-01T00:00:00"), ("s3", "stopped", "2990-01-01T00:00:00"), ("s4", "stopped", "2020-01-01T00:00:00")], "scan_id string, status string, scheduled_at string")
    for _ in range(2):  # a restart goes on and claims nothing again
        query = events.schedule(spark, lambda: scans, claims, place, "1 second")
        till = time.time() + 60
        while (query.lastProgress is None or query.lastProgress["batchId"] < 2) and time.time() < till:
            time.sleep(0.5)
        query.stop()
    found = spark.read.option("basePath", claims).parquet(claims).collect()
    assert sorted(r["scan_id"] for r in found) == ["s1", "s4"]
