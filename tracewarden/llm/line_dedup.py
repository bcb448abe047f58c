"""Cross-site boilerplate removal by the distinct-site spread of lines.

A line is what stands between newlines, compared without spaces, tabs and carriage returns around it; an empty one never
counts. Its spread is the number of distinct sources that it occurs in; all null sources are one. HyperLogLog sketches by
line hash merge by aggregation, map side first; lines whose estimate is within BAND of the threshold get an exact distinct
count. A line with a spread of at least `min_sites` is boilerplate: its first occurrence (smallest doc_id, then line
number; nulls first) stays, all others are removed. Null text is left null with no lines; rows repeated with one doc_id
and text are treated alike; other columns pass through `remove_boilerplate` untouched; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import stored, unused

#: Sources that a line must occur in to be boilerplate.
MIN_SITES = 10
#: Sketch size (its relative error is below 3% at 2**12 for any count and nearly 0 for small ones), and the share of the
#: threshold on either side within which the sketch doesn't decide: four times that error.
LOG_K, BAND = 12, 0.12


def occurrences(docs: DataFrame) -> DataFrame:
    """line (64-bit hash), site, doc_id, line_no, text_key of every line that isn't empty."""
    text = F.col("text")
    site = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))  # sketches ignore empty strings
    lines = docs.select(F.col("doc_id"), site.alias("site"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(" \t\r"))).where("line <> ''").withColumn("line", F.xxhash64("line"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line and first (doc_id, line_no) of every line with a spread of at least min_sites."""
    first = F.min(F.struct("doc_id", "line_no")).alias("first")
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("spread")
    spread = stored(lines.groupBy("line").agg(sketch, first).where(F.col("spread") >= min_sites * (1 - BAND)), "spread")
    near = spread.where(F.col("spread") <= min_sites * (1 + BAND))
    exact = lines.join(near.select("line"), "line", "left_semi").groupBy("line", "site").count().groupBy("line").agg(F.count("*").alias("sites"))
    sure = near.join(exact.where(F.col("sites") >= min_sites), "line").select("line", "first")
    return spread.where(F.col("spread") > min_sites * (1 + BAND)).select("line", "first").unionByName(sure)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))
def _without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, removed in parts:
        out = []
        for text, gone in zip(texts, removed, strict=True):
            if text is None:
                out.append((None, 0, 0))
                continue
            lines = text.split("\n")
            filled = sum(1 for x in lines if x.strip(" \t\r"))
            if gone is not None and len(gone):
                drop = set(gone)
                text = "\n".join(x for i, x in enumerate(lines) if i not in drop)
            out.append((text, filled, 0 if gone is None else len(gone)))
        yield pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])


#: So that a filter on its counts doesn't make the optimizer evaluate it once more, in a second worker.
_without = _without.asNondeterministic()


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs (doc_id, text, source and any others) with text cleaned, and n_lines and n_removed (lines, not empty, before), which
    take the place of input columns of these names."""
    lines = stored(occurrences(docs), "lines")
    common = stored(boilerplate(lines, min_sites), "boilerplate")
    gone = lines.join(common, "line").where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("first")))
    gone = gone.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("gone"))
    own_id, own_key, own_gone, own_out = (unused(docs.columns, x) for x in ("id", "key", "gone", "out"))
    gone = gone.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(own_id), F.col("text_key").alias(own_key), F.col("gone").alias(own_gone))
    keyed = docs.withColumns({own_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), own_key: F.xxhash64("text")})
    joined = keyed.join(gone, [own_id, own_key], "left").withColumn(own_out, _without("text", own_gone))
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return joined.select(*names, *(f"{own_out}.{c}" for c in ("text", "n_lines", "n_removed")))
