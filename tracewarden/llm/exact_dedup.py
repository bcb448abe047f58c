"""Exact dedup by two-pass Bloom filtering; DataFrame functions only.

Texts are equal when identical after lower-casing A-Z; null counts as the empty text. Of equal texts the row with the
largest doc_id stays; among repeated rows with one doc_id, one of them; a null doc_id is below every other. Every input
row gives one output row, and an empty table gives none. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from . import bloom
from .shared import stored


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z and nothing else. lower() does just that to pure ASCII and is much faster there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def possibly_repeated(keys: DataFrame, key: str, rows: int) -> DataFrame:
    """keys with a column repeated, true for every key that occurs twice or more and for few others.

    Pass 1 sets two filter bits for each row and keeps those set at least twice (only bit numbers shuffle, summed before
    they do). Pass 2 tests each row against the kept bits. At its largest size the filter only lets more rows through.
    """
    bits = bloom.bits_for(rows)
    twice = keys.select(F.explode(F.array(*bloom.places(key, bits))).alias("p")).groupBy("p").count().where("count > 1")
    return bloom.tested(keys, key, bloom.pages(twice), bits, "repeated")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. Texts never shuffle, only their digests,
    and of those only the possibly repeated ones."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(lower_ascii(text), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    marked = possibly_repeated(rows, "digest", rows.count())
    again, alone = marked.where("repeated"), marked.where("not repeated")
    groups = again.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))
    groups = stored(groups, "groups")  # read anew, it is small enough to broadcast or a hot digest's rows are split
    out = again.join(groups, "digest").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest")
    rest = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return out.unionByName(rest).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
