"""Bloom filters as tables of bitmap pages: built by aggregation, tested by a broadcast join; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import stored

#: Filter bits for each row, and the largest filter: the broadcast bitmaps never exceed MAX_BITS / 8 = 32 MB.
BITS_A_ROW, MAX_BITS = 16, 1 << 28
PAGE_BITS = 32_768  # of one bitmap of bitmap_construct_agg


def bits_for(rows: int) -> int:
    """A power of two; at MAX_BITS a filter only lets more rows through."""
    return min(MAX_BITS, max(PAGE_BITS, 1 << (max(1, rows) * BITS_A_ROW - 1).bit_length()))


def places(key: str, bits: int) -> list[Column]:
    """The two filter bits of a key."""
    return [F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(bits)) for i in (1, 2)]


def pages(positions: DataFrame) -> DataFrame:
    """page, bits of the filter in which every position p is set."""
    return stored(positions.groupBy(F.expr(f"p div {PAGE_BITS}").alias("page")).agg(F.bitmap_construct_agg(F.col("p") % PAGE_BITS).alias("bits")), "bloom")


def _bit(page: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(page, (position % PAGE_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("getbit", byte, (position % 8).cast("int")) == 1, F.lit(False))


def tested(rows: DataFrame, key: str, filter_pages: DataFrame, bits: int, out: str) -> DataFrame:
    """rows with out: whether both bits of key are set."""
    for i, place in enumerate(places(key, bits), 1):
        rows = rows.withColumn(f"_p{i}", place).withColumn(f"_g{i}", F.expr(f"_p{i} div {PAGE_BITS}"))
        rows = rows.join(F.broadcast(filter_pages.select(F.col("page").alias(f"_g{i}"), F.col("bits").alias(f"_b{i}"))), f"_g{i}", "left")
        rows = rows.withColumn(f"_r{i}", _bit(F.col(f"_b{i}"), F.col(f"_p{i}"))).drop(f"_b{i}", f"_g{i}", f"_p{i}")
    return rows.withColumn(out, F.col("_r1") & F.col("_r2")).drop("_r1", "_r2")


def among(rows: DataFrame, key: str, ids: DataFrame, count: int) -> DataFrame:
    """The rows whose key may be among ids(key), about `count` of them: all that are, and few others. Nothing of rows shuffles."""
    bits = bits_for(count)
    found = pages(ids.select(F.explode(F.array(*places(key, bits))).alias("p")).distinct())
    return tested(rows, key, found, bits, "_among").where("_among").drop("_among")
