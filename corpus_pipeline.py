"""Documents to packed training sequences: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on. All but the last return the columns of
documents. Every stage accepts null and empty texts, repeated rows and empty tables:

- language_id: rows whose text has no letter, or whose language is less likely than MIN_SCORE, go; lang becomes the
  language found. The model learns from the stage's own labelled rows that aren't held out.
- line_dedup: boilerplate lines go and n_chars follows; rows of which nothing is left go.
- minhash: of near-duplicate documents the one with the smallest doc_id stays, once; rows with a null doc_id stay.
- mixing: a document that the mix takes twice comes twice; one that it doesn't take goes.
- packing: one row per piece of a document with its place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewarden.llm import language_id, line_dedup, minhash, mixing, packing
from tracewarden.llm.queries import vocabulary
from tracewarden.llm.shared import release, run_tables, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model, *COLUMNS).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(docs.select(*COLUMNS)).where("n_lines = 0 or n_removed < n_lines")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    kept = minhash.near_duplicates(docs).where("kept").select("doc_id")
    # of rows with one doc_id the first in the order of their columns stays, so that reruns agree
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return one.select("row.*").unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("minhash", dedup_near), ("mixing", mix), ("packing", pack)]
#: A learned model, MinHash and a tokenizer are beyond SQL; tests hold run() against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with run_tables() as written:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name)
            # the last table is what this stage has written; no other is read again
            release(spark, written[:-1])
            del written[:-1]
    return docs
