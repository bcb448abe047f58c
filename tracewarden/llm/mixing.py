"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Every document gets a place in its source's shuffled queue and, for each of at most three copies, a virtual finish time:
the words that its source has sent by then, divided by the source's target. The copies are range-sorted by that time over
all sources and cut where the total budget is spent. A null text has size 0; size 0 takes nothing; a null source is a
source of its own, after the others. Repeated rows are documents of their own. An empty table gives an empty result.
The order is that of md5(doc_id), so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .order import bucketed_total, running_total
from .shared import SPACES, stored, unused

WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this.
EPOCHS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes(source, source_size) with target: the total shared by weight, none above epochs times its size.

    Sources are ranked by a range sort and their shares are found by repeated sums, so a table of many sources is fine.
    """
    one = sizes.withColumn("_one", F.lit(1))
    ranked = running_total(one, [F.col("source").asc_nulls_last()], "_one", "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = stored(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap, level, capped = epochs * F.col("source_size"), 0.0, -1
    while True:
        over = cap < level * F.col("weight") if capped >= 0 else F.lit(False)
        n, spent, free = ranked.agg(F.count(F.when(over, 1)), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - (spent or 0)) / free
    return ranked.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, copies, taken (= size * copies), row."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    return _mixed(stored(rows.withColumn("row", F.monotonically_increasing_id()), "sizes"), weights, epochs)


def _mixed(rows: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    sources = sources.withColumn("_source", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))).drop("source", "weight")
    rows = rows.withColumn("_source", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")))
    rows = rows.withColumn("_key", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"))
    queued = bucketed_total(rows, ["_source"], F.col("_key") / F.lit(float(1 << 60)), [F.col("_key"), F.col("doc_id"), F.col("row")], F.col("size"), "sent", rows.count())
    queued = stored(queued.join(sources, "_source"), "queued")
    copies = queued.where("size > 0").select("row", "size", "source_size", "target", "sent", "_key", "doc_id", "_source", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    sent = F.col("epoch") * F.col("source_size") + F.col("sent")
    copies = copies.where(sent - F.col("size") <= F.col("target")).withColumn("finish", sent / F.col("target"))
    order = [F.col("finish"), F.col("_source"), F.col("epoch"), F.col("_key"), F.col("doc_id"), F.col("row")]
    budget = rows.agg(F.sum("size")).first()[0] or 0
    taken = running_total(copies, order, "size", "_spent").where(F.col("_spent") <= budget).groupBy("row").agg(F.count("*").alias("copies"))
    out = queued.join(taken, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(0).cast("long")))
    return out.select("row", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """docs (doc_id, text, source and any others) as mixed: a document that is taken twice comes twice, one that is not taken
    goes."""
    own_row, own_copies, own_copy = (unused(docs.columns, x) for x in ("row", "copies", "copy"))
    columns = docs.columns
    docs = stored(docs.withColumn(own_row, F.monotonically_increasing_id()), "numbered")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")
    rows = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.col(own_row).alias("row")), "sizes")
    copies = _mixed(rows, weights, epochs).where("copies > 0").select(F.col("row").alias(own_row), F.col("copies").alias(own_copies))
    return docs.join(copies, own_row).withColumn(own_copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(own_copies)))).select(*columns)
