"""Call chains: reverse paths from sinks to entries, helpers near a function, caps.

Walks go level by level. A level is one equi-join of what is still growing with the edges, written out before the next, so that
neither the plan nor the session keeps anything of it, and an empty level ends the walk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from ..sources.shared import stored


def _edges(calls: DataFrame, branches: int) -> DataFrame:
    """callee, caller, ends, place (the first of equal calls), and callers: all callers of the caller, null if it has none."""
    capped = calls.where(F.col("child_ord") < branches).select("caller", "callee", "child_ord", F.coalesce("ends", F.lit(False)).alias("ends"))
    own = stored(capped.groupBy("callee", "caller", "ends").agg(F.min("child_ord").alias("ord")), "calls")
    callers = own.groupBy(F.col("callee").alias("caller")).agg(F.collect_set("caller").alias("callers"))  # `branches` at most
    return stored(own.join(callers, "caller", "left"), "edges")


def _begun(sinks: DataFrame, edges: DataFrame) -> DataFrame:
    first = sinks.join(edges, F.col("sink") == F.col("callee"))
    return first.select("sink", F.col("caller").alias("node"), F.array("caller").alias("path"), F.array("ord").alias("trail"), "ends", "callers")


def _grown(front: DataFrame, edges: DataFrame) -> DataFrame:
    up = edges.select(F.col("callee").alias("node"), *(F.col(c).alias(f"_{c}") for c in ("caller", "ord", "ends", "callers")))
    found = front.where("not ends").join(up, "node").where(~F.array_contains("path", F.col("_caller")))
    return found.select("sink", F.col("_caller").alias("node"), F.array_append("path", F.col("_caller")).alias("path"), F.array_append("trail", F.col("_ord")).alias("trail"), F.col("_ends").alias("ends"), F.col("_callers").alias("callers"))


def _ended(level: int, depth: int) -> Column:
    """A path ends by depth, by a mark, where its node has no callers, or where one of them is on it already."""
    return F.lit(level >= depth) | F.col("ends") | F.col("callers").isNull() | F.arrays_overlap("callers", "path")


def _alone(sinks: DataFrame, edges: DataFrame) -> DataFrame:
    return sinks.join(edges.select(F.col("callee").alias("sink")), "sink", "left_anti").select("sink", F.array("sink").alias("path"))


def _whole(level: DataFrame) -> DataFrame:
    return level.select("sink", F.concat(F.reverse("path"), F.array("sink")).alias("path"))


def reverse_chains(sinks: DataFrame, calls: DataFrame, depth: int = fixed.CHAIN_DEPTH, branches: int = fixed.CHAIN_BRANCHES) -> DataFrame:
    """sink, path (outermost caller first, the sink last) for every chain. calls(caller, callee, child_ord, ends): ends marks
    a caller that nothing may call. A chain ends at `depth` callers, at a caller without callers, or where a caller is on
    it already; a sink without callers is a chain of its own. All chains are made: branches ** depth a sink, if calls are
    that dense; longest_chains makes those that a cap keeps."""
    sinks, edges = sinks.select("sink").distinct(), _edges(calls, branches)
    levels, front = [], stored(_begun(sinks, edges), "level")
    for n in range(1, depth + 1):
        levels.append(_whole(front.where(_ended(n, depth))))
        if n == depth or front.isEmpty():
            break
        front = stored(_grown(front, edges), "level")
    return reduce(DataFrame.unionByName, [*levels, _alone(sinks, edges)]).dropDuplicates(["sink", "path"])


def _heights(edges: DataFrame, depth: int) -> DataFrame:
    """node, height: how many callers a walk up from a node may have, at most `depth`, whether or not it comes round."""
    alive = edges.select(F.col("callee").alias("node")).distinct()
    levels = []
    for k in range(1, depth + 1):
        levels.append(alive.withColumn("height", F.lit(k)))
        if k < depth:
            alive = stored(edges.where("not ends").join(alive.select(F.col("node").alias("caller")), "caller", "left_semi").select(F.col("callee").alias("node")).distinct(), "alive")
            if alive.isEmpty():
                break
    return stored(reduce(DataFrame.unionByName, levels).groupBy("node").agg(F.max("height").alias("height")), "heights")


def longest_chains(sinks: DataFrame, calls: DataFrame, most: int = fixed.CHAINS_A_SINK, depth: int = fixed.CHAIN_DEPTH, branches: int = fixed.CHAIN_BRANCHES) -> DataFrame:
    """sink, path, place of the first `most` chains of reverse_chains: the longest first, those of one length as a walk meets
    them that follows the calls of each caller in their order.

    Each level keeps only the beam of paths that may grow longest, and the best of those that it drops. A sink whose `most`-th
    chain is sure to come before anything dropped is settled; the others go again with a wider beam, until none is left."""
    sinks, edges = stored(sinks.select("sink").distinct(), "sinks"), _edges(calls, branches)
    heights, beam, settled, left = _heights(edges, depth), most, [], sinks
    order = [F.desc("reach"), "trail"]
    while True:
        ended, dropped = [], []
        front = stored(_begun(left, edges), "level")
        for n in range(1, depth + 1):
            ended.append(front.where(_ended(n, depth)).select("sink", "path", "trail", F.lit(n).alias("reach")))
            if n == depth:
                break
            growing = front.where("not ends and callers is not null").join(heights, "node").withColumn("reach", n + F.least(F.col("height"), F.lit(depth - n)))
            ranked = growing.withColumn("_place", F.row_number().over(W.partitionBy("sink").orderBy(*order))).where(F.col("_place") <= beam + 1)
            ranked = stored(ranked, "beam")
            dropped.append(ranked.where(F.col("_place") > beam).select("sink", "reach", "trail"))
            if ranked.isEmpty():
                break
            front = stored(_grown(ranked.where(F.col("_place") <= beam), edges), "level")
        chains = reduce(DataFrame.unionByName, ended).groupBy("sink", "path", "reach").agg(F.min("trail").alias("trail"))
        chains = stored(chains.withColumn("place", F.row_number().over(W.partitionBy("sink").orderBy(*order))).where(F.col("place") <= most), "chains")
        if not dropped:
            settled.append(chains)
            break
        worst = chains.where(F.col("place") == most).select("sink", (-F.col("reach")).alias("r"), F.col("trail").alias("t"))
        best = reduce(DataFrame.unionByName, dropped).groupBy("sink").agg(F.min(F.struct((-F.col("reach")).alias("r"), F.col("trail").alias("t"))).alias("dropped"))
        again = stored(best.join(worst, "sink", "left").where(F.col("r").isNull() | (F.col("dropped") < F.struct("r", "t"))).select("sink"), "again")
        settled.append(chains.join(again, "sink", "left_anti"))
        if again.isEmpty():
            break
        left, beam = again, beam * 8
    found = reduce(DataFrame.unionByName, settled).select("sink", F.concat(F.reverse("path"), F.array("sink")).alias("path"), "place")
    return found.unionByName(_alone(sinks, edges).withColumn("place", F.lit(1)))


def include_chains(includers: DataFrame) -> DataFrame:
    """sink, path of two files for each include of a sink's file."""
    return includers.select(F.col("sink_file").alias("sink"), F.array(F.col("file"), F.col("sink_file")).alias("path")).dropDuplicates(["sink", "path"])


def capped(chains: DataFrame, most: int = fixed.CHAINS_A_SINK) -> DataFrame:
    """At most `most` chains a sink, the longest first, then by path; with their place."""
    place = F.row_number().over(W.partitionBy("sink").orderBy(F.size("path").desc(), "path"))
    return chains.withColumn("place", place).where(F.col("place") <= most)


def helpers(roots: DataFrame, calls: DataFrame, depth: int = fixed.HELPER_DEPTH, most: int = fixed.HELPERS) -> DataFrame:
    """root, helper, depth, place of the functions that a root reaches in its file, breadth first, each once, at most `most`.
    calls(caller, callee, child_ord). The first way to a helper goes over first ways, so each is met once."""
    edges = stored(calls.groupBy(F.col("caller").alias("helper"), F.col("callee").alias("_next")).agg(F.min("child_ord").alias("_ord")), "helper_calls")
    known = front = stored(roots.select("root", F.col("root").alias("helper"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("trail")).distinct(), "helpers")
    for n in range(1, depth + 1):
        met = front.join(edges, "helper").groupBy("root", F.col("_next").alias("helper")).agg(F.min(F.array_append("trail", F.col("_ord"))).alias("trail"))
        front = stored(met.join(known.select("root", "helper"), ["root", "helper"], "left_anti").select("root", "helper", F.lit(n).alias("depth"), "trail"), "helpers")
        known = known.unionByName(front)
        if front.isEmpty():
            break
    place = F.row_number().over(W.partitionBy("root").orderBy("depth", "trail", "helper"))
    return known.where("depth > 0").withColumn("place", place).where(F.col("place") <= most).select("root", "helper", "depth", "place")


def helper_calls(functions: DataFrame) -> DataFrame:
    """caller, callee, child_ord within each file, from functions(file, name, code): calls first, then callbacks."""
    names = F.concat(F.regexp_extract_all("code", F.lit(fixed.HELPER_CALL), F.lit(1)), F.regexp_extract_all("code", F.lit(fixed.HELPER_CALLBACK), F.lit(1)))
    used = functions.select("file", F.col("name").alias("caller"), F.posexplode(F.array_distinct(names)).alias("child_ord", "callee"))
    used = used.where((F.col("callee") != F.col("caller")) & ~F.col("callee").isin(*fixed.NO_HELPERS))
    return used.join(functions.select("file", F.col("name").alias("callee")).distinct(), ["file", "callee"], "left_semi").select("file", "caller", "callee", "child_ord")


def with_functions(chains: DataFrame, pool: DataFrame) -> DataFrame:
    """sink, place, at, node and the pool's columns for each node of numbered chains; pool(function_ref, …)."""
    nodes = chains.select("sink", "place", F.posexplode("path").alias("at", "node"))
    return nodes.join(pool, F.col("node") == F.col("function_ref"), "left")
