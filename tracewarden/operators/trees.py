"""Source trees as rows: counts, histograms, directory roll-ups and compaction to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed, paths


def counts(files: DataFrame) -> DataFrame:
    """One row: files and directories of files(file)."""
    dirs = files.select(F.explode(paths.prefixes(F.col("file"))).alias("d")).distinct().agg(F.count("*").alias("dirs"))
    return files.agg(F.count("*").alias("files")).join(dirs, how="cross")  # one row each


def histogram(files: DataFrame, top: int = 30) -> DataFrame:
    """ext, n: the commonest endings, by count, then name."""
    return files.groupBy(paths.extension(F.col("file")).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "ext").limit(top)


def directories(files: DataFrame) -> DataFrame:
    """dir, depth, files below it (at any depth): each file counts once in every directory above it, summed map side."""
    above = files.select(F.posexplode(paths.prefixes(F.col("file"))).alias("depth", "dir"))
    return above.groupBy("dir", (F.col("depth") + 1).alias("depth")).agg(F.count("*").alias("files"))


def counted(files: DataFrame) -> DataFrame:
    """dir, ext, n of files that a listing only counts."""
    rows = files.where(paths.counted_file(F.col("file")))
    return rows.groupBy(paths.directory_of(F.col("file")).alias("dir"), paths.extension(F.col("file")).alias("ext")).agg(F.count("*").alias("n"))


def compacted(files: DataFrame, depth: int, dirs: int, names: int) -> DataFrame:
    """file of what a policy shows: directories down to depth, of each directory its signal directories and `dirs` others,
    and its signal files and `names` others, all in order of lower-case name. A file shows if all directories above it do."""
    folded = files.select("file", paths.directory_of(F.col("file")).alias("dir"), paths.name_of(F.col("file")).alias("name"))
    low, signal = F.lower("name"), _signal(F.col("name"))
    place = F.row_number().over(W.partitionBy("dir", "_signal").orderBy(low, "name"))
    shown = folded.withColumn("_signal", signal).withColumn("_place", place).where(F.col("_signal") | (F.col("_place") <= names))
    tree = files.select(F.explode(paths.prefixes(F.col("file"))).alias("path")).distinct()
    tree = tree.select("path", paths.directory_of(F.col("path")).alias("parent"), paths.name_of(F.col("path")).alias("name"), F.size(F.split("path", "/")).alias("depth"))
    own = F.row_number().over(W.partitionBy("parent", "_signal").orderBy(low, "name"))
    kept = tree.withColumn("_signal", low.isin(*fixed.SIGNAL_DIRS)).withColumn("_place", own).where((F.col("depth") <= depth) & (F.col("_signal") | (F.col("_place") <= dirs))).select("path")
    above = shown.select("file", "dir", F.explode_outer(paths.prefixes(F.col("file"))).alias("path"))
    hidden = above.where("path is not null").join(kept, "path", "left_anti").select("file").distinct()
    return shown.join(hidden, "file", "left_anti").select("file")


#: Shows everything; and what stands for a tree that no policy makes fit, a second one where even that is too long.
WHOLE, FALLBACKS = (1 << 30,) * 3, ((1, 80, 20), (1, 30, 5))


def _json_chars(name: Column) -> Column:
    """Characters of a text as JSON."""
    plain = F.length(F.regexp_replace(name, r'[\x00-\x1F"\\\\]', ""))
    return 2 + plain + 2 * F.regexp_count(name, F.lit(r'[\n\r\t\x08\f"\\]')) + 6 * F.regexp_count(name, F.lit(r"[\x00-\x07\x0B\x0E-\x1F]"))


def _digits(n: Column) -> Column:
    return F.length(n.cast("string"))


def _signal(name: Column) -> Column:
    low = F.lower(name)
    found = low.isin(*fixed.SIGNAL_FILES) | F.startswith(low, F.lit("dockerfile"))
    for s in fixed.SIGNAL_SUFFIXES:
        found = found | F.endswith(low, F.lit(s))
    return found


def _endings(names: DataFrame, most: int) -> DataFrame:
    """dir, chars and number of the commonest endings of a directory's names as a JSON object."""
    each = names.groupBy("dir", paths.extension(F.col("file")).alias("ext")).agg(F.count("*").alias("n"), F.min(F.struct(F.lower("name"), "name")).alias("first"))
    top = each.withColumn("_place", F.row_number().over(W.partitionBy("dir").orderBy(F.desc("n"), "first"))).where(F.col("_place") <= most)
    return top.groupBy("dir").agg((F.sum(_json_chars(F.col("ext")) + 2 + _digits(F.col("n"))) + 2 * F.count("*")).alias("chars"))


def nodes(files: DataFrame, policies: tuple[tuple[int, int, int], ...]) -> DataFrame:
    """policy (its number), path, depth of each directory that a policy (depth, directories, names) shows, with what it leaves out there
    (omitted_files, omitted_dirs, omitted_descendant_dirs, omitted_descendant_files) and chars, what the directory's own part
    of the tree takes as JSON. A directory shows by its own place and those of the directories above it, so all policies are
    judged from one table of directories."""
    names = files.select("file", paths.directory_of(F.col("file")).alias("dir"), paths.name_of(F.col("file")).alias("name"), paths.counted_file(F.col("file")).alias("counted"))
    listed = names.where("not counted").withColumn("_signal", _signal(F.col("name")))
    listed = listed.withColumn("_place", F.when(F.col("_signal"), 0).otherwise(F.row_number().over(W.partitionBy("dir", "_signal").orderBy(F.lower("name"), "name"))))
    chars = _json_chars(F.col("name")) + 2
    most_names, most_dirs = sorted({p[2] for p in policies}), sorted({p[1] for p in policies})
    own = listed.groupBy("dir").agg(F.count("*").alias("n"), *(f for k in most_names for f in (F.count_if(F.col("_place") <= k).alias(f"n{k}"), F.sum(F.when(F.col("_place") <= k, chars)).alias(f"c{k}"))))
    binary = names.where("counted").groupBy("dir").agg(F.count("*").alias("binary"))
    below = lambda c: F.explode(paths.prefixes(F.col(c)))
    tree = files.select(below("file").alias("path")).groupBy("path").agg(F.count("*").alias("files"))
    tree = tree.join(tree.select(below("path").alias("path")).groupBy("path").agg(F.count("*").alias("dirs")), "path", "left").fillna(0, ["dirs"])
    tree = tree.select("path", "files", "dirs", paths.directory_of(F.col("path")).alias("parent"), paths.name_of(F.col("path")).alias("name"), F.size(F.split("path", "/")).alias("depth"))
    main = F.lower("name").isin(*fixed.SIGNAL_DIRS)
    tree = tree.withColumn("_signal", main).withColumn("_place", F.when(F.col("_signal"), 0).otherwise(F.row_number().over(W.partitionBy("parent", "_signal").orderBy(F.lower("name"), "name"))))
    chars = _json_chars(F.col("name")) + 4
    inner = tree.groupBy(F.col("parent").alias("dir")).agg(
        F.count("*").alias("m"), F.sum("files").alias("mf"), F.sum(F.col("dirs") + 1).alias("md"),
        *(f for k in most_dirs for f in (F.count_if(F.col("_place") <= k).alias(f"m{k}"), F.sum(F.when(F.col("_place") <= k, chars)).alias(f"mc{k}"), F.sum(F.when(F.col("_place") > k, F.col("files"))).alias(f"mf{k}"), F.sum(F.when(F.col("_place") > k, F.col("dirs") + 1)).alias(f"md{k}"))),
    )
    above = tree.select(F.col("path").alias("dir"), F.explode(F.concat(paths.prefixes(F.col("path")), F.array("path"))).alias("path"))
    worst = above.join(tree.select("path", "_place"), "path").groupBy("dir").agg(F.max("_place").alias("worst"))
    root = files.sparkSession.range(1).select(F.lit(".").alias("dir"), F.lit(0).alias("worst"), F.lit(0).alias("depth"))
    every = worst.join(tree.select(F.col("path").alias("dir"), "depth"), "dir").select("dir", "worst", "depth").unionByName(root)
    for part in (own, binary, inner, _endings(names.where("not counted"), 10).withColumnRenamed("chars", "ec"), _endings(names.where("counted"), 1 << 30).withColumnRenamed("chars", "bc")):
        every = every.join(part, "dir", "left")
    every = every.fillna(0)
    shown = [F.when((F.col("depth") <= d) & (F.col("worst") <= m), _node(i, d, m, k)) for i, (d, m, k) in enumerate(policies)]
    return every.select(F.col("dir").alias("path"), "depth", F.explode(F.array_compact(F.array(*shown))).alias("x")).select("x.policy", "path", "depth", "x.omitted_files", "x.omitted_dirs", "x.omitted_descendant_dirs", "x.omitted_descendant_files", "x.chars")


def _node(policy: int, depth: int, most_dirs: int, most_names: int) -> Column:
    c = lambda name: F.col(name)
    n, m = c(f"n{most_names}"), c(f"m{most_dirs}")
    none = F.lit(0).cast("long")
    left, last = c("n") - n, c("depth") >= depth
    dirs = F.when(last, c("md")).otherwise(c("m") - m)
    within = F.when(last, none).otherwise(c(f"md{most_dirs}"))
    lost = F.when(last, c("mf")).otherwise(c(f"mf{most_dirs}"))
    key = lambda name: len(f'"{name}": ')
    # a field's characters and the separator behind it; the last one's is taken off with the braces
    fields = [
        F.when(n > 0, key("files") + c(f"c{most_names}") + 2),
        F.when(left > 0, key("_omitted_files") + _digits(left) + 2 + key("_file_ext_counts") + c("ec") + 2),
        F.when(c("binary") > 0, key("binary") + len('{"total": , "by_ext": }') + _digits(c("binary")) + c("bc") + 2),
        F.when(~last & (m > 0), key("dirs") + c(f"mc{most_dirs}") + 2),
        F.when(dirs > 0, key("_omitted_dirs") + _digits(dirs) + 2 + key("_omitted_descendant_files") + _digits(lost) + 2),
        F.when(within > 0, key("_omitted_descendant_dirs") + _digits(within) + 2),
    ]
    total = F.lit(0)
    for field in fields:
        total = total + F.coalesce(field, F.lit(0))
    return F.struct(F.lit(policy).alias("policy"), left.alias("omitted_files"), dirs.alias("omitted_dirs"), within.alias("omitted_descendant_dirs"), lost.alias("omitted_descendant_files"), F.when(total > 0, total).otherwise(2).cast("long").alias("chars"))


def sizes(files: DataFrame, policies: tuple[tuple[int, int, int], ...]) -> DataFrame:
    """policy, dirs, chars: directories shown and the length of the tree as JSON under each policy, all in one aggregation."""
    return nodes(files, policies).groupBy("policy").agg(F.count("*").alias("dirs"), F.sum("chars").alias("chars"))


def fitting(files: DataFrame, budget: int = fixed.TREE_CHARS) -> tuple[DataFrame, tuple[int, int, int] | None]:
    """All files if their tree as JSON has at most `budget` characters; else what the first policy that fits shows, or a summary of
    the top two levels if none does; and the policy. One job judges all of them."""
    policies = (WHOLE, *fixed.TREE_POLICIES, *FALLBACKS)
    chars = {r["policy"]: r["chars"] for r in sizes(files, policies).collect()}  # a row for each policy
    first = next((i for i in range(len(policies)) if chars[i] <= budget), len(policies) - 1)
    if first == 0:
        return files.select("file"), None
    return compacted(files, *policies[first]), policies[first]
