"""Source trees and text artifacts as DataFrames: files, lines, JSON, JSON lines, Markdown sections, logs, references."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import paths, text
from . import walk

#: Bytes of a file that the viewer shows; the rest only sets `truncated`. Scans read whole files.
MOST_BYTES = 2 << 20


def listing(spark: SparkSession, root: str) -> DataFrame:
    """file (relative), size, modified of everything below root that isn't denied; denied folders aren't entered, symbolic links
    not followed, and no file is opened. walk.tree_order has the order in which a tree is shown."""
    found = walk.names(spark, root, lambda folder: ~paths.denied_dir(folder))
    return found.where(~paths.denied_dir(F.col("file")) & paths.included_file(F.col("file")))


def _path() -> Column:
    """The path of a row's file as it is named: Spark tells it with % codes, in which a + stands for itself."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _text(content: Column) -> Column:
    """Bytes as UTF-8, with U+FFFD for what isn't."""
    return F.make_valid_utf8(content.cast("string"))


def scannable(spark: SparkSession, root: str, target: str | None = None) -> DataFrame:
    """file, size of the scannable sources below root, within target: skipped folders aren't entered, and no file is opened."""
    start = "" if target in (None, "", ".") else walk.contained(target)
    found = walk.names(spark, root, lambda folder: paths.skip_reason(folder).isNull(), start)
    return found.where(paths.is_source(F.col("file")) & paths.skip_reason(F.col("file")).isNull()).select("file", "size")


def sources(spark: SparkSession, root: str, target: str | None = None) -> DataFrame:
    """file, ext, language, text (the whole of it) of the scannable sources below root, within target. Other files aren't opened."""
    kept = walk.contents(scannable(spark, root, target), root)
    return kept.select("file", paths.extension(F.col("file")).alias("ext"), paths.scan_language(F.col("file")).alias("language"), _text(F.col("content")).alias("text"))


def source_lines(spark: SparkSession, root: str, target: str | None = None) -> DataFrame:
    """file, line, code of the scannable sources, large files by byte ranges."""
    return walk.lines(scannable(spark, root, target), root)


def viewed(spark: SparkSession, root: str, file: str) -> DataFrame:
    """file, size, modified, text, truncated of one file below root as the viewer shows it: its first MOST_BYTES bytes. Only its
    folder is listed and only it is opened; a path that leaves root is an error."""
    file = walk.contained(file)
    found = walk.names(spark, root, lambda _: F.lit(False), file.rpartition("/")[0]).where(F.col("file") == file)
    return walk.contents(found, root, MOST_BYTES).select("file", "size", "modified", _text(F.col("content")).alias("text"), (F.col("size") > MOST_BYTES).alias("truncated"))


def lines(files: DataFrame, body: str = "text") -> DataFrame:
    """One row per line: the columns of files without the text, line (from 1) and code (no line ends). Null texts have none."""
    rest = [c for c in files.columns if c != body]
    rows = files.select(*rest, F.posexplode(F.split(F.col(body), "\n")).alias("_at", "_code"))
    return rows.select(*rest, (F.col("_at") + 1).alias("line"), F.rtrim(F.col("_code"), F.lit("\r")).alias("code"))


def whole_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of JSON-lines files with the given columns; lines that aren't objects are skipped, meta lines too."""
    rows = spark.read.text(path).where(F.btrim("value") != "")
    parsed = rows.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row"), F.get_json_object("value", "$.type").alias("_type"), F.try_parse_json("value").isNotNull().alias("_fit"))
    return parsed.where("_fit and coalesce(_type, '') <> 'meta'").select("row.*")


def meta_line(spark: SparkSession, path: str) -> DataFrame:
    """The first meta line of a JSON-lines file as text."""
    rows = spark.read.text(path).where(F.get_json_object("value", "$.type") == "meta")
    return rows.limit(1)


def markdown(spark: SparkSession, path: str, heading: str = "## ") -> DataFrame:
    """number (0: what stands before the first heading) and section of each Markdown file of a folder, or that path is or fits. Folders
    are listed and files opened in tasks."""
    root, wanted = walk.fixed_part(path)
    depth = len(wanted)
    # a path that fits may be a file, or a folder with files
    fits = lambda parts, n: reduce(and_, (paths.glob(F.get(parts, F.lit(i)), w) for i, w in enumerate(wanted[:n])), F.lit(True))
    within = lambda n: F.size(F.split("file", "/")) == n
    parts = F.split("file", "/")
    found = walk.names(spark, root, lambda _: reduce(or_, (within(n) & fits(parts, n) for n in range(1, depth + 1)), F.lit(False)))
    kept = found.where((within(depth) | within(depth + 1)) & fits(parts, depth)).select("file", "size")
    whole = walk.contents(kept, root).select(F.concat(F.lit(f"{walk.uri(root)}/"), "file").alias("path"), _text(F.col("content")).alias("value"))
    return whole.select("path", F.posexplode(text.sections(F.col("value"), heading)).alias("number", "section"))


def tail(rows: DataFrame, order: Column, n: int = 2_000) -> DataFrame:
    """The last n rows by order, in order: a top-n, not a sort of everything."""
    return rows.orderBy(order.desc()).limit(n).orderBy(order)


def git_refs(refs: DataFrame, line: str = "value") -> DataFrame:
    """kind, name, full_ref, commit, short_commit, peeled of each branch and tag in lines `commit ref`; a peeled line's
    commit replaces its tag's. Lines of other shapes are skipped."""
    bare = F.btrim(line)
    parts = refs.select(F.regexp_extract(bare, r"^([0-9a-fA-F]{40})\s+(refs/(heads|tags)/.+)$", 1).alias("commit"), F.regexp_extract(bare, r"^([0-9a-fA-F]{40})\s+(refs/(heads|tags)/.+)$", 2).alias("ref")).where("commit <> ''")
    named = parts.select("commit", F.endswith("ref", F.lit("^{}")).alias("peeled"), F.regexp_replace("ref", r"\^\{\}$", "").alias("full_ref"))
    best = named.groupBy("full_ref").agg(F.max_by("commit", "peeled").alias("commit"), F.max("peeled").alias("peeled"))
    kind = F.when(F.startswith("full_ref", F.lit("refs/heads/")), "branch").otherwise("tag")
    return best.select(kind.alias("kind"), F.regexp_replace("full_ref", "^refs/(heads|tags)/", "").alias("name"), "full_ref", "commit", F.left("commit", F.lit(12)).alias("short_commit"), "peeled")


def scans(spark: SparkSession, root: str, schema: T.StructType | str, name: str = "scan.json", artifacts: str = "*") -> DataFrame:
    """Every scan record below root/source/owner/repo/version/<artifacts>/scans/<scan_id>/, with project_path and scan_id. Folders are
    listed and files opened in tasks; a file of several records gives them all, one that isn't JSON a row of nulls, a blank one none."""
    known = [f for f in (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields if f.name not in ("project_path", "scan_id")]
    own = T.StructType(known)

    def kept(folder: Column) -> Column:
        parts = F.split(folder, "/")
        return (F.size(parts) < 5) | ((F.size(parts) == 5) & paths.glob(parts[4], artifacts)) | ((F.size(parts) == 6) & (F.get(parts, F.lit(5)) == "scans")) | (F.size(parts) == 7)

    found = walk.names(spark, root, kept)
    parts = F.split("file", "/")
    records = walk.contents(found.where((F.size(parts) == 8) & paths.glob(F.element_at(parts, -1), name)).select("file", "size"), root)
    texts = records.select("file", _text(F.col("content")).alias("_text")).where(F.btrim("_text", F.lit(" \t\n\r")) != "")
    each = F.from_json("_text", T.ArrayType(own))
    rows = texts.select(F.slice(parts, 1, 4).alias("_place"), F.get(parts, F.lit(6)).alias("scan_id"), F.explode(F.coalesce(each, F.array(F.lit(None).cast(own)))).alias("_row"))
    return rows.select(F.array_join("_place", "/").alias("project_path"), "scan_id", *(F.col("_row")[f.name].alias(f.name) for f in known))


def logs(spark: SparkSession, folder: str) -> DataFrame:
    """name, size, modified of the log files of a folder, last name first; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(folder)
    return found.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy(F.col("name").desc())
