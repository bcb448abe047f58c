"""Projects, versions, scans and curated vulnerabilities: counts, states, links, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import verdicts
from ..functions.text import any_contains
from . import browse, symbols

STATUSES = ("pending", "running", "done", "error", "stopped")


def project_counts(scans: DataFrame) -> DataFrame:
    """source, owner, repo with their versions and scans: versions are counted first, so a busy one is summed map side."""
    versions = scans.groupBy("source", "owner", "repo", "version").agg(F.count("*").alias("n"))
    return versions.groupBy("source", "owner", "repo").agg(F.count("*").alias("versions"), F.sum("n").alias("scans"))


def fingerprint(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row: how many files of these names there are and when the last one changed; it differs once one is written."""
    own = F.substring_index("file", "/", -1).isin(*names)
    return files.where(own).agg(F.count("*").alias("files"), F.max("modified").alias("modified"))


def with_options(scans: DataFrame) -> DataFrame:
    """Scans whose two concurrency options (texts) are numbers within bounds."""
    return scans.withColumns({"callscan_concurrency": verdicts.clamped(F.col("callscan_concurrency"), 1, 16, 3), "auditor_concurrency": verdicts.clamped(F.col("auditor_concurrency"), 1, 2_500, 8)})


def scan_id(at: Column) -> Column:
    """Ids sort by time to the microsecond."""
    return F.date_format(at, "yyyyMMdd-HHmmss-SSSSSS")


def without_orphans(scans: DataFrame) -> DataFrame:
    """After a restart nothing runs: running scans are stopped and have no current agent."""
    running = F.col("status") == "running"
    return scans.withColumns({"status": F.when(running, "stopped").otherwise(F.col("status")), "current_agent": F.when(~running, F.col("current_agent"))})


def retried(scans: DataFrame, failures: DataFrame) -> DataFrame:
    """Scans that can audit again: with failures and not running; the auditor is no longer among the completed agents.
    failures(scan_id, …): a row for each failed chain."""
    n = failures.groupBy("scan_id").agg(F.count("*").alias("failure_count"))
    rows = scans.join(n, "scan_id").where("status <> 'running'")
    return rows.withColumns({"status": F.lit("pending"), "completed_agents": F.array_remove("completed_agents", "auditor")})


def in_order(legacy: str = "legacy") -> list[Column]:
    """Own scans before legacy ones, new before old; ids break ties."""
    return [F.col(legacy).asc(), F.col("created_at").desc_nulls_last(), F.col("scan_id").desc()]


def latest_scan(scans: DataFrame) -> DataFrame:
    """The first scan of each project in that order."""
    rest = [c for c in scans.columns if c != "project_path"]
    best = scans.groupBy("project_path").agg(F.max_by(F.struct(*rest), F.struct((~F.col("legacy")).alias("own"), "created_at", "scan_id")).alias("x"))
    return best.select("project_path", "x.*")


def searched(rows: DataFrame, columns: list[str], word: str) -> DataFrame:
    """Rows of which the columns, lower-case and joined by spaces, contain the word."""
    return rows.where(any_contains(F.lower(F.concat_ws(" ", *columns)), (word.strip().lower(),)))


def confirmed_only(chains: DataFrame) -> DataFrame:
    """Chains that are neither weak nor suppressed."""
    return chains.where((F.coalesce("evidence_quality", F.lit("")) != "weak") & ~F.coalesce("suppressed", F.lit(False)))


def already_curated(findings: DataFrame, curated: DataFrame) -> DataFrame:
    """Findings that a curated vulnerability came from."""
    key = ["project_path", "scan_id", "chain_id"]
    return findings.join(curated.select(*key), key, "left_semi")


def linked(vulnerabilities: DataFrame, versions: DataFrame) -> DataFrame:
    """vulnerability_id, project_path for each link to a version that exists. vulnerabilities(vulnerability_id, links)."""
    rows = vulnerabilities.select("vulnerability_id", F.explode("links").alias("project_path")).distinct()
    return rows.join(versions.select("project_path"), "project_path", "left_semi").select("vulnerability_id", "project_path")


def chosen_sections(asked: Column, known: dict[str, tuple[str, ...]]) -> Column:
    """Sections of a report that keys or aliases in an array ask for; all if it is empty. known: alias -> sections."""
    every = sorted({s for own in known.values() for s in own})
    wanted = F.array_sort(F.array_distinct(F.flatten(F.transform(asked, lambda x: F.coalesce(F.try_element_at(F.create_map(*(y for k, v in known.items() for y in (F.lit(k), F.array(*map(F.lit, v))))), x), F.when(x.isin(*every), F.array(x)), F.array().cast("array<string>"))))))
    return F.when(F.size(asked) == 0, F.array(*map(F.lit, every))).otherwise(wanted)


def file_groups(locations: DataFrame) -> DataFrame:
    """file, n, and its lines in order, of findings(file, line)."""
    return locations.groupBy("file").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("line")), ",").alias("lines"))


def vulnerability_summary(rows: DataFrame) -> DataFrame:
    """The fields of a curated vulnerability that lists show; a missing name is its id, missing tags and links are none."""
    none = F.array().cast("array<string>")
    return rows.select("vulnerability_id", "project_key", F.coalesce(F.nullif("name", F.lit("")), F.col("vulnerability_id")).alias("name"), "severity", "status", "source", F.coalesce("tags", none).alias("tags"), "created_at", "updated_at", F.coalesce("links", none).alias("links"))


#: Lines of a code region before and after its line, and of one that names no line.
REGION_BEFORE, REGION_AFTER, REGION_HEAD = 8, 10, 80


def code_regions(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """vulnerability_id, code_regions: the source, the sink, the evidence and the told location of each vulnerability, in this order,
    whose file has such lines; a place told twice counts once. rows(vulnerability_id, links, location, source_finding); a region is
    of the project that the finding names, else of the first linked one. lines(project_path, file, line, code) meet regions by
    project, file and blocks of lines, at most 80 lines of each."""
    finding = F.col("source_finding.finding")
    node = lambda role: F.array(F.struct(F.lit(role).alias("role"), finding[role]["file"].alias("file"), finding[role]["line"].alias("line"), F.coalesce(finding[role]["expr"], finding[role]["detail"], F.lit("")).alias("description")))
    told = F.transform(finding["evidence"], lambda e: F.struct(F.lit("evidence").alias("role"), e["file"].alias("file"), e["line"].alias("line"), F.coalesce(e["detail"], e["source"], F.lit("")).alias("description")))
    at = lambda i: F.nullif(F.regexp_extract(F.btrim("location"), r"^([^:\s]+):(\d+)", i), F.lit(""))
    place = F.array(F.struct(F.lit("location").alias("role"), at(1).alias("file"), at(2).try_cast("int").alias("line"), F.coalesce("location", F.lit("")).alias("description")))
    none = F.array().cast("array<struct<role:string,file:string,line:int,description:string>>")
    every = F.concat(*(F.coalesce(x, none) for x in (node("source"), node("sink"), told, place)))
    project = F.coalesce(F.nullif(F.btrim("source_finding.project_path"), F.lit("")), F.get("links", F.lit(0)))
    told_rows = rows.select("vulnerability_id", project.alias("project_path"), F.posexplode(every).alias("place", "x")).select("vulnerability_id", "project_path", "place", "x.*")
    file = F.btrim(F.btrim(F.translate("file", "\\", "/")), F.lit("/"))
    fit = told_rows.withColumn("file", file).where(~F.exists(F.split("file", "/"), lambda p: p == "..") & ~F.col("file").isin("", "."))
    first = fit.groupBy("vulnerability_id", "project_path", "file", "line").agg(F.min_by(F.struct("place", "role", "description"), "place").alias("x"))
    focus = F.greatest(F.col("line"), F.lit(1))
    from_, to = F.when(F.coalesce("line", F.lit(0)) == 0, 1).otherwise(F.greatest(focus - REGION_BEFORE, F.lit(1))), F.when(F.coalesce("line", F.lit(0)) == 0, REGION_HEAD).otherwise(focus + REGION_AFTER)
    wanted = first.select("vulnerability_id", "project_path", "file", "line", "x.*", from_.alias("_from"), to.alias("_to"))
    near = symbols.around(wanted, lines, ["project_path", "file"], REGION_HEAD)
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "code"))), lambda x: x["code"]), "\n")
    shown = near.groupBy("vulnerability_id", "place").agg(F.first("role").alias("role"), F.first("file").alias("file"), F.first("line").alias("line"), F.min("_line").alias("line_start"), F.max("_line").alias("line_end"), F.first("description").alias("description"), code.alias("code"))
    listed = F.array_sort(F.collect_list(F.struct("place", "role", "file", "line", "line_start", "line_end", "description", "code")))
    numbered = F.transform(listed, lambda r, i: F.struct(F.concat_ws(":", (i + 1).cast("string"), r["role"], r["file"], F.coalesce(r["line"], F.lit(0)).cast("string")).alias("id"), r["role"].alias("role"), r["file"].alias("file"), r["line"].alias("line"), r["line_start"].alias("line_start"), r["line_end"].alias("line_end"), F.btrim(r["description"]).alias("description"), r["code"].alias("code")))
    return shown.groupBy("vulnerability_id").agg(numbered.alias("code_regions"))


def vulnerability_detail(rows: DataFrame, lines: DataFrame, attached: DataFrame) -> DataFrame:
    """The summary of each vulnerability with its texts, references, code regions, and the files and commands of its environment,
    reproduction and proof. attached(vulnerability_id, area, file, commands): a row for each file, or one with the commands."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    more = rows.select("vulnerability_id", *map(text, ("details", "location", "affected_version", "cve")), F.coalesce("references", F.array().cast("array<string>")).alias("references"), "source_finding")
    areas = ("environment", "reproduction", "poc")
    held = lambda a: F.struct(F.array_sort(F.collect_list(F.when(F.col("area") == a, F.col("file")))).alias("files"), F.coalesce(F.max(F.when(F.col("area") == a, F.col("commands"))), F.lit("")).alias("commands")).alias(a)
    with_files = vulnerability_summary(rows).join(more, "vulnerability_id").join(attached.groupBy("vulnerability_id").agg(*map(held, areas)), "vulnerability_id", "left")
    return with_files.join(code_regions(rows, lines), "vulnerability_id", "left")


def link_candidates(rows: DataFrame, word: str) -> DataFrame:
    """Vulnerabilities that a version can be linked to: whose name, id, severity, status, source and tags, joined by spaces, contain
    the word in any case; an empty word keeps all."""
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("name", "vulnerability_id", "severity", "status", "source")]
    wanted = word.strip().lower()
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *fields, "tags")), F.lit(wanted))) if wanted else rows


def linked_to(rows: DataFrame, project_path: str) -> DataFrame:
    """The vulnerabilities that a version is linked to, in the order of vulnerability_order."""
    return rows.where(F.array_contains("links", project_path)).orderBy(*sorting(vulnerability_order()))


#: An order of a list: its keys, and which of them fall.
Order = tuple[list[Column], tuple[bool, ...]]


def sorting(order: Order) -> list[Column]:
    return [k.desc() if down else k.asc() for k, down in zip(*order, strict=True)]


def vulnerability_order() -> Order:
    """The last changed first, as texts; a missing time is the oldest; ids break ties."""
    return [F.coalesce("updated_at", F.lit("")), F.col("vulnerability_id")], (True, False)


def history_order() -> Order:
    return [F.col("version")], (True,)


def run_order() -> Order:
    """The last started run first."""
    return [F.coalesce("started_at", F.lit("")), F.col("run_id")], (True, True)


def ref_order() -> Order:
    """Branches before tags, by name in any case; names break ties."""
    return [F.when(F.col("kind") == "branch", 0).otherwise(1), F.lower("name"), F.col("name")], (False, False, False)


def audit_head(audits: DataFrame) -> DataFrame:
    """An audit without its findings: they are not read."""
    return audits.drop("findings")


def shown_profile(profile: Column) -> Column:
    """A project profile (map) without the keys that aren't shown."""
    return F.map_filter(profile, lambda k, _: ~k.isin("project_name", "confidence", "limits"))


def project_order(by_name: bool = False) -> list[Column]:
    """Projects by name (in binary order) or the newest first."""
    return [F.col("name")] if by_name else [F.col("updated_at").desc_nulls_last(), F.col("name")]


def first_source(full: DataFrame, legacy: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the full file of each key, of the legacy file where there is no full one."""
    return full.unionByName(legacy.join(full.select(*key).distinct(), key, "left_anti"))


def all_scans(own: DataFrame, root: DataFrame, specific: DataFrame) -> DataFrame:
    """project_path, scan_id, created_at, legacy: own scans, those of old root folders, and old specific ones, whose ids get a prefix."""
    columns = ["project_path", "scan_id", "created_at"]
    old = root.select("project_path", F.lit("legacy-root").alias("scan_id"), "created_at").unionByName(specific.select("project_path", F.concat(F.lit("legacy-"), F.col("scan_id")).alias("scan_id"), "created_at"))
    return own.select(*columns, F.lit(False).alias("legacy")).unionByName(old.select(*columns, F.lit(True).alias("legacy")))


def by_status(rows: DataFrame, status: str) -> DataFrame:
    """Rows of a queue with the status; `all` keeps every row."""
    return rows if status == "all" else rows.where(F.col("status") == status)


def any_field(rows: DataFrame, columns: list[str], word: str) -> DataFrame:
    """Rows of which one of the columns contains the word in lower case; an empty word keeps all."""
    return rows.where(browse.keyword(columns, word.strip().lower() or None))
