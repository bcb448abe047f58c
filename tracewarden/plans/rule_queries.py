"""Queries of the rule scan, paths, profiles, symbols and trees, over documents as source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, paths, text, verdicts
from ..operators import profiles, rules, symbols, trees
from . import standins as S
from .registry import cases, listed, mapped, query, quoted

RULES = [
    rules.Rule("secret-token", "token", r'token = "', "any", "weak_credential", "critical"),
    rules.Rule("mail-address", "mail", r"[A-Za-z0-9_.]+@[A-Za-z0-9.]+", "any", "info_disclosure", "high"),
    rules.Rule("net-address", "connect", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "any", "ssrf", "medium"),
    rules.Rule("license-note", "license", r"Licensed under|Copyright", "any", "info_disclosure", "low"),
    rules.Rule("license-name", "license", r"Apache License", "any", "xss", "medium", ("py", "php")),
    rules.Rule("article-built", "query", r"[Tt]he ", "english", "sql_injection", "low", ("js", "html", "php"), True),
    rules.Rule("verb-seen", "seen", r" des ", "french", "xss", "high", (), False, (r"aux", r"ment")),
    rules.Rule("never-called", "zzqx", r"zzqx\(", "english", "code_execution", "critical"),
    rules.Rule("version-file", "open", r"Version [0-9]\.[0-9]", "english", "file_path", "high", ("php", "html")),
    rules.Rule("config-mail", "render", r"mail", "php", "xss", "medium", ("php",)),
]
SCOPE = "src3"


def _ext(column: str) -> str:
    name = f"regexp_replace({column}, '^.*/', '')"
    return rf"lower(regexp_extract({name}, '[^.]\.([^.]+)$', 1))"


RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(r.id)}, {quoted(r.function)}, {quoted(r.pattern)}, {quoted(r.language)}, {quoted(r.vulnerability_type)}, {quoted(r.severity)}, {str(r.needs_dynamic).lower()}, [{listed(r.extra)}]::VARCHAR[], [{listed(r.endings)}]::VARCHAR[])" for i, r in enumerate(RULES)) + ") t(rule_ord, rule_id, function, pattern, language, vulnerability_type, severity, needs_dynamic, extra, endings))"
SKIP_SQL = cases([(f"regexp_matches(file, {quoted('(?i)' + p)})", quoted(p)) for p in fixed.SKIPPED_PATHS])
RANK_SQL = mapped("severity", fixed.SEVERITIES, "0")
DYNAMIC_SQL = f"regexp_matches(code, {quoted('(?i)' + '|'.join(fixed.DYNAMIC_HINTS))})"
STAGED_SQL = f"""{S.LINES_SQL}, {RULES_SQL},
hits AS (SELECT rules.*, doc_id, file, line, code, regexp_extract(code, pattern) AS matched_text FROM lines JOIN rules ON (len(endings) = 0 OR list_contains(endings, {_ext('file')})) AND regexp_matches(code, pattern)),
staged AS (SELECT *, CASE WHEN {SKIP_SQL} IS NOT NULL THEN 'filtered_by_path' WHEN NOT (file = '{SCOPE}' OR starts_with(file, '{SCOPE}/') OR true) THEN 'filtered_by_scope'
 WHEN needs_dynamic AND NOT {DYNAMIC_SQL} THEN 'filtered_by_dynamic' WHEN len(extra) > 0 AND len(list_filter(extra, lambda p: regexp_matches(code, p))) = 0 THEN 'filtered_by_extra' ELSE 'kept' END AS stage FROM hits)"""
SCOPED_SQL = STAGED_SQL.replace(" OR true)", ")")


def _staged(spark, sf_dir, target=None):
    return rules.staged(rules.matched(S.lines(spark, sf_dir).drop("lang", "source"), RULES), target)


@query(f"WITH {STAGED_SQL} SELECT rule_id, severity, file, line, CAST(instr(regexp_replace(code, pattern, chr(1)), chr(1)) - 1 AS INT) AS col, matched_text FROM staged WHERE stage = 'kept'")
def rule_scan_hits(spark, sf_dir):
    return _staged(spark, sf_dir).where("stage = 'kept'").select("rule_id", "severity", "file", "line", F.col("column").alias("col"), "matched_text")


@query(f"WITH {SCOPED_SQL} SELECT count(*) AS rg_raw, {', '.join(f'count(*) FILTER (stage = {quoted(s)}) AS {s}' for s in rules.STAGES)} FROM staged")
def rule_scan_funnel(spark, sf_dir):
    return rules.funnel(_staged(spark, sf_dir, SCOPE))


_BEST_SQL = f"best AS (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY {RANK_SQL} DESC, rule_ord) AS rn FROM staged WHERE stage = 'kept')"


@query(f"WITH {STAGED_SQL}, {_BEST_SQL} SELECT file, line, rule_id, severity, concat('C-', left(sha1(concat(language, ':', vulnerability_type, ':', rule_id, ':', file, ':', line, ':', code)), 12)) AS chain_id FROM best WHERE rn = 1")
def rule_hits_dedup(spark, sf_dir):
    best = rules.one_a_line(_staged(spark, sf_dir).where("stage = 'kept'"))
    return best.select("file", "line", "rule_id", "severity", rules.chain_id(best).alias("chain_id"))


@query(f"WITH {STAGED_SQL}, {_BEST_SQL} SELECT severity, count(*) AS n, count(DISTINCT file) AS files FROM best WHERE rn = 1 GROUP BY severity")
def rule_severity_counts(spark, sf_dir):
    best = rules.one_a_line(_staged(spark, sf_dir).where("stage = 'kept'"))
    return best.groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


@query(f"WITH {STAGED_SQL} SELECT rule_id, 'no_rg_match' AS reason FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM staged WHERE stage = 'kept')")
def rule_skipped_anti(spark, sf_dir):
    return rules.skipped(rules.table(spark, RULES), _staged(spark, sf_dir).where("stage = 'kept'")).select("rule_id", "reason")


@query(f"WITH {STAGED_SQL}, {_BEST_SQL} SELECT CAST(row_number() OVER (ORDER BY {RANK_SQL} DESC, len(string_split(file, '/')), file DESC, line) AS INT) AS place, file, line, rule_id FROM best WHERE rn = 1 ORDER BY place LIMIT 100")
def rule_rank_topk(spark, sf_dir):
    from pyspark.sql import Window as W

    top = rules.one_a_line(_staged(spark, sf_dir).where("stage = 'kept'")).orderBy(*rules.work_order()).limit(100)
    return top.select(F.row_number().over(W.orderBy(*rules.work_order())).alias("place"), "file", "line", "rule_id")


@query(f"WITH {S.LINES_SQL} SELECT file, line, CAST(len(regexp_extract_all(code, '(?i)[a-z]*tion')) AS INT) AS n_matches FROM lines WHERE regexp_matches(code, '(?i)[a-z]*tion')")
def grep_matches(spark, sf_dir):
    return rules.grep(S.lines(spark, sf_dir), "[a-z]*tion", ignore_case=True).select("file", "line", "n_matches")


@query(f"WITH {S.LINES_SQL}, near AS (SELECT *, max(CASE WHEN contains(code, 'Licensed under') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS hit FROM lines) SELECT file, line, code FROM near WHERE hit = 1")
def grep_context(spark, sf_dir):
    return rules.context(S.lines(spark, sf_dir), F.contains("code", F.lit("Licensed under")), 2).select("file", "line", "code")


@query(f"WITH {S.FILES_SQL}, r AS (SELECT {SKIP_SQL} AS reason FROM files) SELECT coalesce(reason, '') AS reason, count(*) AS files FROM r GROUP BY ALL")
def path_skip_reason(spark, sf_dir):
    return S.files(spark, sf_dir).groupBy(F.coalesce(paths.skip_reason(F.col("file")), F.lit("")).alias("reason")).agg(F.count("*").alias("files"))


@query(f"WITH {S.FILES_SQL} SELECT file, doc_id FROM files WHERE file = '{SCOPE}/src' OR starts_with(file, '{SCOPE}/src/')")
def scope_filter(spark, sf_dir):
    return S.files(spark, sf_dir).where(paths.in_scope(F.col("file"), f"{SCOPE}/src")).select("file", "doc_id")


@query(f"WITH {S.FILES_SQL}, e AS (SELECT file, {_ext('file')} AS x FROM files) SELECT CASE WHEN x = '' THEN '<no_ext>' ELSE concat('.', x) END AS ext, {mapped('x', fixed.SCAN_LANGUAGES, quoted('template'))} AS scanned_as, {mapped('x', fixed.SHOWN_LANGUAGES, 'coalesce(nullif(x, {}), {})'.format(quoted(''), quoted('text')))} AS shown_as, count(*) AS files FROM e GROUP BY ALL")
def language_by_suffix(spark, sf_dir):
    f = F.col("file")
    return S.files(spark, sf_dir).groupBy(paths.extension(f).alias("ext"), paths.scan_language(f).alias("scanned_as"), paths.shown_language(f).alias("shown_as")).agg(F.count("*").alias("files"))


@query(f"WITH {S.FILES_SQL} SELECT CASE WHEN {_ext('file')} = '' THEN '<no_ext>' ELSE concat('.', {_ext('file')}) END AS ext, count(*) AS n FROM files GROUP BY 1 ORDER BY n DESC, ext LIMIT 30")
def ext_histogram_topk(spark, sf_dir):
    return trees.histogram(S.files(spark, sf_dir))


@query(f"WITH {S.FILES_SQL}, p AS (SELECT file, string_split(file, '/') AS parts FROM files), u AS (SELECT file, parts, unnest(range(1, len(parts))) AS k FROM p) SELECT array_to_string(parts[1:k], '/') AS dir, CAST(k AS INT) AS depth, count(*) AS files FROM u GROUP BY ALL")
def tree_prefix_counts(spark, sf_dir):
    return trees.directories(S.files(spark, sf_dir))


@query(f"WITH {S.FILES_SQL} SELECT regexp_replace(file, '/[^/]*$', '') AS dir, concat('.', {_ext('file')}) AS ext, count(*) AS n FROM files WHERE regexp_matches(file, {quoted('(?i)' + '|'.join(fixed.COUNTED_FILES))}) GROUP BY ALL")
def tree_binary_counts(spark, sf_dir):
    return trees.counted(S.files(spark, sf_dir))


_SIGNAL_SQL = f"(lower(name) IN ({listed(fixed.SIGNAL_FILES)}) OR starts_with(lower(name), 'dockerfile') OR {' OR '.join(f'ends_with(lower(name), {quoted(s)})' for s in fixed.SIGNAL_SUFFIXES)})"


@query(f"""WITH {S.FILES_SQL}, f AS (SELECT file, regexp_replace(file, '/[^/]*$', '') AS dir, regexp_replace(file, '^.*/', '') AS name FROM files),
shown AS (SELECT *, {_SIGNAL_SQL} AS sig, row_number() OVER (PARTITION BY dir, {_SIGNAL_SQL} ORDER BY lower(name), name) AS pl FROM f QUALIFY sig OR pl <= 4),
pre AS (SELECT DISTINCT array_to_string(string_split(file, '/')[1:k], '/') AS path FROM (SELECT file, unnest(range(1, len(string_split(file, '/')))) AS k FROM files)),
d AS (SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS parent, regexp_replace(path, '^.*/', '') AS name, len(string_split(path, '/')) AS depth FROM pre),
kept AS (SELECT path, depth, lower(name) IN ({listed(fixed.SIGNAL_DIRS)}) AS sig, row_number() OVER (PARTITION BY parent, lower(name) IN ({listed(fixed.SIGNAL_DIRS)}) ORDER BY lower(name), name) AS pl FROM d QUALIFY depth <= 2 AND (sig OR pl <= 10)),
a AS (SELECT file, array_to_string(string_split(file, '/')[1:k], '/') AS path FROM (SELECT file, unnest(range(1, len(string_split(file, '/')))) AS k FROM shown))
SELECT file FROM shown WHERE file NOT IN (SELECT file FROM a WHERE path NOT IN (SELECT path FROM kept))""")
def tree_compaction(spark, sf_dir):
    return trees.compacted(S.files(spark, sf_dir), 2, 10, 4)


@query()
def tree_policy_sizes(spark, sf_dir):
    """Every directory that any policy shows, with what is left out and its characters; tests hold it against whole JSON texts."""
    return trees.nodes(S.files(spark, sf_dir), (trees.WHOLE, *fixed.TREE_POLICIES, *trees.FALLBACKS))


def _profiled(spark, sf_dir):
    kept = _staged(spark, sf_dir).where("stage = 'kept'").withColumn("enclosing", F.lit("<module>"))
    return profiles.profiled(kept.withColumn("language", F.when(F.endswith("file", F.lit("php")), "php").when(F.endswith("file", F.lit("js")), "javascript").otherwise("python")))


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(ctx, {quoted(w)})" for w in words) + ")"


_PROFILE_SQL = f"""{STAGED_SQL}, k AS (SELECT * EXCLUDE (language), CASE WHEN ends_with(file, 'php') THEN 'php' WHEN ends_with(file, 'js') THEN 'javascript' ELSE 'python' END AS language FROM staged WHERE stage = 'kept'),
c AS (SELECT *, lower(concat_ws(' ', language, vulnerability_type, file, code, '<module>', rule_id, function)) AS ctx FROM k),
s AS (SELECT *, regexp_matches(ctx, {quoted(fixed.RAW_OUTPUT)}) AS raw, {_has(fixed.CONFIG_SIGNS)} AS config, language = 'php' AND {_has(fixed.WIKI_SIGNS)} AS wiki, language = 'python' AND {_has(fixed.PYTHON_WEB_SIGNS)} AS pyweb, language = 'javascript' AND {_has(fixed.JS_WEB_SIGNS)} AS jsweb,
 vulnerability_type = 'xss' AS xss FROM c),
x AS (SELECT *, xss AND config AND regexp_matches(ctx, {quoted(fixed.HTML_ATTRIBUTE)}) AS attr, xss AND {_has(fixed.CONTENT_SIGNS)} AND {_has(fixed.FORMAT_SIGNS)} AND raw AS content, xss AND {_has(('filename', 'basename', 'preset'))} AND {_has(('script', 'javascript', '.js'))} AS fname FROM s)"""


@query(f"WITH {_PROFILE_SQL} SELECT CASE WHEN attr OR content OR fname THEN 'L2' WHEN wiki OR pyweb OR jsweb THEN 'L1' ELSE 'L0' END AS level, rule_id, count(*) AS n FROM x GROUP BY ALL")
def profile_level(spark, sf_dir):
    return _profiled(spark, sf_dir).groupBy("level", "rule_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_PROFILE_SQL}, t AS (SELECT unnest(list_distinct(list_filter(['generic_sink', CASE WHEN xss AND raw THEN 'raw_output' WHEN xss THEN 'render_sink' END, CASE WHEN vulnerability_type = 'file_path' THEN 'file_operation' END, CASE WHEN vulnerability_type = 'sql_injection' THEN 'database_sink' END,
 CASE WHEN contains(ctx, 'unserialize') THEN 'deserialization_sink' END, CASE WHEN wiki THEN 'framework_yeswiki' END, CASE WHEN wiki THEN 'template_engine' END, CASE WHEN wiki OR pyweb OR jsweb THEN 'framework_entry' END, CASE WHEN wiki AND config THEN 'config_write_or_read' END,
 CASE WHEN pyweb THEN 'python_web_framework' END, CASE WHEN pyweb AND {_has(fixed.ORM_SIGNS)} THEN 'db_persist' END, CASE WHEN jsweb THEN 'js_web_framework' END, CASE WHEN attr THEN 'shape_config_to_raw_html_attr' END, CASE WHEN content THEN 'shape_db_content_format_to_raw_template' END,
 CASE WHEN fname THEN 'shape_filename_to_js_string' END, CASE WHEN attr OR content OR fname THEN 'nday_family_profile' END], lambda v: v IS NOT NULL))) AS tag FROM x) SELECT tag, count(*) AS n FROM t GROUP BY tag""")
def profile_tags(spark, sf_dir):
    return _profiled(spark, sf_dir).select(F.explode("semantic_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


#: Functions of documents: a line whose first word is a capital and at most six signs opens one.
OPENS, CLASS = r"^([A-Z][a-z]{1,5}) ", r"^(The|Der|Les|Los)\b"
_OPENED_SQL = rf"""o AS (SELECT file, line, nullif(regexp_extract(code, '{OPENS}', 1), '') AS name, nullif(regexp_extract(code, '{CLASS}', 1), '') AS own FROM lines),
 m AS (SELECT file, max(line) AS mx FROM lines GROUP BY file), p AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY file ORDER BY line) AS cls FROM o WHERE name IS NOT NULL OR own IS NOT NULL),
 spans AS (SELECT file, concat_ws('.', cls, name) AS function, line AS s, CAST(coalesce(lead(line) OVER (PARTITION BY file ORDER BY line) - 1, mx) AS INT) AS e FROM p JOIN m USING (file) WHERE name IS NOT NULL)"""


def _spans(spark, sf_dir):
    return symbols.spans(S.lines(spark, sf_dir), OPENS, CLASS)


@query(f"WITH {S.LINES_SQL}, {_OPENED_SQL} SELECT file, function, s AS span_start, e AS span_end FROM spans")
def symbol_spans_lead(spark, sf_dir):
    return _spans(spark, sf_dir).select("file", "function", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query(f"""WITH {STAGED_SQL}, {_OPENED_SQL}, j AS (SELECT h.file, h.line, h.rule_id, spans.function, s, e, row_number() OVER (PARTITION BY h.file, h.line, h.rule_id ORDER BY e - s, spans.function, s) AS rn FROM (SELECT * FROM staged WHERE stage = 'kept') h LEFT JOIN spans ON spans.file = h.file AND s <= h.line AND h.line <= e)
SELECT file, line, rule_id, coalesce(function, '<module>') AS function, s AS span_start, e AS span_end FROM j WHERE rn = 1""")
def enclosing_symbol_range(spark, sf_dir):
    hits = _staged(spark, sf_dir).where("stage = 'kept'").select("file", "line", "rule_id")
    out = symbols.enclosing(hits, _spans(spark, sf_dir), ["file", "line", "rule_id"])
    return out.select("file", "line", "rule_id", "function", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query(rf"""WITH {S.LINES_SQL}, {_OPENED_SQL}, called AS (SELECT file, line, replace(code, ' of ', ' of (') AS code FROM lines), f AS (SELECT l.file, function, s, min(line) AS line FROM spans JOIN called l ON l.file = spans.file AND l.line BETWEEN s AND e AND regexp_matches(code, '\bof\s*\(') GROUP BY ALL)
SELECT f.file, function, s AS span_start, f.line, left(trim(code), 240) AS code FROM f JOIN called ON called.file = f.file AND called.line = f.line""")
def call_site_first(spark, sf_dir):
    nodes = _spans(spark, sf_dir).withColumn("callee", F.lit("Module.of"))
    called = S.lines(spark, sf_dir).withColumn("code", F.replace("code", F.lit(" of "), F.lit(" of (")))
    return symbols.call_sites(nodes, called, ["file", "function", "start"]).select("file", "function", F.col("start").alias("span_start"), "line", "code")


@query(f"""WITH {S.LINES_SQL}, {_OPENED_SQL}, g AS (SELECT l.file, s, count(*) AS n, string_agg(code, chr(10) ORDER BY line) AS code FROM spans JOIN lines l ON l.file = spans.file AND l.line BETWEEN s AND e GROUP BY l.file, s)
SELECT file, s AS span_start, CASE WHEN n <= 12 THEN code ELSE array_to_string(string_split(code, chr(10))[1:2] || ['// ... omitted ' || (n - 12) || ' line(s) ...'] || string_split(code, chr(10))[-9:], chr(10)) END AS code_slice FROM g""")
def function_slices(spark, sf_dir):
    functions = _spans(spark, sf_dir)
    return symbols.slices(functions, S.lines(spark, sf_dir), ["file", "start"], 12).select("file", F.col("start").alias("span_start"), "code_slice")


@query(f"""WITH {STAGED_SQL}, w AS (SELECT h.file, h.line, h.rule_id, min(l.line) AS line_start, max(l.line) AS line_end, string_agg(concat(l.line, ': ', l.code), chr(10) ORDER BY l.line) AS code FROM (SELECT * FROM staged WHERE stage = 'kept' AND severity = 'critical') h JOIN lines l ON l.file = h.file AND l.line BETWEEN h.line - 8 AND h.line + 10 GROUP BY ALL) SELECT * FROM w""")
def code_snippets(spark, sf_dir):
    critical = _staged(spark, sf_dir).where("stage = 'kept' and severity = 'critical'").select("file", "line", "rule_id")
    return symbols.windows(critical, S.lines(spark, sf_dir), ["file", "line", "rule_id"], 8, 10)


#: Includes in documents: every line names the file of the next document but two of its source.
_INCLUDING = {"file": S.FILE, "line": "CAST(1 AS INT)", "code": f"concat('require ''', {S.FILE.replace('doc_id', '(doc_id + 40)')}, ''';')"}


@query(f"""WITH i AS (SELECT file, line, regexp_extract(code, {quoted(fixed.INCLUDE)}, 1) AS target FROM ({S.sql(_INCLUDING, 'documents')})), {S.FILES_SQL},
j AS (SELECT f.file AS sink_file, i.file, i.line, target, row_number() OVER (PARTITION BY f.file ORDER BY i.file, i.line, target) AS place FROM (SELECT DISTINCT file FROM files) f JOIN i ON regexp_replace(f.file, '^.*/', '') = regexp_replace(target, '^.*/', '') AND (ends_with(f.file, target) OR ends_with(target, f.file)) AND i.file <> f.file)
SELECT sink_file, CAST(place AS INT) AS place, file, line, target FROM j WHERE place <= 12""")
def include_finder(spark, sf_dir):
    lines = S.table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {n}" for n, e in _INCLUDING.items()))
    return symbols.includers(S.files(spark, sf_dir), symbols.includes(lines))


@query(f"WITH {S.FILES_SQL}, p AS (SELECT doc_id, file, string_split(file, '/') AS s FROM files) SELECT doc_id, array_to_string(list_filter([file, array_to_string(s[-2:], '/'), CASE WHEN len(s) >= 3 AND array_to_string(s[-3:], '/') NOT IN (file, array_to_string(s[-2:], '/')) THEN array_to_string(s[-3:], '/') END, s[-1]], lambda v: v IS NOT NULL), '|') AS needles FROM p")
def include_needles(spark, sf_dir):
    return S.files(spark, sf_dir).select("doc_id", F.array_join(paths.needles(F.col("file")), "|").alias("needles"))


_STACK = {"project": "source", "place": "doc_id", "technology": S.pick("doc_id", "' Django '", "'node.js'", "'MySQL'", "'Twig'", "'C++'", "'spring boot'", "'Deno'")}


@query(f"WITH stack AS ({S.sql(_STACK, 'documents')}), n AS (SELECT project, place, {mapped('lower(trim(technology))', fixed.TECHNOLOGIES)} AS language FROM stack) SELECT project, language, min(place) AS first FROM n WHERE language IS NOT NULL GROUP BY ALL")
def technology_languages(spark, sf_dir):
    return rules.languages(S.table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {n}" for n, e in _STACK.items())))


@query(f"WITH {STAGED_SQL}, {_BEST_SQL}, c AS (SELECT *, doc_id % 3 = 0 AS has_chain FROM best WHERE rn = 1) SELECT severity, vulnerability_type, function, count(*) AS candidates, count(*) FILTER (has_chain) AS with_call_chain, count(*) FILTER (NOT has_chain) AS without_call_chain FROM c GROUP BY ALL")
def callscan_summary(spark, sf_dir):
    best = rules.one_a_line(_staged(spark, sf_dir).where("stage = 'kept'")).withColumn("has_chain", F.expr("doc_id % 3 = 0"))
    return best.groupBy("severity", "vulnerability_type", "function").agg(F.count("*").alias("candidates"), F.count_if("has_chain").alias("with_call_chain"), F.count_if(~F.col("has_chain")).alias("without_call_chain"))


@query(rf"SELECT doc_id, regexp_extract(loc, '^([^:\s]+):(\d+)', 1) AS file, CAST(regexp_extract(loc, '^([^:\s]+):(\d+)', 2) AS BIGINT) AS line FROM (SELECT doc_id, concat({S.FILE}, ':', n_chars, ' call') AS loc FROM documents)")
def location_parse(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents").selectExpr("doc_id", f"concat({S.FILE}, ':', n_chars, ' call') AS loc")
    return rows.select("doc_id", paths.location_file(F.col("loc")).alias("file"), paths.location_line(F.col("loc")).alias("line"))


@query("WITH d AS (SELECT DISTINCT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages) SELECT path, trim(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN length(path) <= 8 THEN '****' ELSE concat(left(path, 4), '****', right(path, 4)) END AS masked, count(*) AS n FROM d GROUP BY ALL")
def slugs_and_masks(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    rows = S.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).distinct()
    return rows.groupBy("path", text.slug(F.col("path")).alias("slug"), text.masked(F.col("path")).alias("masked")).agg(F.count("*").alias("n"))


@query(f"SELECT vulnerability_type, {mapped('vulnerability_type', fixed.CWES, quoted(fixed.UNKNOWN_CWE))} AS cwe, count(*) AS n FROM (SELECT {S.FINDINGS['vulnerability_type']} AS vulnerability_type FROM documents) GROUP BY ALL")
def cwe_default(spark, sf_dir):
    return S.findings(spark, sf_dir).groupBy("vulnerability_type", verdicts.cwe(F.col("vulnerability_type")).alias("cwe")).agg(F.count("*").alias("n"))
