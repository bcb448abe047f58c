"""Queries of findings and reviews, over documents with their labels as model answers and marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text, verdicts
from ..operators import browse, findings, review
from ..sources import files
from . import standins as S
from .registry import cases, listed, mapped, query, quoted

_V = "lower(trim(coalesce(verdict_text, 'uncertain')))"
VERDICT_SQL = cases([(f"{_V} IN ({listed(fixed.VERDICTS)})", _V), (" OR ".join(f"contains({_V}, {quoted(w)})" for w in fixed.SAFE_SIGNS), "'safe'"), (" OR ".join(f"contains({_V}, {quoted(w)})" for w in fixed.VULNERABLE_SIGNS), "'vulnerable'")], "'uncertain'")
_K = "translate(lower(trim(confidence_text)), '- /', '___')"
_NUMBER = f"coalesce({mapped(_K, fixed.CONFIDENCES)}, {cases([(f'contains(confidence_text, {quoted(w)})', str(v)) for w, v in fixed.CONFIDENCE_SIGNS.items()])}, CASE WHEN ends_with({_K}, '%') THEN try_cast(left({_K}, length({_K}) - 1) AS DOUBLE) / 100 ELSE try_cast({_K} AS DOUBLE) END, 0.5)"
CONFIDENCE_SQL = f"(CASE WHEN {_NUMBER} > 1 AND {_NUMBER} <= 100 THEN CAST({_NUMBER} AS DOUBLE) / 100 WHEN {_NUMBER} BETWEEN 0 AND 1 THEN CAST({_NUMBER} AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END)"
_B = "lower(trim(coalesce(missing_text, '')))"
BREAKPOINT_SQL = cases([(f"{_B} IN ({listed(fixed.BREAKPOINTS)})", _B), (f"{_B} IN ({listed(fixed.EVIDENCE_BREAKPOINTS)})", mapped(_B, fixed.EVIDENCE_BREAKPOINTS))] + [(" OR ".join(f"contains({_B}, {quoted(w)})" for w in words), quoted(kind)) for kind, words in fixed.BREAKPOINT_WORDS])
PUBLISHABLE_SQL = "NOT (coalesce(trim(stopped), '') = 'llm_error' OR starts_with(trim(title), 'LLM 调用失败') OR (trim(title) = 'tool-loop exhausted' AND coalesce(principle, '') = '' AND n_evidence = 0 AND n_missing = 0))"
FULL_SQL = f"{S.FINDINGS_SQL}, f AS (SELECT *, {VERDICT_SQL} AS v, {CONFIDENCE_SQL} AS c, {BREAKPOINT_SQL} AS bp, {PUBLISHABLE_SQL} AS publishable FROM findings), g AS (SELECT *, CASE WHEN v = 'vulnerable' AND (c < 0.5 OR trim(coalesce(missing_text, '')) <> '') THEN 'uncertain' ELSE v END AS verdict, CASE WHEN v = 'vulnerable' AND c >= 0.5 AND trim(coalesce(missing_text, '')) <> '' THEN least(c, 0.6) ELSE c END AS confidence FROM f)"


def _findings(spark, sf_dir):
    rows = S.findings(spark, sf_dir)
    rows = rows.withColumns({"v": verdicts.verdict(F.col("verdict_text")), "c": verdicts.confidence(F.col("confidence_text")), "missing": findings.items(F.col("missing_text"))})
    verdict, confidence = verdicts.guarded(F.col("v"), F.col("c"), F.col("missing"))
    ok = verdicts.publishable(F.col("title"), F.col("stopped"), F.col("principle"), F.col("n_evidence"), F.col("n_missing"))
    return rows.withColumns({"verdict": verdict, "confidence": confidence, "publishable": ok})


@query(f"WITH {FULL_SQL} SELECT verdict_text, v AS verdict, count(*) AS n FROM f GROUP BY ALL")
def verdict_normalize(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("verdict_text", F.col("v").alias("verdict")).agg(F.count("*").alias("n"))


@query(f"WITH {FULL_SQL} SELECT coalesce(confidence_text, '-') AS raw, c AS confidence, count(*) AS n FROM f GROUP BY ALL")
def confidence_normalize(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy(F.coalesce("confidence_text", F.lit("-")).alias("raw"), F.col("c").alias("confidence")).agg(F.count("*").alias("n"))


@query(f"WITH {FULL_SQL} SELECT chain_id, verdict, confidence FROM g")
def guardrail(spark, sf_dir):
    return _findings(spark, sf_dir).select("chain_id", "verdict", "confidence")


@query(f"WITH {FULL_SQL} SELECT coalesce(missing_text, '-') AS raw, bp AS kind, count(*) AS n FROM f GROUP BY ALL")
def breakpoint_normalize(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy(F.coalesce("missing_text", F.lit("-")).alias("raw"), verdicts.breakpoint_of(F.col("missing_text")).alias("kind")).agg(F.count("*").alias("n"))


_RAW = {"doc_id": "doc_id", "chain_id": S.CHAIN, "raw": S.pick("doc_id", "concat('{\"verdict\": \"safe\", \"n\": ', CAST(doc_id AS STRING), '}')", "concat('```json', chr(10), '{\"verdict\": \"vulnerable\", \"n\": ', CAST(doc_id AS STRING), '}', chr(10), '```')", "concat('Here it is: {\"verdict\": \"', lang, '\", \"x\": {\"y\": 1}} - done')", "'{\"verdict\": \"safe\", \"n\": '", "'no object at all'", "''")}


@query(f"WITH r AS ({S.sql(_RAW, 'documents')}), s AS (SELECT *, CASE WHEN starts_with(trim(raw), '```') THEN trim(regexp_replace(trim(trim(raw), '`'), '^json', ''), chr(10) || ' ') ELSE trim(raw) END AS bare FROM r), t AS (SELECT *, regexp_extract(bare, '(?s)\\{{.*\\}}') AS inner_ FROM s), u AS (SELECT chain_id, CASE WHEN bare <> '' AND json_valid(bare) THEN bare WHEN inner_ <> '' AND json_valid(inner_) THEN inner_ END AS j FROM t) SELECT chain_id, j IS NOT NULL AS parsed, json_extract_string(j, '$.verdict') AS verdict FROM u")
def json_salvage(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {n}" for n, e in _RAW.items()))
    found = rows.withColumn("j", text.json_text(F.col("raw")))
    return found.select("chain_id", F.col("j").isNotNull().alias("parsed"), F.get_json_object("j", "$.verdict").alias("verdict"))


_ANSWER = "concat('{\"verdict\": \"', verdict_text, '\", \"confidence\": \"', coalesce(confidence_text, ''), '\", \"missing_info\": ', CASE WHEN missing_text IS NULL THEN '[]' ELSE concat('\"', missing_text, '\"') END, ', \"sink\": {\"file\": \"', sink_file, '\", \"line\": 7}}')"


@query(f"WITH {FULL_SQL} SELECT chain_id, verdict, confidence, concat(vulnerability_type, ' 风险点 @ ', sink_file, ':', sink_line) AS title, {mapped('vulnerability_type', fixed.CWES, quoted(fixed.UNKNOWN_CWE))} AS cwe_guess, coalesce(nullif(severity, ''), 'medium') AS severity, sink_file AS told_file, '7' AS told_line, CAST(0 AS INT) AS repair_rounds FROM g")
def finding_parse(spark, sf_dir):
    rows = S.findings(spark, sf_dir).withColumn("raw", F.expr(_ANSWER))
    out = findings.parsed(rows.select("chain_id", "vulnerability_type", "severity", "sink_file", "sink_line", "raw"))
    return out.select("chain_id", "verdict", "confidence", "title", "cwe_guess", "severity", "told_file", "told_line", "repair_rounds")


_HALVES = "a AS (SELECT concat('K-', CAST(doc_id % 300 AS VARCHAR)) AS chain_id, doc_id AS line, lang FROM documents), b AS (SELECT concat('K-', CAST(doc_id % 450 AS VARCHAR)) AS chain_id, doc_id AS line, source AS lang FROM documents)"


@query(f"WITH {_HALVES}, u AS (SELECT *, 0 AS o FROM a UNION ALL SELECT *, 1 FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY o, line) AS rn FROM u) SELECT chain_id, CAST(o AS INT) AS source_ord, line, lang FROM r WHERE rn = 1")
def chain_union_dedupe(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents")
    a = docs.selectExpr("concat('K-', doc_id % 300) AS chain_id", "doc_id AS line", "lang")
    b = docs.selectExpr("concat('K-', doc_id % 450) AS chain_id", "doc_id AS line", "source AS lang")
    return findings.united(a, b).select("chain_id", "source_ord", "line", "lang")


@query("WITH o AS (SELECT concat('K-', CAST(doc_id AS VARCHAR)) AS chain_id, CASE doc_id % 3 WHEN 0 THEN 'dataflow' ELSE 'callscan' END AS origin, CASE doc_id % 4 WHEN 0 THEN 'weak' ELSE 'probable' END AS evidence_quality, doc_id % 5 = 0 AS suppressed FROM documents) SELECT origin, evidence_quality, suppressed, count(*) AS n FROM o WHERE NOT (origin = 'dataflow' AND (suppressed OR evidence_quality = 'weak')) GROUP BY ALL")
def auditable_chains(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents").selectExpr("concat('K-', doc_id) AS chain_id", "CASE doc_id % 3 WHEN 0 THEN 'dataflow' ELSE 'callscan' END AS origin", "CASE doc_id % 4 WHEN 0 THEN 'weak' ELSE 'probable' END AS evidence_quality", "doc_id % 5 = 0 AS suppressed")
    return findings.auditable(rows).groupBy("origin", "evidence_quality", "suppressed").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, source FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti(spark, sf_dir):
    return findings.pending(S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT d.doc_id, source FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)")
def completed_semi(spark, sf_dir):
    return findings.completed(S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT user_id AS finding_id, max(event_id) AS line, arg_max(event_type, event_id) AS verdict FROM events GROUP BY user_id")
def last_checkpoint(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").selectExpr("user_id AS finding_id", "event_id AS line", "event_type AS verdict")
    return findings.progress(rows, "finding_id").select("finding_id", "line", "verdict")


_MARKS = "concat('C-', left(sha1(CAST(doc_id AS STRING)), 12)) AS chain_id, toxic = 1 AND quality = 1 AS favorite, CASE quality WHEN 1 THEN 'true_positive' ELSE '' END AS codex_verdict, CAST(NULL AS STRING) AS codex_review, CASE WHEN doc_id % 3 = 0 THEN 'false_positive' END AS manual_verdict, CASE WHEN doc_id % 4 = 0 THEN 'seen' END AS manual_review, CAST(NULL AS STRING) AS cc_verdict, '' AS cc_review, CASE WHEN doc_id % 5 = 0 THEN 'uncertain' END AS user_verdict, CASE WHEN doc_id % 7 = 0 THEN 'old note' END AS note, doc_id"
MARKS_SQL = f"raw AS (SELECT {_MARKS} FROM labels), marks AS (SELECT chain_id, favorite, codex_verdict, '' AS codex_review, coalesce(nullif(manual_verdict, ''), user_verdict, '') AS manual_verdict, coalesce(nullif(manual_review, ''), note, '') AS manual_review, doc_id FROM raw)"
_FILLED = "(favorite OR codex_verdict <> '' OR codex_review <> '' OR manual_verdict <> '' OR manual_review <> '')"


def _marks(spark, sf_dir):
    return review.normal_marks(S.table(spark, sf_dir, "labels").selectExpr(*_split(_MARKS)))


def _split(expressions: str) -> list[str]:
    """Expressions of a select list, cut at top-level commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(expressions):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(expressions[start:i])
            start = i + 1
    return [*out, expressions[start:]]


@query(f"WITH {MARKS_SQL} SELECT chain_id, favorite, codex_verdict, manual_verdict, manual_review FROM marks WHERE {_FILLED}")
def marks_normalize(spark, sf_dir):
    return _marks(spark, sf_dir).select("chain_id", "favorite", "codex_verdict", "manual_verdict", "manual_review")


@query(f"""WITH {MARKS_SQL}, kept AS (SELECT * FROM marks WHERE {_FILLED}), ch AS (SELECT {S.CHAIN} AS chain_id, CASE doc_id % 2 WHEN 0 THEN 'clear' ELSE 'true_positive' END AS verdict, CASE WHEN doc_id % 6 = 0 THEN 'again' END AS review, CASE WHEN doc_id % 9 = 0 THEN false END AS fav FROM documents),
m AS (SELECT chain_id, coalesce(fav, favorite, false) AS favorite, coalesce(codex_verdict, '') AS codex_verdict, CASE verdict WHEN 'clear' THEN '' ELSE verdict END AS manual_verdict, coalesce(review, manual_review, '') AS manual_review FROM ch LEFT JOIN kept USING (chain_id)) SELECT * FROM m WHERE favorite OR codex_verdict <> '' OR manual_verdict <> '' OR manual_review <> ''""")
def marks_upsert(spark, sf_dir):
    changes = S.table(spark, sf_dir, "documents").selectExpr(f"{S.CHAIN} AS chain_id", "'manual' AS track", "CASE doc_id % 2 WHEN 0 THEN 'clear' ELSE 'true_positive' END AS verdict", "CASE WHEN doc_id % 6 = 0 THEN 'again' END AS review", "CASE WHEN doc_id % 9 = 0 THEN false END AS favorite")
    return review.upsert(_marks(spark, sf_dir), changes).select("chain_id", "favorite", "codex_verdict", "manual_verdict", "manual_review")


@query(f"WITH {FULL_SQL}, {MARKS_SQL.replace('raw AS', 'raw_marks AS').replace('FROM raw)', 'FROM raw_marks)')} SELECT chain_id, vulnerability_type, coalesce(nullif(manual_verdict, ''), 'none') AS mark FROM findings LEFT JOIN (SELECT * FROM marks WHERE {_FILLED}) m USING (chain_id) WHERE vulnerability_type IN ('xss', 'ssrf') AND coalesce(nullif(manual_verdict, ''), 'none') IN ('none', 'false_positive')")
def marks_left_filter(spark, sf_dir):
    rows = review.with_marks(S.findings(spark, sf_dir), _marks(spark, sf_dir), ["xss", "ssrf"], wanted=["none", "false_positive"])
    return rows.select("chain_id", "vulnerability_type", F.coalesce(F.nullif("manual_verdict", F.lit("")), F.lit("none")).alias("mark"))


@query(f"WITH {FULL_SQL} SELECT chain_id, doc_id FROM g WHERE publishable AND lower(severity) = 'high' ORDER BY confidence DESC, doc_id LIMIT 20 OFFSET 10")
def finding_page(spark, sf_dir):
    _, page = browse.findings(_findings(spark, sf_dir), [F.col("confidence").desc(), F.col("doc_id")], severity="HIGH", within=["title"], offset=10, limit=20)
    return page.select("chain_id", "doc_id")


@query(f"WITH {FULL_SQL} SELECT count(*) AS total FROM g WHERE publishable AND verdict = 'uncertain' AND (contains(lower(coalesce(sink_file, '')), 'api/') OR contains(lower(coalesce(title, '')), 'api/'))")
def finding_keyword(spark, sf_dir):
    total, _ = browse.findings(_findings(spark, sf_dir), [F.col("doc_id")], verdict="Uncertain", word="API/", within=["sink_file", "title"])
    return total


@query(f"WITH {FULL_SQL} SELECT publishable, count(*) AS n FROM f GROUP BY ALL")
def publishable_findings(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("publishable").agg(F.count("*").alias("n"))


@query(f"WITH {FULL_SQL}, e AS (SELECT 'verdict' AS measure, verdict AS key FROM g WHERE publishable UNION ALL SELECT 'verdict', 'done' FROM g WHERE publishable UNION ALL SELECT 'severity', coalesce(nullif(severity, ''), 'unknown') FROM g WHERE publishable AND verdict = 'vulnerable' UNION ALL SELECT 'vulnerability_type', vulnerability_type FROM g WHERE publishable AND verdict = 'vulnerable') SELECT measure, key, count(*) AS n FROM e GROUP BY ALL")
def audit_summary(spark, sf_dir):
    return findings.summary(_findings(spark, sf_dir))


_CHECKS = {"finding_id": "doc_id", "verdict": S.pick("doc_id", "'Confirmed'", "'refuted '", "'maybe'", "CAST(NULL AS STRING)", "'confirmed'"), "confidence": S.FINDINGS["confidence_text"], "concrete_payload": "CASE WHEN doc_id % 3 = 0 THEN 'x=1' ELSE ' ' END", "severity_revised": S.FINDINGS["severity"], "confidence_text": S.FINDINGS["confidence_text"]}
CHECKED_SQL = f"k AS ({S.sql(_CHECKS, 'documents')}), l AS (SELECT *, CASE WHEN lower(trim(coalesce(verdict, ''))) IN ({listed(fixed.CHECKER_VERDICTS)}) THEN lower(trim(verdict)) ELSE 'need_context' END AS v, {CONFIDENCE_SQL} AS c FROM k), checked AS (SELECT finding_id, CASE WHEN v = 'confirmed' AND trim(concrete_payload) = '' THEN 'refuted' ELSE v END AS verdict, CASE WHEN v = 'confirmed' AND trim(concrete_payload) = '' THEN least(c, 0.7) ELSE c END AS confidence, CASE WHEN lower(trim(severity_revised)) IN ({listed(fixed.SEVERITIES)}) THEN lower(trim(severity_revised)) END AS severity_revised FROM l)"


def _checked(spark, sf_dir):
    return review.checked(S.table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {n}" for n, e in _CHECKS.items())))


@query(f"WITH {CHECKED_SQL} SELECT * FROM checked")
def checker_normalize(spark, sf_dir):
    return _checked(spark, sf_dir).select("finding_id", "verdict", "confidence", "severity_revised")


@query(f"WITH {CHECKED_SQL} SELECT 'partial' AS status, CAST(900 AS BIGINT) AS total_targets, count(*) AS total_checked, {', '.join(f'count(*) FILTER (verdict = {quoted(v)}) AS {v}' for v in fixed.CHECKER_VERDICTS)}, CAST(2 AS BIGINT) AS failed FROM checked")
def checker_summary(spark, sf_dir):
    return review.checker_summary(_checked(spark, sf_dir), 900, 2)


_MISSING = {"doc_id": "doc_id", "chain_id": S.CHAIN, "sink_file": S.FILE, "missing_text": S.FINDINGS["missing_text"]}


@query(f"WITH m AS (SELECT *, {BREAKPOINT_SQL} AS kind FROM ({S.sql(_MISSING, 'documents')})), t AS (SELECT *, list_distinct(list_filter([kind, 'missing_source_entry'], lambda v: v IS NOT NULL)) AS ks, CASE WHEN kind IS NULL OR kind = 'missing_source_entry' THEN ['missing_source_entry'] ELSE [kind, 'missing_source_entry'] END AS kinds FROM m), u AS (SELECT chain_id, sink_file, unnest(kinds) AS kind, generate_subscripts(kinds, 1) AS place FROM t) SELECT chain_id, CAST(place AS INT) AS place, kind, {mapped('kind', fixed.REPAIR_PATTERNS)} AS pattern, regexp_replace(sink_file, '/[^/]*$', '') AS path FROM u")
def repair_tasks(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {n}" for n, e in _MISSING.items()))
    rows = rows.withColumn("missing", findings.missing_kinds(F.array("missing_text"), F.array(F.lit("source_control"))))
    return findings.repair_tasks(rows)


@query(f"""WITH m AS (SELECT *, {BREAKPOINT_SQL} AS kind FROM ({S.sql(_MISSING, 'documents')})), u AS (SELECT chain_id, CASE WHEN kind IS NULL OR kind = 'missing_source_entry' THEN ['missing_source_entry'] ELSE [kind, 'missing_source_entry'] END AS missing, doc_id % 2 = 0 AS found FROM m)
SELECT chain_id, CASE WHEN found THEN missing[1] ELSE '' END AS resolved, CASE WHEN found THEN array_to_string(missing[2:], ',') ELSE array_to_string(missing, ',') END AS unresolved, CAST(found AS INT) AS evidence_count FROM u""")
def repair_merge(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {n}" for n, e in _MISSING.items()))
    rows = rows.withColumns({"missing": findings.missing_kinds(F.array("missing_text"), F.array(F.lit("source_control"))), "resolved": F.array().cast("array<string>")})
    found = findings.repair_tasks(rows).where("place = 1").join(rows.where("doc_id % 2 = 0").select("chain_id"), "chain_id", "left_semi")
    return findings.repaired(rows, found).select("chain_id", F.array_join("resolved", ",").alias("resolved"), F.array_join("unresolved", ",").alias("unresolved"), "evidence_count")


@query("SELECT concat('K-', CAST(event_id AS VARCHAR)) AS chain_id, 'safe' AS verdict, CAST(0.95 AS DOUBLE) AS confidence, 'html_escape' AS refuted_by FROM events WHERE event_type IN ('signup', 'view') AND event_id % 2 = 0 AND event_id % 3 <> 1")
def dataflow_precheck(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").selectExpr("concat('K-', event_id) AS chain_id", "CASE event_type WHEN 'signup' THEN 'cross_request' WHEN 'view' THEN 'recovered_partial' ELSE 'direct_call' END AS chain_kind", "CASE WHEN event_id % 2 = 0 THEN array('html_escape') ELSE array() END AS refuting", "CASE event_id % 3 WHEN 0 THEN array('dangerous_sink') WHEN 1 THEN array('dangerous_sink', 'file_flow') ELSE CAST(NULL AS ARRAY<STRING>) END AS positive")
    return findings.prechecked(rows).select("chain_id", "verdict", "confidence", "refuted_by")


_SKILLS = [("en", "xss", "english-xss"), ("fr", "ssrf", "french-ssrf"), (None, "xss", "xss"), (None, "file_upload", "upload")]


@query(f"WITH {S.FINDINGS_SQL} SELECT language, vulnerability_type, CASE WHEN language = 'en' AND vulnerability_type = 'xss' THEN 'english-xss' WHEN language = 'fr' AND vulnerability_type = 'ssrf' THEN 'french-ssrf' WHEN vulnerability_type = 'xss' THEN 'xss' WHEN vulnerability_type = 'file_upload' THEN 'upload' ELSE 'default' END AS skill, count(*) AS n FROM findings GROUP BY ALL")
def skill_lookup(spark, sf_dir):
    rows = findings.skills(S.findings(spark, sf_dir).select("language", "vulnerability_type"), findings.skill_table(spark, _SKILLS))
    return rows.groupBy("language", "vulnerability_type", "skill").agg(F.count("*").alias("n"))


@query(f"WITH {FULL_SQL} SELECT chain_id, CASE WHEN title NOT IN ('', 'unit-test') THEN title ELSE concat(vulnerability_type, ' @ ', sink_file, ':', sink_line, ' call') END AS name, concat(sink_file, ':', sink_line, ' call') AS location, concat_ws(chr(10) || chr(10), CASE WHEN coalesce(principle, '') <> '' THEN concat('## 原理', chr(10), principle) END, concat('## 修复建议', chr(10), 'escape')) AS details, array_to_string(list_filter([vulnerability_type, language, cwe], lambda v: v <> ''), ',') AS tags, lower(coalesce(nullif(severity, ''), 'medium')) AS severity, CASE WHEN verdict = 'vulnerable' THEN 'confirmed' ELSE 'draft' END AS status FROM g")
def curated_fields(spark, sf_dir):
    rows = _findings(spark, sf_dir).withColumns({"project_path": F.col("repo"), "cwe_guess": F.col("cwe"), "sink_expr": F.lit("call"), "fix_suggestion": F.lit("escape")})
    return findings.curated(rows).select("chain_id", "name", "location", "details", F.array_join("tags", ",").alias("tags"), "severity", "status")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS total FROM documents), k AS (SELECT *, sum(CASE WHEN starts_with(code, 'The ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS number FROM l), g AS (SELECT doc_id, CAST(number AS INT) AS number, CAST(sum(length(code) + CASE WHEN n = total THEN 0 ELSE 1 END) AS INT) AS chars FROM k GROUP BY ALL) SELECT * FROM g UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE starts_with(text, 'The ')")
def section_split(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(text.sections(F.col("text"), "The ")).alias("number", "section"))
    return rows.select("doc_id", "number", F.length("section").alias("chars"))


_REF = "concat(sha1(CAST(p_partkey AS STRING)), '  ', CASE WHEN p_partkey % 5 = 0 THEN concat('refs/heads/', p_brand, '/', CAST(p_partkey AS STRING)) WHEN p_partkey % 7 = 0 THEN 'HEAD' ELSE concat('refs/tags/v', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING), CASE WHEN p_partkey % 2 = 1 THEN '^{}' ELSE '' END) END)"


@query("WITH r AS (SELECT " + _REF + r" AS value FROM part), p AS (SELECT regexp_extract(value, '^([0-9a-f]{40})\s+(refs/(heads|tags)/.+)$', 1) AS commit, regexp_extract(value, '^([0-9a-f]{40})\s+(refs/(heads|tags)/.+)$', 2) AS ref FROM r), n AS (SELECT commit, ends_with(ref, '^{}') AS peeled, regexp_replace(ref, '\^\{\}$', '') AS full_ref FROM p WHERE commit <> ''), b AS (SELECT full_ref, arg_max(commit, peeled) AS commit, bool_or(peeled) AS peeled FROM n GROUP BY full_ref) SELECT CASE WHEN starts_with(full_ref, 'refs/heads/') THEN 'branch' ELSE 'tag' END AS kind, regexp_replace(full_ref, '^refs/(heads|tags)/', '') AS name, left(commit, 12) AS short_commit, peeled FROM b")
def ref_peel(spark, sf_dir):
    return files.git_refs(S.table(spark, sf_dir, "part").selectExpr(f"{_REF} AS value")).select("kind", "name", "short_commit", "peeled")


@query("WITH o AS (SELECT CASE user_id % 4 WHEN 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS raw FROM events) SELECT raw, CAST(CASE WHEN try_cast(raw AS BIGINT) IS NULL THEN 3 ELSE greatest(1, least(16, try_cast(raw AS BIGINT))) END AS INT) AS callscan, CAST(CASE WHEN try_cast(raw AS BIGINT) IS NULL THEN 8 ELSE greatest(1, least(2500, try_cast(raw AS BIGINT))) END AS INT) AS auditor, count(*) AS n FROM o GROUP BY ALL")
def option_clamp(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").selectExpr("CASE user_id % 4 WHEN 0 THEN 'x' ELSE CAST(user_id AS STRING) END AS raw")
    return rows.groupBy("raw", verdicts.clamped(F.col("raw"), 1, 16, 3).alias("callscan"), verdicts.clamped(F.col("raw"), 1, 2500, 8).alias("auditor")).agg(F.count("*").alias("n"))
