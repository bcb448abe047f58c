"""Queries over rule tables: parts as rules that somebody wrote, and a scan with hundreds of rules for the commonest words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import rules
from . import standins as S
from .registry import listed, query

#: Rules as parts: some have no id, function or pattern, repeat an id, or hold what doesn't compile.
PART_RULES = {
    "rule_ord": "CAST(p_partkey AS INT)",
    "rule_id": "CASE WHEN p_partkey % 31 = 0 THEN ' ' WHEN p_partkey % 29 = 0 THEN 'again' ELSE concat('p-', CAST(p_partkey AS STRING)) END",
    "function": "CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_name END",
    "pattern": S.pick("p_partkey", "p_name", "concat('(', p_name)", "'[a-z'", "concat(p_name, '\\\\s*[(]')", "''", "'a{2,1}'", "p_name", "'ok+'", "'[0-9]+'", "p_brand", "'x(?:y)'", "'z'", "p_type"),
    "language": "p_brand", "vulnerability_type": "p_name",
    "severity": S.pick("p_size", "'critical'", "'high'", "'medium'", "'low'", "'urgent'", "CAST(NULL AS STRING)", "'info'"),
    "extra": "CASE WHEN p_partkey % 19 = 0 THEN array('b', '[c') WHEN p_partkey % 17 = 0 THEN array('d') END",
}
PARTS_SQL = f"rules AS ({S.sql(PART_RULES | {'pattern': PART_RULES['pattern'].replace(chr(92) * 2, chr(92)), 'extra': PART_RULES['extra'].replace('array(', 'list_value(')}, 'part')})"


def _parts(spark, sf_dir):
    return S.table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in PART_RULES.items()))


@query(f"WITH {PARTS_SQL}, kinds AS (SELECT language, vulnerability_type, count(*) AS n FROM rules GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY n DESC, vulnerability_type) AS place FROM kinds) SELECT language, CAST(sum(n) AS BIGINT) AS rules, count(*) AS kinds, string_agg(CASE WHEN place <= 4 THEN concat(vulnerability_type, ':', n) END, ', ' ORDER BY place) AS top FROM ranked GROUP BY language")
def rule_overview_top4(spark, sf_dir):
    return rules.overview(_parts(spark, sf_dir))


@query(f"""WITH {PARTS_SQL}, bad AS (SELECT * FROM rules)
SELECT rule_id, 'repeated id' AS problem FROM bad GROUP BY rule_id HAVING count(*) > 1 UNION ALL SELECT rule_id, 'no id' FROM bad WHERE trim(rule_id) = '' UNION ALL SELECT rule_id, 'no function' FROM bad WHERE trim(function) = ''
UNION ALL SELECT rule_id, 'no pattern' FROM bad WHERE trim(pattern) = '' UNION ALL SELECT rule_id, 'bad severity' FROM bad WHERE severity IS NULL OR severity NOT IN ({listed(fixed.SEVERITIES)})
UNION ALL SELECT DISTINCT rule_id, 'bad pattern' FROM bad WHERE rule_ord % 13 IN (1, 2, 5) UNION ALL SELECT DISTINCT rule_id, 'bad extra pattern' FROM bad WHERE rule_ord % 19 = 0""")
def rule_violations(spark, sf_dir):
    return rules.violations(_parts(spark, sf_dir))


#: How many rules the scan has, each for one of the commonest words of four letters or more.
WORD_RULES = 600
_TOKEN = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+"
_WORD_SQL = f"""{S.LINES_SQL}, words AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(code, '[A-Za-z]+')) AS word FROM lines) WHERE length(word) >= 4 GROUP BY word),
rules AS (SELECT word, place % 3 AS kind, place % 5 = 0 AS limited, concat('w-', word) AS rule_id FROM (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS place FROM words) WHERE place < {WORD_RULES}),
tokens AS (SELECT DISTINCT file, line, unnest(regexp_extract_all(code, '{_TOKEN}[,.]?')) AS token FROM lines),
bare AS (SELECT file, line, rtrim(token, ',.') AS token, length(rtrim(token, ',.')) < length(token) AS ends FROM tokens),
ext AS (SELECT file, lower(regexp_extract(regexp_replace(file, '^.*/', ''), '[^.]\\.([^.]+)$', 1)) AS ext FROM files),
hits AS (SELECT DISTINCT rule_id, file, line FROM bare JOIN rules ON token = word AND (kind = 0 OR (kind = 2 AND ends)) UNION SELECT DISTINCT rule_id, file, line FROM bare JOIN rules ON lower(token) = lower(word) AND kind = 1)"""


def word_rules(spark, sf_dir):
    """A table of rules, as rules.load takes it: whole words, whole words in either case, and words before a comma or dot."""
    words = S.files(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(WORD_RULES).collect()
    shapes = (r"\b{}\b", r"(?i)\b{}\b", r"\b{}[,.]")
    return rules.table(spark, [rules.Rule(f"w-{r['word']}", r["word"], shapes[i % 3].format(r["word"]), "any", "xss", endings=("py", "php") if i % 5 == 0 else ()) for i, r in enumerate(top)], "endings")


@query(f"WITH {_WORD_SQL} SELECT rule_id, count(*) AS lines, count(DISTINCT file) AS files FROM hits JOIN rules USING (rule_id) JOIN ext USING (file) WHERE NOT limited OR ext IN ('py', 'php') GROUP BY rule_id")
def rule_scan_hundreds(spark, sf_dir):
    found = rules.matched(S.lines(spark, sf_dir), rules.load(word_rules(spark, sf_dir)))
    return found.groupBy("rule_id").agg(F.count("*").alias("lines"), F.countDistinct("file").alias("files"))
