"""Column functions over data-flow facts: storage identity, sanitizers, match quality, score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .text import first_true, lookup, normal_field, selected_columns, sql_columns, trimmed, written_columns


def stable_id(prefix: str, length: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha1(F.concat_ws(":", *parts)), F.lit(length)))


def field_key(field: Column) -> Column:
    return F.concat(F.lit("field:"), normal_field(field))


def storage_id(kind: Column, field: Column) -> Column:
    return F.concat_ws(":", F.lit("storage"), kind, normal_field(field))


def storage_label(kind: Column, field: Column, model: Column | None = None) -> Column:
    return F.concat_ws(".", kind if model is None else F.coalesce(model, kind), normal_field(field))


def saved_path(text: Column) -> Column:
    """The first argument of a saving or opening call; null if there is none."""
    first = F.btrim(F.substring_index(F.regexp_extract(trimmed(text), fixed.SAVE_CALL, 1), ",", 1))
    return F.nullif(trimmed(first, 120), F.lit(""))


def sql_table(text: Column) -> Column:
    """The table of the first of insert, update and select in text; null if none."""
    tables = [F.regexp_extract(text, fixed.SQL_INSERT, 1), F.regexp_extract(text, fixed.SQL_UPDATE, 1), F.regexp_extract(text, fixed.SQL_SELECT, 2)]
    return F.coalesce(*(F.when(t != "", normal_field(t)) for t in tables))


def sql_column(text: Column, field: Column) -> Column:
    """The field if the statement names it or is a select, else the statement's first column, else the field."""
    inserted = F.regexp_extract(text, fixed.SQL_INSERT, 2)
    names = F.when(inserted != "", sql_columns(inserted)).when(F.regexp_extract(text, fixed.SQL_UPDATE, 1) != "", written_columns(text))
    return F.when(names.isNull() | F.array_contains(names, field), field).otherwise(F.coalesce(F.get(names, F.lit(0)), field))


def storage_identity(kind: Column, field: Column, evidence: Column) -> Column:
    """struct(kind, identity, confidence) of where a value is kept."""
    field = normal_field(field)
    star = F.coalesce(F.nullif(field, F.lit("")), F.lit("*"))
    named = F.when(field != "", "probable").otherwise("weak")
    table, column, path = sql_table(evidence), sql_column(evidence, field), saved_path(evidence)
    made = lambda k, identity, sure: F.struct(k.alias("kind"), identity.alias("identity"), sure.alias("confidence"))
    full = F.coalesce(F.nullif(column, F.lit("")), F.lit("*"))
    sql = made(F.lit("sql_column"), F.concat_ws(":", F.lit("sql_column"), F.coalesce(table, F.lit("*")), full), F.when(table.isNotNull() & (full != "*"), "confirmed").when(full != "*", "probable").otherwise("weak"))
    slot = made(F.lit("file_path"), F.concat_ws(":", F.lit("file_path"), F.coalesce(path, star)), F.when(path.isNotNull(), "confirmed").otherwise(named))
    keyed = made(kind, F.concat_ws(":", kind, star), F.when(field != "", "confirmed").otherwise("weak"))
    bound = made(F.lit("template_binding"), F.concat_ws(":", F.lit("template_binding"), star), named)
    return first_true([(kind == "sql_field", sql), (kind == "file_slot", slot), (kind.isin("session_key", "cache_key", "config_key"), keyed), (kind == "template_field", bound)], made(kind, F.concat_ws(":", kind, star), named))


def sanitizer_kind(vulnerability_type: Column) -> Column:
    return F.coalesce(lookup(vulnerability_type, fixed.SANITIZER_KINDS), F.when(F.startswith(vulnerability_type, F.lit("file")), "path_or_filename_policy"), F.lit("sanitizer"))


def sanitizers(evidence: Column, vulnerability_type: Column) -> Column:
    """Array of struct(kind, strength, evidence) of the sanitizers in a text: a strong one, a weak one, both or none."""
    item = lambda pattern, strength: F.when(F.rlike(evidence, F.lit(pattern)), F.struct(sanitizer_kind(vulnerability_type).alias("kind"), F.lit(strength).alias("strength"), trimmed(evidence).alias("evidence")))
    return F.array_compact(F.array(item(fixed.STRONG_SANITIZER, "strong"), item(fixed.WEAK_SANITIZER, "weak")))


def dangerous(vulnerability_type: Column, evidence: Column) -> Column:
    """Whether the evidence of a sink shows the danger itself."""
    touched = F.rlike(evidence, F.lit(fixed.FILE_READ)) | F.rlike(evidence, F.lit(fixed.FILE_WRITE))
    return first_true([(vulnerability_type == "xss", F.rlike(evidence, F.lit(fixed.RAW_HTML))), (F.startswith(vulnerability_type, F.lit("file")), touched)], F.lit(True))


def file_flow(text: Column) -> Column:
    """What a file operation shows about upload, name, path and policy."""
    has = lambda pattern: F.rlike(text, F.lit(pattern))
    return F.struct(
        F.when(has(fixed.UPLOAD), "multipart file").otherwise("unknown").alias("source"),
        F.when(F.contains(F.lower(text), F.lit("filename")), "original filename").otherwise("unknown").alias("filename_expr"),
        F.coalesce(saved_path(text), F.lit("unknown")).alias("save_path"),
        has(fixed.WEB_PATH).alias("web_accessible"),
        F.when(has(fixed.FILE_NAME_SANITIZER), "present").otherwise("missing").alias("filename_sanitizer"),
        F.when(has(fixed.EXTENSION_POLICY), "present").otherwise("unknown").alias("extension_policy"),
        F.when(has(fixed.FILE_WRITE), "confirmed").otherwise("weak").alias("confidence"),
    )


def match_quality(write_kind: Column, read_kind: Column, sink_kind: Column, template_var: Column) -> Column:
    """How well a write, the read in between (kind null if none) and a sink on one field fit together."""
    exact = (write_kind == sink_kind) | (read_kind.isNotNull() & (write_kind == read_kind) & (sink_kind == read_kind))
    return F.when(exact, "exact_storage_key").when(read_kind.isNotNull(), F.when(F.coalesce(template_var, F.lit("")) != "", "template_binding").otherwise("storage_read_binding")).otherwise("weak_name_match")


def breakpoints(quality: Column, write_kind: Column, has_read: Column, sink_kind: Column, write_evidence: Column) -> Column:
    """Sorted kinds of evidence that a chain lacks."""
    by_name = lookup(write_kind, {"sql_field": "missing_sql_column_mapping", "file_slot": "missing_file_save_path"}, F.lit("weak_storage_name_match"))
    unbound = (quality == "storage_read_binding") | (~has_read & (sink_kind == "template_field"))
    unsaved = (write_kind == "file_slot") & ~F.rlike(F.coalesce(write_evidence, F.lit("")), F.lit(fixed.FILE_WRITE))
    found = F.array(F.when(quality == "weak_name_match", by_name), F.when(unbound, "missing_template_binding"), F.when(unsaved, "missing_file_save_path"))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def n_breakpoints(quality: Column, write_kind: Column, has_read: Column, sink_kind: Column, write_evidence: Column) -> Column:
    """How many breakpoints a chain has, without making their list: a file that isn't saved counts once."""
    one = lambda condition: F.when(condition, 1).otherwise(0)
    unbound = (quality == "storage_read_binding") | (~has_read & (sink_kind == "template_field"))
    unsaved = (write_kind == "file_slot") & (quality != "weak_name_match") & ~F.rlike(F.coalesce(write_evidence, F.lit("")), F.lit(fixed.FILE_WRITE))
    return one(quality == "weak_name_match") + one(unbound) + one(unsaved)


def noise_tags(quality: Column, has_read: Column, sink_kind: Column, n_strong: Column) -> Column:
    """Sorted reasons to doubt a chain."""
    found = F.array(
        F.when(quality == "weak_name_match", "weak_name_match"),
        F.when(quality == "storage_read_binding", "storage_read_without_template_binding"),
        F.when(~has_read & (sink_kind == "template_field"), "missing_template_binding"),
        F.when(n_strong > 0, "sanitized_before_sink"),
    )
    return F.array_sort(F.array_compact(found))


def score(quality: Column, has_source: Column, has_read: Column, has_function: Column, n_positive: Column, n_strong: Column, n_weak: Column, n_breakpoints: Column) -> Column:
    """Evidence score of a chain, 0 to 100."""
    points = lambda condition, value: F.when(condition, value).otherwise(0)
    total = (
        25
        + points(has_source, 15)
        + lookup(quality, {"exact_storage_key": 25, "template_binding": 25, "storage_read_binding": 15, "weak_name_match": 8}, F.lit(0))
        + points(has_read, 20)
        + points(has_function, 10)
        + F.least(F.lit(15), 5 * n_positive)
        - points(n_strong > 0, 35)
        - F.least(F.lit(30), 12 * n_breakpoints)
        - points(quality == "weak_name_match", 15)
        - points(n_weak > 0, 5)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def evidence_quality(score_: Column, has_read: Column, n_strong: Column, quality: Column) -> Column:
    sure = (score_ >= 80) & has_read & (n_strong == 0) & quality.isin("exact_storage_key", "template_binding")
    return F.when(sure, "confirmed").when((score_ >= 50) & (n_strong == 0), "probable").otherwise("weak")
