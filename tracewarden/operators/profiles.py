"""Semantic profile of a hit: level, tags, required evidence and repair hints from its context, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, verdicts
from ..functions.text import any_contains

FILE_TYPES = ("file_upload", "file_inclusion", "file_download", "file_path", "path_traversal")


def profiled(hits: DataFrame) -> DataFrame:
    """hits (language, vulnerability_type, file, code, function, rule_id, enclosing, level and the three lists) with the
    four profile columns raised and extended. Each family below is (condition, level, tags, evidence, hints)."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("language", "vulnerability_type", "file", "code", "enclosing", "rule_id", "function"))))
    kind, language = F.col("vulnerability_type"), F.lower("language")
    has = lambda words: any_contains(text, words)
    raw = F.rlike(text, F.lit(fixed.RAW_OUTPUT))
    config = has(fixed.CONFIG_SIGNS)
    wiki = (language == "php") & has(fixed.WIKI_SIGNS)
    python_web = (language == "python") & has(fixed.PYTHON_WEB_SIGNS)
    js_web = language.isin("javascript", "typescript") & has(fixed.JS_WEB_SIGNS)
    rendered = kind.isin("xss", "ssti")
    attribute = (kind == "xss") & config & F.rlike(text, F.lit(fixed.HTML_ATTRIBUTE))
    content = (kind == "xss") & has(fixed.CONTENT_SIGNS) & has(fixed.FORMAT_SIGNS) & raw
    file_name = (kind == "xss") & has(("filename", "basename", "preset")) & has(("script", "javascript", ".js"))
    hidden = has(("unserialize",)) & has(("hidden",)) & has(("serialize", "base64", "unserialize"))
    families: list[tuple[Column, str, tuple, tuple, tuple]] = [
        (F.lit(True), "L0", ("generic_sink",), ("source_control", "sanitizer_state"), ()),
        (rendered & raw, "L0", ("raw_output",), (), ()),
        (rendered & ~raw, "L0", ("render_sink",), (), ()),
        (rendered, "L0", (), ("template_binding",), ("find_template_binding", "find_sanitizer")),
        (kind.isin(*FILE_TYPES), "L0", ("file_operation",), ("file_save_path", "reachability"), ("find_file_save_path", "find_path_sanitizer")),
        ((kind == "deserialization") | has(("unserialize",)), "L0", ("deserialization_sink",), ("storage_identity", "reachability"), ("find_serialized_source", "find_unserialize_guard")),
        (kind.isin("sql_injection", "nosql_injection"), "L0", ("database_sink",), ("storage_identity", "sanitizer_state"), ("find_query_builder", "find_parameterization")),
        (wiki, "L1", ("framework_yeswiki", "framework_entry", "template_engine"), ("permission_check", "template_binding", "storage_identity"), ("find_yeswiki_action", "find_yeswiki_permission", "find_template_binding")),
        (wiki & config, "L1", ("config_write_or_read",), ("storage_read",), ("find_config_storage",)),
        (python_web, "L1", ("python_web_framework", "framework_entry"), ("permission_check", "template_binding"), ("find_python_route", "find_python_decorator", "find_template_binding")),
        (python_web & has(fixed.ORM_SIGNS), "L1", ("db_persist",), ("storage_identity",), ("find_orm_field_mapping",)),
        (js_web, "L1", ("js_web_framework", "framework_entry"), ("permission_check", "template_binding"), ("find_js_route", "find_js_middleware", "find_props_or_template_binding")),
        (attribute, "L2", ("shape_config_to_raw_html_attr", "nday_family_profile"), ("permission_check", "storage_identity", "template_binding", "sanitizer_state"), ("find_config_writer", "find_html_attribute_context")),
        (content, "L2", ("shape_db_content_format_to_raw_template", "nday_family_profile"), ("storage_identity", "storage_read", "template_binding", "sanitizer_state"), ("find_db_content_write", "find_renderer_format", "find_raw_template_output")),
        (file_name, "L2", ("shape_filename_to_js_string", "nday_family_profile"), ("file_save_path", "template_binding", "sanitizer_state"), ("find_filename_source", "find_js_string_context")),
        (hidden, "L2", ("shape_post_serialized_hidden_unserialize", "nday_family_profile"), ("source_control", "storage_identity", "sanitizer_state"), ("find_hidden_input_roundtrip", "find_unserialize_guard")),
    ]
    rank = F.greatest(verdicts.level_rank(F.col("level")), *(F.when(c, fixed.LEVELS[lv]).otherwise(1) for c, lv, *_ in families))

    def extended(own: str, at: int) -> Column:
        none = F.array().cast("array<string>")
        more = [F.when(f[0], F.array(*map(F.lit, f[at]))).otherwise(none) for f in families if f[at]]
        return verdicts.once(F.concat(F.coalesce(F.col(own), none), *more))

    columns = {"level": F.concat(F.lit("L"), (rank - 1).cast("string")), "semantic_tags": extended("semantic_tags", 2), "required_evidence": extended("required_evidence", 3), "repair_hints": extended("repair_hints", 4)}
    return hits.withColumns(columns)
