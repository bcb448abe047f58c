"""Column functions over texts: all built-in expressions, null in, null out unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import fixed


def any_contains(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is in text (as is)."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def first_true(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first case that holds, else otherwise."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


_EDGE = {"b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", "B": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"}


def ascii_edges(pattern: str) -> str:
    r"""pattern with every \b and \B at words of \w, which are A-Z, a-z, 0-9 and _. Java before 19 takes any letter for part of a word
    there, so that its \b and its \w differ; quoted parts stay."""
    return re.sub(r"\\Q.*?(?:\\E|\Z)|\\(.)", lambda m: _EDGE.get(m[1], m[0]), pattern, flags=re.DOTALL)


def stripped(text: Column) -> Column:
    """text without white space at its ends; btrim alone takes off spaces only."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def lookup(key: Column, table: dict, otherwise: Column | None = None) -> Column:
    """table[key], else otherwise (null)."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if otherwise is None else F.coalesce(found, otherwise)


def trimmed(text: Column, limit: int = fixed.EVIDENCE_CHARS) -> Column:
    """White space collapsed and cut; null is the empty text."""
    return F.left(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit(limit))


def normal_field(value: Column) -> Column:
    """A field's name: quotes and brackets off, the part after the last dot, other signs as _, lower case."""
    bare = F.btrim(stripped(F.coalesce(value, F.lit(""))), F.lit("`\"'[]{}()"))
    return F.lower(F.btrim(F.regexp_replace(F.substring_index(bare, ".", -1), r"[^A-Za-z0-9_]+", "_"), F.lit("_")))


def field_of(expr: Column) -> Column:
    """The field that an expression ends in: of the first pattern with one, the last match that isn't a request word."""
    found = []
    for pattern in fixed.FIELD_PATTERNS:
        names = F.transform(F.regexp_extract_all(expr, F.lit(pattern), F.lit(1)), normal_field)
        fit = F.filter(names, lambda x: (x != "") & ~x.isin(*fixed.NO_FIELDS))
        found.append(F.try_element_at(fit, F.lit(-1)))
    return F.coalesce(*found, F.lit(""))


def sql_columns(raw: Column) -> Column:
    """Names in a SQL column list: aliases win, qualifiers go."""
    quotes = F.lit("`\"'[]")

    def name(item: Column) -> Column:
        bare = F.btrim(stripped(item), quotes)
        own = F.when(F.contains(F.lower(bare), F.lit(" as ")), F.regexp_extract(bare, r"(\S+)\s*$", 1)).otherwise(bare)
        return F.substring_index(own, ".", -1)

    return F.filter(F.transform(F.split(raw, ","), name), lambda x: x != "")


def written_columns(text: Column) -> Column:
    """Normalised columns that an insert or update in text sets."""
    inserted = F.regexp_extract(text, fixed.SQL_INSERT, 2)
    updated = F.regexp_extract(text, fixed.SQL_UPDATE, 2)
    sets = F.transform(F.split(updated, ","), lambda x: F.btrim(F.substring_index(x, "=", 1), F.lit(" `\"'")))
    none = F.array().cast("array<string>")
    both = F.concat(F.when(inserted != "", sql_columns(inserted)).otherwise(none), F.when(updated != "", sets).otherwise(none))
    return F.filter(F.transform(both, normal_field), lambda x: x != "")


def selected_columns(text: Column) -> Column:
    """Normalised columns that a select in text reads; none for a star."""
    raw = F.regexp_extract(text, fixed.SQL_SELECT, 1)
    none = F.array().cast("array<string>")
    names = F.when((raw != "") & ~F.contains(raw, F.lit("*")), sql_columns(raw)).otherwise(none)
    return F.filter(F.transform(names, normal_field), lambda x: x != "")


def shortened_log(text: Column, limit: int = fixed.LOG_CHARS) -> Column:
    """A log value: beyond limit characters cut, with a note of how many are gone."""
    note = F.concat(F.lit("...<truncated "), (F.length(text) - limit).cast("string"), F.lit(" chars>"))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit)), note))


def shortened_list(items: Column, limit: int = fixed.LOG_ITEMS) -> Column:
    """A logged list of strings: each shortened, and beyond limit items a note instead of the rest."""
    note = F.concat(F.lit("...<truncated "), (F.size(items) - limit).cast("string"), F.lit(" list items>"))
    kept = F.transform(F.slice(items, 1, limit), shortened_log)
    return F.when(F.size(items) <= limit, kept).otherwise(F.concat(kept, F.array(note)))


def estimated_tokens(chars: Column, messages: Column) -> Column:
    """Tokens of messages by their characters: a third each, rounded up, and eight for each message."""
    return (F.floor((F.coalesce(chars, F.lit(0)) + 2) / 3) + 8 * messages).cast("long")


def available_tokens(window: int, answer: int, reserve: int) -> int:
    return max(1, window - answer - reserve)


def char_index(text: Column, byte_offset: Column) -> Column:
    """Characters before a byte offset of text's UTF-8; a cut character doesn't count."""
    head = F.substring(F.encode(text, "UTF-8"), F.lit(1), F.greatest(byte_offset, F.lit(0)).cast("int"))
    # bytes that continue a character don't begin one; an incomplete last character is taken off
    hexes = F.hex(head)
    begun = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(head) - 1, F.lit(0))), lambda i: F.substring(hexes, 2 * i + 1, F.lit(1))), lambda h: (h != "") & ~h.isin("8", "9", "A", "B")))
    whole = F.octet_length(F.left(text, begun))
    return F.when(F.octet_length(head) == 0, 0).when(whole > F.octet_length(head), begun - 1).otherwise(begun)


def sections(text: Column, heading: str = "## ") -> Column:
    """A Markdown text cut before each line that begins with heading: element 1 is what stands before the first one."""
    pattern = "(?m)(?=^" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in heading) + ")"
    parts = F.split(text, pattern)
    return F.when(F.startswith(text, F.lit(heading)), F.concat(F.array(F.lit("")), F.filter(parts, lambda x: x != ""))).otherwise(parts)


def slug(text: Column) -> Column:
    """Lower case, runs of other signs than letters and digits as one -, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "-"), F.lit("-"))


def masked(secret: Column) -> Column:
    """A secret with its first and last four characters; a short one is hidden whole."""
    return F.when(F.length(secret) <= 8, "****").otherwise(F.concat(F.left(secret, F.lit(4)), F.lit("****"), F.right(secret, F.lit(4))))


def json_text(text: Column) -> Column:
    """The JSON in a model's answer as text, null if there is none: a fence is taken off, else the outermost braces count."""
    bare = stripped(text)
    unfenced = F.btrim(bare, F.lit("`"))
    unfenced = F.when(F.startswith(F.lower(unfenced), F.lit("json")), stripped(F.substring(unfenced, 5, 1 << 30))).otherwise(stripped(unfenced))
    whole = F.when(F.startswith(bare, F.lit("```")), unfenced).otherwise(bare)
    braces = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    parsed = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(parsed(whole), F.when(braces != "", parsed(braces)))
