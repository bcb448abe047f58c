"""Column functions over relative paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import fixed
from .text import first_true, lookup


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.rlike(text, F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory_of(path: Column) -> Column:
    """What stands before the last slash; . for a bare name."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def suffix(path: Column) -> Column:
    """Lower-case ending without its dot; empty for names without one and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(name_of(path), r"[^.]\.([^.]+)$", 1))


def extension(path: Column) -> Column:
    """The ending with its dot, <no_ext> where there is none."""
    return F.when(suffix(path) == "", "<no_ext>").otherwise(F.concat(F.lit("."), suffix(path)))


def denied_dir(path: Column) -> Column:
    return _any(path, fixed.DENIED_DIRS)


def included_file(path: Column) -> Column:
    return ~_any(path, fixed.DENIED_FILES)


def counted_file(path: Column) -> Column:
    """Files of which a listing only counts how many there are by ending."""
    return _any(path, fixed.COUNTED_FILES)


def skip_reason(path: Column) -> Column:
    """The first pattern for which a scan skips path; null if none."""
    return first_true([(F.rlike(slashed(path), F.lit(f"(?i){p}")), p) for p in fixed.SKIPPED_PATHS])


def in_scope(path: Column, target: str | None) -> Column:
    """Whether path is the target directory or below it; everything is if there is no target, or `.`."""
    if target in (None, "", "."):
        return F.lit(True)
    return (path == target) | F.startswith(path, F.lit(f"{target}/"))


def is_source(path: Column) -> Column:
    return suffix(path).isin(*fixed.SOURCE_SUFFIXES)


def scan_language(path: Column) -> Column:
    return lookup(suffix(path), fixed.SCAN_LANGUAGES, F.lit("template"))


def shown_language(path: Column) -> Column:
    return lookup(suffix(path), fixed.SHOWN_LANGUAGES, F.coalesce(F.nullif(suffix(path), F.lit("")), F.lit("text")))


def prefixes(path: Column) -> Column:
    """All directories that path is in, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))


def needles(path: Column) -> Column:
    """What an include of path may spell: the path, its last two and last three parts, and its name; each once."""
    whole = F.btrim(slashed(path), F.lit("/"))
    parts = F.split(whole, "/")
    tail = lambda n: F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), "/"))
    return F.filter(F.array_distinct(F.array_compact(F.array(whole, tail(2), tail(3), name_of(whole)))), lambda x: x != "")


def location_file(text: Column) -> Column:
    """Of `file:line …` the file; null where the text doesn't begin so."""
    return F.nullif(F.regexp_extract(F.btrim(text), r"^([^:\s]+):(\d+)", 1), F.lit(""))


def location_line(text: Column) -> Column:
    return F.try_to_number(F.regexp_extract(F.btrim(text), r"^([^:\s]+):(\d+)", 2), F.lit("999999999")).cast("long")


def project_part(path: Column, part: int) -> Column:
    """Part 1 to 4 of source/owner/repo/version; null unless path has exactly four parts, none of them empty, . or .."""
    parts = F.split(path, "/")
    fit = (F.size(parts) == 4) & F.forall(parts, lambda x: ~x.isin("", ".", ".."))
    return F.when(fit, F.get(parts, F.lit(part - 1)))


def resolved_parts(path: Column) -> Column:
    """The parts of a path without empty ones and dots; each .. takes back the part before it, at the root nothing."""
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", up(done)).otherwise(F.array_append(done, x))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def contained(raw: Column, root: str, otherwise: str = ".", home: str | None = None) -> Column:
    """A told path, quoted or with either slash, relative to root (absolute): the root itself is `.`. Paths below repo/ are below
    home, others that start with a slash below root unless root leads them. What leaves root becomes `otherwise`, or `.` if
    that leaves root too; case counts inside root, but a path that begins like it in another case isn't put below it again."""
    base = [x for x in root.split("/") if x]
    text = slashed(F.btrim(F.btrim(F.coalesce(F.nullif(raw, F.lit("")), F.lit(otherwise)), F.lit(" \t\r\n")), F.lit("'\"")))
    below = lambda folder, x: F.concat(F.lit(folder.rstrip("/") + "/"), x)
    home = root.rsplit("/", 1)[0] if home is None else home
    whole = (
        F.when(F.startswith(F.lower(text), F.lit(root.lower())), text)
        .when(F.rlike(text, F.lit("^.:")), below("/..", F.lit("")))
        .when(F.rlike(text, F.lit("^/?repo/")), below(home, text))
        .otherwise(below(root, text))
    )

    def within(path: Column) -> Column:
        parts = resolved_parts(path)
        rest = F.array_join(F.slice(parts, F.lit(len(base) + 1), F.size(parts)), "/")
        return F.when(F.slice(parts, 1, len(base)) == F.array(*map(F.lit, base)), F.coalesce(F.nullif(rest, F.lit("")), F.lit(".")))

    return F.when(text.isin("", ".", "./"), ".").otherwise(F.coalesce(within(whole), within(F.lit(f"{root}/{otherwise}")), F.lit(".")))


def glob(path: Column, pattern: str) -> Column:
    """Whether path fits a glob: ** any path, * and ? within a name, {a,b} either; without a slash it is about the name at any depth."""
    out, depth = "", 0
    for part in re.split(r"(\*\*/?|[*?{},])", pattern):
        if part == "{":
            out, depth = out + "(?:", depth + 1
        elif part == "}" and depth:
            out, depth = out + ")", depth - 1
        elif part == "," and depth:
            out += "|"
        else:
            out += {"**": ".*", "**/": "(?:.*/)?", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return F.rlike(path, F.lit(("^" if "/" in pattern else "(?:^|/)") + out + "$"))


def visible(path: Column) -> Column:
    """False below a hidden or reserved folder of the project hierarchy."""
    return F.forall(F.split(path, "/"), lambda x: ~F.startswith(x, F.lit(".")) & ~x.isin(*fixed.RESERVED_CHILDREN))
