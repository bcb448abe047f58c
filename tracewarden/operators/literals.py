"""Literals that a pattern can't match without, and one expression that finds the literals of all patterns at once.

A line is tested only against patterns one of whose literals it holds. A pattern whose matches begin with its literals is tested
where one stands, inside that expression, so that no line is searched from its start for each pattern. Literals are of ASCII and in lower case, so that they serve
patterns of either case over folded lines; a pattern whose literals can't be told is tested everywhere.
"""

from __future__ import annotations

import json
import re
import re._constants as op
import re._parser
import string
import warnings
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

#: A literal set has at most so many literals, and none shorter than this.
MOST, LEAST = 64, 2
#: What Java reads as Python does, and in any place.
PLAIN = re.compile(r"(?:\(\?[imsu]+\))?(?:\\[bBdDwWsSnrt](?!\{)|\\[^\w\s]|\((?!\?)|\(\?(?:[:=!>]|<[=!])|\[\^?(?:[^\]\[\\&^]|\\[dDwWsSnrt]|\\[^\w\s])+\]|\{\d+(?:,\d*)?\}|[^\\\[\]{}(])*")
#: Those of ASCII that a word is made of, one by one: a class of single letters is looked up at once.
LETTERS = string.ascii_letters + string.digits + "_"
#: Letters beyond ASCII that match ASCII letters without regard to case.
ALIKE = ("ſKıİ", "skii")


def folded(code: Column) -> Column:
    return F.lower(F.translate(code, *ALIKE))


def required(pattern: str) -> frozenset[str]:
    """Lower-case literals of which each match of the pattern holds one; none where that can't be told."""
    return _best(_walk(_parsed(pattern)))


def signs(pattern: str) -> frozenset[str]:
    """Texts of any length without letters, of which each match of the pattern holds one; none where that can't be told."""
    fit = [own for own in _walk(_parsed(pattern)) if all(own) and not any(c.isalpha() for word in own for c in word)]
    return max(fit, key=_rank, default=frozenset())


def _parsed(pattern: str):
    """What the pattern is made of; nothing if it has syntax that means other things elsewhere (nested classes, quoting, free spacing)."""
    bare = re.sub(r"\\[^Q]", "", pattern, flags=re.S)
    if "\\Q" in bare or re.search(r"\[[^\]]*(\[|&&)|\(\?[a-zA-Z]*x", bare):
        return ()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return re._parser.parse(pattern)
    except (re.error, RecursionError, OverflowError, Warning):
        return ()


def leading(pattern: str) -> frozenset[str]:
    """Literals one of which each match begins with, if they tell as much as those that it holds and the pattern, of plain syntax
    only, can stand inside another expression (no back references or named groups); else none."""
    items = _parsed(pattern)
    own, held = _best([_starts(items)]), _best(_walk(items))
    return own if _rank(own)[0] >= _rank(held)[0] and PLAIN.fullmatch(pattern) else frozenset()


def _rank(words: frozenset[str]) -> tuple[int, int]:
    return min(map(len, words), default=0), -len(words)


def _best(found: list[frozenset[str]]) -> frozenset[str]:
    best = max(found, key=_rank, default=frozenset())
    return best if _rank(best)[0] >= LEAST else frozenset()


def _spelled(code: int) -> frozenset[str] | None:
    return frozenset({chr(code).lower()}) if code < 128 else None


def _exact(items) -> frozenset[str] | None:
    """All texts that items match, in lower case; None if they are many or can't be told."""
    out = frozenset({""})
    for kind, value in items:
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        own = _texts(kind, value)
        if own is None or len(out) * len(own) > MOST:
            return None
        out = frozenset(a + b for a in out for b in own)
    return out


def _texts(kind, value) -> frozenset[str] | None:
    if kind is op.LITERAL:
        return _spelled(value)
    if kind is op.IN:
        codes: set[int] = set()
        for what, own in value:
            if what is op.LITERAL:
                codes.add(own)
            elif what is op.RANGE and own[1] - own[0] < 8:
                codes.update(range(own[0], own[1] + 1))
            else:
                return None
        return frozenset(chr(c).lower() for c in codes) if codes and max(codes) < 128 and len(codes) <= 8 else None
    if kind is op.SUBPATTERN:
        return _exact(value[3])
    if kind is op.ATOMIC_GROUP:
        return _exact(value)
    if kind is op.BRANCH:
        own = [_exact(x) for x in value[1]]
        every = frozenset().union(*own) if None not in own else None
        return every if every is not None and len(every) <= MOST else None
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, own = value
        one = _exact(own) if most == 1 else None
        return one if one is None or least else one | {""}
    return None


def _walk(items) -> list[frozenset[str]]:
    """Literal sets, of each of which a match holds one: runs of what is spelled out, and what groups hold."""
    found, run = [], frozenset({""})
    for kind, value in items:
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        own = _texts(kind, value)
        if own is not None and len(run) * len(own) <= MOST:
            run = frozenset(a + b for a in run for b in own)
            continue
        found.append(run)
        run = own if own is not None else frozenset({""})
        if own is not None:
            continue
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            found += _walk(value[2])
        elif kind is op.SUBPATTERN:
            found += _walk(value[3])
        elif kind is op.ATOMIC_GROUP:
            found += _walk(value)
        elif kind is op.BRANCH:
            sides = [_best(_walk(x)) for x in value[1]]
            every = frozenset().union(*sides)
            found += [every] if all(sides) and len(every) <= MOST else []
    return [*found, run]


def _starts(items) -> frozenset[str]:
    """Texts, in lower case, one of which each match begins with; with an empty one among them if that can't be told."""
    run = frozenset({""})
    for kind, value in items:
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        whole = _texts(kind, value)
        own = _first(kind, value) if whole is None else whole
        if len(run) * len(own) > MOST:
            break
        run = frozenset(a + b for a in run for b in own)
        if whole is None:
            break
    return run


def _first(kind, value) -> frozenset[str]:
    if kind is op.SUBPATTERN:
        return _starts(value[3])
    if kind is op.ATOMIC_GROUP:
        return _starts(value)
    if kind is op.BRANCH:
        return frozenset().union(*map(_starts, value[1]))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
        return _starts(value[2])
    return frozenset({""})


def either(letter: str) -> str:
    """What is folded to the letter, as in a class."""
    return letter + letter.upper() + "".join(a for a, b in zip(*ALIKE, strict=True) if b == letter) if letter.isalpha() else re.escape(letter)


def finder(words: set[str], tests: dict[str, str] | None = None, spell: Callable[[str], str] = re.escape) -> str:
    """An expression whose group 1 is, at each place of a line where one of the words begins, the longest that does, of words with
    a test (what is to follow the word) the longest that passes. spell: the letters that a letter is found by; else the line is a folded one."""
    tests = tests or {}
    tree: dict = {}
    for word in words:
        at = tree
        for letter in word:
            at = at.setdefault(letter, {})
        at[""] = tests.get(word, "")

    def spelled(node: dict) -> str:
        test = node.get("", "")
        ways = [(re.escape(k) if spell(k) == re.escape(k) else f"[{spell(k)}]") + spelled(v) for k, v in sorted(node.items()) if k]
        if not ways:
            return test
        ways += [test] if test else []
        whole = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return whole + ("?" if "" in node and not test else "")

    return f"(?=[{''.join(map(spell, sorted(tree)))}])(?=({spelled(tree)}))"


@dataclass(frozen=True)
class Index:
    """For each literal the numbers of the patterns that match a line where it's found, and of those that may (a word's prefixes
    among the literals are in the line too); the tests of literals; those that are found where a word begins, if at all; the
    numbers of the patterns that have no literal."""

    sure: dict[str, list[int]]
    maybe: dict[str, list[int]]
    tests: dict[str, str]
    edged: set[str]
    rest: list[int]


def index(patterns: list[str]) -> Index:
    led = [leading(p) for p in patterns]
    of = [own or required(p) for own, p in zip(led, patterns, strict=True)]
    words: dict[str, set[int]] = {}
    for i, own in enumerate(of):
        for word in own:
            words.setdefault(word, set()).add(i)
    tested = {w: sorted(own) for w, own in words.items() if all(led[i] for i in own)}
    # looked at from the literal's end: a match of one of its patterns begins where it does
    tests = {w: f"(?<=(?={'|'.join(f'(?:(?U){patterns[i]})' for i in own)})(?s:.{{{len(w)}}}))" for w, own in tested.items()}
    sure = {w: own for w, own in tested.items() if len(own) == 1}
    maybe = {w: sorted(set().union(*(words.get(w[:n], ()) for n in range(LEAST, len(w) + 1))) - set(sure.get(w, ()))) for w in words}
    at_edge = [bool(own) and _parsed(p)[0] == (op.AT, op.AT_BOUNDARY) for own, p in zip(led, patterns, strict=True)]
    edged = {w for w, own in tested.items() if w[0] in LETTERS and all(at_edge[i] for i in own)}
    return Index(sure, maybe, tests, edged, [i for i, own in enumerate(of) if not own])


def met(code: Column, found: Index) -> Column:
    """The literals found in a line, each once; those with a test only where it's passed."""
    # what is sought where words begin is sought by itself, since most places of a line lie within a word
    ways = [(f"(?<![{LETTERS}])", found.edged), ("", set(found.maybe) - found.edged)]
    alike = [F.regexp_extract_all(code, F.lit(f"{before}{finder(words, found.tests, either)}"), F.lit(1)) for before, words in ways if words]
    return F.array_distinct(F.transform(F.array_distinct(F.concat(*alike)), folded)) if alike else F.array().cast("array<string>")


def numbers(words: Column, known: dict[str, list[int]]) -> Column:
    """The numbers that the words have, each once."""
    known = {w: own for w, own in known.items() if own}
    if not known:
        return F.array().cast("array<int>")
    # a map is searched from its start, so words are dealt over as many maps by their hash
    dealt: list[dict[str, list[int]]] = [{} for _ in known]
    for word, own in known.items():
        dealt[zlib.crc32(word.encode()) % len(dealt)][word] = own
    maps = F.from_json(F.lit(json.dumps(dealt)), "array<map<string, array<int>>>")  # a constant of the plan
    return F.array_distinct(F.flatten(F.array_compact(F.transform(words, lambda w: F.element_at(F.get(maps, (F.crc32(w) % len(dealt)).cast("int")), w)))))
