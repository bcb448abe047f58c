"""The literal index of the rule scan."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tracewarden.operators import literals, rules


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [
        (r"\beval\s*\(", {"eval"}),
        (r"(?i)\b(?:EXEC|shell_exec)\s*\(", {"exec", "shell_exec"}),
        (r"f[ou]o", {"foo", "fuo"}),
        (r"ab?cd", {"acd", "abcd"}),
        (r"(?:ab)+xcd", {"xcd"}),
        (r"x*yz\w+longer", {"longer"}),
        (r"(?:foo|\w+)bar", {"bar"}),
        (r"\d{1,3}", set()),
        (r"[[a-z]&&[^b]]xyz", set()),
        (r"\Qabc\E", set()),
        (r"(?x) a b c # d", set()),
        (r"a(", set()),
        (r"(['\"])key\1", {"'key", '"key'}),
        (r"naïves", {"ves"}),
    ],
)
def test_required(pattern, expected):
    assert literals.required(pattern) == expected


_PIECES = st.sampled_from(["ab", "c", "Ab", "[xy]", "[a-d]", r"\w", ".", r"\b", "(?:ab|cd)", "(?:a|bcd)", "(ab)+", "(?:cd)*", "x?", "(?:xy){2}", "(?=a)", "(?!z)", "(?>ab)", "ba{1,2}", "(?i:aB)"])


@settings(max_examples=400, deadline=None)
@given(st.lists(_PIECES, min_size=1, max_size=6), st.lists(st.text("abcdxyAB ", max_size=30), min_size=1, max_size=20))
def test_every_match_holds_a_literal(pieces, texts):
    pattern = "".join(pieces)
    own = literals.required(pattern)
    for text in texts:
        if own and re.search(pattern, text):
            assert any(w in text.lower() for w in own)


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [(r"[\w.]+@[\w.]+", {"@"}), (r"\d{1,3}\.\d{1,3}", {"."}), (r"x\w+[#@]\w", {"#", "@"}), (r"\w+[#@]y", set()), (r"\w+@?", set()), (r"(?:\w+@|\w+#)", set()), (r"@|", set()), (r"(?i)k\w+", set()), (r"\d+(?:@\d)*", set()), (r"[[a-z]&&[^b]]@", set())],
)
def test_signs(pattern, expected):
    assert literals.signs(pattern) == expected


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", r"\.", "[@#]", r"\w+", "#?", "(?:@|#)", "(?:@|a+)", "(@#)*", "@{2}", "(?=@)", "[^@]", ".", "(?:a@)+", "@|#"]), min_size=1, max_size=6), st.lists(st.text("aA@#.", max_size=20), min_size=1, max_size=20))
def test_every_match_holds_a_sign(pieces, texts):
    pattern = "".join(pieces)
    own = literals.signs(pattern)
    for text in texts:
        if own and re.search(pattern, text):
            assert any(w in text for w in own)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab.(", min_size=2, max_size=5), min_size=1, max_size=12), st.text("ab.(", max_size=40))
def test_finder_finds_all(words, text):
    """What begins somewhere is found there, or a longer word that it begins."""
    found = {m[1] for m in re.finditer(literals.finder(words), text)}
    assert found <= words
    assert {w for w in words if w in text} == {w for w in words if any(f.startswith(w) for f in found)}


def test_scan(spark):
    """Rules with and without literals, Unicode letters alike ASCII ones, back references, places of matches."""
    own = [
        rules.Rule("call", "eval", r"\beval\s*\(", "any", "xss"), rules.Rule("alike", "kiss", r"(?iu)kiss", "any", "xss"), rules.Rule("twice", "quote", r"(['\"])abc\1", "any", "xss"),
        rules.Rule("digit", "n", r"\d\d", "any", "xss", endings=("py",)), rules.Rule("empty", "n", r"(?=z)|zz", "any", "xss"), rules.Rule("cafe", "cafe", "(?i)CAFÉ", "any", "xss"),
    ]
    lines = [("a.py", 1, "x = eval (1) + eval(2)"), ("a.py", 2, "medieval(1)"), ("a.py", 3, "x 12 34"), ("a.js", 1, "x 12"), ("a.py", 4, "Kıſs"), ("a.py", 5, 'say "abc\' or "abc"'), ("a.py", 6, "🙂 zz"), ("a.py", 7, "zx"), ("a.py", 8, "un café"), ("a.py", 9, None), ("a.py", 10, "")]
    found = rules.matched(spark.createDataFrame(lines, "file string, line int, code string"), own)
    rows = sorted((r["rule_id"], r["file"], r["line"], r["column"], r["matched_text"]) for r in found.collect())
    assert rows == [
        ("alike", "a.py", 4, 0, "Kıſs"), ("cafe", "a.py", 8, 3, "café"), ("call", "a.py", 1, 4, "eval ("), ("digit", "a.py", 3, 2, "12"),
        ("empty", "a.py", 6, 2, ""), ("empty", "a.py", 7, 0, ""), ("twice", "a.py", 5, 13, '"abc"'),
    ]
    assert rules.matched(spark.createDataFrame(lines, "file string, line int, code string"), []).count() == 0


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [
        (r"\beval\s*\(", {"eval"}),
        (r"(?i)\b(?:EXEC|shell_exec)\s*\(", {"exec", "shell_exec"}),
        (r"(?:ab\w|cd)+x", {"ab", "cd"}),
        (r"ab?cd", {"acd", "abcd"}),
        (r"\w+eval", set()),
        (r"do\w+longer", set()),  # the longer literal tells more
        (r"(['\"])key\1", set()),
        (r"(?P<name>eval)", set()),
        (r"\beval\b{g}", set()),
        (r"eval\v", set()),
    ],
)
def test_leading(pattern, expected):
    assert literals.leading(pattern) == expected


def test_tested_where_they_stand(spark):
    """Rules whose literals a line holds only within other words, in another case or before other signs cost it no search."""
    found = literals.index([r"\beval\b", r"\bKISS\b", r"\bevaluate[,.]", r"\w+\.query"])
    lines = spark.createDataFrame([("medieval evaluated kiss a.query",), ("eval KISS evaluate, x.que",), (None,)], "code string")
    rows = lines.select(literals.met(F.col("code"), found).alias("met")).select(literals.numbers(F.col("met"), found.sure).alias("sure"), literals.numbers(F.col("met"), found.maybe).alias("maybe")).collect()
    assert [(sorted(r["sure"]), sorted(r["maybe"])) for r in rows[:2]] == [([], [3]), ([0, 1, 2], [0])]
    assert rows[2]["sure"] is None


def test_scan_as_rule_by_rule(spark):
    """Rules with literals in common, at edges of words and within them, of either case, with what looks back and ahead."""
    heads, bodies, tails = ["", r"\b", "(?i)", r"(?i)\b", "^", "(?<=x)", "(?<![.])"], ["is", "isk", "Kis", "ki(?:s|ss)t?", "sk[iy]", "is|ki", "[.]is", r"\]k", "(?:is)+"], ["", r"\b", "[,.]", r"\s*\(", "(?=x)", "$", "é"]
    patterns = [h + (f"(?:{b})" if "|" in b else b) + t for h in heads for b in bodies for t in tails]
    own = [rules.Rule(f"r{i}", "f", p, "any", "xss", endings=("py",) if i % 4 == 0 else ()) for i, p in enumerate(patterns)]
    words = ["is", "isk", "KIS", "kist", "skix", "ſKıſ", "Is,", "ki.", ".is", "]k", "isis", "xis", "éis", "isé", "is (", "kiss(", "_is", "1is", "sky", "🙂kis", "Kisk"]
    lines = [(f"{a}{i}.{'py' if i % 2 else 'js'}", i, a + s + b) for i, (a, s, b) in enumerate((a, s, b) for a in words for s in ("", " ") for b in words[::2])]
    given = spark.createDataFrame(lines, "file string, line int, code string")
    expected = given.select("*", *(F.rlike("code", F.lit(f"(?U){p}")).alias(f"r{i}") for i, p in enumerate(patterns))).collect()
    fits = {(r["file"], f"r{i}") for r in expected for i in range(len(patterns)) if r[f"r{i}"] and (i % 4 or r["file"].endswith(".py"))}
    rows = rules.matched(given, own).select("file", "rule_id").collect()
    assert len(rows) == len(fits) and {tuple(r) for r in rows} == fits
