"""Compaction of trees against whole JSON texts."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest

from tracewarden.functions import fixed
from tracewarden.operators import trees

COUNTED = (".png", ".zip")


def ext(name):
    return "." + name.rpartition(".")[2].lower() if "." in name[1:] else "<no_ext>"


def node(files, depth, policy):
    """The tree of files (lists of path parts) as it is shown under a policy."""
    most_depth, most_dirs, most_names = policy
    own, binary, dirs = [f[0] for f in files if len(f) == 1 and ext(f[0]) not in COUNTED], [f[0] for f in files if len(f) == 1 and ext(f[0]) in COUNTED], {}
    for f in files:
        if len(f) > 1:
            dirs.setdefault(f[0], []).append(f[1:])
    signal = lambda x: x.lower() in fixed.SIGNAL_FILES or x.lower().startswith("dockerfile") or x.lower().endswith(fixed.SIGNAL_SUFFIXES)
    order = lambda names: sorted(names, key=lambda x: (x.lower(), x))
    shown = [x for x in order(own) if signal(x)] + [x for x in order(own) if not signal(x)][:most_names]
    out = {}
    if shown:
        out["files"] = shown
    if len(own) > len(shown):
        out["_omitted_files"] = len(own) - len(shown)
        out["_file_ext_counts"] = dict(Counter(map(ext, order(own))).most_common(10))
    if binary:
        out["binary"] = {"total": len(binary), "by_ext": dict(Counter(map(ext, order(binary))))}
    count = lambda names: (sum(len(dirs[x]) for x in names), sum(len({tuple(f[:k]) for f in dirs[x] for k in range(1, len(f))}) + 1 for x in names))
    chosen = [] if depth >= most_depth else [x for x in order(dirs) if x.lower() in fixed.SIGNAL_DIRS] + [x for x in order(dirs) if x.lower() not in fixed.SIGNAL_DIRS][:most_dirs]
    if chosen:
        out["dirs"] = {x: node(dirs[x], depth + 1, policy) for x in chosen}
    if left := [x for x in dirs if x not in chosen]:
        lost, within = count(left)
        out["_omitted_dirs"] = within if depth >= most_depth else len(left)
        out["_omitted_descendant_files"] = lost
        if depth < most_depth:
            out["_omitted_descendant_dirs"] = within
    return out


@pytest.fixture(scope="module")
def files():
    rng = random.Random(6)
    names = ["a.py", "B.py", "b.py", "Dockerfile.x", "setup.py", "x.yml", "p.png", "q.PNG", "r.zip", "no", ".env", 'q"uo.te', "back\\slash.js", "ta\tb.c", "日本.md", "c.go", "d.rs", "e.rb", "f.kt", "g.ts", "h.cs", "i.lua"]
    folders = ["src", "Web", "lib", "x y", "z", "Ä", "k1", "k2"]
    return sorted({"/".join([*rng.choices(folders, k=rng.randrange(6)), rng.choice(names)]) for _ in range(900)})


def test_sizes(spark, files):
    policies = (trees.WHOLE, *fixed.TREE_POLICIES, *trees.FALLBACKS, (0, 0, 0), (9, 1, 0))
    df = spark.createDataFrame([(f,) for f in files], "file string").repartition(4)
    found = {r["policy"]: r["chars"] for r in trees.sizes(df, policies).collect()}
    for i, policy in enumerate(policies):
        assert found[i] == len(json.dumps(node([f.split("/") for f in files], 0, policy), ensure_ascii=False)), policy


def test_fitting(spark, files):
    df = spark.createDataFrame([(f,) for f in files], "file string")
    length = lambda p: len(json.dumps(node([f.split("/") for f in files], 0, p), ensure_ascii=False))
    assert trees.fitting(df, length(trees.WHOLE))[1] is None
    for budget in (length(trees.WHOLE) - 1, length((3, 8, 2)), length((2, 3, 0)), length((2, 3, 0)) - 1, 10):
        expected = next((p for p in (*fixed.TREE_POLICIES, *trees.FALLBACKS) if length(p) <= budget), trees.FALLBACKS[-1])
        assert trees.fitting(df, budget)[1] == expected


def test_empty_tree(spark):
    empty = spark.createDataFrame([], "file string")
    assert [(r["dirs"], r["chars"]) for r in trees.sizes(empty, ((7, 36, 28),)).collect()] == [(1, 2)]
    assert trees.fitting(empty)[1] is None


def test_query(spark, sf):
    from tracewarden.plans import QUERIES

    rows = QUERIES["tree_policy_sizes"](spark, sf("0.001")).collect()
    assert {r["policy"] for r in rows} == set(range(12)) and all(r["chars"] >= 2 for r in rows)
