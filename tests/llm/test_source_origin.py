from __future__ import annotations

import datetime as dt

from cairn.llm import source_origin as O

HAND = "def load(path, limit):\n    rows = []\n    for x in open(path):\n        rows.append(x.strip())\n    return rows[:limit]\n" * 3
DENSE = "(()=>{const rl=(m,e)=>{if(!m.windowLens)return void 0;let u=e.switchBucket(m.mirbaTunnel,1);return u};" * 6
BLOB = "table = [" + ", ".join(f"0x{k * 2654435761 % 2**32:08x}" for k in range(200)) + "]"


def classes(spark, rows):
    df = spark.createDataFrame(rows, "repo string, file_path string, content string")
    return {(r.repo, r.file_path): r.file_class for r in O.found(df).collect()}


def test_classes(spark):
    rows = [
        ("a/one", "src/hand.py", HAND), ("a/one", "src/generated_names.py", HAND.replace("rows", "vendored")), ("a/one", "generators/g.py", HAND.replace("rows", "g")), ("a/one", "x/notice.py", "# Code generated by tool 1.2. DO NOT EDIT.\n" + HAND),
        ("a/one", "x/block.ts", "/*\n * This file was produced by tool; manual changes will be lost.\n */\n" + HAND), ("a/one", "x/speaks.py", 'def f():\n    header = "Code generated by me"\n' + HAND), ("a/one", "x/stub.java", "/** Auto-generated method stub, fill in. */\n" + HAND),
        ("a/one", "x/y.gen.ts", HAND), ("a/one", "x/m_pb2.py", HAND), ("a/one", "generated/z.py", HAND), ("a/one", "x/q.min.js", DENSE), ("a/one", "x/dense.js", DENSE), ("a/one", "x/blob.py", BLOB), ("a/one", "third_party/two.io/f.py", HAND + "# v"),
        ("a/one", "lib/n.py", "# vendored: three 1.13 (see upstream)\n" + HAND), ("a/one", "lib/one/own.py", HAND + "# own"), ("b/two.io", "src/f.py", HAND + "# v"), (None, "x.py", DENSE), ("a/one", None, DENSE), ("a/one", "e.py", None),
    ]
    assert classes(spark, rows) == {
        ("a/one", "x/notice.py"): "generated", ("a/one", "x/block.ts"): "generated", ("a/one", "x/y.gen.ts"): "generated", ("a/one", "x/m_pb2.py"): "generated", ("a/one", "generated/z.py"): "generated", ("a/one", "x/q.min.js"): "minified",
        ("a/one", "x/dense.js"): "minified", ("a/one", "x/blob.py"): "data_blob", ("a/one", "third_party/two.io/f.py"): "vendored", ("a/one", "lib/n.py"): "vendored",
    }
    assert classes(spark, []) == {}


def test_merkle_hash_is_of_content_not_names(spark):
    rows = [("a/r", "p/x/1.py", HAND), ("a/r", "p/x/2.py", HAND + "#2"), ("b/s", "q/deep/y/8.py", HAND), ("b/s", "q/deep/y/9.py", HAND + "#2"), ("b/s", "q/deep/z/9.py", HAND + "#3")]
    files = O.file_facts(spark.createDataFrame(rows, "repo string, file_path string, content string"))
    h = {(r.repo, r.path): r.hash for r in O.merkle(files).collect()}
    assert ("a/r", "") in h and ("b/s", "q/deep") in h
    depth = {p: p.count("/") for _, p in h}
    assert h["a/r", "p/x"] != h["b/s", "q/deep/z"] and depth


def test_shared_copy_of_a_named_origin(spark):
    rows = [("a/lib.io", "src/k.py", HAND), ("b/x", "deps/lib.io/k.py", HAND + "  \n"), ("c/y", "core/k.py", HAND), ("d/z", "core/part.py", HAND.split("\n\n")[0][:60])]
    got = classes(spark, rows)
    assert got == {("b/x", "deps/lib.io/k.py"): "vendored", ("c/y", "core/k.py"): "vendored"}


def test_long_content(spark):
    assert classes(spark, [("a/b", "x.py", "data = '" + "A" * 2_000_000 + "'")]) == {("a/b", "x.py"): "data_blob"}


def test_equal_subtrees_at_other_depths_have_equal_hashes(spark):
    rows = [("a/r", "p/x/1.py", HAND), ("a/r", "p/x/2.py", HAND + "#2"), ("b/s", "q/deep/y/8.py", HAND), ("b/s", "q/deep/y/9.py", HAND + "#2")]
    h = {(r.repo, r.path): r.hash for r in O.merkle(O.file_facts(spark.createDataFrame(rows, "repo string, file_path string, content string"))).collect()}
    assert h["a/r", "p/x"] == h["b/s", "q/deep/y"] != h["a/r", "p"]


def test_shared_directory_marks_the_short_files_below_it(spark):
    tree = [(f"s{k}.py", f"def short_{k}(a):\n    return a + {k}\n") for k in range(4)] + [("in/deep.py", "LIMIT = 3\n"), ("in/__init__.py", "")]
    rows = [(repo, f"{at}/{p}", text) for repo, at in (("a/lib.io", "src"), ("b/x", "deps/lib.io/src"), ("c/y", "core/own/tree")) for p, text in tree]
    rows += [("d/z", "alone/s0.py", tree[0][1]), ("d/z", "alone/t.py", HAND)]
    df = spark.createDataFrame(rows, "repo string, file_path string, content string")
    assert classes(spark, rows) == {(repo, f"{at}/{p}"): "vendored" for repo, at in (("b/x", "deps/lib.io/src"), ("c/y", "core/own/tree")) for p, _ in tree}
    got = {(r.repo, r.file_path): r.shared_repos for r in O.classify(df).collect()}
    assert {got["a/lib.io", "src/s0.py"], got["c/y", "core/own/tree/in/deep.py"]} == {3} and got["d/z", "alone/s0.py"] == 1
    # a notice in one file speaks for its directory where the repository it names holds it
    told = [(repo, f"{at}/{p}", ("# vendored from lib.io\n" if at == "core" and p == "s0.py" else "") + text) for repo, at in (("a/lib.io", "src"), ("c/y", "core")) for p, text in tree]
    assert classes(spark, told) == {("c/y", f"core/{p}"): "vendored" for p, _ in tree}
    other = [(r.replace("lib.io", "two"), p, t) for r, p, t in told]
    kin = [(r.replace("a/two", "c/two"), p, t) for r, p, t in other]  # of one owner: only what the notice says
    assert classes(spark, [*kin, ("e/lib.io", "m.py", HAND)]) == {("c/y", "core/s0.py"): "vendored"}


TREE = [(f"s{k}.py", f"def short_{k}(a):\n    return a + {k}\n") for k in range(6)] + [("in/deep.py", "LIMIT = 3\n")]


def test_a_shared_subtree_is_found_by_its_hash_alone(spark, monkeypatch):
    """No notice, no telling directory: unrelated repositories hold the same directory, and the first keeps it."""
    schema = "repo string, file_path string, content string, indexed_at timestamp"
    day = lambda k: dt.datetime(2024, 1, k)
    rows = [(repo, f"{at}/{p}", text, day(d)) for repo, at, d in (("z/first", "src", 1), ("b/x", "core/own/tree", 2), ("c/y", "misc", 3)) for p, text in TREE]
    rows += [("z/other", f"kept/{p}", text, day(4)) for p, text in TREE]  # the origin's owner
    rows += [("b/x", "core/hand.py", HAND, day(1)), ("q/w", "one.py", HAND + "# same\n", day(1)), ("r/v", "two.py", HAND + "# same\n", day(2))]  # one function alone
    df = spark.createDataFrame(rows, schema)
    got = {(r.repo, r.file_path): (r.file_class, r.sign) for r in O.classify(df).collect() if r.file_class}
    assert got == {(repo, f"{at}/{p}"): ("vendored", "subtree") for repo, at in (("b/x", "core/own/tree"), ("c/y", "misc")) for p, _ in TREE}
    real = O.merkle
    monkeypatch.setattr(O, "merkle", lambda files: real(files).where("false"))
    assert O.found(df).count() == 0


def test_generated_twins_tell_no_origin(spark):
    made = [(repo, f"{at}/{p}", ("# Code generated by tool. DO NOT EDIT.\n" if made else "") + t) for repo, at, made in (("a/gen", "src", True), ("b/x", "lib", False)) for p, t in (("a.py", HAND), ("b.py", HAND + "b = 1\n"))]
    assert classes(spark, made) == {("a/gen", "src/a.py"): "generated", ("a/gen", "src/b.py"): "generated"}


def test_notices_stand_anywhere_in_the_head(spark):
    far = "# Copyright 2020 The X Authors.\n" + "# licence text\n" * 300
    rows = [
        ("a/r", "one.go", "// Copyright 2020 The X Authors.\n// Code generated by protoc-gen-go. DO NOT EDIT.\n" + HAND), ("a/r", "two.ts", "/*\n * Copyright X\n * @generated\n */\n" + HAND), ("a/r", "three.py", '"""Generated by tool 3.1. Do not edit."""\n' + HAND),
        ("a/r", "four.py", far + "# This file was generated by mkdata.\n" + HAND), ("a/r", "five.py", far + "# vendored from upstreamlib 2.1\n" + HAND), ("a/r", "six.py", far + "# Reads files generated by protoc and lists them.\n" + HAND), ("a/r", "seven.py", far + HAND + "# This file was generated by mkdata.\n"),
    ]
    assert classes(spark, rows) == {("a/r", p): "generated" for p in ("one.go", "two.ts", "three.py", "four.py")} | {("a/r", "five.py"): "vendored"}
