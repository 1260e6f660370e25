from __future__ import annotations

from cairn.operators import catalog as C
from cairn.operators import chunking as H
from cairn.sources import files as SF
from cairn.sources import tables as ST
from pyspark.sql import functions as F


def test_dedup_is_first_wins_and_idempotent(spark):
    df = spark.createDataFrame([(3, "a" * 200 + "x"), (1, "a" * 200 + "y"), (2, None), (4, ""), (5, "b")], "i long, c string")
    once = C.first_by_prefix(df, "c", "i")
    assert sorted(r.i for r in once.collect()) == [1, 2, 5]
    assert C.first_by_prefix(once, "c", "i").count() == 3
    assert C.first_by_prefix(df.where("false"), "c", "i").count() == 0


def test_unseen(spark):
    new = spark.createDataFrame([("x",), ("y",), ("y",)], "content string")
    stored = new.where("content = 'x'").select(F.upper(C.short_hash(F.col("content"))).alias("hash"))
    assert [r.content for r in C.unseen(new, stored).collect()] == ["y", "y"]


def test_rollups(spark):
    d = spark.createDataFrame([(k, "o/r", "python", "f.py", f"n{k}", "function") for k in range(25)] + [(99, None, "java", "g", "x", "class")], "detail_id long, repo string, language string, file_path string, name string, type string")
    r = C.file_rollup(d, "detail_id").collect()
    assert len(r) == 1 and r[0].summary.split("\n")[1] == "  function: n0" and len(r[0].summary.split("\n")) == 21
    assert C.repo_rollup(d).first().summary == "Repository: o/r\nLanguages: python\nFiles: 1\nChunks: 25"


def test_ordinals(spark):
    d = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    assert all(r.k == r.ordinal for r in C.ordinals(d, "k").collect())


def test_stats_of_nulls(spark):
    c = spark.createDataFrame([(1, None, None), (3, "py", "abcdefgh"), (3, "", "xy")], "level int, language string, content string")
    got = {(r.kind, r.key): (r.chunks, r.chars, r.est_tokens) for r in C.chunk_stats(c).collect()}
    assert got == {("total", None): (3, 10, 2), ("level", "1"): (1, 0, 0), ("level", "3"): (2, 10, 2), ("language", "py"): (1, 8, 2)}


def test_python_extraction():
    src = "@d\ndef f(a):\n    def inner(x, y, z, w):\n        return x + y + z + w\n    return inner\n\nclass K:\n    async def m(self):\n        return 'long enough body here'\n"
    got = [(k, n) for k, n, *_ in H.python_items(src)]
    assert got == [("function", "f"), ("class", "K"), ("function", "inner"), ("function", "m")]
    assert H.python_items("def broken(:") == [] and H.python_items("\0") == []
    exactly = "def g(): return 'abcdefghijkl'"
    assert len(exactly) == 30 and H.python_items(exactly) == [] and len(H.python_items(exactly.replace("l'", "lm'"))) == 1


def test_pattern_extraction():
    js = "function add(a, b) { return a + b + 1000; }\nconst mul = function (a, b) { return a * b; }"
    assert [x[1] for x in H.pattern_items(js, ".js", H.PATTERNS_V1)][:1] == ["add"]
    kt = "suspend fun load(id: Int): String { return repo.get(id) }\nclass StoreOfManyThingsAndMore"
    assert [x[1] for x in H.pattern_items(kt, ".kt", H.PATTERNS_V2)] == ["load", "StoreOfManyThingsAndMore"]
    big = "function f(a) { return a + 1; }\n" * 20000
    assert len(H.pattern_items(big, ".js", H.PATTERNS_V1)) == 20000


def test_paths(spark):
    p = ["a/b.py", "x.JAVA", ".git/c.py", "node_modules/d.js", "src/my_test.ts", "test_x.py", "README", "q/.h/x.c"]
    df = spark.createDataFrame([(x,) for x in p], "p string")
    c = F.col("p")
    got = {r.p: (r.l, r.m, r.w, r.n) for r in df.select("p", H.language(c).alias("l"), H.module(c).alias("m"), H.walked(c).alias("w"), H.wanted_name(c).alias("n")).collect()}
    assert got["a/b.py"] == ("python", "a", True, True) and got["x.JAVA"] == ("java", "", True, True) and not got[".git/c.py"][2] and not got["node_modules/d.js"][2]
    assert not got["src/my_test.ts"][3] and got["test_x.py"][3] and got["README"][0] is None and not got["q/.h/x.c"][2]


def test_tree_and_collections(spark, tmp_path):
    root = tmp_path / "o__r"
    for name, text in {"README.md": b"hello \xff there", "src/a.py": b'"""Doc."""\ndef function_one(a, b):\n    return a + b\n', "src/bad.py": b"def (", "tests/t.py": b"x = 1", "node_modules/z.js": b"function zz() { return 12345678901; }", ".hid/h.py": b"y = 1"}.items():
        f = root / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text)
    files = SF.scan(spark, str(root))
    assert sorted(r.path for r in files.collect()) == ["README.md", "src/a.py", "src/bad.py", "tests/t.py"]
    assert SF.readme(files).first().readme == "hello  there"
    chunks = H.chunk_tree(files, "o/r")
    levels = {(r.level, r.name) for r in chunks.collect()}
    assert (1, "o/r") in levels and (2, "r/src") in levels and (3, "src/a.py") in levels and (4, "function_one") in levels and not any(n == "r/tests" for _, n in levels)
    at = str(tmp_path / "store")
    assert {r.collection: r.n for r in ST.validate(spark, at).collect()} == {"summary": 0, "chunks": 0, "details": 0}
    ST.write_collections(chunks, at)
    assert {r.collection: r.n for r in ST.validate(spark, at).collect()} == {"summary": 2, "chunks": 3, "details": 1}
    assert ST.read_collection(spark, at, "details", language="python").count() == 1
    assert SF.catalogue(spark.createDataFrame([("o/r",), ("p/q",), ("z/y",)], "repo string"), spark.createDataFrame([("o__r",), ("q",)], "directory string")).orderBy("repo").collect()[1].directory == "q"


def test_records_round_trip(spark, tmp_path):
    rec = spark.createDataFrame([("a", 1.5, 1, 0, 1, 0.5), ("b", 2.5, 3, 2, 3, 0.0)], "doc_id string, last_access_time double, access_count int, correct_count int, total_use_count int, created_time double")
    ST.write_records(rec, str(tmp_path / "r"))
    assert sorted(map(tuple, ST.read_records(spark, str(tmp_path / "r")).collect())) == sorted(map(tuple, rec.collect()))
    (tmp_path / "one.json").write_text('{"x": {"last_access_time": 3.0}}')
    assert tuple(ST.read_records(spark, str(tmp_path / "one.json")).first()) == ("x", 3.0, 0, 0, 0, 0.0)


def test_snapshots_lines_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc')], "i long, t string")
    for run in ("2024-01-01", "2024-01-03", "2024-01-02"):
        ST.write_snapshot(df.withColumn("v", F.lit(run)), str(tmp_path / "s"), run)
    assert [r.v for r in ST.latest_snapshot(spark, str(tmp_path / "s")).collect()] == ["2024-01-03"]
    ST.write_csv(df, str(tmp_path / "c"))
    assert tuple(ST.read_csv(spark, str(tmp_path / "c"), "i long, t string").first()) == (1, 'a "q", b\nc')
    ST.write_lines(df, str(tmp_path / "l"))
    ST.write_lines(df, str(tmp_path / "l"), resume=True)
    assert ST.read_lines(spark, str(tmp_path / "l"), "i long, t string").count() == 2


def test_files_over_the_limit_are_rows_without_text(spark, tmp_path):
    from cairn.sources import files as S

    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "big.py").write_text("y" * 5000)
    got = {r.path: (r.length, r.text) for r in S.scan(spark, str(tmp_path), longest=1000).collect()}
    assert got == {"a.py": (6, "x = 1\n"), "big.py": (5000, None)}


def test_patterns_over_whole_texts():
    from cairn.operators import chunking as H

    long = "int total(int a) {\n" + "  a = a + 1;\n" * 18_000 + "/* at the margin\nint not a function\n*/ return a; }\n"
    got = H.pattern_items(long, ".c", H.PATTERNS_V1)
    assert len(long) > 200_000 and [(x[1], x[3]) for x in got] == [("match_0", 1)] and got[0][2].endswith("return a; }")
    words = "word " * 60_000 + "int f(int a) { return a + a + a; }"
    assert [x[2][-34:] for x in H.pattern_items(words, ".c", H.PATTERNS_V1)] == ["int f(int a) { return a + a + a; }"]
    assert H.pattern_items("x" * 300_000, ".cpp", H.PATTERNS_V1) == []


def test_second_version_has_no_javascript(spark):
    from cairn.operators import chunking as H

    code = "function work(a) { return a + a + a + a; }"
    df = spark.createDataFrame([(1, "a.js", code), (2, "a.ts", code)], "id long, path string, text string")
    ids = lambda v: {r.file_id for r in H.extract(df, "id", "path", "text", version=v).collect()}
    assert ids(1) == {1, 2} and ids(2) == {2}


def test_incremental_store(spark, tmp_path):
    from cairn.sources import tables as T

    rows = [(k, f"o/r{k % 2}", "python", f"src/f{k % 3}.py", f"n{k}", "function", f"def n{k}(): return {k}") for k in range(8)]
    df = spark.createDataFrame(rows, "detail_id long, repo string, language string, file_path string, name string, type string, content string")
    at = str(tmp_path / "store")
    count = lambda part: {r.collection: r.n for r in T.append_expansion(spark, at, part, "detail_id").collect()}
    assert count(df.where("detail_id < 5")) == {"details": 5, "chunks": 5, "summary": 2}
    assert count(df.where("detail_id < 5")) == {"details": 5, "chunks": 5, "summary": 2}  # nothing new
    assert count(df)["details"] == 8


def test_tasks_and_stated_caps(spark, tmp_path):
    import json

    from cairn.sources import tables as T

    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps({"task_id": f"T/{k}", "prompt": "p", "entry_point": None}) for k in (3, 1, 2)))
    tasks = T.read_tasks(spark, str(tmp_path / "t.jsonl"))
    assert [r.task_id for r in tasks.collect()] == ["T/1", "T/2", "T/3"] and T.capped(tasks, 2).count() == 2
