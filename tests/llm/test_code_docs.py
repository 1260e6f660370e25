from __future__ import annotations

from cairn.llm import code_docs as D
from cairn.llm.code_text import language_of

GOOD = "Return the first entry of every sorted list."


def names(text, language="python"):
    return sorted({f[0] for f in D.functions_of(text, language) if f[5] is not None and D.says_something(D.describe(f[5]), f[0])})


def test_python():
    text = f'''
class K:
    """{GOOD}"""
    def bare(self): pass
    async def m(self, a: dict[str, int] = {{}}) -> "x":
        # a remark
        r"""{GOOD}"""
        def inner(x):
            "{GOOD}"
            print "old", x
    def quoted(self):
        x = """{GOOD}"""
    def joined(self):
        "{GOOD}".strip()
    def fmt(self):
        f"{GOOD}"
s = """
def in_string():
    '{GOOD}'
"""
# def in_comment():
#     "{GOOD}"
'''
    assert names(text) == ["inner", "m"]


def test_braces():
    text = f"""
/** {GOOD} */
public class C extends B {{
    /** {GOOD}
     * @param a the a
     */
    @Override
    // a line
    public Map<String, List<Long>> javaOne(int a) {{ return x; }}
    /** {GOOD} */
    /* other */
    void notRightBefore() {{}}
    /** {GOOD} */
    int field = call(3);
    String s = "/** {GOOD} */ void inString() {{}}";
}}
// /** {GOOD} */ void inComment() {{}}
"""
    assert names(text, "java") == ["javaOne"]
    assert names(f"/** {GOOD} */\nsuspend fun <T> List<T>.kotlinOne(x: Int): Map<String, Long> = run {{ }}", "kotlin") == ["kotlinOne"]
    ts = f"/** {GOOD} */\nexport const arrow = async (a: string[], b: Map<string, number>) => {{ }};\n/** {GOOD} */\nexport default async function named(x) {{ }}\nclass Q {{\n  /** {GOOD} */\n  async method(a: number): Promise<void> {{ }}\n  /** {GOOD} */\n  if (x) {{ }}\n}}"
    assert names(ts, "typescript") == ["arrow", "method", "named"]


def test_descriptions():
    d = D.describe
    assert d("Text here.\n\n:param x: y") == "Text here." and d("Args:\n    x: y") == "" and d("A {@link Foo} <b>bold</b> `c`\n@return x") == "A Foo bold c"
    assert d("Text.\n\nParameters\n----------\nx") == "Text."
    ok = D.says_something
    assert not ok("Open compact route.", "open_compact_route") and not ok("The open route of the open route.", "openRoute") and not ok("TODO: describe what this does later on", "f")
    assert not ok("Auto-generated method stub, fill in before the release.", "f") and not ok("See above.", "f") and ok("根据访问时间计算分数。", "f") and not ok("", "f") and ok(GOOD, "f")


def test_language_of():
    assert language_of("PYTHON", None) == "python" and language_of(None, "a/b.KT") == "kotlin" and language_of(None, None) == "" and language_of("x", "a.min.js") == "javascript"


def test_declarations_join_definitions(spark):
    rows = [
        (1, "r", "java", "A.java", f"interface Store {{\n  /** {GOOD} */\n  long load(int a, String b);\n  /** Tells how many lists there still are. */\n  long load(int a);\n}}"),
        (2, "r", "java", "B.java", "class Disk implements Store {\n  /** */\n  public long load(int x, String y) { return 1; }\n}"),
        (3, "q", "java", "B.java", "class Disk implements Store {\n  /** */\n  public long load(int x, String y) { return 1; }\n}"),
        (4, "r", "python", "a.py", None), (5, "r", "python", "a.py", ""),
    ]
    df = spark.createDataFrame(rows, "detail_id long, repo string, language string, file_path string, content string")
    assert sorted(map(tuple, D.found(df).collect())) == [(1, "load")]
    bare = df.where("detail_id <> 2").unionByName(spark.createDataFrame([(2, "r", "python", "b.py", "class Disk(Base):\n    def load(self, a):\n        return 1\n"), (6, "r", "python", "b.pyi", f'class Base:\n    def load(self, a):\n        """{GOOD}"""\n        ...\n')], df.schema))
    got = {(r.detail_id, r.func_name): r.doc_from for r in D.pairs(bare).collect()}
    assert got == {(1, "load"): 1, (6, "load"): 6, (2, "load"): 6}


def test_empty(spark):
    assert D.found(spark.createDataFrame([], "detail_id long, repo string, language string, file_path string, content string, owner string")).count() == 0


def test_long_text():
    text = "x = 1\n" * 100_000 + f'def last():\n    """{GOOD}"""\n'
    assert names(text) == ["last"]


def test_overloads_and_classes_stay_apart(spark):
    java = f"class A {{\n  /** {GOOD} */\n  int f(int a) {{ return 1; }}\n  /** Tells how many lists there still are. */\n  int f(String b) {{ if (b) {{ }} return 2; }}\n}}"
    python = f'class A:\n    def f(self):\n        """{GOOD}"""\n        return 1\n\nclass B:\n    def f(self):\n        """{GOOD}"""\n        x = """\nno end\n"""\n        return x\n'
    df = spark.createDataFrame([(1, "r", "java", "A.java", java), (2, "r", "python", "a.py", python), (2, "r", "python", "a.py", python)], "detail_id long, repo string, language string, file_path string, content string")
    code = {1: java, 2: python}
    got = sorted((r.detail_id, r.owner, r.signature, code[r.detail_id][r.code_start : r.code_end]) for r in D.pairs(df).collect())
    first = f'def f(self):\n        """{GOOD}"""\n        '
    assert got == [(1, "A", "1(String)", "int f(String b) { if (b) { } return 2; }"), (1, "A", "1(int)", "int f(int a) { return 1; }"), (2, "A", "0()", first + "return 1"), (2, "B", "0()", first + 'x = """\nno end\n"""\n        return x')]
    assert sorted(map(tuple, D.found(df).collect())) == [(1, "f"), (2, "f")]


def test_undocumented_definitions_of_brace_languages(spark):
    rows = [
        (1, "r", "java", "Store.java", f"public interface Store {{\n  /** {GOOD} */\n  long load(int a, String b);\n}}"), (2, "r", "java", "Disk.java", "class Disk extends Base implements Store {\n  @Override\n  public long load(int x, String y) {\n    if (x > 1) { call(x); }\n    return 1;\n  }\n  long load(int x) { return 2; }\n}"),
        (3, "r", "kotlin", "Store.kt", f"interface Shelf {{\n  /** {GOOD} */\n  fun load(a: Int): Long\n  fun other(b: Int = 2): Long\n}}"), (4, "r", "kotlin", "Disk.kt", "class Disk : Shelf {\n  override fun load(x: Int): Long = 1\n}"),
        (5, "r", "typescript", "s.ts", f"export interface Rack {{\n  /** {GOOD} */\n  load(a: number): Promise<void>;\n}}"), (6, "r", "typescript", "d.ts", "export class Disk implements Rack {\n  async load(b: number): Promise<void> {\n  }\n}"),
        (7, "r", "c", "s.h", f"/** {GOOD} */\nint load(const char *path, int n);\n"), (8, "r", "c", "s.c", '#include "s.h"\nint load(const char *p, int k)\n{\n  return k;\n}\nint main(void) {\n  return load("x", 1);\n}\n'), (9, "q", "c", "s.c", "int load(const char *p, int k) { return k; }"),
    ]
    df = spark.createDataFrame(rows, "detail_id long, repo string, language string, file_path string, content string")
    got = {(r.detail_id, r.owner, r.func_name, r.doc_from) for r in D.pairs(df).collect()}
    assert got == {(1, "Store", "load", 1), (2, "Disk", "load", 1), (3, "Shelf", "load", 3), (4, "Disk", "load", 3), (5, "Rack", "load", 5), (6, "Disk", "load", 5), (7, "", "load", 7), (8, "", "load", 7)}
    assert sorted(r.detail_id for r in D.found(df).collect()) == [1, 3, 5, 7]


def test_long_heads_hide_no_body():
    thrown = ", ".join(f"com.example.very.long.package.Failure{k}" for k in range(60))
    text = f"class A {{\n    /** Copies every given row into the target table. */\n    public void copy(int a)\n        throws {thrown} {{\n        run(a);\n    }}\n}}\n"
    got = [(x[0], x[4]) for x in D.functions_of(text, "java")]
    assert len(thrown) > 400 and got == [("copy", True)]
    kind = "Map<String, " * 60 + "Long" + ">" * 60
    text = f"/** Gives the table of all rows by their name. */\nfun table(a: Int): {kind} {{\n    return x\n}}\n"
    assert [(x[0], x[4]) for x in D.functions_of(text, "kotlin")] == [("table", True)]


def test_join_against_brute_force(spark):
    """Headers and definitions in several rows, with overloads, supertypes and repositories that don't mix."""
    import itertools
    import random

    rng, rows, want = random.Random(2), [], set()
    doc = "/** Counts every open row of the given table {0} once more. */"
    i = itertools.count(1)
    for repo in ("a/x", "b/y"):
        for k in range(12):
            kinds = rng.sample(["int", "String", "long"], rng.randint(1, 2))
            params = ", ".join(f"{t} p{n}" for n, t in enumerate(kinds))
            told, held = next(i), next(i)
            rows.append((told, repo, "java", f"src/I{k}.java", f"public interface I{k} {{\n    {doc.format(k)}\n    int work(int a, {params});\n    int bare(int a);\n}}\n"))
            other = rng.random() < 0.4  # another signature: no overload of the documented one
            rows.append((held, repo, "java", f"src/C{k}.java", f"public class C{k} implements I{k} {{\n    public int work(int a, {params}{', int z' if other else ''}) {{\n        return a;\n    }}\n    public int bare(int a) {{\n        return a;\n    }}\n}}\n"))
            want.add((told, "work", told))
            if not other:
                want.add((held, "work", told))
    df = spark.createDataFrame(rows, "detail_id long, repo string, language string, file_path string, content string")
    got = {(r.detail_id, r.func_name, r.doc_from) for r in D.pairs(df).collect()}
    assert got == want and len(want) > 26
    assert {tuple(r) for r in D.found(df).collect()} == {(a, n) for a, n, b in want if a == b}


def test_python_functions_of_the_tables_against_a_parser(spark):
    """Every Python content of the given table that parses: the same documented functions as a syntax tree holds."""
    import ast

    rows = spark.read.parquet("/root/testdata/sf0.01/details.parquet").where("content is not null").select("detail_id", "language", "file_path", "content").collect()
    seen = 0
    for r in rows:
        if language_of(r.language, r.file_path) != "python":
            continue
        try:
            tree = ast.parse(r.content)
        except (SyntaxError, ValueError):
            continue
        kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
        documented = {n.name for n in ast.walk(tree) if isinstance(n, kinds) and (d := ast.get_docstring(n, clean=False)) and D.says_something(D.describe(d), n.name)}
        assert {f[0] for f in D.functions_of(r.content, "python") if f[5] is not None and D.says_something(D.describe(f[5]), f[0])} == documented, r.detail_id
        assert {f[0] for f in D.functions_of(r.content, "python")} == {n.name for n in ast.walk(tree) if isinstance(n, kinds)}, r.detail_id
        seen += 1
    assert seen > 300
