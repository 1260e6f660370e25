from __future__ import annotations

import numpy as np

from cairn.functions import chat as C
from cairn.functions import pycode as P
from cairn.functions import textcode as T
from cairn.operators import evaluate as E
from pyspark.sql import functions as F

FENCE = "Text\n```python\ndef f(a):\n    return a\n```\nmore"


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first().x


def test_code_extraction(spark):
    assert one(spark, FENCE, T.fenced) == "def f(a):\n    return a\n"
    assert one(spark, "```\nx\n```", T.fenced) == "x\n"
    assert one(spark, "a\ndef g():\n  pass", T.code_block) == "def g():\n  pass"
    assert one(spark, "plain", T.code_block) == "plain"
    assert one(spark, None, T.fenced) is None


def test_detectors(spark):
    assert one(spark, "import numpy\nfrom NUMPY import x", T.banned_found) == ["numpy", "numpy"]
    assert one(spark, "std::sort(v)", T.language_error) and not one(spark, "x = 1", T.language_error)
    assert one(spark, "x" * 60 + " therefore ", T.truncated) and one(spark, "x" * 60 + "..", T.truncated) and one(spark, "short", T.truncated)
    assert one(spark, "Sure, here", T.template_response) and not one(spark, "no\nSure", T.template_response)
    assert one(spark, "def f(): return 1 # TODO", T.complete) is False
    assert one(spark, "Step 1: think\nStep 3: code", T.reasoning_part) == "Step 1: think"
    assert one(spark, "before ```x```", T.reasoning_part) == "before" and one(spark, "none", T.reasoning_part) == ""
    assert one(spark, FENCE + "\nStep 4: check", T.response_part).endswith("```\n\nStep 4: check")


def test_quality(spark):
    q = spark.createDataFrame([(FENCE,), ("def f(:",), ("console.log(1)",)], "t string").select(T.quality(F.col("t"), P.syntax_ok(T.fenced(F.col("t")))).alias("q"))
    got = [(r.q["pass"], r.reason) for r in q.select("q", T.failure_reasons(F.col("q")).alias("reason")).collect()]
    assert got[0][0] and not got[1][0] and "syntax_ok" in got[1][1] and "language_ok" in got[2][1]


def test_completions():
    prompt = "def f(a):\n    '''Doc.'''\n    # note"
    assert P.completion_code("```python\ndef f(a):\n    return a\n\nprint(f(1))\n```", prompt) == "def f(a):\n    return a"
    assert P.completion_code("```python\ndef f(a):\n    return 1", prompt).startswith("def f(a):")
    assert P.completion_code(prompt + "\n    return a", prompt) == "def f(a):\n    return a"
    assert P.trim_tail("x = 1\n# end\n") == "x = 1"
    assert P.without_prompt("p " * 40 + "rest", "p  " * 40) == "rest" and P.without_prompt("abc", "abd") == "abc"
    assert P.parses("x = 1") and not P.parses("x =") and not P.parses(None)


def test_run_tests_is_off_by_default(spark):
    df = spark.createDataFrame([("print(1)", [("", "1")])], "code string, tests array<struct<input:string,expected:string>>")
    assert P.run_tests(df, "code", "tests").first().exec_pass is None
    assert P.run_tests(df, "code", "tests", allow=True).first().exec_pass == 1.0


def test_scores(spark):
    df = spark.createDataFrame([("DEF x\ndef f():\n# c\n", ["def", "zzz"]), ("", [])], "a string, k array<string>")
    r = df.select(T.heuristic_score(F.col("a"), F.col("k")).alias("h"), T.pass_at_1(F.col("a"), F.lit(True), F.lit(None).cast("double")).alias("p")).collect()
    assert (r[0].h.score, r[0].h.keyword_matches, r[0].p) == (0.7, 1, 1.0) and (r[1].h.score, r[1].p) == (0.0, 0.0)


def test_prompts(spark):
    df = spark.createDataFrame([("p", None, "rag"), ("p", "c", "no-rag"), ("p", "c", "rag"), ("p", "c", "rag-forgetting")], "p string, c string, m string")
    got = [r.x for r in df.select(T.rag_prompt(F.col("p"), F.col("c"), F.col("m")).alias("x")).collect()]
    assert got[0] == got[1] == "p" and got[2].startswith(T.RAG_PREFIX + "c\n\n") and got[3].startswith(T.FORGETTING_PREFIX)


MERGED = "rec_id long, source_text string, target_text string, messages array<struct<role:string,content:string>>, conversations string, instruction string, input string, output string, context string, response string"


def test_chat_shapes(spark):
    n = None
    rows = [
        (1, "q", "a", n, n, n, n, n, n, n), (2, n, n, [("user", "u")], n, n, n, n, n, n), (3, n, n, n, '[{"from":"human","value":"h"},{"from":"bot","value":"x"},{"from":"gpt","value":"g"}]', n, n, n, n, n),
        (4, n, n, n, n, "i", "", "o", n, n), (5, n, n, n, n, "i", "in", "o", n, n), (6, n, n, n, n, "i", n, n, "c", "r"), (7, n, n, n, n, n, n, n, n, n), (8, "q", n, n, n, n, n, n, n, n),
    ]
    got = {r.rec_id: r.m and [tuple(x) for x in r.m] for r in spark.createDataFrame(rows, MERGED).select("rec_id", C.messages().alias("m")).collect()}
    assert got[3] == [("user", "h"), ("user", "x"), ("assistant", "g")] and got[4][0] == ("user", "i") and got[5][0] == ("user", "i\nin") and got[6] == [("user", "i\nc"), ("assistant", "r")] and got[7] is None and got[8][1] == ("assistant", None)


def test_loss_mask(spark):
    assert C.mask([1, 2, 5, 6, 1, 3, 7], [1, 2], [1]) == [-100, -100, 5, 6, -100, -100, -100]
    assert C.mask([9], [1, 2], [1]) == [-100] and C.mask([1, 2], [1, 2], [1]) == [-100, -100]
    df = spark.createDataFrame([([1, 2, 5],), (None,), ([],)], "ids array<int>")
    r = C.loss_mask(df, "ids", [1, 2], [1]).collect()
    assert r[0].labels == [-100, -100, 5] and r[1].labels is None and list(r[2].labels) == [] and r[0].attention_mask == [1, 1, 1]


def test_evaluation(spark):
    p = spark.createDataFrame([("a", "x\n"), ("b", None)], "task_id string, prompt string")
    g = spark.createDataFrame([("a", "s2"), ("a", "s1")], "task_id string, solution string")
    assert sorted(map(tuple, E.back_fill(p, g).collect())) == [("a", "s1", False), ("b", "    pass\n", True)]
    st = spark.createDataFrame([("m", "pass", "fail"), ("m", "fail", "pass"), ("m", "pass", "pass")], "model string, base_status string, plus_status string")
    assert tuple(E.pass_counts(st, ["model"]).first()) == ("m", 3, 2, 1, 66.7, 33.3)
    ev = spark.createDataFrame([({"t": [("pass", "fail"), ("fail", "fail")], "u": []},)], "eval map<string,array<struct<base_status:string,plus_status:string>>>")
    assert [tuple(r) for r in E.eval_rows(ev).collect()] == [("t", "pass", "fail")]
    runs = spark.createDataFrame([("m", "d", "no-rag", 50.0, 40.0), ("m", "d", "rag", 45.0, 44.0)], "model string, dataset string, mode string, base_pct double, plus_pct double")
    got = {r.metric: (r.gap, r.recovery) for r in E.contamination(runs).collect()}
    assert got == {"base_pct": (5.0, None), "plus_pct": (-4.0, None)}
    assert E.reasons(spark.createDataFrame([("a; b",), ("a",), ("",)], "r string"), "r").collect()[0].n == 2
    assert E.summary(spark.createDataFrame([], "experiment string, pass_at_1 double, latency double, vram double, forgotten int, old_ratio double")).count() == 0


def test_fit(spark):
    pts = [(0.725, 0.794), (0.905, 0.765), (0.533, 0.765)]
    f = E.quadratic_fit(spark.createDataFrame(pts, "x double, y double"), "x", "y").first()
    assert np.allclose([f.a, f.b, f.c], [-0.839120, 1.206655, 0.360238], atol=1e-5)
    assert E.quadratic_fit(spark.createDataFrame([(1.0, 1.0)], "x double, y double"), "x", "y").first().a is None
    assert E.curve(E.quadratic_fit(spark.createDataFrame(pts, "x double, y double"), "x", "y"), 0.0, 1.0).count() == 100


def test_jaccard(spark):
    df = spark.createDataFrame([("a b", "b c"), ("", ""), ("a", None)], "a string, b string").select(E.jaccard(F.col("a"), F.col("b")).alias("j"))
    assert [r.j and round(r.j, 4) for r in df.collect()] == [0.3333, 1.0, None]


def test_generation_asks_again_without_code(spark):
    asked = []

    def make():
        return lambda prompts: ["def f(): pass" if p.startswith("Only code") or "easy" in p else "I think so." for p in prompts]

    df = spark.createDataFrame([("easy one",), ("hard one",), (None,)], "p string").coalesce(1)
    got = [r.completion for r in P.generate(df.na.fill(""), "p", make, simpler="Only code: ").collect()]
    assert got == ["def f(): pass"] * 3 and asked == []


def test_report_and_choices(spark):
    runs = spark.createDataFrame([(0, "b", "rag"), (1, "a", "no-rag"), (2, "c", "rag")], "place int, model string, mode string")
    results = spark.createDataFrame([("a", "no-rag", "y", 1.0), ("b", "rag", "y", 2.0), ("b", "rag", "x", 3.0), ("b", "rag", "z", 4.0)], "model string, mode string, dataset string, pct double")
    got = [(r.dataset, r.row, r.model, r.mode_label) for r in E.report_table(runs, results, ["y", "x"]).orderBy("place", "row").collect()]
    assert got == [("y", 1, "b", "RAG"), ("y", 2, "a", "No-RAG"), ("x", 1, "b", "RAG")]
    groups = spark.createDataFrame([("g1",), ("g2",), ("h",)], "k string")
    pick = lambda p: sorted(r.k for r in E.chosen(groups, "k", p).collect())
    assert pick(["g"]) == ["g1", "g2"] and pick([]) == pick(["zzz"]) == ["g1", "g2", "h"]
    assert [r.k for r in E.first_in_order(groups, "k", 2).collect()] == ["g1", "g2"] and E.first_in_order(groups, "k", 0).count() == 3


def test_queries_and_lines(spark):
    df = spark.createDataFrame([(" ab\n",), (" abc ",), (None,)], "q string").select(T.checked_query(F.col("q")).alias("c"))
    assert [(r.c.query, r.c.error) for r in df.collect()] == [("ab", T.TOO_SHORT), ("abc", None), ("", T.TOO_SHORT)]
    assert one(spark, "a\nb" * 100, T.preview) == ("a b" * 100)[:200]
    import hashlib

    key = spark.range(1).select(T.cache_key(F.lit("q"), F.lit(5), F.lit(0.65), F.lit(None).cast("string"), F.lit("r")).alias("x")).first().x
    assert key == hashlib.md5(b"q|5|0.65||r").hexdigest()


def test_tokenizer_hook(spark):
    df = spark.createDataFrame([("a bb",), (None,), ("",)], "t string").coalesce(1)
    got = [r.ids for r in C.tokenized(df, "t", lambda: lambda texts: [[len(w) for w in t.split()] for t in texts]).collect()]
    assert got[0] == [1, 2] and got[1] is None and list(got[2]) == []
