"""Answers: code extraction, detectors, scores, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import pycode as P
from cairn.functions import textcode as T
from cairn.operators import evaluate as E
from cairn.runtime import table

KEYWORDS = ["return", "def", "class", "cache", "Vektor"]


def _answers(s, d):
    m = table(s, d, "merged_distillation")
    return m.select("rec_id", F.coalesce("source_text", "instruction").alias("prompt"), F.coalesce("target_text", "output", "response").alias("answer")).where("answer is not null")


def _one(name, fn):
    def q(s, d):
        return _answers(s, d).select("rec_id", fn(F.col("answer")).alias(name))

    q.__name__ = name
    return q


code_extract = _one("code", lambda a: F.md5(T.fenced(a)))
code_block = _one("block", lambda a: F.md5(T.code_block(a)))
language_error = _one("language_error", T.language_error)
missing_code = _one("missing_code", T.missing_code)
truncation = _one("truncated", T.truncated)
template = _one("template", T.template_response)
fake_reasoning = _one("fake_reasoning", T.fake_reasoning)
completeness = _one("complete", lambda a: T.complete(T.fenced(a)))
reasoning_extract = _one("reasoning", T.reasoning_part)
response_extract = _one("response_md5", lambda a: F.md5(T.response_part(a)))
syntax_ok = _one("syntax_ok", lambda a: P.syntax_ok(T.fenced(a)))
trailing_clean = _one("cleaned", lambda a: P.clean_tail(T.fenced(a)))
normal_space = _one("flat_md5", lambda a: F.md5(T.normal_space(a)))


def banned_imports(s, d):
    return _answers(s, d).select("rec_id", F.array_join(T.banned_found(F.col("answer")), ",").alias("banned"))


def completion_code(s, d):
    return _answers(s, d).select("rec_id", P.extract_completion(F.col("answer"), F.col("prompt")).alias("code"))


def prompt_stripped(s, d):
    return _answers(s, d).select("rec_id", P.strip_prompt(F.col("answer"), F.col("prompt")).alias("code"))


def _quality(s, d):
    a = _answers(s, d)
    return a.select("rec_id", T.quality(F.col("answer"), P.syntax_ok(T.fenced(F.col("answer")))).alias("q"))


def quality_check(s, d):
    return _quality(s, d).select("rec_id", "q.*").withColumn("banned_found", F.array_join("banned_found", ","))


def failure_histogram(s, d):
    return E.reasons(_quality(s, d).where("not q.pass").select(T.failure_reasons(F.col("q")).alias("reason")), "reason")


def keyword_score(s, d):
    k = F.array(*[F.lit(x) for x in KEYWORDS])
    return _answers(s, d).select("rec_id", T.heuristic_score(F.col("answer"), k).alias("h")).select("rec_id", "h.*")


def score_answer(s, d):
    """Keyword share, code, share of passed cases and pass of the answers.  Cases stand for results of runs: whether the
    answer returns, loops and documents itself.  That the code parses is given, so that SQL can say the rest."""
    k = F.array(*[F.lit(x) for x in KEYWORDS])
    a = _answers(s, d).withColumn("exec_pass", E.pass_rate(F.array(F.col("answer").contains("return"), F.col("answer").contains("for "), F.col("answer").contains("/**"))))
    score = lambda strict: T.pass_at_1(F.col("answer"), F.lit(True), F.col("exec_pass"), strict)
    return a.select("rec_id", F.round(T.keyword_score(F.col("answer"), k), 6).alias("kw_score"), F.col("answer").rlike(T.HAS_CODE).alias("has_code"), F.round("exec_pass", 6).alias("exec_pass"), score(False).alias("pass_at_1"), score(True).alias("pass_strict"))


def score_parsed(s, d):
    """The pass of answers whose code must parse, without cases."""
    a = _answers(s, d).withColumn("ok", P.syntax_ok(T.code_block(F.col("answer"))))
    return a.select("rec_id", "ok", T.pass_at_1(F.col("answer"), F.col("ok"), F.lit(None).cast("double")).alias("pass_at_1"))


def quality_text(s, d):
    """The checks of an answer that need no parser."""
    return _quality(s, d).select("rec_id", *[f"q.{c}" for c in ("has_code", "has_code_block", "completeness_ok", "no_banned_imports", "language_ok", "no_truncation", "no_template")], F.array_join("q.banned_found", ",").alias("banned_found"))


def query_check(s, d):
    q = F.concat(F.lit(" \t"), F.left("prompt", (F.col("item_id") % 6).cast("int")), F.lit("\n "))
    return table(s, d, "benchmark_items").select("item_id", T.checked_query(q).alias("q")).select("item_id", "q.*")


def cache_keys(s, d):
    lang = F.when(F.col("item_id") % 2 == 0, "python")
    return table(s, d, "benchmark_items").where("prompt is not null").select("item_id", T.cache_key(F.col("prompt"), (F.col("item_id") % 5).cast("int"), F.lit(0.65), lang, F.lit(None).cast("string")).alias("cache_key"))


def previews(s, d):
    return _answers(s, d).select("rec_id", T.preview(F.col("answer")).alias("preview"))


def result_format(s, d):
    from cairn.operators.catalog import collection

    c = table(s, d, "chunks").where("level is not null")
    return c.select("chunk_id", F.md5(T.result_lines(collection(F.col("level")), F.pmod(F.length("chunk_id"), F.lit(8)) / 8.0, F.col("repo"), F.col("name"), F.col("file_path"), F.col("content"))).alias("shown_md5"))


def prompt_build(s, d):
    b = table(s, d, "benchmark_items")
    mode = F.explode(F.array(F.lit("no-rag"), F.lit("rag"), F.lit("rag-forgetting"))).alias("mode")
    p = b.select("item_id", "prompt", "entry_point", mode).withColumn("context", F.when(F.col("item_id") % 5 > 0, F.concat(F.lit("// ctx "), F.col("item_id").cast("string"))))
    return p.select("item_id", "mode", T.rag_prompt(F.col("prompt"), F.col("context"), F.col("mode")).alias("built"), T.rag_query(F.col("prompt"), F.col("entry_point")).alias("query"))


def prompt_strategies(s, d):
    b = table(s, d, "benchmark_items").where("prompt is not null").withColumn("context", F.lit("// ctx"))
    return b.select("item_id", F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), T.strategy_prompt(F.col("prompt"), F.col("context"), k).alias("built")) for k in T.STRATEGIES])).alias("p")).select("item_id", "p.*")


def placeholder_fill(s, d):
    b = table(s, d, "benchmark_items").where("task_id is not null")
    done = b.where("item_id % 3 <> 0").select("task_id", F.concat(F.lit("# "), "task_id").alias("solution"))
    return E.back_fill(b, done)


def generate_stub(s, d):
    """The generation hook with its deterministic stub, extracted and parsed."""
    g = P.generate(table(s, d, "benchmark_items").select("item_id", "prompt"), "prompt")
    return g.select("item_id", P.syntax_ok(T.fenced(F.col("completion"))).alias("syntax_ok"))


QUERIES = {
    k: f
    for k, f in dict(
        code_extract=code_extract, code_block=code_block, banned_imports=banned_imports, language_error=language_error, missing_code=missing_code, truncation=truncation, template=template, fake_reasoning=fake_reasoning,
        completeness=completeness, reasoning_extract=reasoning_extract, response_extract=response_extract, syntax_ok=syntax_ok, trailing_clean=trailing_clean, normal_space=normal_space, completion_code=completion_code,
        prompt_stripped=prompt_stripped, quality_check=quality_check, failure_histogram=failure_histogram, keyword_score=keyword_score, score_answer=score_answer, score_parsed=score_parsed, quality_text=quality_text, query_check=query_check, cache_keys=cache_keys, previews=previews, result_format=result_format, prompt_build=prompt_build, prompt_strategies=prompt_strategies,
        placeholder_fill=placeholder_fill, generate_stub=generate_stub,
    ).items()
}

_A = "WITH a AS (SELECT rec_id, coalesce(source_text, instruction) AS prompt, coalesce(target_text, output, response) AS answer FROM merged_distillation WHERE coalesce(target_text, output, response) IS NOT NULL)"
_RX = lambda col, rx: f"regexp_matches({col}, '{rx.replace(chr(39), chr(39) * 2)}')"
_ANY = lambda col, rxs: "(" + " OR ".join(_RX(col, r) for r in rxs) + ")"
_PY, _FN = r"(?s)```python\s*\n(.*?)```", r"(?s)```\s*\n(.*?)```"
_FENCED = f"CASE WHEN {_RX('answer', _PY)} THEN regexp_extract(answer, '{_PY}', 1) WHEN {_RX('answer', _FN)} THEN regexp_extract(answer, '{_FN}', 1) ELSE answer END"
_LINES = "string_split(answer, chr(10))"
_FIRST = f"list_position(list_transform({_LINES}, lambda x: starts_with(ltrim(x), 'def ') OR starts_with(ltrim(x), 'class ')), true)"
_BAN = " || ".join(f"CASE WHEN {_RX('answer', rf'(?i)\bimport\s+{n}\b')} THEN ['{n}'] ELSE [] END || CASE WHEN {_RX('answer', rf'(?i)\bfrom\s+{n}\b')} THEN ['{n}'] ELSE [] END" for n in T.BANNED_IMPORTS)
_COMPLETE = lambda c: f"({_RX(c, r'(def \w+|class \w+)')} AND (contains({c}, 'return') OR contains({c}, 'yield')) AND NOT {_RX(c, r'(TODO|FIXME|\.\.\.)')})"
_KW = "len(list_filter([" + ", ".join(f"'{k}'" for k in KEYWORDS) + "], lambda k: contains(lower(answer), lower(k))))"
_TRIM = r"string_split(regexp_replace(answer, '^\s+|\s+$', '', 'g'), chr(10))"
_S = lambda x: x.replace("'", "''")

SQL = {
    "code_extract": f"{_A} SELECT rec_id, md5({_FENCED}) AS code FROM a",
    "code_block": f"{_A} SELECT rec_id, md5(CASE WHEN {_RX('answer', _PY)} OR {_RX('answer', _FN)} THEN {_FENCED} WHEN {_FIRST} > 0 THEN array_to_string({_LINES}[{_FIRST}:], chr(10)) ELSE answer END) AS block FROM a",
    "banned_imports": f"{_A} SELECT rec_id, array_to_string({_BAN}, ',') AS banned FROM a",
    "language_error": f"{_A} SELECT rec_id, {_ANY('answer', T.OTHER_LANGUAGE)} AS language_error FROM a",
    "missing_code": f"{_A} SELECT rec_id, NOT (contains(answer, 'def ') OR contains(answer, 'class ')) AS missing_code FROM a",
    "truncation": f"{_A} SELECT rec_id, ends_with(answer, '..') OR length(answer) < 50 OR {_RX('answer', T.HALF_SENTENCE)} AS truncated FROM a",
    "template": f"{_A} SELECT rec_id, {_ANY('answer', T.TEMPLATES)} AS template FROM a",
    "fake_reasoning": f"{_A} SELECT rec_id, NOT {_ANY('answer', T.REASONING)} AS fake_reasoning FROM a",
    "completeness": f"{_A} SELECT rec_id, {_COMPLETE('c')} AS complete FROM (SELECT rec_id, {_FENCED} AS c FROM a)",
    "keyword_score": f"""{_A} SELECT rec_id, {_RX('answer', T.HAS_CODE_WIDE)} AS has_code, {_KW}::INTEGER AS keyword_matches, {len(KEYWORDS)}::INTEGER AS keyword_total,
len(list_filter({_TRIM}, lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '#') AND NOT starts_with(ltrim(x), '//')))::INTEGER AS code_lines, len({_TRIM})::INTEGER AS total_lines,
round({_KW} / {len(KEYWORDS)}::DOUBLE * 0.6::DOUBLE + CASE WHEN {_RX('answer', T.HAS_CODE_WIDE)} THEN 0.4::DOUBLE ELSE 0 END, 3) AS score FROM a""",
    "score_answer": f"""{_A}, x AS (SELECT *, (contains(answer, 'return')::INTEGER + contains(answer, 'for ')::INTEGER + contains(answer, '/**')::INTEGER) / 3::DOUBLE AS e, {_RX('answer', T.HAS_CODE)} AS h FROM a)
SELECT rec_id, round({_KW} / {len(KEYWORDS)}::DOUBLE, 6) AS kw_score, h AS has_code, round(e, 6) AS exec_pass, CASE WHEN h AND e >= 0.5 THEN 1::DOUBLE ELSE 0 END AS pass_at_1, CASE WHEN h AND e >= 1 THEN 1::DOUBLE ELSE 0 END AS pass_strict FROM x""",
    "quality_text": f"""{_A}, x AS (SELECT rec_id, answer, c, contains(c, 'def ') OR contains(c, 'class ') AS has, {_BAN.replace("'(?i)", "'(?i)").replace('answer', 'c')} AS ban FROM (SELECT rec_id, answer, {_FENCED} AS c FROM a))
SELECT rec_id, has AS has_code, contains(answer, '```') AS has_code_block, has AND {_COMPLETE('c')} AS completeness_ok, len(ban) = 0 AS no_banned_imports, NOT {_ANY('answer', T.OTHER_LANGUAGE)} AS language_ok, NOT (ends_with(answer, '..') OR length(answer) < 50 OR {_RX('answer', T.HALF_SENTENCE)}) AS no_truncation,
NOT {_ANY('answer', T.TEMPLATES)} AS no_template, array_to_string(ban, ',') AS banned_found FROM x""",
    "query_check": r"""WITH q AS (SELECT item_id, regexp_replace(coalesce(' ' || chr(9) || left(prompt, (item_id % 6)::INTEGER) || chr(10) || ' ', ''), '^\s+|\s+$', '', 'g') AS query FROM benchmark_items) SELECT item_id, query, CASE WHEN length(query) < 3 THEN 'Query too short (min 3 chars)' END AS error FROM q""",
    "cache_keys": "SELECT item_id, md5(prompt || '|' || (item_id % 5) || '|0.65|' || CASE WHEN item_id % 2 = 0 THEN 'python' ELSE '' END || '|') AS cache_key FROM benchmark_items WHERE prompt IS NOT NULL",
    "previews": f"{_A} SELECT rec_id, replace(left(answer, 200), chr(10), ' ') AS preview FROM a",
    "result_format": r"""WITH c AS (SELECT *, printf('  [%.3f] ', (length(chunk_id) % 8) / 8::DOUBLE) AS s, replace(left(coalesce(content, ''), 120), chr(10), '\n') AS b, replace(left(coalesce(content, ''), 150), chr(10), '\n') AS e FROM chunks WHERE level IS NOT NULL)
SELECT chunk_id, md5(CASE WHEN level <= 2 THEN s || coalesce(repo, '?') || ' | ' || left(coalesce(name, ''), 60) WHEN level = 3 THEN s || coalesce(repo, '?') || ':' || coalesce(file_path, '') || chr(10) || '    ' || b ELSE s || coalesce(repo, '?') || '::' || coalesce(name, '?') || chr(10) || '    ' || e END) AS shown_md5 FROM c""",
    "normal_space": f"{_A} SELECT rec_id, md5(trim(regexp_replace(answer, '\\s+', ' ', 'g'))) AS flat_md5 FROM a",
    "response_extract": f"""{_A}, r AS (SELECT rec_id, {_FENCED} AS c, regexp_replace(regexp_extract(answer, '(?is)(Step\\s*4.*)$', 1), '^\\s+|\\s+$', '', 'g') AS tail FROM a)
SELECT rec_id, md5('```python' || chr(10) || c || chr(10) || '```' || CASE WHEN tail <> '' THEN chr(10) || chr(10) || tail ELSE '' END) AS response_md5 FROM r""",
    "reasoning_extract": f"""{_A} SELECT rec_id, CASE WHEN regexp_matches(answer, '(?is)Step\\s*1.*?(Step\\s*3|```)') THEN regexp_replace(regexp_extract(answer, '(?is)(Step\\s*1.*?)(?:Step\\s*3|```)', 1), '^\\s+|\\s+$', '', 'g')
WHEN contains(answer, '```') THEN regexp_replace(split_part(answer, '```', 1), '^\\s+|\\s+$', '', 'g') ELSE '' END AS reasoning FROM a""",
    "prompt_build": f"""WITH p AS (SELECT item_id, prompt, entry_point, unnest(['no-rag', 'rag', 'rag-forgetting']) AS mode, CASE WHEN item_id % 5 > 0 THEN '// ctx ' || item_id END AS context FROM benchmark_items)
SELECT item_id, mode, CASE WHEN mode = 'no-rag' OR coalesce(context, '') = '' THEN prompt ELSE CASE WHEN mode = 'rag-forgetting' THEN '{_S(T.FORGETTING_PREFIX[:-2])}' || chr(10) || chr(10) ELSE '{_S(T.RAG_PREFIX[:-1])}' || chr(10) END || context || chr(10) || chr(10) || '{T.COMPLETE[:-1]}' || chr(10) || prompt END AS built,
left(coalesce(prompt, '') || ' ' || coalesce(entry_point, ''), 500) AS query FROM p""",
    "prompt_strategies": "WITH b AS (SELECT item_id, prompt FROM benchmark_items WHERE prompt IS NOT NULL) "
    + " UNION ALL ".join(f"SELECT item_id, '{k}' AS strategy, " + ("prompt" if v is None else f"'{_S(v[:-1])}'{' || chr(10)' if v else ''} || '// ctx' || chr(10) || chr(10) || prompt") + " AS built FROM b" for k, v in T.STRATEGIES.items()),
    "placeholder_fill": """WITH b AS (SELECT * FROM benchmark_items WHERE task_id IS NOT NULL), g AS (SELECT task_id, min('# ' || task_id) AS solution FROM b WHERE item_id % 3 <> 0 GROUP BY task_id)
SELECT task_id, coalesce(g.solution, coalesce(prompt, '') || '    pass' || chr(10)) AS solution, g.solution IS NULL AS placeholder FROM b LEFT JOIN g USING (task_id)""",
}
