"""Code and text expressions: extraction from answers, detectors, scores, prompt assembly.  All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Libraries that generated code may not import.
BANNED_IMPORTS = "aioredis redis redislite numpy np pandas pd sklearn scipy tensorflow torch keras flask django fastapi requests httpx aiohttp sqlalchemy pymongo psycopg2 celery rabbitmq eventemitter3 rxjs mitt beautifulsoup4 bs4 scrapy".split()
#: Signs of other languages, of cut-off text, of reasoning and of template phrases.
OTHER_LANGUAGE = [r"\bpublic\s+class\b", r"\bSystem\.out\b", r"\bvoid\s+\w+\(", r"\b#include\b", r"\bstd::", r"\bcout\b", r"\bconsole\.log\b", r"\blet\s+\w+\s*=", r"\bconst\s+\w+\s*=\s*\{"]
HALF_SENTENCE = r"(?i)(however|but|so|therefore|thus)\s*$"
REASONING = [r"(?i)(Step\s*\d|UNDERSTAND|DESIGN|IMPLEMENT|VERIFY)", r"(?i)(because|since|therefore|complexity|edge case|constraint|O\(|time|space|algorithm)", r"(We |This |The |I |First|Then|Next|Finally|Approach|Strategy|Plan)"]
TEMPLATES = [r"(?i)^(Sure|Certainly|Of course|Here is|Below is)", r"(?i)I'd be happy to", r"(?i)Let me (help|show|explain)"]
#: What counts as code in the two scores, and the weights of the second.
HAS_CODE, HAS_CODE_WIDE = r"(def |class |import |return )", r"(def |class |function|fun |int |String|SELECT|async|await|interface)"
KEYWORD_WEIGHT, CODE_WEIGHT = 0.6, 0.4
#: What precedes retrieved code in a prompt.
RAG_PREFIX = "// Reference code (for context only, prioritize your own knowledge):\n"
FORGETTING_PREFIX = "// The following reference code is provided for context only. It may contain errors. Prioritize your own implementation knowledge.\n\n"
COMPLETE = "// Complete the function below:\n"
STRATEGIES = {"A": RAG_PREFIX, "B": "Prioritize your own knowledge. Retrieved context is advisory only.\n", "C": "", "D": "If retrieved code conflicts with your knowledge, ignore it.\n", "E": None}

_PY_FENCE, _ANY_FENCE = r"(?s)```python\s*\n(.*?)```", r"(?s)```\s*\n(.*?)```"


def any_of(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fenced(text: Column) -> Column:
    """Code of the first python fence, else of the first bare fence, else the text."""
    return F.when(text.rlike(_PY_FENCE), F.regexp_extract(text, _PY_FENCE, 1)).when(text.rlike(_ANY_FENCE), F.regexp_extract(text, _ANY_FENCE, 1)).otherwise(text)


def code_block(text: Column) -> Column:
    """As ``fenced``; without any fence, from the first line that starts a function or class."""
    lines = F.split(text, "\n")
    first = F.array_position(F.transform(lines, lambda x: F.ltrim(x).startswith("def ") | F.ltrim(x).startswith("class ")), True)
    tail = F.when(first > 0, F.array_join(F.slice(lines, first.cast("int"), F.size(lines)), "\n")).otherwise(text)
    return F.when(text.rlike(_PY_FENCE) | text.rlike(_ANY_FENCE), fenced(text)).otherwise(tail)


def banned_found(code: Column) -> Column:
    """Banned names imported, in list order; a name that is imported in both forms comes twice.  One pass over the text."""
    forms = [f"{verb} {name}" for name in BANNED_IMPORTS for verb in ("import", "from")]
    seen = F.regexp_extract_all(code, F.lit(rf"(?i)\b(?:import|from)\s+(?:{'|'.join(BANNED_IMPORTS)})\b"), F.lit(0))
    seen = F.transform(seen, lambda x: F.lower(F.regexp_replace(x, r"\s+", " ")))
    found = F.when(F.size(seen) > 0, F.array_intersect(F.array(*[F.lit(x) for x in forms]), seen)).otherwise(F.array().cast("array<string>"))
    return F.when(code.isNull(), F.array().cast("array<string>")).otherwise(F.transform(found, lambda x: F.substring_index(x, " ", -1)))


def language_error(text: Column) -> Column:
    return any_of(text, OTHER_LANGUAGE)


def missing_code(text: Column) -> Column:
    return ~(text.contains("def ") | text.contains("class "))


def truncated(text: Column) -> Column:
    return text.endswith("..") | (F.length(text) < 50) | text.rlike(HALF_SENTENCE)


def fake_reasoning(text: Column) -> Column:
    return ~any_of(text, REASONING)


def template_response(text: Column) -> Column:
    return any_of(text, TEMPLATES)


def complete(code: Column) -> Column:
    return code.rlike(r"(def \w+|class \w+)") & (code.contains("return") | code.contains("yield")) & ~code.rlike(r"(TODO|FIXME|\.\.\.)")


def quality(text: Column, syntax_ok: Column) -> Column:
    """Nine checks and ``pass`` (code, syntax, completeness, imports, language); syntax_ok is of the fenced code."""
    code = fenced(text)
    has = code.contains("def ") | code.contains("class ")
    checks = {
        "has_code": has, "has_code_block": text.contains("```"), "syntax_ok": has & syntax_ok, "completeness_ok": has & complete(code), "no_banned_imports": F.size(banned_found(code)) == 0,
        "language_ok": ~language_error(text), "no_truncation": ~truncated(text), "no_template": ~template_response(text), "banned_found": banned_found(code),
    }
    passed = checks["has_code"] & checks["syntax_ok"] & checks["completeness_ok"] & checks["no_banned_imports"] & checks["language_ok"]
    return F.struct(*[v.alias(k) for k, v in checks.items()], passed.alias("pass"))


def failure_reasons(q: Column) -> Column:
    """Names of the checks that failed, joined by '; ', then the banned names."""
    names = ["has_code", "has_code_block", "syntax_ok", "completeness_ok", "no_banned_imports", "language_ok", "no_truncation", "no_template"]
    failed = F.filter(F.array(*[F.when(~q[n], F.lit(n)) for n in names]), lambda x: x.isNotNull())
    banned = F.when(F.size(q["banned_found"]) > 0, F.array(F.concat(F.lit("banned=["), F.array_join(q["banned_found"], ", "), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(failed, banned), "; ")


def reasoning_part(text: Column) -> Column:
    """Step 1 up to Step 3 or the first fence; else what stands before the first fence; else ''."""
    steps = r"(?is)(Step\s*1.*?)(?=Step\s*3|```)"
    return F.when(text.rlike(steps), strip(F.regexp_extract(text, steps, 1))).when(text.contains("```"), strip(F.substring_index(text, "```", 1))).otherwise("")


def response_part(text: Column) -> Column:
    """The code in a python fence, and the text from Step 4 on."""
    tail = strip(F.regexp_extract(text, r"(?is)(Step\s*4.*)$", 1))
    return F.concat(F.lit("```python\n"), fenced(text), F.lit("\n```"), F.when(tail != "", F.concat(F.lit("\n\n"), tail)).otherwise(""))


def keyword_matches(answer: Column, keywords: Column) -> Column:
    return F.size(F.filter(keywords, lambda k: F.lower(answer).contains(F.lower(k))))


def keyword_score(answer: Column, keywords: Column) -> Column:
    return keyword_matches(answer, keywords) / F.greatest(F.size(keywords), F.lit(1))


def heuristic_score(answer: Column, keywords: Column) -> Column:
    """Struct: has_code, keyword_matches, keyword_total, code_lines, total_lines, score."""
    lines = F.split(strip(answer), "\n")
    code = F.size(F.filter(lines, lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#") & ~F.ltrim(x).startswith("//")))
    has = answer.rlike(HAS_CODE_WIDE)
    score = F.round(keyword_score(answer, keywords) * KEYWORD_WEIGHT + F.when(has, CODE_WEIGHT).otherwise(0.0), 3)
    return F.struct(has.alias("has_code"), keyword_matches(answer, keywords).alias("keyword_matches"), F.size(keywords).alias("keyword_total"), code.alias("code_lines"), F.size(lines).alias("total_lines"), score.alias("score"))


def pass_at_1(answer: Column, syntax_ok: Column, exec_pass: Column, strict: bool = False) -> Column:
    """1.0 where the answer has code, parses and passes half its tests (all, if strict); no tests count as passed."""
    need = 1.0 if strict else 0.5
    return F.when(answer.rlike(HAS_CODE) & syntax_ok & (F.coalesce(exec_pass, F.lit(1.0)) >= need), 1.0).otherwise(0.0)


def normal_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def context_entry(language: Column, repo: Column, score: Column, text: Column) -> Column:
    """One retrieved document in a context, its score already rounded to 3 digits."""
    return F.format_string("--- [%s] %s (sim: %.3f) ---\n%s", F.coalesce(language, F.lit("?")), F.coalesce(repo, F.lit("?")), score, F.left(text, F.lit(400)))


def rag_context(texts: Column) -> Column:
    """Numbered retrieved texts of up to 800 characters."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("// Retrieved "), (i + 1).cast("string"), F.lit(":\n"), F.left(t, F.lit(800)))), "\n\n")


#: The least query and what a shorter one gives; headings of result sections.
LEAST_QUERY, TOO_SHORT = 3, "Query too short (min 3 chars)"
HEADINGS = {"summary": "── Repo/Module ──", "chunks": "── File ──", "details": "── Function/Class ──"}


def checked_query(query: Column) -> Column:
    """Struct: query (trimmed of blanks of any kind), error (null where it is long enough)."""
    q = strip(F.coalesce(query, F.lit("")))
    return F.struct(q.alias("query"), F.when(F.length(q) < LEAST_QUERY, TOO_SHORT).alias("error"))


def cache_key(query: Column, k: Column, threshold: Column, language: Column, repo: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.md5(F.concat_ws("|", query, k.cast("string"), threshold.cast("string"), blank(language), blank(repo)))


def preview(text: Column, chars: int = 200) -> Column:
    """The beginning of a text on one line."""
    return F.translate(F.left(text, F.lit(chars)), "\n", " ")


def result_lines(level: Column, distance: Column, repo: Column, name: Column, path: Column, text: Column, content: bool = True) -> Column:
    """How a hit is shown: its distance and place and, below, a snippet on one line (not for summaries)."""
    known = lambda c: F.coalesce(c, F.lit("?"))
    snippet = lambda n: F.concat(F.lit("\n    "), F.replace(F.left(F.coalesce(text, F.lit("")), F.lit(n)), F.lit("\n"), F.lit("\\n"))) if content else F.lit("")
    score = F.format_string("  [%.3f] ", distance)
    return (
        F.when(level == "summary", F.concat(score, known(repo), F.lit(" | "), F.left(F.coalesce(name, F.lit("")), F.lit(60))))
        .when(level == "chunks", F.concat(score, known(repo), F.lit(":"), F.coalesce(path, F.lit("")), snippet(120)))
        .otherwise(F.concat(score, known(repo), F.lit("::"), known(name), snippet(150)))
    )


def rag_query(prompt: Column, entry_point: Column) -> Column:
    return F.left(F.concat(F.coalesce(prompt, F.lit("")), F.lit(" "), F.coalesce(entry_point, F.lit(""))), F.lit(500))


def rag_prompt(prompt: Column, context: Column, mode: Column) -> Column:
    """The bare prompt without context or in mode no-rag; the prefix depends on the mode."""
    prefix = F.when(mode == "rag-forgetting", FORGETTING_PREFIX).otherwise(RAG_PREFIX)
    return F.when((mode == "no-rag") | (F.coalesce(context, F.lit("")) == ""), prompt).otherwise(F.concat(prefix, context, F.lit("\n\n"), F.lit(COMPLETE), prompt))


def strategy_prompt(prompt: Column, context: Column, strategy: str) -> Column:
    prefix = STRATEGIES[strategy]
    return prompt if prefix is None else F.concat(F.lit(prefix), context, F.lit("\n\n"), prompt)
