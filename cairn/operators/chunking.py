"""Source files to chunks: language map, path filters, modules, function and class extraction, summaries.

Extraction runs in Python over Arrow batches (no JVM regex: some patterns exhaust its stack), over whole texts of any
length.  The second version has no JavaScript.
Defined results: null text gives nothing; Python that doesn't parse gives nothing from the parser.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Name endings to languages, of the first and of the second chunk version.
LANGUAGES_V1 = {".py": "python", ".go": "go", ".rs": "rust", ".js": "javascript", ".ts": "typescript", ".java": "java", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp"}
LANGUAGES_V2 = {".py": "python", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript"}
#: Directories not walked, and not taken as modules.
PRUNED_V1, PRUNED_V2 = ("node_modules", "__pycache__", "venv", "env", ".git"), ("node_modules", "__pycache__", "venv", "env", ".git", "target", "build", "dist")
NO_MODULES = ("__pycache__", "node_modules", "test", "tests", "venv", "env")
LEAST_CHARS = 30
#: Patterns of functions by name ending, first version (name: what follows fn, func or function).
PATTERNS_V1 = {
    ".go": [r"func\s+(?:\([^)]*\)\s+)?\w+[^{]*\{[^}]*\}"],
    ".js": [r"(?:async\s+)?function(?:\s+\w+)?\s*\([^)]*\)[^{]*\{[^}]*\}", r"\w+\s*=\s*(?:async\s+)?function\s*\([^)]*\)[^{]*\{[^}]*\}"],
    ".ts": [r"(?:async\s+)?function(?:\s+\w+)?\s*\([^)]*\)\s*(?::\s*\w+)?[^{]*\{[^}]*\}", r"\w+\s*=\s*(?:async\s+)?function\s*\([^)]*\)\s*(?::\s*\w+)?[^{]*\{[^}]*\}", r"\w+\s*:\s*(?:async\s+)?\([^)]*\)\s*=>[^{]*\{[^}]*\}"],
    ".rs": [r"(?:pub\s+)?(?:unsafe\s+)?fn\s+\w+[^{;]*\{[^}]*\}"],
    ".java": [r"(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?:\w+(?:<[^>]*>)?)\s+\w+\s*\([^)]*\)\s*(?:throws\s+\w+(?:,\s*\w+)*)?\s*\{[^}]*\}"],
    ".c": [r"(?:\w+\s+)+\w+\s*\([^)]*\)\s*\{[^}]*\}"],
    ".cpp": [r"(?:\w+(?:::))?\w+\s*\([^)]*\)\s*(?:const\s*)?(?:override\s*)?(?:final\s*)?\{[^}]*\}", r"(?:\w+\s+)+\w+\s*\([^)]*\)\s*(?:const\s*)?\{[^}]*\}"],
}
#: Patterns of the second version; group 1 is the name.
PATTERNS_V2 = {
    ".java": [r"(?:public|private|protected|static|final|abstract)\s+(?:\w+(?:<[^>]*>)?)\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+\w+(?:,\s*\w+)*)?\s*\{[^}]*\}", r"(?:public|private|protected)\s+(?:static\s+)?(?:class|interface|enum)\s+(\w+)"],
    ".kt": [r"(?:fun|suspend fun)\s+(\w+)\s*\([^)]*\)[^{]*\{[^}]*\}", r"(?:class|interface|object|data class)\s+(\w+)"],
    ".kts": [r"(?:fun|suspend fun)\s+(\w+)\s*\([^)]*\)[^{]*\{[^}]*\}", r"(?:class|interface|object)\s+(\w+)"],
    ".ts": [r"(?:async\s+)?function\s+(\w+)\s*\([^)]*\)[^{]*\{[^}]*\}", r"(?:export\s+)?(?:default\s+)?(?:class|interface|type|enum)\s+(\w+)", r"(\w+)\s*[=:]\s*(?:async\s+)?\([^)]*\)\s*=>[^{]*\{[^}]*\}"],
    ".tsx": [r"(?:export\s+)?(?:default\s+)?(?:class|interface|type|enum)\s+(\w+)", r"(?:async\s+)?function\s+(\w+)\s*\([^)]*\)[^{]*\{[^}]*\}"],
    ".js": [r"(?:async\s+)?function\s+(\w+)\s*\([^)]*\)[^{]*\{[^}]*\}", r"(\w+)\s*=\s*(?:async\s+)?function\s*\([^)]*\)[^{]*\{[^}]*\}", r"(?:class|const)\s+(\w+)[^{]*\{[^}]*\}"],
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column, table: dict[str, str] = LANGUAGES_V1) -> Column:
    """null for endings not in the table."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[extension(path)]


def walked(path: Column, pruned: tuple[str, ...] = PRUNED_V1) -> Column:
    """False below a hidden or pruned directory."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return ~F.exists(dirs, lambda d: d.startswith(".") | d.isin(*pruned))


def wanted_name(path: Column) -> Column:
    """Drops cache and vendor names, and test files that aren't Python."""
    name = F.element_at(F.split(path, "/"), -1)
    return ~(name.contains("__pycache__") | name.contains("node_modules") | name.contains(".git")) & ~(F.lower(name).contains("test") & (extension(path) != ".py"))


def module(path: Column) -> Column:
    """The first directory of the path, '' at the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("")


def python_items(source: str) -> list[tuple]:
    """(type, name, content, start_line, end_line) of all functions over the least length and all classes, breadth first."""
    try:
        nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for n in nodes:
        kind = "class" if isinstance(n, ast.ClassDef) else "function" if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) else None
        text = kind and ast.get_source_segment(source, n)
        if text and (kind == "class" or len(text) > LEAST_CHARS):
            out.append((kind, n.name, text, n.lineno, n.end_lineno))
    return out


#: What a pattern of leading words begins with: its runs of words are extended to the left, not tried from each word.
_WORDS_FIRST = r"(?:\w+\s+)+"


@cache
def _compiled(pattern: str) -> re.Pattern:
    """A pattern that begins with a word is tried at the beginnings of words only; within one it fails as it did there."""
    return re.compile((r"(?<!\w)" if re.match(r"(?:\(\?:|\()*\\w", pattern) else "") + pattern, re.S)


def _after_words(tail: re.Pattern, text: str) -> Iterator[tuple[int, int, re.Match]]:
    """Matches of one or more words with blanks after them, and then ``tail``, from left to right.  Each word is looked at
    a few times, however long its run is."""
    end = at = 0
    while m := tail.search(text, at):
        start = m.start()
        while True:
            k = start
            while k > end and text[k - 1].isspace():
                k -= 1
            w = k
            while w > end and (text[w - 1].isalnum() or text[w - 1] == "_"):
                w -= 1
            if k == start or w == k:
                break
            start = w
        if start < m.start():
            yield start, m.end(), m
            end = at = m.end()
        else:
            at = re.compile(r"\w+").match(text, m.start()).end()


def _hits(pattern: str, text: str) -> Iterator[tuple[int, int, re.Match]]:
    if pattern.startswith(_WORDS_FIRST):
        return _after_words(_compiled(pattern[len(_WORDS_FIRST) :]), text)
    return ((m.start(), m.end(), m) for m in _compiled(pattern).finditer(text))


_FUNCTION_NAME = re.compile(r"(?:fn|func|function)\s+(\w+)")


def pattern_items(source: str, ext: str, patterns: dict[str, list[str]]) -> list[tuple]:
    """The same by patterns; hits of several patterns all come out; names of the second version are group 1."""
    out, second = [], patterns is PATTERNS_V2
    line = lambda at: bisect_left(breaks, at) + 1
    breaks = [m.start() for m in re.finditer("\n", source)]
    for pattern in patterns.get(ext, []):
        for start, end, m in _hits(pattern, source):
            text = source[start:end].strip()
            if len(text) >= LEAST_CHARS:
                named = (m if m.lastindex else None) if second else _FUNCTION_NAME.search(text)
                out.append(("function", named.group(1) if named else f"{'m' if second else 'match'}_{len(out)}", text, line(start), line(end)))
    return out


def _extract(version: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = PATTERNS_V1 if version == 1 else PATTERNS_V2
        for b in batches:
            rows = []
            for key, path, text in zip(*[b.column(k).to_pylist() for k in range(3)]):
                ext = "." + path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if path and "." in path else ""
                if version == 2 and ext == ".js":
                    continue  # rows of that language are dropped
                items = python_items(text) if ext == ".py" else pattern_items(text, ext, patterns)
                rows += [(key, k, *x) for k, x in enumerate(items)]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file_id", "nth", "type", "name", "content", "start_line", "end_line"])

    return run


def extract(files: DataFrame, id_col: str, path: str, text: str, version: int = 1) -> DataFrame:
    """file_id, nth, type, name, content, start_line, end_line of every function and class of every file."""
    rows = files.where(F.col(text).isNotNull()).select(F.col(id_col).cast("long"), F.col(path), F.col(text))
    return rows.mapInArrow(_extract(version), "file_id long, nth int, type string, name string, content string, start_line int, end_line int")


def file_summary(path: Column, text: Column, docstring: Column) -> Column:
    doc = F.when(F.coalesce(docstring, F.lit("")) != "", F.concat(docstring, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("# "), path, F.lit("\n\n"), doc, F.array_join(F.slice(F.split(text, "\n"), 1, 50), "\n"))


def repo_text(repo: Column, readme: Column) -> Column:
    return F.when(F.coalesce(readme, F.lit("")) != "", F.concat(F.lit("Repository: "), repo, F.lit("\n\n"), readme)).otherwise(repo)


def module_text(repo: Column, name: Column) -> Column:
    return F.concat(F.lit("Module: "), F.element_at(F.split(repo, "/"), -1), F.lit("/"), name)


def docstring_of(text: str | None) -> str:
    try:
        return ast.get_docstring(ast.parse(text or "")) or ""
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return ""


def chunk_tree(files: DataFrame, repo: str) -> DataFrame:
    """Chunks of four levels of one repository.  files: path (relative), text."""
    @F.pandas_udf(StringType())
    def docs(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([docstring_of(t) if (p or "").endswith(".py") else "" for p, t in zip(paths, texts)], dtype=object)

    name = F.element_at(F.split("path", "/"), -1)
    readme = files.where((F.instr("path", "/") == 0) & name.isin("README.md", "README.rst", "README")).agg(F.min_by(F.left("text", F.lit(2000)), F.array_position(F.array(F.lit("README.md"), F.lit("README.rst"), F.lit("README")), F.col("path"))).alias("readme"))
    blank = F.lit("")
    cols = lambda level, kind, mod, path, lang, nm, content, doc, lo=F.lit(None).cast("int"), hi=F.lit(None).cast("int"): [
        F.lit(level).alias("level"), F.lit(kind).alias("type"), F.lit(repo).alias("repo"), mod.alias("module"), path.alias("file_path"), lang.alias("language"), nm.alias("name"), content.alias("content"), doc.alias("docstring"), lo.alias("start_line"), hi.alias("end_line")
    ]
    one = readme.select(*cols(1, "repo", blank, blank, blank, F.lit(repo), repo_text(F.lit(repo), F.col("readme")), blank))
    mods = files.where(F.instr("path", "/") > 0).select(module(F.col("path")).alias("m")).distinct().where(~F.col("m").startswith(".") & ~F.col("m").isin(*NO_MODULES))
    two = mods.select(*cols(2, "module", F.col("m"), F.col("m"), blank, F.concat(F.element_at(F.split(F.lit(repo), "/"), -1), F.lit("/"), F.col("m")), module_text(F.lit(repo), F.col("m")), blank))
    kept = files.where(walked(F.col("path")) & wanted_name(F.col("path")) & F.col("text").isNotNull()).withColumn("lang", language(F.col("path"))).where("lang is not null").withColumn("doc", docs("path", "text"))
    three = kept.select(*cols(3, "file", module(F.col("path")), F.col("path"), F.col("lang"), F.col("path"), file_summary(F.col("path"), F.col("text"), F.col("doc")), F.col("doc")))
    ids = kept.withColumn("fid", F.xxhash64("path"))
    items = extract(ids, "fid", "path", "text")
    four = items.join(ids.select(F.col("fid").alias("file_id"), "path", "lang"), "file_id").select(*cols(4, "x", module(F.col("path")), F.col("path"), F.col("lang"), F.col("name"), F.col("content"), blank, F.col("start_line"), F.col("end_line")), F.col("type").alias("kind"))
    four = four.withColumn("type", F.col("kind")).drop("kind")
    return one.unionByName(two).unionByName(three).unionByName(four)
