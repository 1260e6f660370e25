"""What only Python can do with code: parsing, line-state extraction, running tests.  All over Arrow batches."""

from __future__ import annotations

import ast
import re
import subprocess
import sys
import tempfile
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType


def parses(code: str | None) -> bool:
    """Whether the text is Python; null isn't, text too deep or with null bytes isn't."""
    try:
        ast.parse(code)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError, TypeError):
        return False


@F.pandas_udf(BooleanType())
def syntax_ok(code: pd.Series) -> pd.Series:
    return code.map(parses).astype(bool)


#: Beginnings of lines that may go from the end of code, lines that only close something, beginnings of
#: repeated prompt lines that stay, and the signature that is put back.
NOISE = ("#", "//", "print(", ">>>", "...", "if __name__")
CLOSING = ("", "}", "]", ")")
DECLARING = ("def ", "class ", "import ", "from ", "@", "if __name__")
SIGNATURE = r"((?:async\s+)?def\s+\w+\s*\([^)]*\)(?:\s*->\s*\w+(?:\[\w+(?:,\s*\w+)*\])?)?\s*:)"

_CLOSED_FENCE = re.compile(r"```(?:python)?\s*\n(.*?)```", re.S)
_FENCE_LINES = re.compile(r"\A```.*\n?|^```.*\Z", re.M)


def _line_kind(line: str) -> str:
    bare = line.strip()
    return "closing" if bare in CLOSING else "noise" if bare.startswith(NOISE) else "code"


def trim_tail(code: str) -> str:
    """The text up to its last line of code; where none is code, what stands before the first noise."""
    lines = code.split("\n")
    kinds = [_line_kind(x) for x in lines]
    if "code" in kinds:
        return "\n".join(lines[: len(kinds) - kinds[::-1].index("code")]).strip()
    return "\n".join(lines[: kinds.index("noise")] if "noise" in kinds else lines).strip()


def unfenced(text: str) -> str:
    """What the first closed fence holds; the stripped text if there is none."""
    fence = _CLOSED_FENCE.search(text)
    return (fence.group(1) if fence else text).strip()


def _shared(a, b) -> int:
    """Number of leading elements on which two sequences agree."""
    return len(commonprefix([a, b]))


def _own_lines(text: str, prompt: str, least: int = 3) -> str:
    """Without the prompt's lines, but for declarations, if ``least`` or more of them lead the text."""
    asked = [x.strip() for x in prompt.strip().split("\n")]
    lines = [(x, x.strip()) for x in text.split("\n")]
    if _shared(asked, [bare for _, bare in lines]) < least:
        return text
    own = [x for x, bare in lines if bare.startswith(DECLARING) or bare not in asked]
    return "\n".join(own).strip() if own else text


def _signed(text: str, completion: str) -> str:
    """With the completion's first signature before it, where the text declares nothing itself."""
    if re.search(r"(?m)^\s*(?:def|class|async def) ", text):
        return text
    lost = re.search(SIGNATURE, completion)
    return f"{lost.group(1)}\n{text}" if lost else text


def completion_code(completion: str, prompt: str) -> str:
    """The code of a completion: taken out of its fence, closed or not; without repeated prompt lines; with its
    signature; without test calls and remarks at its end."""
    text = unfenced(completion)
    if text.startswith("```") and not _CLOSED_FENCE.search(completion):
        text = _FENCE_LINES.sub("", text).strip()
    return trim_tail(_signed(_own_lines(text, prompt), completion))


def without_prompt(completion: str, prompt: str, least: int = 60) -> str:
    """Drop a repeated prompt of ``least`` or more characters, blanks counted alike."""
    text = unfenced(completion)
    again = _shared(*(" ".join(x.split()) for x in (prompt, text)))
    if again < least:
        return text
    units = list(re.finditer(r"\s+|\S", text))[:again]  # a run of blanks is one character of the compared text
    return text[units[-1].end() :].strip()


@F.pandas_udf(StringType())
def extract_completion(completion: pd.Series, prompt: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else completion_code(c, p or "") for c, p in zip(completion, prompt)], dtype=object)


@F.pandas_udf(StringType())
def strip_prompt(completion: pd.Series, prompt: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else without_prompt(c, p or "") for c, p in zip(completion, prompt)], dtype=object)


@F.pandas_udf(StringType())
def clean_tail(code: pd.Series) -> pd.Series:
    return code.map(lambda c: None if c is None else trim_tail(c))


def run_tests(df: DataFrame, code: str, tests: str, allow: bool = False, seconds: float = 5.0) -> DataFrame:
    """Add exec_pass, the share of (input, expected) cases whose expected text is in the output, in any case.

    Runs untrusted code in a subprocess, so it does nothing but give null unless ``allow`` is set."""
    if not allow:
        return df.withColumn("exec_pass", F.lit(None).cast("double"))

    def one(source: str, given: str, expected: str) -> bool:
        with tempfile.TemporaryDirectory() as d:
            try:
                r = subprocess.run([sys.executable, "-I", "-c", f"{source}\n{given}"], capture_output=True, text=True, timeout=seconds, cwd=d)
            except subprocess.TimeoutExpired:
                return False
        return (expected or "").lower() in r.stdout.lower()

    @F.pandas_udf(DoubleType())
    def share(sources: pd.Series, cases: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or not len(c) or s is None else sum(one(s, x["input"], x["expected"]) for x in c) / len(c) for s, c in zip(sources, cases)], dtype=float)

    return df.withColumn("exec_pass", share(F.col(code), F.col(tests)))


_HOLDS_CODE = re.compile(r"def |class ")


def generate(df: DataFrame, prompt: str, make=None, simpler: str = "Write Python code only. No explanation.\n") -> DataFrame:
    """Model hook: add ``completion``.  ``make`` builds a function from prompts to texts once per worker; the default is
    a deterministic stub that returns a function with the prompt as its comment.  Where a text holds no code, the prompt is
    asked once more with ``simpler`` before it."""

    def stub():
        return lambda prompts: [f"```python\ndef solve(*args):\n    # {(p or '').splitlines()[0][:60] if p else ''}\n    return args\n```" for p in prompts]

    build = make or stub

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for s in batches:
            asked = s.tolist()
            texts = list(model(asked))
            again = [k for k, t in enumerate(texts) if not _HOLDS_CODE.search(t or "")]
            for k, t in zip(again, model([simpler + (asked[k] or "") for k in again]) if again else []):
                texts[k] = t
            yield pd.Series(texts, dtype=object)

    return df.withColumn("completion", run(F.col(prompt)))
