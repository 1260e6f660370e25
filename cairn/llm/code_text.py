"""Lexing shared by the code operators: comments, strings and function declarations of Python and brace languages.

Works on fragments and on code no grammar accepts.  Comments and strings are blanked in place, so positions stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_PY = re.compile(
    r"""(?P<comment>\#[^\n]*)|(?P<triple>[A-Za-z]{0,2}(?P<q>\"\"\"|''')(?:\\.|(?!(?P=q)).)*(?:(?P=q)|\Z))|(?P<plain>(?<![A-Za-z0-9_])[A-Za-z]{0,2}(?:"(?:\\.|[^"\\\n])*(?:"|$)|'(?:\\.|[^'\\\n])*(?:'|$)))""",
    re.S | re.M | re.X,
)
_BRACE = re.compile(
    r"""(?P<doc>/\*\*(?!/)(?:(?!\*/).)*(?:\*/|\Z))|(?P<block>/\*(?:(?!\*/).)*(?:\*/|\Z))|(?P<line>//[^\n]*)|(?P<text>\"\"\"(?:(?!\"\"\").)*(?:\"\"\"|\Z)|"(?:\\.|[^"\\\n])*(?:"|$)|'(?:\\.|[^'\\\n])*(?:'|$)|`(?:\\.|[^`\\])*(?:`|\Z))""",
    re.S | re.M | re.X,
)
_NOT_NL = re.compile(r"[^\n]")


@dataclass
class Lexed:
    """code: the text with comments and string bodies blanked; marks: (kind, start, end) of them in order."""

    code: str
    marks: list[tuple[str, int, int]] = field(default_factory=list)


def lex(text: str, python: bool) -> Lexed:
    out, at, marks = [], 0, []
    for m in (_PY if python else _BRACE).finditer(text):
        kind = m.lastgroup if m.lastgroup != "q" else "triple"
        marks.append((kind, m.start(), m.end()))
        out += (text[at : m.start()], _NOT_NL.sub(" ", m.group()))
        at = m.end()
    out.append(text[at:])
    return Lexed("".join(out), marks)


#: File name endings to languages.
EXTENSIONS = {"py": "python", "pyi": "python", "java": "java", "kt": "kotlin", "kts": "kotlin", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "php": "php", "swift": "swift", "scala": "scala"}


def language_of(language: str | None, path: str | None) -> str:
    """The ending of the path decides, else the given language (in any case), else ''."""
    ending = (path or "").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    return EXTENSIONS.get(ending) or (language or "").strip().lower()


def closing(code: str, at: int) -> int:
    """Position after the bracket that closes the one at ``at`` (end of text if none does)."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(code, at):
        depth += 1 if m.group() in "([{" else -1
        if depth <= 0:
            return m.end()
    return len(code)
