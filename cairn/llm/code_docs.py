"""Functions paired with their documentation.

Every row's content gives a symbol table: qualified names (owner class, its declared supertypes, name), normalised
signatures (parameter count and types where given), whether the declaration has a body, its own documentation.
Documented declarations without a body are joined to separate definitions of the same owner, name and signature in
the same repository, where overloads are told apart by signature; then trivial descriptions are dropped.

A tolerant lexer blanks comments and strings first, so code inside them is no function and code that no grammar
accepts is still read.

Defined results: null or empty content gives nothing; overloads and methods of several classes are pairs of their own,
while ``found`` gives a name once a row; ids repeated in the input are separate rows of it; other columns are ignored.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.code_text import closing, language_of, lex
from cairn.runtime import cut, distinct_names

MIN_WORDS, MIN_NEW_WORDS = 5, 3

_WORDS = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\W_㐀-䶿一-鿿豈-﫿]+")
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")
#: Where parameter tags and sections begin, to-do notes, notices of generated stubs.
_SECTION = re.compile(
    r"^\s*(?:[:@\\](?:param|parameter|arg|argument|key|keyword|type|return|returns|rtype|raise|raises|throws|exception|yield|yields|see|since|author|version|deprecated|example|template|property|constructor|receiver|sample|suppress|default|override|todo|var|ivar|cvar|meta|public|private|async|class|memberof|apiNote|implNote|implSpec|serial|serialData|link)\b"
    r"|(?:Args|Arguments|Params|Parameters|Keyword Args|Keyword Arguments|Other Parameters|Return|Returns|Yield|Yields|Raise|Raises|Throws|Except|Exceptions|Attributes|Example|Examples|See Also|Note|Notes|Warning|Warnings|Warns|References|Todo|Usage)\s*:\s*$"
    r"|(?:Args|Arguments|Params|Parameters|Returns|Yields|Raises)\s*:"
    r"|(?:Parameters|Other Parameters|Returns|Yields|Raises|Attributes|Examples?|See Also|Notes|Warnings|References)\s*\n\s*[-=~]{3,})",
    re.M,
)
_TODO = re.compile(r"\W*(?:todo|fixme|xxx|hack|tbd|to[- ]do)(?![^\W_])", re.I)
_STUB = re.compile(r"\W*(?:this\s+is\s+an?\s+)?(?:auto[-\s]?(?:matically)?[-\s]?generated|generated)\b(?=.*\b(?:stub|skeleton|placeholder|method|constructor|function|code)\b)", re.I | re.S)


def describe(doc: str) -> str:
    """The description of a documentation text: what stands before tags and sections, without markup."""
    m = _SECTION.search(doc)
    text = doc[: m.start()] if m else doc
    text = re.sub(r"\{@\w+\s*([^{}]*)\}", r"\1", text)
    text = re.sub(r"</?[A-Za-z][^<>\n]*>", " ", text)
    text = re.sub(r"!?\[([^\]\n]*)\]\([^)\n]*\)", r"\1", text)
    text = re.sub(r"&(?:nbsp|lt|gt|amp|quot);", " ", text)
    text = re.sub(r":\w+:`([^`]*)`", r"\1", text)
    text = re.sub(r"[`*]+", "", text)
    return " ".join(text.split())


def says_something(description: str, name: str, min_words: int = MIN_WORDS, min_new: int = MIN_NEW_WORDS) -> bool:
    words = [w.lower() for w in _WORDS.findall(description)]
    if len(words) < min_words or _TODO.match(description) or _STUB.match(description):
        return False
    return len(set(words) - {p.lower() for p in _NAME_PARTS.findall(name)} - {name.lower()}) >= min_new


def _comment_text(raw: str) -> str:
    body = raw[3:-2] if raw.endswith("*/") and len(raw) >= 5 else raw[3:]
    return "\n".join(re.sub(r"^\s*\*+ ?", "", line) for line in body.split("\n"))


def _unquote(raw: str) -> str | None:
    """The text of a Python string literal; None for bytes and formatted strings, which document nothing."""
    prefix = re.match(r"[A-Za-z]*", raw).group().lower()
    if "b" in prefix or "f" in prefix:
        return None
    body = raw[len(prefix) :]
    q = body[:3] if body[:3] in ('"""', "'''") else body[:1]
    inner = body[len(q) : -len(q)] if body.endswith(q) and len(body) >= 2 * len(q) else body[len(q) :]
    if "r" not in prefix and "\\" in inner:
        try:
            return ast.literal_eval(f"{q}{inner}{q}")
        except (SyntaxError, ValueError):
            return inner
    return inner


_DEF = re.compile(r"^([ \t]*)(?:(?:async[ \t]+)?def[ \t]+(\w+)|class[ \t]+(\w+))|(?<=[:;])[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", re.M)


def _python(text: str) -> Iterator[tuple]:
    lx = lex(text, True)
    strings = [m for m in lx.marks if m[0] != "comment"]
    starts = [m[1] for m in strings]
    stack: list[tuple[int, str, bool]] = []
    supers: dict[str, list[str]] = {}
    for m in _DEF.finditer(lx.code):
        indent = len((m.group(1) or "").expandtabs(8))
        while stack and stack[-1][0] >= indent:
            stack.pop()
        if m.group(3):
            bases = re.match(r"\s*\(([^()]*)\)", lx.code[m.end() :])
            supers[m.group(3)] = re.findall(r"\w+(?=\s*(?:,|$))", bases.group(1)) if bases else []
            stack.append((indent, m.group(3), True))
            continue
        name = m.group(2) or m.group(4)
        owner = stack[-1][1] if stack and stack[-1][2] else ""
        stack.append((indent, name, False))
        p = re.compile(r"\s*(?:\[[^\]]*\]\s*)?\(").match(lx.code, m.end())
        if not p:
            continue
        end = closing(lx.code, p.end() - 1)
        params = lx.code[p.end() : end - 1]
        colon = re.compile(r"\s*(?:->[^:\n]*(?:\[[^\n]*\])?[^:\n]*)?:").match(lx.code, end)
        doc, has_body = None, True
        if colon:
            at = re.compile(r"(?:\s|\\\n)*").match(lx.code, colon.end()).end()
            # comments are blanked, strings too: the first string is the documentation if no code stands before it
            k = bisect_left(starts, colon.end())
            first = strings[k] if k < len(strings) else None
            if first and first[1] <= at:
                tail = re.compile(r"[ \t]*(?=\n|;|\Z)").match(lx.code, first[2])
                raw = text[first[1] : first[2]]
                if tail:
                    doc = _unquote(raw)
            has_body = not re.compile(r"\s*\.\.\.\s*(?:\n|\Z)").match(lx.code, colon.end() if doc is None else first[2])
        stop = re.compile(r"\n(?=[ \t]{0,%d}\S)|\Z" % len(m.group(1)) if m.group(2) else r"\n|\Z").search(lx.code, colon.end() if colon else end).start()
        begin = m.start() + re.match(r"\s*", m.group()).end()
        yield name, owner, supers.get(owner, []), _signature(params, "python"), has_body, doc, begin, begin + len(text[begin:stop].rstrip())


#: Words that stand before "(" and are no function names.
_NOT_NAMES = frozenset("if for while switch catch return new throw else do try synchronized when super this typeof await yield case in of instanceof function assert delete void import export default constructor_".split())
_NAME = r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|native|synchronized|default|strictfp|override|open|suspend|inline|infix|operator|tailrec|external|actual|expect|data|export|declare|async|readonly|get|set|transient|volatile|sealed|noinline|crossinline|lateinit|const|pub|unsafe|extern|virtual|constexpr|explicit)\s+|\*\s*|\#)*"
_GENERIC = r"(?:<[^<>()]*(?:<[^<>()]*(?:<[^<>()]*>[^<>()]*)*>[^<>()]*)*>\s*)?"
_TYPE = rf"{_NAME}(?:\.{_NAME})*\s*{_GENERIC}(?:\[\s*\]\s*|\.\.\.\s*|[?&*]\s*)*"
_DECLS = [
    re.compile(rf"{_MODS}(?:fun|func|fn)\s+{_GENERIC}(?:\([^()]*\)\s*)?(?:{_TYPE}\.)?({_NAME})\s*{_GENERIC}(?=\()"),
    re.compile(rf"{_MODS}(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_NAME})\s*{_GENERIC}(?=\()"),
    re.compile(rf"{_MODS}(?:const|let|var|val)\s+({_NAME})\s*(?::[^=]*?)?=\s*(?:async\s*)?(?:function\b\s*\*?\s*(?:{_NAME})?\s*)?{_GENERIC}(?=\(|{_NAME}\s*=>)"),
    re.compile(rf"{_MODS}({_NAME})\s*(?::[^=;{{}}]*?)?=\s*(?:async\s*)?(?:function\b\s*\*?\s*(?:{_NAME})?\s*)?{_GENERIC}(?=\(|{_NAME}\s*=>)"),
    re.compile(rf"(?:{_NAME}\.)+({_NAME})\s*=\s*(?:async\s*)?(?:function\b\s*\*?\s*(?:{_NAME})?\s*)?{_GENERIC}(?=\(|{_NAME}\s*=>)"),
    re.compile(rf"{_MODS}({_NAME})\s*:\s*(?:async\s*)?(?:function\b\s*\*?\s*(?:{_NAME})?\s*)(?=\()"),
    re.compile(rf"{_MODS}{_GENERIC}{_MODS}{_TYPE}\s+({_NAME})\s*(?=\()"),
    re.compile(rf"{_MODS}({_NAME})\s*\??\s*{_GENERIC}(?=\()"),
]
_ANNOTATION = re.compile(rf"\s*@(?!interface\b)(?:\w+:)?{_NAME}(?:\.{_NAME})*")
_CLASS = re.compile(rf"\b(?:class|interface|object|trait|enum|record|struct)\s+({_NAME})\s*{_GENERIC}([^{{;]*)\{{")


#: What may stand between parameters and body: a result on the same line, exceptions, qualifiers; what no definition begins with.
_BODY = re.compile(r"\s*(?:(?:const|noexcept|override|final)\b\s*)*(?:throws\s[^{;=]*)?(?:(?::|->)[^{;=\n]*)?(?:where\s[^{=;]*)?\s*(?:\{|=(?![=>]))|\s*(?::[^;{}=\n]*|:[^;=\n]*)?=>|\s*:\s*\{[^{}]*\}[^;{}=\n]*\{")
_ARROW = re.compile(r"\s*(?::[^={};]*(?:\{[^{}]*\})?[^={};]*?)?=>")
#: What follows the parameters of a declaration that begins with its name.
_PLAIN = re.compile(r"\s*(?:throws\s[^{;]*)?(?::[^{;=]*)?(?:\{|;|\Z)|\s*:\s*\{")
_CANDIDATE = re.compile(r"(?:^|[;{}])[ \t]*+(?=[@A-Za-z_$*#<\u0080-￿][^;{}()\n]*(?:\(|=>))", re.M)
_NO_START = frozenset("if for while switch catch return new throw else do try synchronized when super this typeof await yield case assert delete import".split())


def _end(code: str, tail: int, body: bool) -> int:
    """Where the function ends whose parameters end at ``tail``: its brace, or its statement."""
    brace = re.compile(r"[^;{}]*\{").match(code, tail) if body else None
    return closing(code, brace.end() - 1) if brace else re.compile(r"[^;\n}]*;?").match(code, tail).end()


def _brace(text: str) -> Iterator[tuple]:
    lx = lex(text, False)
    code = lx.code
    classes = [(m.start(), closing(code, m.end() - 1), m.group(1), re.findall(rf"{_NAME}", re.sub(r"<[^<>]*>|\([^()]*\)|\b(?:extends|implements|with)\b", " ", m.group(2)))) for m in _CLASS.finditer(code)]
    marks = lx.marks
    seen: set[int] = set()
    for i, (kind, start, end) in enumerate(marks):
        if kind != "doc":
            continue
        at, k = end, i + 1
        blocked = False
        while True:  # annotations and line comments may stand between
            at = re.compile(r"[ \t\r\n\f]*").match(text, at).end()
            if k < len(marks) and marks[k][1] == at:
                if marks[k][0] != "line":
                    blocked = True
                    break
                at = marks[k][2]
                k += 1
                continue
            a = _ANNOTATION.match(code, at)
            if not a:
                break
            at = a.end()
            paren = re.compile(r"[ \t]*\(").match(code, at)
            if paren:
                at = closing(code, paren.end() - 1)
            while k < len(marks) and marks[k][1] < at:
                k += 1
        if blocked:
            continue
        if d := _declaration(code, at):
            seen.add(at)
            name, params, tail, body = d
            owner = next((c for c in reversed(classes) if c[0] < start < c[1]), None)
            yield name, owner[2] if owner else "", owner[3] if owner else [], _signature(params, ""), body, _comment_text(text[start:end]), at, _end(code, tail, body)
    bounds, open_ = iter(sorted(classes)), []
    coming = next(bounds, None)
    for c in _CANDIDATE.finditer(code):  # definitions without documentation
        at = c.end()
        while a := _ANNOTATION.match(code, at):
            at = a.end()
            paren = re.compile(r"[ \t]*\(").match(code, at)
            at = re.compile(r"\s*").match(code, closing(code, paren.end() - 1) if paren else at).end()
        word = re.compile(r"\w+").match(code, at)
        if at in seen or word and word.group() in _NO_START:
            continue
        first = re.compile(r"[^(;{}]*?(?:\(|=>)").match(code, at)
        if not first or code[first.end() - 1] == "(" and "=" not in first.group() and not _BODY.match(code, closing(code, first.end() - 1)) and "." not in first.group():
            continue
        d = _declaration(code, at)
        if d and d[3]:
            seen.add(at)
            while coming and coming[0] < at:
                open_.append(coming)
                coming = next(bounds, None)
            while open_ and open_[-1][1] <= at:
                open_.pop()
            name, params, tail, body = d
            yield name, open_[-1][2] if open_ else "", open_[-1][3] if open_ else [], _signature(params, ""), True, None, at, _end(code, tail, body)


def _declaration(code: str, at: int) -> tuple[str, str, int, bool] | None:
    """Name, parameters, their end and whether a body follows, of the function declared at ``at``."""
    for n, rx in enumerate(_DECLS):
        m = rx.match(code, at)
        if not m or m.group(1) in _NOT_NAMES:
            continue
        params, tail = "", m.end()
        if code[m.end() : m.end() + 1] == "(":
            tail = closing(code, m.end())
            params = code[m.end() + 1 : tail - 1]
        arrow = bool(_ARROW.match(code, tail)) or code[m.end() : m.end() + 1] != "("
        body = arrow or bool(_BODY.match(code, tail))
        if n in (2, 3, 4) and not (arrow or "function" in m.group()):
            continue
        if n == 7 and not _PLAIN.match(code, tail):
            continue
        return m.group(1), params, tail, body
    return None


def _signature(params: str, language: str) -> str:
    """Normalised: the count of parameters and their types where given, without names, defaults and spaces."""
    depth, part, parts = 0, "", []
    for ch in params:
        depth += (ch in "([{<") - (ch in ")]}>")
        if ch == "," and depth <= 0:
            parts.append(part)
            part = ""
        else:
            part += ch
    parts = [p.strip() for p in [*parts, part] if p.strip() not in ("", "self", "cls", "/", "*")]
    kinds = []
    for p in parts:
        p = re.sub(r"\s*=(?!>).*", "", p, flags=re.S)
        typed = p.partition(":")[2] if ":" in p else " ".join(re.sub(r"@\w+|\bfinal\b", " ", p).split()[:-1]) if language != "python" else ""
        kinds.append(re.sub(r"\s+", "", typed).rsplit(".", 1)[-1])
    return f"{len(parts)}({','.join(kinds)})"


def functions_of(text: str, language: str) -> Iterator[tuple]:
    """(name, owner, supertypes, signature, has_body, documentation or None, start, end) of functions in ``text``.
    Of brace languages: those with a ``/** */`` comment, and definitions without one."""
    yield from _python(text) if language == "python" else _brace(text)


_SYMBOLS = pa.schema(
    [("detail_id", pa.int64()), ("repo", pa.string()), ("owner", pa.string()), ("supertypes", pa.list_(pa.string())), ("func_name", pa.string()), ("signature", pa.string()), ("has_body", pa.bool_()), ("description", pa.string()), ("good", pa.bool_()), ("code_start", pa.int64()), ("code_end", pa.int64())]
)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, repo, language, path, text in zip(*[c.to_pylist() for c in b.columns]):
            for name, owner, supers, sig, body, doc, start, end in functions_of(text, language_of(language, path)):
                description = describe(doc) if doc is not None else None
                out.append((i, repo, owner, supers, name, sig, body, description, description is not None and says_something(description, name), start, end))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SYMBOLS)], schema=_SYMBOLS)


def symbols(details: DataFrame) -> DataFrame:
    """The symbol tables of all rows (see ``functions_of``), with cleaned descriptions and whether they say something."""
    rows = distinct_names(details, ["detail_id", "repo", "language", "file_path", "content"]).where("content <> ''")
    return rows.mapInArrow(_extract, "detail_id long, repo string, owner string, supertypes array<string>, func_name string, signature string, has_body boolean, description string, good boolean, code_start long, code_end long")


def pairs(details: DataFrame) -> DataFrame:
    """detail_id, owner, func_name, signature, code_start, code_end (characters from 0 of the function in its content),
    description, doc_from (the row the description stands in); one row a function.

    A function's own documentation wins.  An undocumented definition takes that of a documented declaration without
    body of the same repository, name and signature whose owner is the definition's class or one of its supertypes,
    or which like the definition has none (free functions);
    of several the one of the least detail_id.
    """
    sym = cut(symbols(details), "symbols")
    key = ["detail_id", "owner", "func_name", "signature", "code_start", "code_end"]
    own = sym.where("good").select(*key, "description", F.col("detail_id").alias("doc_from"))
    declared = sym.where("good and not has_body").groupBy("repo", F.col("owner").alias("declared_in"), "func_name", "signature").agg(F.min_by("description", "detail_id").alias("description"), F.min("detail_id").alias("doc_from"))
    bare = sym.where("has_body and description is null").select(*key, "repo", F.explode(F.array_union(F.array("owner"), "supertypes")).alias("declared_in"))
    joined = bare.join(declared, ["repo", "declared_in", "func_name", "signature"]).select(*key, "description", "doc_from")
    return own.unionByName(joined).groupBy(*key).agg(F.min_by(F.struct("description", "doc_from"), F.struct(F.col("doc_from") != F.col("detail_id"), "doc_from", "description")).alias("d")).select(*key, "d.description", "d.doc_from")


def found(details: DataFrame) -> DataFrame:
    """Functions documented in their own row: detail_id, func_name."""
    return pairs(details).where("doc_from = detail_id").select("detail_id", "func_name").distinct()
