"""Credentials in source code and configuration: find every live one with its place, and redact it in place.

Token formats, key armor and connection strings are one deterministic automaton (``automaton.Grammars``).  Their literal
beginnings, with the names of settings, headers and remarks, are sought by Aho-Corasick in overlapping chunks of the
text; from each beginning the automaton walks the text, whatever the chunk, so a value may have any length and its left
neighbour is always seen.  Spans are absolute positions, so what two chunks see counts once.  Settings, headers and
remarks have values of no fixed form; names and words around vouch for them.  Redaction splices a placeholder over the
spans only, so quotes and code around stay.

One pass, no shuffle of contents.  Defined results: null and empty content gives nothing; repeated rows each come
out; a key split over joined string literals starts at its first literal, and every literal is redacted; key armor
without an end is redacted to the end of the lines of key material that follow.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.automaton import Grammars
from cairn.runtime import distinct_names

#: Characters of a chunk, and of what it shares with the next (more than any beginning has).
WINDOW, OVERLAP = 1 << 16, 64
#: Characters of key material between BEGIN and END up to which it need not look like any.
ARMOR_SLACK = 1 << 13
PLACEHOLDER = "<REDACTED>"

#: Token formats (prefix, what follows).
TOKEN_FORMATS = [
    ("AKIA", r"[A-Z0-9]{16}"),
    ("ASIA", r"[A-Z0-9]{16}"),
    ("ghp_", r"[A-Za-z0-9]{36,}"),
    ("gho_", r"[A-Za-z0-9]{36,}"),
    ("ghu_", r"[A-Za-z0-9]{36,}"),
    ("ghs_", r"[A-Za-z0-9]{36,}"),
    ("ghr_", r"[A-Za-z0-9]{36,}"),
    ("github_pat_", r"[A-Za-z0-9_]{40,}"),
    ("glpat-", r"[A-Za-z0-9_-]{20,}"),
    ("xoxb-", r"[A-Za-z0-9-]{20,}"),
    ("xoxp-", r"[A-Za-z0-9-]{20,}"),
    ("xoxa-", r"[A-Za-z0-9-]{20,}"),
    ("xoxs-", r"[A-Za-z0-9-]{20,}"),
    ("xoxr-", r"[A-Za-z0-9-]{20,}"),
    ("xapp-", r"[A-Za-z0-9-]{20,}"),
    ("sk-", r"(?:proj-|ant-|svcacct-|or-)?[A-Za-z0-9_-]{20,}"),
    ("sk_live_", r"[A-Za-z0-9]{16,}"),
    ("sk_test_", r"[A-Za-z0-9]{16,}"),
    ("rk_live_", r"[A-Za-z0-9]{16,}"),
    ("whsec_", r"[A-Za-z0-9+/=]{20,}"),
    ("AIza", r"[A-Za-z0-9_-]{35}"),
    ("ya29.", r"[A-Za-z0-9_-]{20,}"),
    ("hf_", r"[A-Za-z0-9]{30,}"),
    ("npm_", r"[A-Za-z0-9]{36}"),
    ("pypi-", r"[A-Za-z0-9_-]{30,}"),
    ("SG.", r"[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    ("dop_v1_", r"[a-f0-9]{64}"),
    ("shpat_", r"[a-fA-F0-9]{32}"),
    ("eyJ", r"[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]
#: Formats that end where no letter or digit follows.
ENDED = ("AKIA", "ASIA")
ARMOR = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
CONNECTION = r"""://[^\s:/@"'`<>]*:[^\s/@"'`]*(?:/[^\s/@"'`]*)?@[\w.$%{\[-]"""
#: Last words of setting names that hold credentials; "key" only after one of the second list.
SECRET_WORDS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "credential", "credentials")
KEY_KINDS = frozenset("api access auth secret private service client signing sign encryption master account admin session app application shared storage ssh bearer crypto hmac jwt license webhook root deploy deployment subscription consumer".split())
_REMARKS = ("login", "credentials", "still valid", "for now", "fallback", "use this", "temporary", "hardcoded", "hard-coded", "do not commit", "don't commit", "rotate")
_DUMMY = re.compile(
    r"x{4,}|\*{3,}|\.{3}|^<.*>$|^\[.*\]$|\$\{|\{\{|\$\(|^\$\w|^%[A-Za-z_]\w*%$|%\(\w|^\{\w*\}$|example|dummy|placeholder|change[-_ ]?(?:me|it|this)|replace[-_ ]?(?:me|this|with)|redacted|insert[-_ ]|^(?:your|my|some|the|enter|put|add|fake|mock|insert|todo)[-_ ]|^(?:test|sample|demo|default|none|null|nil|todo|tbd|foo|bar|foobar|baz|secret|password|passw0rd|token|hunter|letmein|qwerty|abc|admin|guest|user|root|pass)[-_]?\d{0,4}[!@#$]?$|[-_](?:here|goes[-_]here)$|^[a-z]+(?:[-_.][a-z]+)*[-_.](?:password|secret|token|key|id|name)$|^(?:0123|1234|abcd)",
    re.I,
)
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_DIGEST = re.compile(r"^(?:sha(?:1|224|256|384|512)|md5|blake2[bs]?)[-:$]", re.I)
_REFERENCE = re.compile(r"^(?:(?:vault|env|secret|secrets|ref|ssm|arn|file|config|op|keyring|kms)[:/]|(?:~|\.{1,2})?/[A-Za-z_.-]+(?:/[A-Za-z_.-]+)*/?$|https?://[^@]*$|process\.env|os\.environ|System\.getenv|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$)|^[A-Za-z_-]+(?:[/.][A-Za-z_-]+)+$")


def usable(value: str, least: int = 8) -> bool:
    """Whether a value can be a live credential: no placeholder, dummy, name, reference, id or digest."""
    if len(value) < least or re.search(r"\s", value) or _DUMMY.search(value) or _UUID.match(value) or _DIGEST.match(value) or _REFERENCE.match(value):
        return False
    if len(set(value)) < 5 or value.startswith("data:"):
        return False
    digits, symbols = any(c.isdigit() for c in value), any(c in "!@#$%^&*+?~=" for c in value)
    if not (digits or symbols or _scrambled(value)) or not any(c.isalpha() for c in value) and len(value) < 12:
        return False
    return not re.fullmatch(r"v?\d+(?:[._-]\d+)*|[a-z]+_?\d{1,2}|\w+\(.*\)|[\w.]+\[.*\]", value)


def _scrambled(value: str) -> bool:
    """Letters only, of both cases and in no order that words have: its parts by case are short on average."""
    parts = _WORDS.findall(value)
    return value.isalpha() and len(value) >= 8 and len(parts) * 2.6 > len(value)


def _random_looking(value: str) -> bool:
    """For values that no name vouches for: of mixed kinds, no plain words."""
    if not usable(value, 12):
        return False
    kinds = any(c.islower() for c in value) + any(c.isupper() for c in value) + any(c.isdigit() for c in value)
    if re.search(r"\.[a-z]{1,5}$", value):
        return False  # a file's name
    mixed = kinds == 3 or len(value) >= 20 and kinds >= 2 and sum(c.isdigit() for c in value) >= 3
    phrase = re.search(r"[A-Za-z]+[-_][A-Za-z]+[-_].*\d|[!@#%^&*+]", value)
    return bool(phrase or mixed and not re.search(r"^[a-z]+(?:[-_/.][a-z]+){2,}", value))


_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def holds_credential(name: str) -> bool:
    """Whether a setting of this name holds a credential, by its last words."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words:
        return False
    last, before = words[-1], words[-2] if len(words) > 1 else ""
    if before in ("public", "pub", "primary", "foreign", "csrf", "eos", "bos", "unk"):
        return False
    if last in SECRET_WORDS or last.endswith(("password", "passwd", "passphrase", "secret")) or last in ("apikey", "authkey", "accesskey", "secretkey", "privatekey", "authtoken"):
        return True
    return last == "key" and before in KEY_KINDS


_IDENT_BACK = re.compile(r"[\w.\-\[\]\"'$]*$")
_ASSIGN = re.compile(
    r"""(?P<close>["'`]?\]?)(?P<label>\s*\*/\s*(?=["'`]))?(?:\s*:\s*[A-Za-z_][\w.<>?\[\]| ]{0,40}?(?=\s*=))?\s*(?P<op>:=|=>|==?|:|,|(?<=\*/)|(?<=\*/\s))\s*(?:\(\s*)?(?:[rbufRBUF]{1,2}(?=["']))?(?:(?P<q>\"\"\"|'''|["'`])(?P<v>(?:\\.|(?!(?P=q))[^\n\\])*)|(?P<bare>[^\s"'`,;(){}\[\]<>]+)(?=[\s,;"'`]|$))""",
    re.X | re.M,
)
_JOINED = re.compile(r"""["'`](?:\s*\)?\s*[+.]\s*|[ \t]*\n\s*)["'`]([^"'`\n]+)(?=["'`])""")
_ARMOR = re.compile(ARMOR)
_ARMOR_END = re.compile(r"-----END (?:[A-Z0-9]+ )*?PRIVATE KEY(?: BLOCK)?-----")
_ARMOR_RUN = re.compile(r"(?:[A-Za-z0-9+/=]|\\[nr]){16,}")
_ARMOR_HEADER = re.compile(r"[\s\"'`#*/+>]*(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID)\s*:")
_ARMOR_LAST = re.compile(r"[\s\"'`#*/+>]*(?:[A-Za-z0-9+/]{1,15}={0,2}|=[A-Za-z0-9+/]{4})(?=(?:\\[nr]|[\s\"'`,;+)])*$)")
_SCHEME = re.compile(r"(Bearer|Basic|Token|token|bearer|basic)\s+([A-Za-z0-9+/_=.~:-]{8,})")
_LOGIN = re.compile(r"(?:login|credentials|creds|account|user)\b[^\n:=]{0,40}[:=]\s*[\"']?[\w.@-]+\s*(?:/|:|\|)\s*[\"']?([^\s\"'`,;]+)", re.I)
_EXPORT, _BLANKS, _LINE_ENDS = re.compile(r"(?:export|set|ENV|env|-)\s"), re.compile(r"[^\S\n]*"), re.compile(r"[^\S\n]*(?=\n|\Z)")
#: Characters before a word in which the start of a setting's name is sought.
LONGEST_NAME = 200
_COMMENT = re.compile(r"^\s*(?:#|//|\*|/\*(?![^\n]*\*/[^\n]*\w)|--|;|<!--)|(?:\s#\s|\s//\s)")
_REMARK_VALUE = re.compile(r"(?<![\w+/.-])([A-Za-z0-9][A-Za-z0-9+/_=!@#%^&*.-]{11,})")
_AFTER_WORD = re.compile(r"[^\n:=]{0,24}?[:=]?\s*[\"'`]?([A-Za-z0-9][A-Za-z0-9+/_=!@#%^&*.-]{11,})")
_NOT_SECRET_NEAR = re.compile(r"\b(?:commit|sha\d*|digest|checksum|integrity|md5|uuid|guid|revision|rev|hash|fingerprint|version|build|id|request[-_ ]id|trace)\b[^\n]{0,12}$", re.I)


def _beginnings() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("grammar", ["-----begin ", "://", *(p.lower() for p, _ in TOKEN_FORMATS)]), ("scheme", ["bearer ", "basic ", "token "]), ("name", [*SECRET_WORDS, "key"]), ("remark", _REMARKS)):
        for w in words:
            a.add_word(w, [*a.get(w, []), (kind, w)])
    a.make_automaton()
    return a


#: Both automata, once a worker.
_MADE: list = []


def _automata() -> tuple[ahocorasick.Automaton, Grammars]:
    if not _MADE:
        _MADE.extend((_beginnings(), Grammars({"armor": ARMOR, "connection": CONNECTION, **{p: re.escape(p) + tail for p, tail in TOKEN_FORMATS}})))
    return _MADE[0], _MADE[1]


class _Lines:
    """The line around a position and where its remark begins, remembered for the next position."""

    def __init__(self, text: str):
        self.text, self.start, self.first, self.end, self.remark, self.told = text, 0, 0, -1, -1, -1

    def at(self, place: int) -> tuple[int, int, bool]:
        if not self.start <= place <= self.end:
            self.start = self.text.rfind("\n", 0, place) + 1
            self.end = self.text.find("\n", place)
            self.end = len(self.text) if self.end < 0 else self.end
            self.first = _BLANKS.match(self.text, self.start).end()
            m = _COMMENT.search(self.text[self.start : self.end])
            self.remark = self.start + m.start() if m else -1
        return self.start, self.end, 0 <= self.remark <= place


def _scan(text: str, low: str, lines: _Lines, base: int, stop: int) -> Iterator[tuple[int, int]]:
    """Spans of credentials that begin in one chunk; that of key armor ends at -1, which stands for ``_armor_end``."""
    beginnings, grammars = _automata()
    for end, hits in beginnings.iter(low, base, stop):
        for kind, word in hits:
            at = end - len(word) + 1
            if kind == "grammar":
                for name, to in grammars.longest(text, at).items():
                    if name == "armor":
                        if len(re.findall(r"[A-Za-z0-9+/=]", re.sub(r"\\[nr]", "", text[to : to + 200]).split("-----")[0])) >= 24 and "..." not in text[to : to + 40]:
                            yield at, -1
                    elif name == "connection":
                        value = text.index(":", at + 3) + 1, to - 2  # the user holds no colon, the password no at-sign
                        if usable(text[slice(*value)], 6):
                            yield value
                    elif name.lower() == word:
                        if at and (text[at - 1].isalnum() or text[at - 1] in "_/+") and not text.startswith("\\n", at - 2):
                            continue
                        if name in ENDED and text[to : to + 1].isalnum():
                            continue
                        token = text[at:to]
                        if not _DUMMY.search(token) and len(set(token)) >= 9 and re.search(r"\d", token if name == "AKIA" else token[len(name) :]):
                            yield at, to
            elif kind == "scheme":
                m = _SCHEME.match(text, at)
                if not m:
                    continue
                value = m.group(2)
                if word == "basic ":
                    try:
                        user, colon, password = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode().partition(":")
                        if colon and usable(password, 6):
                            yield m.span(2)
                    except (binascii.Error, ValueError):
                        pass
                elif word == "bearer " and usable(value, 12):
                    yield m.span(2)
                elif word == "token " and re.search(r"authorization[\"']?\s*[:,=]\s*[\"']?$", low[max(0, at - 30) : at]) and usable(value, 12):
                    yield m.span(2)
            elif kind == "name":
                stop = end + 1
                if stop < len(text) and (text[stop].isalnum() or text[stop] == "_"):
                    continue
                head = _IDENT_BACK.search(text, max(0, at - 120), at).group() + text[at:stop]  # two words decide, none of them that long
                start, line_end, comment = lines.at(at)
                if holds_credential(re.split(r"[\"'\[\]]", head)[-1] or head):
                    m = _ASSIGN.match(text, stop)
                    if m and (m.group("op") != "," or m.group("close")) and m.group("op") != "==":
                        if m.group("v") is not None:
                            value = m.group("v")
                            begin = m.start("v")
                            lead = re.match(r"(?:Bearer|Basic|Token)\s+", value)
                            if lead:
                                continue  # the scheme's own grammar decides
                            parts, after = [(begin, m.end("v"))], m.end("v")
                            while j := _JOINED.match(text, after):
                                parts.append(j.span(1))
                                after = j.end(1)
                            if usable("".join(text[a:b] for a, b in parts)) and not value.startswith("-----"):
                                yield from parts
                        elif m.group("bare") and m.end("bare") <= line_end:
                            value = m.group("bare")
                            begin = max(lines.first, at - LONGEST_NAME)
                            before = text[begin:at]
                            alone = begin == lines.first  # nothing but blanks before
                            setting = comment or _EXPORT.match(text, lines.first) or alone and m.group("op") == ":" and re.match(r"(?:-\s*)?[\w.\-\"']*$", before) or alone and m.group("op") == "=" and re.match(r"[\w.\-]*$", before) and ("." in head and _LINE_ENDS.match(text, m.end("bare")) or head.isupper() and text[stop : stop + 1] == "=")
                            if (setting or text[at - 1 : at] in "?&" or re.search(r"[?&][\w-]*$", before)) and usable(value.rstrip("\\")) and not re.search(r"^\w+\.\w+$|\.\w+\(", value):
                                yield m.span("bare")
                elif comment and word in ("key", "token", "secret", "password", "passphrase", "pwd", "credential") and text[at - 1 : at] not in ("/", ".") and text[stop : stop + 1] not in ("/", "."):
                    m = _AFTER_WORD.match(text, stop)
                    if m and m.end() <= line_end and _random_looking(m.group(1)) and not _NOT_SECRET_NEAR.search(text, max(start, m.start(1) - 60), m.start(1)):
                        yield m.span(1)
            elif kind == "remark":
                start, line_end, _ = lines.at(at)
                if start == lines.told:
                    continue  # all that follows in the line is seen already
                lines.told = start
                line = text[start:line_end]
                if lines.remark < 0 and not re.match(r"\s*(?:-\s*)?(?:login|credentials|creds)\b", line, re.I):
                    continue
                m = _LOGIN.search(line)
                if m and usable(m.group(1)):
                    yield start + m.start(1), start + m.end(1)
                    continue
                for m in _REMARK_VALUE.finditer(line, max(0, at - start)):
                    if _random_looking(m.group(1)) and not _NOT_SECRET_NEAR.search(line, max(0, m.start(1) - 60), m.start(1)):
                        yield start + m.start(1), start + m.end(1)


def _armored(line: str) -> int:
    """Where key material ends in a line that is mostly of it; 0 if it is not."""
    runs = list(_ARMOR_RUN.finditer(line))
    return runs[-1].end() if 2 * sum(len(m.group()) for m in runs) >= len(re.sub(r"\s", "", line)) > 0 and runs else 0


def _armor_end(text: str, at: int) -> int:
    """The end of the private key whose BEGIN line stands at ``at``: its END, however far, unless another key begins
    before or far more than key material lies between; else the end of the lines of key material that follow."""
    begin = _ARMOR.match(text, at).end()
    following = _ARMOR.search(text, begin)
    end = _ARMOR_END.search(text, begin, following.start() if following else len(text))
    if end and (end.start() - begin < ARMOR_SLACK or _armored(text[begin : end.start()])):
        return end.end()
    stop, pos, limit = begin, begin, following.start() if following else len(text)
    while pos < limit:
        line_end = text.find("\n", pos, limit)
        line = text[pos : limit if line_end < 0 else line_end]
        if n := _armored(line):
            stop = pos + n
        elif stop > begin and (m := _ARMOR_LAST.match(line)):
            stop = pos + m.end()
        elif line.strip(" \t\r\"'`#*/+>,;\\nr") and not _ARMOR_HEADER.match(line):
            break
        pos += len(line) + 1
    return stop if stop > begin else min(limit, begin + 400)


def spans(text: str) -> list[tuple[int, int]]:
    """Credentials in ``text`` as disjoint spans in order; overlapping chunks, absolute places, each once."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change length in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found: set[tuple[int, int]] = set()
    armor: set[int] = set()
    lines = _Lines(text)
    for base in range(0, len(text), WINDOW - OVERLAP):
        for s, e in _scan(text, low, lines, base, min(len(text), base + WINDOW)):
            armor.add(s) if e < 0 else found.add((s, e))
    found.update((s, _armor_end(text, s)) for s in armor)
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def redact(text: str, placeholder: str = PLACEHOLDER, found: list[tuple[int, int]] | None = None) -> str:
    out, at = [], 0
    for s, e in spans(text) if found is None else found:
        out += (text[at:s], placeholder)
        at = e
    return "".join(out) + text[at:]


_BETWEEN = re.compile(r"""["'`](?:\s*\)?\s*[+.]\s*|[ \t]*\n\s*)["'`]""")


def starts(text: str, found: list[tuple[int, int]] | None = None) -> list[int]:
    """Line numbers, from 1, where credentials start; joined literals after the first are part of it."""
    out, line, counted, last_end = [], 1, 0, -1
    for s, e in spans(text) if found is None else found:
        line, counted = line + text.count("\n", counted, s), s
        if not (0 <= last_end <= s and _BETWEEN.fullmatch(text, last_end, s)) and out[-1:] != [line]:
            out.append(line)
        last_end = e
    return out


def _map(df: DataFrame, key: str, column: str, fn, schema: str) -> DataFrame:
    rows = distinct_names(df, [key, column]).where(F.col(column).isNotNull()).select(F.col(key).cast("string").alias("row_key"), F.col(column).alias("content"))
    return rows.mapInArrow(fn, schema)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(k, n) for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n in starts(text)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int64())], ["row_key", "line_no"])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [(t, spans(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([redact(t, found=s) for t, s in texts], pa.string()), pa.array([len(starts(t, s)) for t, s in texts], pa.int32())], ["row_key", "content", "credentials"])


def find(df: DataFrame, key: str, column: str = "content") -> DataFrame:
    """row_key, line_no (from 1) of every credential's start."""
    return _map(df, key, column, _lines, "row_key string, line_no long")


def redacted(df: DataFrame, key: str, column: str = "content") -> DataFrame:
    """row_key, content with every credential replaced, number of credentials; rows with null content are left out."""
    return _map(df, key, column, _clean, "row_key string, content string, credentials int")


def found(details: DataFrame, chunks: DataFrame) -> DataFrame:
    both = find(details, "detail_id").select(F.lit("details").alias("src_table"), "row_key", "line_no").unionByName(find(chunks, "chunk_id").select(F.lit("chunks").alias("src_table"), "row_key", "line_no"))
    return both.distinct()
