"""Broken prompt-response pairs.

The response is cut into clauses (sentences, list blocks, code blocks); a conditional random field tags each as answer,
refusal, echo, foreign or unfinished.  What a clause says enters as its words, pairs of words and letter sequences, all
hashed; how it stands to the question and to its neighbours as a few more features.  Many clauses mean nothing by
themselves ("Is there anything else?", a short line without a language); what stands beside them decides, through the
field's transitions.  The coverage of the tags over the response, in words, gives the pair's defect.

The field is trained here on ``TRAINING_SEQUENCES`` composed from parts of sentences in ten languages (seeded), and on
at most ``WEAK_ROWS`` rows of the table, those of least hashed id and at most ``WEAK_CHARS`` characters, which the rules
below label where they are sure.  The rules label this sample only: none of them decides about a row.  One pass over
the rows, no shuffle of texts; only the weights are shared.

Defined results: a null, blank or placeholder answer is ``empty``; rows without question (source_text and
instruction null) are left out; a missing end tag is no defect; repeated rows each come out.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import pair_phrases as S
from cairn.llm.crf import LinearChainCRF
from cairn.llm.language import asked_for, language
from cairn.runtime import distinct_names

TAGS = ["answer", "refusal", "echo", "foreign", "unfinished"]
TRAINING_SEQUENCES, WEAK_ROWS, WEAK_CHARS = 4000, 1500, 4000
#: Numbers that words, pairs of words and letter sequences are hashed to.
LEXICAL, LEXICAL_VALUE, RELATED_VALUE = 1 << 14, 2.0, 4.0
_I = {t: i for i, t in enumerate(TAGS)}
#: Shares of a response's words (of its prose, for the language) that a tag must cover.
REFUSED, COPIED, FOREIGN = 0.6, 0.8, 0.5

#: Phrases that decline, in four languages; with the next three they label the sample for training.
_DECLINE = re.compile(
    r"\b(?:i|we)(?:'m|’m| am|'re| are)?\s+(?:(?:really|truly|just|simply|still)\s+)?(?:can(?:no|')?t|can’t|cannot|could(?: not|n't)|won't|won’t|will not|would rather not|(?:may|must|shall|should) not|unable to|not able to|not (?:allowed|permitted|in a position|willing|going|comfortable)|(?:have|need|must) to (?:refuse|decline)|must (?:refuse|decline)|refuse to|decline to|do not feel comfortable|don't feel comfortable)"
    r"|\b(?:isn't|is not|wouldn't be|not) possible for me\b|\bnot something i(?:'m| am|’m)? (?:comfortable|able|allowed|willing)|\bgoes against (?:my|our)\b|\bagainst my (?:guidelines|policy|policies|rules|programming)|\boutside (?:of )?what i(?:'m| am|’m) (?:allowed|able|permitted)|\bbeyond what i(?:'m| am) (?:allowed|able)|\bmy (?:guidelines|policies|policy) (?:forbid|prohibit|do(?:es)? not allow|don't allow|prevent)|\bi (?:was|am|'m) not (?:designed|trained|built) to"
    r"|\b(?:kann|darf|möchte|werde|will) (?:ich|wir) (?:\w+ ){0,5}?(?:nicht|keine?n?)\b|\b(?:ich|wir) (?:kann|darf|möchte|werde|will|können|dürfen) (?:\w+ ){0,5}?(?:nicht|keine?n?)\b|\b(?:ich|wir) (?:muss|müssen) (?:\w+ ){0,4}?(?:ablehnen|verweigern)|\bnicht (?:möglich|erlaubt|gestattet)\b.*\bmir\b|\bmir (?:ist )?(?:es )?(?:leider )?nicht (?:möglich|erlaubt)|\bnicht in der lage\b"
    r"|\bno (?:me es posible|puedo|podemos|debo|estoy (?:autorizado|capacitado|en condiciones)|me siento cómodo|tengo permitido|voy a poder)\b|\bme (?:niego|veo obligado a (?:rechazar|negarme))\b|\b(?:debo|tengo que) (?:negarme|rechazar|declinar)\b|\bva en contra de mis\b"
    r"|(?:我|本模型|作为[^，。]{1,10}，?我?)[^，。；]{0,6}?(?:不能|无法|不可以|不方便|不会|没有办法|没办法|拒绝|不便)|(?:无法|不能)(?:回答|提供|协助|帮助|满足|完成|继续|讨论|给出)",
    re.I,
)
_SORRY = re.compile(r"\b(?:sorry|apologi[sz]e|regrettably|unfortunately|sadly|i am afraid|i'm afraid|as an? (?:ai|assistant|language model)|for safety reasons|to stay within policy|leider|tut mir leid|entschuldigung|lo siento|lamento|lamentablemente|desafortunadamente)\b|抱歉|对不起|很遗憾|作为一个", re.I)
#: Openings and closings that answer nothing by themselves.
_COURTESY = re.compile(r"^\W*(?:hmm+|well|thanks?(?: you)?(?: for (?:asking|your (?:question|message)))?|great question|hello|hi|is there anything else.*|please consult .*|let me know if .*|feel free to .*|i hope (?:this|that) helps|(?:please )?ask (?:me )?(?:something|anything) else|gracias(?: por preguntar)?|danke(?: für die frage)?|谢谢.{0,6}|您好|你好|if you have any other .*|¿?hay algo más.*|kann ich sonst .*)\W*$", re.I)
_GOES_ON = re.compile(r"\b(?:but|however|though|yet|still)\b[^.!?]*\b(?:this|here|the following|below|instead|should|would)\b|\b(?:aber|jedoch)\b[^.!?]*\b(?:hier|folgend\w*|so)\b|\bpero\b[^.!?]*\b(?:aquí|esto|siguiente)\b|但[^。]*(?:可以|如下|以下|这)", re.I)
_PLACEHOLDERS = frozenset("na null none nil nan empty noanswer answer response output todo tbd undefined blank placeholder noresponse noreply unanswered nodata notavailable notapplicable noansweravailable pending nicht keineantwort sinrespuesta 无 空 暂无 无答案 没有答案".split())
_ECHO_LEAD = re.compile(r"^\s*(?:(?:\*{1,2})?[^\W\d_]{1,12}(?: [^\W\d_]{1,12}){0,3}(?:\*{1,2})?\s*[:：](?:\*{1,2})?\s*|>\s*)+", re.I)
_TAG = re.compile(r"<\|[^|<>]*\|>|</?(?:s|eos|end|pad|answer|response|assistant|output)>", re.I)
_FENCE = re.compile(r"^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)", re.S | re.M)
_CODE_SPAN = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r"\"[^\"\n]{2,160}\"|“[^”\n]{2,160}”|«[^»\n]{2,160}»|「[^」\n]{2,160}」")
_ALNUM = re.compile(r"[^\W_]+")
_PIECE = re.compile(r"[㐀-䶿一-鿿]|[^\W_㐀-䶿一-鿿]+")
_SPLIT = re.compile(r"(?<=[.!?。！？…])[\"'”’)\]]*(?:\s+|(?<=[。！？])(?=\S))|\n\s*\n")
_ENDED = re.compile(r"[.!?。！？…:：;；]['\"”’)\]*_»]*\s*$")
_CALL = re.compile(r"\b\w+\s?\([^()\n]*\)")
_LIST_LINE = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+\S")


def normal(text: str) -> list[str]:
    return [w.lower() for w in _PIECE.findall(text)]


def clauses(answer: str) -> list[tuple[str, str]]:
    """(kind, text): code (closed), open (code fence never closed), list, prose."""
    out, at = [], 0

    def prose(text: str) -> None:
        for block in re.split(r"\n\s*\n", text):
            lines = [x for x in block.split("\n") if x.strip()]
            if lines and all(_LIST_LINE.match(x) for x in lines):
                out.append(("list", block.strip()))
                continue
            for piece in _SPLIT.split(block):
                if piece and piece.strip():
                    out.append(("prose", piece.strip()))

    for m in _FENCE.finditer(answer):
        prose(answer[at : m.start()])
        body = m.group()
        closed = bool(re.search(r"\n[ \t]*(?:```|~~~)[ \t]*$", body))
        out.append(("code" if closed else "open", body))
        at = m.end()
    prose(answer[at:])
    return out


FEATURES = [
    "bias", "code", "open", "list", "prose", "echo", "echo_led", "overlap_most", "overlap_half", "overlap_some", "other_language", "same_language", "no_language", "ended", "not_ended", "last", "first", "only", "short", "has_code_span", "has_quote", "has_number",
    "last_not_ended", "last_not_ended_long", "whole_code", "beside_code",
]
_F = {f: i for i, f in enumerate(FEATURES)}
_RELATED = frozenset(_F[f] for f in ("echo", "other_language", "open"))


class _Lexicon(dict):
    """Feature numbers of a word (itself and its sequences of four letters) or of a pair of words; emptied when full."""

    def __missing__(self, key):
        if len(self) > 1 << 18:
            self.clear()
        if isinstance(key, tuple):
            found = [" ".join(key)]
        else:
            found = [f"={key}", *(f" {key} "[k : k + 4] for k in range(len(key) - 1) if len(key) > 3)]
        out = self[key] = [len(FEATURES) + zlib.crc32(x.encode()) % LEXICAL for x in found]
        return out


_LEXICON = _Lexicon()


def _said(text: str) -> str:
    return _QUOTED.sub(" ⟦q⟧ ", _CODE_SPAN.sub(" ⟦c⟧ ", text))


def features(question: str, answer: str) -> tuple[list[tuple[str, str]], list[tuple[list[int], list[float]]]]:
    """Clauses of the answer, and the features that each has: numbers and values (words count less the more there are)."""
    parts = clauses(answer)
    q_words = normal(question)
    q_text = " " + " ".join(q_words) + " "
    q_pairs = set(zip(q_words, q_words[1:]))
    q_lang = language(_CODE_SPAN.sub(" ", _FENCE.sub(" ", question)))
    allowed = asked_for(question) | ({q_lang} if q_lang else set())
    rows = []
    for k, (kind, text) in enumerate(parts):
        f, lexical = {"bias", kind}, []
        if kind == "prose":
            said = _said(text)
            lead = _ECHO_LEAD.match(text)
            words = normal(_ECHO_LEAD.sub("", text))
            if lead and not words:
                f.add("echo_led")
            if len(words) >= 3 and f" {' '.join(words)} " in q_text:
                f |= {"echo", "echo_led"} if lead else {"echo"}
            elif len(words) >= 3:
                share = sum(p in q_pairs for p in zip(words, words[1:])) / (len(words) - 1)
                if share >= 0.3:
                    f.add("overlap_most" if share >= 0.95 else "overlap_half" if share >= 0.6 else "overlap_some")
            lang = language(said)
            f.add("no_language" if lang is None or not q_lang else "same_language" if lang in allowed else "other_language")
            ended = bool(_ENDED.search(text))
            f.add("ended" if ended else "not_ended")
            if len(words) <= 3:
                f.add("short")
            if "`" in text:
                f.add("has_code_span")
            if "⟦q⟧" in said:
                f.add("has_quote")
            if re.search(r"\d", text):
                f.add("has_number")
            if k == len(parts) - 1 and not ended and not f & {"echo", "overlap_most"}:  # a copied end isn't broken off
                f.add("last_not_ended")
                plain = _CALL.sub(" ", _CODE_SPAN.sub(" ", text))
                words, prose_words = normal(_CALL.sub(" ", text)), normal(plain)
                if len(words) >= 4 and len(prose_words) >= 2 or k and parts[k - 1][0] != "code" and len(prose_words) >= 1 or len(parts) > 1 and len(prose_words) >= 1:
                    f.add("last_not_ended_long")
            # what repeats the question says nothing by its words
            tokens = [] if f & {"echo", "overlap_most"} else [w if not w.isdigit() else "0" for w in normal(said)]
            for w in tokens:
                lexical += _LEXICON[w]
            for pair in zip(tokens, tokens[1:]):
                lexical += _LEXICON[pair]
        if kind in ("code", "list") and len(parts) == 1:
            f.add("whole_code")
        if kind not in ("code", "open") and any(x[0] in ("code", "open") for x in (parts[k - 1 : k] if k else []) + parts[k + 1 : k + 2]):
            f.add("beside_code")
        if k == len(parts) - 1:
            f.add("last")
        if not k:
            f.add("first")
        if len(parts) == 1:
            f.add("only")
        said_so, words = sorted(_F[name] for name in f), sorted(set(lexical))
        rows.append((said_so + words, [RELATED_VALUE if x in _RELATED else 1.0 for x in said_so] + [LEXICAL_VALUE / max(1, len(words)) ** 0.5] * len(words)))
    return parts, rows


def _sequence(rng: random.Random) -> tuple[str, str, list[str]]:
    """Question, answer and the tags of its clauses."""
    lang = rng.choice(["en", "en", "en", "de", "es", "zh", "fr", "pt"])
    q = " ".join([rng.choice(S.QUESTIONS[lang]), *(rng.choice(S.ANSWERS[lang]) for _ in range(rng.randint(0, 1)))])
    kind = rng.choice(["answer", "answer", "answer", "refusal", "refusal", "refusal", "echo", "echo_answer", "echo_answer", "foreign", "foreign", "unfinished", "unfinished", "excuse", "excuse", "whole", "asked"])
    say = lambda lg: [rng.choice(S.ANSWERS[lg]) for _ in range(rng.randint(1, 3))]
    beside = lambda share, lot=S.BESIDE: [rng.choice(lot)] if rng.random() < share else []
    code = [rng.choice(S.CODE)] if rng.random() < 0.5 else []
    parts: list[tuple[str, str]]
    if kind == "refusal":
        parts = [(x, "refusal") for x in [*beside(0.25), *(S.refusal(rng) for _ in range(rng.choice([1, 1, 1, 2]))), *beside(0.5), *beside(0.15)]]
    elif kind in ("echo", "echo_answer"):
        parts = [(x, "echo") for x in _SPLIT.split(q) if x.strip()]
        if rng.random() < 0.4:
            parts[0] = (rng.choice(["Question: ", "You asked: ", "> "]) + parts[0][0], "echo")
        if kind == "echo_answer":
            parts += [(x, "answer") for x in say(lang) + code]
    elif kind in ("foreign", "asked"):
        other = rng.choice([x for x in S.ANSWERS if x != lang])
        parts = [(x, "foreign" if kind == "foreign" else "answer") for x in say(other)]
        if kind == "asked":
            named = {"en": " Please answer in English.", "de": " (German please)", "es": " Answer in Spanish.", "zh": " Please reply in Chinese.", "fr": " Answer in French.", "pt": " In Portuguese, please."}
            q += named.get(other, "")
            parts = [(x, "answer" if other in named else "foreign") for x, _ in parts]
        parts += [(x, "answer") for x in code]
    elif kind == "unfinished":
        parts = [(x, "answer") for x in (say(lang) if rng.random() < 0.8 else [])]
        if rng.random() < 0.4:
            parts.append((rng.choice(S.OPEN_CODE), "unfinished"))
        else:
            last = rng.choice(S.ANSWERS[lang])
            cut = rng.randint(len(last) // 3 + 1, len(last) - 2)
            parts.append((last[:cut].rstrip(" ,."), "unfinished"))
    elif kind == "excuse":
        parts = [(x, "answer") for x in [*beside(0.2), rng.choice(S.EXCUSES), *say("en"), *code, *beside(0.3)]]
        q = rng.choice(S.QUESTIONS["en"])
    elif kind == "whole":
        parts = [(rng.choice(S.WHOLE), "answer")]
    else:
        parts = [(x, "answer") for x in [*beside(0.15), *say(lang), *code, *(say(lang) if code and rng.random() < 0.5 else []), *beside(0.3)]]
    text, tags = "", []
    for x, t in parts:
        block = x.startswith(("```", "-")) or "\n" in x
        text += ("\n\n" if block or text.endswith(("```", "`")) and tags else " " if text else "") + x
        tags.append(t)
    return q, text.strip(), tags


def weak_tags(parts: list[tuple[str, str]], rows: list[tuple[list[int], list[float]]]) -> list[str] | None:
    """Tags of a response's clauses by rule, or None where the rules aren't sure."""
    has = lambda k, name: _F[name] in rows[k][0]
    saids = [_said(text) for _, text in parts]
    declines = [kind == "prose" and bool(_DECLINE.search(s)) for (kind, _), s in zip(parts, saids)]
    if any(declines):
        beside = [d or kind == "prose" and bool(_COURTESY.match(text) or _SORRY.search(s)) for d, (kind, text), s in zip(declines, parts, saids)]
        if all(beside) and not any(map(_GOES_ON.search, saids)):
            return ["refusal"] * len(parts)
        return None
    out = []
    for k, (kind, text) in enumerate(parts):
        if kind == "open" or has(k, "last_not_ended_long"):
            out.append("unfinished")
        elif has(k, "echo"):
            out.append("echo")
        elif kind == "prose" and has(k, "other_language"):
            out.append("foreign")
        elif any(has(k, x) for x in ("overlap_most", "overlap_half")):
            return None
        else:
            out.append("answer")
    return out


def train(sequences: int = TRAINING_SEQUENCES, seed: int = 7, rows: list[tuple[str, str]] | None = None) -> LinearChainCRF:
    """The field, from composed sequences and (question, answer) pairs of a bounded sample."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(sequences):
        q, a, tags = _sequence(rng)
        parts, x = features(q, a)
        if len(parts) == len(tags):  # a composed text that splits otherwise has no sure tags
            xs.append(x)
            ys.append(np.array([_I[t] for t in tags]))
    for q, a in rows or []:
        text = substance(a)
        parts, x = features(q, text) if text else ([], [])
        tags = weak_tags(parts, x) if parts else None
        if tags:
            xs.append(x)
            ys.append(np.array([_I[t] for t in tags]))
    return LinearChainCRF(len(FEATURES) + LEXICAL, len(TAGS)).fit(xs, ys, steps=120, rate=0.3, decay=1e-4)


def last_question(source: str) -> str:
    """The user's last turn of a chat-template text, else the text without tags."""
    turns = re.split(r"<\|im_start\|>\s*(\w+)", source)
    user = [turns[k + 1] for k in range(1, len(turns) - 1, 2) if turns[k].lower() in ("user", "human")]
    return _TAG.sub(" ", user[-1] if user else re.sub(r"<\|im_start\|>\s*\w+", " ", source)).strip()


def substance(answer: str | None) -> str:
    """The answer without tags and invisible characters; '' if nothing is said."""
    text = re.sub(r"[​-‏⁠﻿­]", "", _TAG.sub(" ", re.sub(r"<\|im_start\|>\s*\w*", " ", answer or "")))
    body = re.sub(r"^\s*(?:```|~~~)[\w+-]*\s*$", "", text, flags=re.M)
    said = "".join(_ALNUM.findall(body)).lower()
    return "" if not said or said in _PLACEHOLDERS else text.strip()


def defect(crf: LinearChainCRF, question: str, answer: str | None) -> str | None:
    """The pair's defect, or None: by the words that tags cover, and by the last tag for what breaks off."""
    text = substance(answer)
    if not text:
        return "empty"
    parts, x = features(question, text)
    if not parts:
        return "empty"
    tags = [TAGS[t] for t in crf.tags(x)]
    cover, prose = dict.fromkeys(TAGS, 0), 0
    for (kind, clause), tag in zip(parts, tags):
        size = max(1, len(normal(clause)))
        cover[tag] += size
        prose += size * (kind == "prose")
    total = sum(cover.values())
    if cover["refusal"] >= REFUSED * total:
        return "refusal"
    if cover["echo"] >= COPIED * total:
        return "copied_question"
    if tags[-1] == "unfinished":
        return "truncated"
    if cover["foreign"] > FOREIGN * prose:
        return "other_language"
    return None


def _asked(rows: DataFrame) -> DataFrame:
    """rec_id, chat, q, a of rows with a question."""
    rows = distinct_names(rows, ["rec_id", "source_text", "instruction", "target_text", "output", "response"]).where("source_text is not null or instruction is not null")
    return rows.select(
        "rec_id", F.col("source_text").isNotNull().alias("chat"), F.coalesce("source_text", "instruction").alias("q"),
        F.when(F.col("source_text").isNotNull(), F.col("target_text")).otherwise(F.coalesce("output", "response", "target_text")).alias("a"),
    )


def sample(rows: DataFrame, n: int = WEAK_ROWS, chars: int = WEAK_CHARS) -> list[tuple[str, str]]:
    """(question, answer) of at most ``n`` rows of least hashed id whose texts have at most ``chars`` characters."""
    short = rows.where(f"a is not null and length(a) <= {chars} and length(q) <= {chars}").withColumn("h", F.xxhash64("rec_id", "q"))
    return [(last_question(r.q) if r.chat else r.q, r.a) for r in short.orderBy("h", "rec_id").limit(n).collect()]


def tagged(df: DataFrame) -> DataFrame:
    """rec_id, defect (null where the pair is sound) of rows with a question."""
    rows = _asked(df)
    shared = df.sparkSession.sparkContext.broadcast(train(rows=sample(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for b in batches:
            out = [defect(crf, last_question(q) if chat else q, a) for chat, q, a in zip(*[b.column(k).to_pylist() for k in (1, 2, 3)])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["rec_id", "defect"])

    return rows.mapInArrow(run, "rec_id long, defect string")


def found(merged: DataFrame) -> DataFrame:
    return tagged(merged).where("defect is not null")
