"""Chat records: schema dispatch, template, tokens, loss mask."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

START, END = "<|im_start|>", "<|im_end|>"
MAX_PAIR_TOKENS, MIN_TOKENS, MAX_TOKENS, IGNORED = 4096, 10, 2048, -100
_MSG = "array<struct<role:string,content:string>>"


def _pair(user: Column, assistant: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), assistant.alias("content")))


def messages() -> Column:
    """Messages of a merged record, by the first shape whose fields aren't null: source/target, messages,
    conversations (JSON; unknown speakers are users), instruction with output, instruction with response; else null."""
    turns = F.from_json("conversations", "array<map<string,string>>")
    role = lambda m: F.when(m["from"] == "gpt", "assistant").when(m["from"] == "system", "system").otherwise("user")
    ask = lambda extra: F.concat("instruction", F.when(F.coalesce(extra, F.lit("")) != "", F.concat(F.lit("\n"), extra)).otherwise(""))
    return (
        F.when(F.col("source_text").isNotNull(), _pair(F.col("source_text"), F.col("target_text")))
        .when(F.col("messages").isNotNull(), F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
        .when(F.col("conversations").isNotNull(), F.transform(turns, lambda m: F.struct(role(m).alias("role"), F.coalesce(m["value"], F.lit("")).alias("content"))))
        .when(F.col("instruction").isNotNull() & F.col("output").isNotNull(), _pair(ask(F.col("input")), F.col("output")))
        .when(F.col("instruction").isNotNull() & F.col("response").isNotNull(), _pair(ask(F.col("context")), F.col("response")))
    )


def template(msgs: Column, prompt_only: bool = False) -> Column:
    body = F.array_join(F.transform(msgs, lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(END + "\n"))), "")
    return F.concat(body, F.lit(f"{START}assistant\n")) if prompt_only else body


def estimate_tokens(text: Column) -> Column:
    """Characters by four, the default length where no tokenizer is given."""
    return F.floor(F.length(text) / 4).cast("int")


def word_ids(text: Column) -> Column:
    """Deterministic offline tokenizer: chat tags and words are tokens, ids by hash."""
    tokens = F.regexp_extract_all(text, F.lit(r"(<\|im_start\|>|<\|im_end\|>|\w+|[^\w\s])"), 1)
    return F.transform(tokens, lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(1 << 30)).cast("int"))


def tokenized(df: DataFrame, text: str, make, out: str = "ids") -> DataFrame:
    """Tokenizer hook: add ids of a text column.  ``make`` builds a function from a list of texts to lists of ids, once a
    worker; null stays null."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for s in batches:
            known = s.notna()
            ids = pd.Series([None] * len(s), index=s.index, dtype=object)
            for k, x in zip(s.index[known], encode(s[known].tolist()) if known.any() else []):
                ids[k] = [int(v) for v in x]
            yield ids

    return df.withColumn(out, run(F.col(text)))


def mask(ids: list[int], tag: list[int], sep: list[int], ignored: int = IGNORED) -> list[int]:
    """Labels: ignored but for what follows an assistant tag up to the next start tag."""
    out, at, n = [ignored] * len(ids), 0, len(tag)
    while at <= len(ids) - n:
        if ids[at : at + n] != tag:
            at += 1
            continue
        begin = at + n
        end = next((k for k in range(begin, len(ids)) if ids[k : k + len(sep)] == sep), len(ids))
        out[begin:end] = ids[begin:end]
        at = end
    return out


def loss_mask(df: DataFrame, ids: str, tag: list[int], sep: list[int]) -> DataFrame:
    """Add labels and attention_mask to rows of token ids."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else mask([int(v) for v in x], tag, sep))

    return df.withColumn("labels", run(F.col(ids))).withColumn("attention_mask", F.transform(ids, lambda _: F.lit(1)))
