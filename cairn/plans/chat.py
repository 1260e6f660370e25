"""Chat records: conversion, template, lengths, loss mask."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import chat as C
from cairn.runtime import table


def _messages(s, d):
    return table(s, d, "merged_distillation").select("rec_id", C.messages().alias("msgs"))


def chat_convert(s, d):
    return _messages(s, d).select("rec_id", F.posexplode("msgs").alias("turn", "m")).select("rec_id", "turn", "m.role", "m.content")


def chat_template(s, d):
    return _messages(s, d).where("msgs is not null").select("rec_id", F.md5(C.template(F.col("msgs"))).alias("text_md5"), F.length(C.template(F.col("msgs"))).alias("chars"))


def chat_shapes(s, d):
    m = table(s, d, "merged_distillation")
    shape = F.when(F.col("source_text").isNotNull(), "pair").when(F.col("messages").isNotNull(), "messages").when(F.col("conversations").isNotNull(), "conversations").when(F.col("instruction").isNotNull() & F.col("output").isNotNull(), "instruction_output").when(F.col("instruction").isNotNull() & F.col("response").isNotNull(), "instruction_response").otherwise("none")
    return m.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


def _pairs(s, d):
    m = table(s, d, "merged_distillation").where("source_text is not null and target_text is not null")
    return m.select("rec_id", C.estimate_tokens(F.col("source_text")).alias("source_len"), C.estimate_tokens(F.col("target_text")).alias("target_len"))


def length_filter(s, d):
    return _pairs(s, d).where(F.col("source_len") + F.col("target_len") <= C.MAX_PAIR_TOKENS)


def token_stats(s, d):
    total = F.col("source_len") + F.col("target_len")
    kept = total <= C.MAX_PAIR_TOKENS
    g = _pairs(s, d).agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("too_long"), F.coalesce(F.sum(F.when(kept, total)), F.lit(0)).alias("t"))
    return g.select("kept", "too_long", F.expr("t div greatest(kept, 1)").alias("avg_tokens"))


def _ids(s, d):
    return _messages(s, d).where("msgs is not null").select("rec_id", C.word_ids(C.template(F.col("msgs"))).alias("input_ids"))


def loss_mask(s, d):
    """Token rows of 10 to 2048 tokens with labels of the assistant spans only; counts of trained tokens."""
    tag, sep = (s.range(1).select(C.word_ids(F.lit(t))).first()[0] for t in (C.START + "assistant", C.START))
    rows = C.loss_mask(_ids(s, d).where((F.size("input_ids") > C.MIN_TOKENS) & (F.size("input_ids") <= C.MAX_TOKENS)), "input_ids", list(tag), list(sep))
    return rows.select("rec_id", F.size("input_ids").alias("tokens"), F.size(F.filter("labels", lambda x: x != C.IGNORED)).alias("trained"))


QUERIES = {f.__name__: f for f in (chat_convert, chat_template, chat_shapes, length_filter, token_stats, loss_mask)}

_CONV = """m AS (SELECT rec_id, CASE WHEN source_text IS NOT NULL THEN [{'role': 'user', 'content': source_text}, {'role': 'assistant', 'content': target_text}]
WHEN messages IS NOT NULL THEN list_transform(messages, lambda x: {'role': x.role, 'content': x.content})
WHEN conversations IS NOT NULL THEN list_transform(from_json(conversations, '[{"from": "VARCHAR", "value": "VARCHAR"}]'), lambda x: {'role': CASE x."from" WHEN 'gpt' THEN 'assistant' WHEN 'system' THEN 'system' ELSE 'user' END, 'content': coalesce(x.value, '')})
WHEN instruction IS NOT NULL AND output IS NOT NULL THEN [{'role': 'user', 'content': instruction || CASE WHEN coalesce(input, '') <> '' THEN chr(10) || input ELSE '' END}, {'role': 'assistant', 'content': output}]
WHEN instruction IS NOT NULL AND response IS NOT NULL THEN [{'role': 'user', 'content': instruction || CASE WHEN coalesce(context, '') <> '' THEN chr(10) || context ELSE '' END}, {'role': 'assistant', 'content': response}] END AS msgs FROM merged_distillation)"""
_TEXT = "array_to_string(list_transform(msgs, lambda x: '<|im_start|>' || x.role || chr(10) || coalesce(x.content, '') || '<|im_end|>' || chr(10)), '')"
_LEN = "p AS (SELECT rec_id, (length(source_text) // 4)::INTEGER AS source_len, (length(target_text) // 4)::INTEGER AS target_len FROM merged_distillation WHERE source_text IS NOT NULL AND target_text IS NOT NULL)"

SQL = {
    "chat_convert": f"WITH {_CONV} SELECT rec_id, (i - 1)::INTEGER AS turn, msgs[i].role AS role, msgs[i].content AS content FROM (SELECT rec_id, msgs, unnest(range(1, len(msgs) + 1)) AS i FROM m WHERE msgs IS NOT NULL)",
    "chat_template": f"WITH {_CONV} SELECT rec_id, md5({_TEXT}) AS text_md5, length({_TEXT})::INTEGER AS chars FROM m WHERE msgs IS NOT NULL",
    "chat_shapes": """SELECT CASE WHEN source_text IS NOT NULL THEN 'pair' WHEN messages IS NOT NULL THEN 'messages' WHEN conversations IS NOT NULL THEN 'conversations' WHEN instruction IS NOT NULL AND output IS NOT NULL THEN 'instruction_output'
WHEN instruction IS NOT NULL AND response IS NOT NULL THEN 'instruction_response' ELSE 'none' END AS shape, count(*) AS n FROM merged_distillation GROUP BY 1""",
    "loss_mask": f"""WITH {_CONV}, t AS (SELECT rec_id, regexp_extract_all({_TEXT}, '(<\\|im_start\\|>|<\\|im_end\\|>|\\w+|[^\\w\\s])') AS w FROM m WHERE msgs IS NOT NULL),
p AS (SELECT rec_id, unnest(generate_series(1, len(w))) AS i, w FROM t WHERE len(w) > 10 AND len(w) <= 2048), s AS (SELECT rec_id, i, w, max(CASE WHEN w[i] = '<|im_start|>' THEN i END) OVER (PARTITION BY rec_id ORDER BY i) AS st FROM p)
SELECT rec_id, count(*)::INTEGER AS tokens, (count(*) FILTER (st IS NOT NULL AND w[st + 1] = 'assistant' AND i >= st + 2))::INTEGER AS trained FROM s GROUP BY rec_id""",
    "length_filter": f"WITH {_LEN} SELECT * FROM p WHERE source_len + target_len <= 4096",
    "token_stats": f"WITH {_LEN} SELECT count(*) FILTER (t <= 4096) AS kept, count(*) FILTER (t > 4096) AS too_long, coalesce(sum(t) FILTER (t <= 4096), 0)::BIGINT // greatest(count(*) FILTER (t <= 4096), 1) AS avg_tokens FROM (SELECT source_len + target_len AS t FROM p)",
}
