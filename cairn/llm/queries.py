"""Queries of the training-data operators, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.llm import code_docs, credentials, eval_leaks, mixing, near_duplicates, pair_defects, residue, source_origin
from cairn.runtime import table

QUERIES = {
    "p2_found": lambda s, d: near_duplicates.found(table(s, d, "details")),
    "p2_groups": lambda s, d: near_duplicates.groups(table(s, d, "details"), "detail_id", "content"),
    "p2_links": lambda s, d: near_duplicates.class_links(table(s, d, "details"), "detail_id", "content").withColumn("similarity", F.round("similarity", 6)),
    "p3_found": lambda s, d: code_docs.found(table(s, d, "details")),
    "p3_pairs": lambda s, d: code_docs.pairs(table(s, d, "details")),
    "p4_found": lambda s, d: pair_defects.found(table(s, d, "merged_distillation")),
    "p5_found": lambda s, d: credentials.found(table(s, d, "details"), table(s, d, "chunks")),
    "p5_redacted": lambda s, d: credentials.redacted(table(s, d, "details"), "detail_id").select(F.lit("details").alias("src_table"), "*").unionByName(credentials.redacted(table(s, d, "chunks"), "chunk_id").select(F.lit("chunks").alias("src_table"), "*")),
    "p6_found": lambda s, d: source_origin.found(table(s, d, "details")),
    "p6_files": lambda s, d: source_origin.classify(table(s, d, "details")),
    "p7_found": lambda s, d: eval_leaks.found(table(s, d, "documents"), table(s, d, "benchmark_items")),
    "p8_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p8_report": lambda s, d: mixing.report(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p9_found": lambda s, d: residue.found(table(s, d, "documents")),
    "p9_kept": lambda s, d: residue.kept(table(s, d, "documents")),
}

_P2 = r"""
w AS (SELECT detail_id, unnest(regexp_extract_all(content, '[\p{L}\p{N}_]+')) AS word FROM details WHERE content IS NOT NULL),
t AS (SELECT detail_id, count(*) AS n FROM w GROUP BY detail_id HAVING count(*) >= 20),
c AS (SELECT detail_id, word, count(*) AS n FROM w SEMI JOIN t USING (detail_id) GROUP BY ALL),
common AS (SELECT a.detail_id AS x, b.detail_id AS y, sum(least(a.n, b.n)) AS k FROM c a JOIN c b ON a.word = b.word AND a.detail_id < b.detail_id GROUP BY ALL),
near AS (SELECT x, y, k / (ta.n + tb.n - k)::DOUBLE AS s FROM common JOIN t ta ON ta.detail_id = x JOIN t tb ON tb.detail_id = y WHERE 5 * k >= 4 * (ta.n + tb.n - k))
"""

_P2C = r"""
cls AS (SELECT detail_id, min(detail_id) OVER (PARTITION BY key) AS class_id FROM (SELECT detail_id, string_agg(word, ' ' ORDER BY word) AS key FROM w SEMI JOIN t USING (detail_id) GROUP BY detail_id)),
tied AS (SELECT least(a.class_id, b.class_id) AS x, greatest(a.class_id, b.class_id) AS y, round(s, 6) AS similarity FROM near JOIN cls a ON a.detail_id = near.x JOIN cls b ON b.detail_id = near.y WHERE a.class_id <> b.class_id)
"""

SQL = {
    "p2_found": f"""WITH {_P2}
SELECT x AS detail_id_a, y AS detail_id_b FROM near JOIN details da ON da.detail_id = x JOIN details db ON db.detail_id = y WHERE da.content <> db.content""",
    "p2_links": f"""WITH {_P2}, {_P2C}
SELECT x AS class_a, y AS class_b, max(similarity) AS similarity FROM tied GROUP BY ALL""",
    "p2_groups": f"""WITH RECURSIVE {_P2}, {_P2C},
both_ways AS (SELECT DISTINCT x, y FROM tied UNION SELECT DISTINCT y, x FROM tied),
reach AS (SELECT class_id AS a, class_id AS b FROM cls UNION SELECT a, y FROM reach JOIN both_ways ON b = x)
SELECT detail_id AS id, class_id, (SELECT min(b) FROM reach WHERE a = class_id) AS group_id, (SELECT count(*) FROM both_ways WHERE x = class_id) AS links, count(*) OVER (PARTITION BY class_id) AS copies FROM cls""",
    "p7_found": r"""WITH iw AS (SELECT item_id, regexp_extract_all(lower(prompt), '[\p{L}\p{N}]+') AS w FROM benchmark_items WHERE prompt IS NOT NULL),
ir AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 9), ' ') AS run FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 9)) AS k FROM iw)),
own AS (SELECT run FROM ir GROUP BY run HAVING count(*) < 3),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dr AS (SELECT doc_id, array_to_string(list_slice(w, k, k + 9), ' ') AS run FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 9)) AS k FROM dw))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run) JOIN own USING (run)""",
}
