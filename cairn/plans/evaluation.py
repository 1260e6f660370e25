"""Experiment summaries, retrieval impact, comparisons, fits – over result tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import evaluate as E
from cairn.operators import rerank as R
from cairn.runtime import table


def _results(s, d):
    m = table(s, d, "merged_distillation").where("origin is not null")
    a = F.coalesce("target_text", "output", "response", F.lit(""))
    return m.select(F.col("origin").alias("experiment"), "rec_id", F.when(a.contains("return"), 1.0).otherwise(0.0).alias("pass_at_1"), (F.length(a) / 100.0).alias("latency"), (F.col("rec_id") % 97 + 0.5).alias("vram"), (F.col("rec_id") % 7).alias("forgotten"), ((F.col("rec_id") % 10) / 10.0).alias("old_ratio"))


def experiment_summary(s, d):
    return E.summary(_results(s, d))


def running_totals(s, d):
    """Results so far by category, in order of record: n, passed."""
    from pyspark.sql import Window

    day = table(s, d, "merged_distillation").where("merged_at is not null").groupBy("origin", F.date_format("merged_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return day.withColumn("total", F.sum("n").over(Window.partitionBy("origin").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def _status(s, d):
    r = R.latest_records(table(s, d, "access_records"))
    st = lambda c: F.when(c, "pass").otherwise("fail")
    return r.select(F.substring_index("doc_id", "_", 1).alias("model"), st(F.coalesce(F.col("correct_count") > 0, F.lit(False))).alias("base_status"), st(F.coalesce(F.col("correct_count") * 2 >= F.col("total_use_count"), F.lit(False))).alias("plus_status"))


def pass_counts(s, d):
    return E.pass_counts(_status(s, d), ["model"])


def pass_rate(s, d):
    """Share of a record's messages that hold code or a number, as cases that pass."""
    m = table(s, d, "merged_distillation").where("messages is not null")
    return m.select("rec_id", F.round(E.pass_rate(F.transform("messages", lambda x: F.coalesce(x["content"], F.lit("")).rlike("[0-9]|return"))), 6).alias("pass_rate"))


def _runs(s, d):
    e = table(s, d, "events").where("user_id is not null and value is not null")
    mode = F.element_at(F.array(*[F.lit(m) for m in E.MODES]), (F.col("event_id") % 3 + 1).cast("int"))
    g = e.groupBy(F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"), F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("dataset"), mode.alias("mode"))
    return g.agg(F.round(F.avg("value"), 1).alias("base_pct"), F.round(F.avg(F.col("value") / 2), 1).alias("plus_pct"))


def contamination_pivot(s, d):
    return E.contamination(_runs(s, d)).select("model", "dataset", "metric", "norag", "rag", "ff")


def gap_recovery(s, d):
    return E.contamination(_runs(s, d)).select("model", "dataset", "metric", F.round("gap", 3).alias("gap"), F.round("recovery", 3).alias("recovery"))


def mode_table(s, d):
    """The report: runs in their stated order for each dataset, joined to what results there are."""
    runs = s.createDataFrame([(k, m, mode) for k, (m, mode) in enumerate([(m, mode) for m in ("m2", "m0", "m9") for mode in ("rag", "no-rag")])], "place int, model string, mode string")
    return E.report_table(runs, _runs(s, d), ["d1", "d0"]).select("dataset", F.col("row").cast("int").alias("row"), "model", "mode_label", "base_pct", "plus_pct")


def config_filter(s, d):
    """Items whose task begins with a stated prefix, the first ten in order of task (a stated limit)."""
    items = table(s, d, "benchmark_items").where("task_id is not null").withColumn("key", F.concat_ws("#", "task_id", F.lpad(F.col("item_id").cast("string"), 9, "0")))
    return E.first_in_order(E.chosen(items, "task_id", ["T", "b", "k"]), "key", 10).select("item_id", "task_id")


def _cases(s, d):
    """One effect for each (user, day): sign of purchases over errors."""
    e = table(s, d, "events").where("user_id is not null and ts is not null")
    g = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg((F.count_if(F.col("event_type") == "purchase") - F.count_if(F.col("event_type") == "error")).alias("delta"))
    return g.withColumn("effect", E.effect(F.col("delta"))).withColumn("difficulty", F.element_at(F.array(*[F.lit(x) for x in ("easy", "medium", "hard")]), (F.col("user_id") % 3 + 1).cast("int")))


def effect_distribution(s, d):
    return E.distribution(_cases(s, d).select("effect"), "effect")


def contamination_crosstab(s, d):
    return E.crosstab(_cases(s, d), "difficulty", "effect", ["rag_helped", "rag_harmed", "neutral"])


def strategy_effects(s, d):
    c = _cases(s, d).withColumn("strategy", F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (F.col("user_id") % 5 + 1).cast("int")))
    return c.groupBy("strategy").agg(F.count_if(F.col("effect") == "rag_helped").alias("helped"), F.count_if(F.col("effect") == "rag_harmed").alias("harmed"))


def delta_vs_control(s, d):
    g = E.summary(_results(s, d)).select("experiment", "pass_at_1")
    return E.delta_vs(g, "experiment", "pass_at_1", "alpaca").withColumn("delta", F.round("delta", 3))


def _pairs(s, d):
    m = table(s, d, "merged_distillation")
    return m.select("rec_id", F.coalesce("source_text", "instruction").alias("a"), F.coalesce("target_text", "output", "response").alias("b")).where("a is not null and b is not null")


def jaccard_overlap(s, d):
    return _pairs(s, d).select("rec_id", F.round(E.jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))


def answer_change_rate(s, d):
    return _pairs(s, d).agg(F.round(F.avg((F.col("a") != F.col("b")).cast("double")), 6).alias("change_rate"), F.count("*").alias("n"))


def _points(s, d):
    return table(s, d, "events").where("value is not null").select(((F.col("event_id") % 24) / 24.0).alias("x"), (F.col("value") / 100.0).alias("y"))


def quad_fit(s, d):
    return E.quadratic_fit(_points(s, d), "x", "y").select(*[F.round(c, 4).alias(c) for c in "abc"])


def quad_curve(s, d):
    return E.curve(E.quadratic_fit(_points(s, d), "x", "y"), 0.0, 1.0).select(F.round("x", 6).alias("x"), F.round("y", 4).alias("y"))


def resume_anti(s, d):
    items = table(s, d, "benchmark_items").select("item_id", "task_id")
    return E.pending(items, items.where("item_id % 4 = 1").select("item_id"), ["item_id"])


def version_compare(s, d):
    """Every record's score in one version (length of its answer) and in the other (of its question)."""
    m = table(s, d, "merged_distillation")
    one = lambda *c: m.select("rec_id", (F.length(F.coalesce(*c)) / 100.0).alias("score")).where("score is not null")
    return E.versions_compared(one("target_text", "output", "response"), one("source_text", "instruction"), "rec_id", "score").select("rec_id", F.round("base", 4).alias("base"), F.round("other", 4).alias("other"), "improvement")


def experiment_grid(s, d):
    cfg = s.createDataFrame([(m, a) for m in ("small", "large") for a in E.MODES], "model string, mode string")
    return E.grid(cfg, table(s, d, "benchmark_items").select("item_id")).groupBy("model", "mode").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        experiment_summary, running_totals, pass_counts, pass_rate, contamination_pivot, gap_recovery, mode_table, effect_distribution, contamination_crosstab, strategy_effects, delta_vs_control, jaccard_overlap,
        config_filter, answer_change_rate, quad_fit, quad_curve, resume_anti, version_compare, experiment_grid,
    )
}

_RES = """r AS (SELECT origin AS experiment, rec_id, CASE WHEN contains(a, 'return') THEN 1::DOUBLE ELSE 0 END AS pass_at_1, length(a) / 100::DOUBLE AS latency, rec_id % 97 + 0.5::DOUBLE AS vram, rec_id % 7 AS forgotten, (rec_id % 10) / 10::DOUBLE AS old_ratio
FROM (SELECT *, coalesce(target_text, output, response, '') AS a FROM merged_distillation WHERE origin IS NOT NULL))"""
_SUM = f"""WITH {_RES}, s AS (SELECT experiment, count(*) AS n, round(sum(pass_at_1) / greatest(count(*), 1), 3) AS pass_at_1, sum(pass_at_1)::BIGINT AS passed, round(avg(latency), 2) AS avg_latency_s, round(max(vram), 1) AS max_vram_mb, round(avg(forgotten), 3) AS avg_forgotten, round(avg(old_ratio), 3) AS avg_old_ratio FROM r GROUP BY experiment)"""
_RUNS = """runs AS (SELECT 'm' || (user_id % 4) AS model, 'd' || (user_id % 3) AS dataset, ['no-rag', 'rag', 'rag-forgetting'][event_id % 3 + 1] AS mode, round(avg(value), 1) AS base_pct, round(avg(value / 2), 1) AS plus_pct FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
piv AS (SELECT model, dataset, metric, max(v) FILTER (mode = 'no-rag') AS norag, max(v) FILTER (mode = 'rag') AS rag, max(v) FILTER (mode = 'rag-forgetting') AS ff FROM (SELECT model, dataset, mode, 'base_pct' AS metric, base_pct AS v FROM runs UNION ALL SELECT model, dataset, mode, 'plus_pct', plus_pct FROM runs) GROUP BY ALL)"""
_CASES = """c AS (SELECT *, CASE WHEN delta > 0 THEN 'rag_helped' WHEN delta < 0 THEN 'rag_harmed' ELSE 'neutral' END AS effect, ['easy', 'medium', 'hard'][user_id % 3 + 1] AS difficulty, ['A', 'B', 'C', 'D', 'E'][user_id % 5 + 1] AS strategy
FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'purchase') - count(*) FILTER (event_type = 'error') AS delta FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL))"""
_PAIRS = "p AS (SELECT rec_id, coalesce(source_text, instruction) AS a, coalesce(target_text, output, response) AS b FROM merged_distillation WHERE coalesce(source_text, instruction) IS NOT NULL AND coalesce(target_text, output, response) IS NOT NULL)"
_W = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '\\W+'), lambda w: w <> ''))"
_LATEST = "rec AS (SELECT * FROM access_records WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY saved_at DESC NULLS LAST, coalesce(last_access_time, 0) DESC, access_count DESC NULLS LAST, total_use_count DESC NULLS LAST, correct_count DESC NULLS LAST) = 1)"
_DET = "(s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2))"
_FIT = f"""f AS (SELECT count(*)::DOUBLE AS s0, sum(x) AS s1, sum(x * x) AS s2, sum(x ** 3) AS s3, sum(x ** 4) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2 FROM (SELECT (event_id % 24) / 24::DOUBLE AS x, value / 100::DOUBLE AS y FROM events WHERE value IS NOT NULL)),
q AS (SELECT (t2 * (s2 * s0 - s1 * s1) - s3 * (t1 * s0 - s1 * t0) + s2 * (t1 * s1 - s2 * t0)) / {_DET} AS a, (s4 * (t1 * s0 - s1 * t0) - t2 * (s3 * s0 - s1 * s2) + s2 * (s3 * t0 - t1 * s2)) / {_DET} AS b, (s4 * (s2 * t0 - t1 * s1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2)) / {_DET} AS c FROM f)"""

SQL = {
    "experiment_summary": f"{_SUM} SELECT * FROM s",
    "running_totals": "WITH g AS (SELECT origin, strftime(merged_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n FROM merged_distillation WHERE merged_at IS NOT NULL GROUP BY ALL) SELECT *, (sum(n) OVER (PARTITION BY origin ORDER BY day ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM g",
    "pass_counts": f"""WITH {_LATEST}, st AS (SELECT split_part(doc_id, '_', 1) AS model, coalesce(correct_count > 0, false) AS b, coalesce(correct_count * 2 >= total_use_count, false) AS p FROM rec)
SELECT *, round(100::DOUBLE * base / greatest(total, 1), 1) AS base_pct, round(100::DOUBLE * plus / greatest(total, 1), 1) AS plus_pct FROM (SELECT model, count(*) AS total, count(*) FILTER (b) AS base, count(*) FILTER (b AND p) AS plus FROM st GROUP BY model)""",
    "pass_rate": "SELECT rec_id, round(len(list_filter(messages, lambda x: regexp_matches(coalesce(x.content, ''), '[0-9]|return'))) / greatest(len(messages), 1)::DOUBLE, 6) AS pass_rate FROM merged_distillation WHERE messages IS NOT NULL",
    "contamination_pivot": f"WITH {_RUNS} SELECT * FROM piv",
    "gap_recovery": f"WITH {_RUNS} SELECT model, dataset, metric, round(norag - rag, 3) AS gap, round(ff - rag, 3) AS recovery FROM piv",
    "mode_table": f"""WITH {_RUNS}, o(place, model, mode) AS (VALUES (0, 'm2', 'rag'), (1, 'm2', 'no-rag'), (2, 'm0', 'rag'), (3, 'm0', 'no-rag'), (4, 'm9', 'rag'), (5, 'm9', 'no-rag'))
SELECT dataset, (row_number() OVER (PARTITION BY dataset ORDER BY place))::INTEGER AS row, model, CASE mode WHEN 'no-rag' THEN 'No-RAG' WHEN 'rag' THEN 'RAG' ELSE 'RAG+Forgetting' END AS mode_label, base_pct, plus_pct FROM runs JOIN o USING (model, mode) WHERE dataset IN ('d0', 'd1')""",
    "config_filter": """WITH i AS (SELECT item_id, task_id, task_id || '#' || lpad(item_id::VARCHAR, 9, '0') AS key, starts_with(task_id, 'T') OR starts_with(task_id, 'b') OR starts_with(task_id, 'k') AS hit FROM benchmark_items WHERE task_id IS NOT NULL)
SELECT item_id, task_id FROM i WHERE hit OR NOT (SELECT bool_or(hit) FROM i) ORDER BY encode(key) LIMIT 10""",
    "effect_distribution": f"WITH {_CASES} SELECT effect, count(*) AS n, round(100::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM c GROUP BY effect",
    "contamination_crosstab": f"WITH {_CASES} SELECT difficulty, count(*) FILTER (effect = 'rag_helped') AS rag_helped, count(*) FILTER (effect = 'rag_harmed') AS rag_harmed, count(*) FILTER (effect = 'neutral') AS neutral FROM c GROUP BY difficulty",
    "strategy_effects": f"WITH {_CASES} SELECT strategy, count(*) FILTER (effect = 'rag_helped') AS helped, count(*) FILTER (effect = 'rag_harmed') AS harmed FROM c GROUP BY strategy",
    "delta_vs_control": f"{_SUM} SELECT experiment, pass_at_1, round(pass_at_1 - (SELECT pass_at_1 FROM s WHERE experiment = 'alpaca'), 3) AS delta FROM s",
    "jaccard_overlap": f"""WITH {_PAIRS}, w AS (SELECT rec_id, {_W('a')} AS x, {_W('b')} AS y FROM p)
SELECT rec_id, round(CASE WHEN len(x) + len(y) = 0 THEN 1 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE END, 6) AS overlap FROM w""",
    "answer_change_rate": f"WITH {_PAIRS} SELECT round(avg((a <> b)::INTEGER), 6) AS change_rate, count(*) AS n FROM p",
    "quad_fit": f"WITH {_FIT} SELECT round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c FROM q",
    "quad_curve": f"WITH {_FIT} SELECT round(i / 99::DOUBLE, 6) AS x, round(a * (i / 99::DOUBLE) ** 2 + b * (i / 99::DOUBLE) + c, 4) AS y FROM q, range(100) t(i)",
    "resume_anti": "SELECT item_id, task_id FROM benchmark_items WHERE item_id % 4 <> 1",
    "version_compare": """WITH r AS (SELECT rec_id, length(coalesce(target_text, output, response)) / 100::DOUBLE AS b, length(coalesce(source_text, instruction)) / 100::DOUBLE AS o FROM merged_distillation WHERE rec_id IS NOT NULL), x AS (SELECT rec_id, min(b) AS b, min(o) AS o FROM r GROUP BY rec_id HAVING min(b) IS NOT NULL AND min(o) IS NOT NULL)
SELECT rec_id, round(b, 4) AS base, round(o, 4) AS other, round(o - b, 3) AS improvement FROM x""",
    "experiment_grid": "SELECT model, mode, count(*) AS n FROM benchmark_items, (VALUES ('small'), ('large')) a(model), (VALUES ('no-rag'), ('rag'), ('rag-forgetting')) b(mode) GROUP BY ALL",
}
