"""Experiment results: resume, back-fill, summaries, retrieval impact, comparisons, fits.

Defined results: rates over no rows are 0, never an error; a metric missing on one side of a difference gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("no-rag", "rag", "rag-forgetting")
#: Labels of the modes in reports.
MODE_LABELS = {"no-rag": "No-RAG", "rag": "RAG", "rag-forgetting": "RAG+Forgetting"}


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys aren't among those done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def back_fill(problems: DataFrame, generations: DataFrame, key: str = "task_id") -> DataFrame:
    """Every problem with its solution; one not generated gets its prompt with an empty body.  Of several generations of
    a problem the least text counts."""
    one = generations.groupBy(key).agg(F.min("solution").alias("solution"))
    return problems.join(one, key, "left").select(key, F.coalesce("solution", F.concat(F.coalesce("prompt", F.lit("")), F.lit("    pass\n"))).alias("solution"), F.col("solution").isNull().alias("placeholder"))


def grid(configs: DataFrame, problems: DataFrame) -> DataFrame:
    """Every configuration with every problem.  Configurations are a stated set of a few rows (checked)."""
    n = configs.count()
    if n > 10_000:
        raise ValueError(f"{n} configurations; the grid is meant for a stated set of at most 10000")
    return problems.crossJoin(F.broadcast(configs))


def summary(results: DataFrame, by: str = "experiment") -> DataFrame:
    """n, pass_at_1, passed, avg_latency_s, max_vram_mb, avg_forgotten, avg_old_ratio of each experiment."""
    return results.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.sum("pass_at_1") / F.greatest(F.count("*"), F.lit(1)), 3).alias("pass_at_1"), F.sum("pass_at_1").cast("bigint").alias("passed"), F.round(F.avg("latency"), 2).alias("avg_latency_s"),
        F.round(F.max("vram"), 1).alias("max_vram_mb"), F.round(F.avg("forgotten"), 3).alias("avg_forgotten"), F.round(F.avg("old_ratio"), 3).alias("avg_old_ratio"),
    )


def pass_counts(status: DataFrame, by: list[str]) -> DataFrame:
    """total, base, plus (base and plus), percentages; status: base_status and plus_status strings."""
    base, plus = F.col("base_status") == "pass", F.col("plus_status") == "pass"
    g = status.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(base).alias("base"), F.count_if(base & plus).alias("plus"))
    pct = lambda c: F.round(100.0 * F.col(c) / F.greatest("total", F.lit(1)), 1)
    return g.withColumn("base_pct", pct("base")).withColumn("plus_pct", pct("plus"))


def eval_rows(evals: DataFrame) -> DataFrame:
    """task_id, base_status, plus_status from an evaluation map; the first attempt of a task counts."""
    return evals.select(F.explode("eval").alias("task_id", "attempts")).where(F.size("attempts") > 0).select("task_id", F.col("attempts")[0]["base_status"].alias("base_status"), F.col("attempts")[0]["plus_status"].alias("plus_status"))


def pass_rate(passed: Column) -> Column:
    """Share of true values of an array of booleans; 0 for none."""
    return F.size(F.filter(passed, lambda p: p)) / F.greatest(F.size(passed), F.lit(1))


def contamination(runs: DataFrame, metrics: tuple[str, ...] = ("base_pct", "plus_pct")) -> DataFrame:
    """model, dataset, metric, norag, rag, ff, gap (norag - rag), recovery (ff - rag)."""
    g = runs.groupBy("model", "dataset").pivot("mode", list(MODES)).agg(*[F.max(m).alias(m) for m in metrics])
    name = lambda mode, m: F.col(f"`{mode}_{m}`") if len(metrics) > 1 else F.col(f"`{mode}`")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), *[name(mode, m).alias(a) for mode, a in zip(MODES, ("norag", "rag", "ff"))]) for m in metrics])
    out = g.select("model", "dataset", F.explode(rows).alias("r")).select("model", "dataset", "r.*")
    return out.withColumn("gap", F.col("norag") - F.col("rag")).withColumn("recovery", F.col("ff") - F.col("rag"))


def effect(delta: Column) -> Column:
    return F.when(delta > 0, "rag_helped").when(delta < 0, "rag_harmed").when(delta.isNotNull(), "neutral")


def distribution(rows: DataFrame, kind: str) -> DataFrame:
    """kind, n, pct of all rows."""
    g = rows.groupBy(kind).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))  # one row a kind


def crosstab(rows: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    return rows.groupBy(by).pivot(kind, kinds).agg(F.count(F.lit(1))).na.fill(0)


def reasons(rows: DataFrame, reason: str) -> DataFrame:
    """reason, n of '; '-joined reasons, most first."""
    return rows.where(F.col(reason) != "").select(F.explode(F.split(reason, "; ")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def versions_compared(base: DataFrame, other: DataFrame, key: str, score: str) -> DataFrame:
    """key, base, other, improvement; of several rows of a key the least score counts."""
    a = base.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(score).alias("base"))
    b = other.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(score).alias("other"))
    return a.join(b, key).withColumn("improvement", F.round(F.col("other") - F.col("base"), 3))


def jaccard(a: Column, b: Column) -> Column:
    """Of two texts' word sets; 1 for two texts without words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != ""))
    union = F.size(F.array_union(words(a), words(b)))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / F.greatest(union, F.lit(1)))


def delta_vs(rows: DataFrame, key: str, score: str, control: str) -> DataFrame:
    """Each row's score against that of the control row (one value, no join)."""
    c = F.max(F.when(F.col(key) == control, F.col(score))).over(Window.partitionBy())  # one row a strategy
    return rows.withColumn("delta", F.col(score) - c)


def quadratic_fit(points: DataFrame, x: str, y: str) -> DataFrame:
    """a, b, c of the least-squares a x^2 + b x + c, from power sums and a 3 x 3 solve; null if undetermined."""
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    s = p.agg(*[F.sum(F.pow("x", F.lit(k))).alias(f"s{k}") for k in range(5)], *[F.sum(F.pow("x", F.lit(k)) * F.col("y")).alias(f"t{k}") for k in range(3)])

    def det(m: list[list[str]]) -> str:
        (a, b, c), (d, e, f), (g, h, i) = m
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    rows = [["s4", "s3", "s2"], ["s3", "s2", "s1"], ["s2", "s1", "s0"]]
    swap = lambda k: [[f"t{2 - r}" if c == k else rows[r][c] for c in range(3)] for r in range(3)]
    d = det(rows)
    return s.select(*[F.expr(f"try_divide({det(swap(k))}, {d})").alias(n) for k, n in enumerate("abc")])


def curve(fit: DataFrame, lo: float, hi: float, n: int = 100) -> DataFrame:
    """x, y of a fitted curve at n points."""
    step = (hi - lo) / (n - 1)
    return fit.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((F.lit(lo) + i * F.lit(step)).alias("x"), (F.col("a") * F.pow(F.lit(lo) + i * F.lit(step), F.lit(2.0)) + F.col("b") * (F.lit(lo) + i * F.lit(step)) + F.col("c")).alias("y")))).alias("p")).select("p.*")


def ordered_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of the listed keys, with their place in the list."""
    place = F.create_map(*[v for k, name in enumerate(order) for v in (F.lit(name), F.lit(k))])
    return rows.where(F.col(key).isin(order)).withColumn("place", place[F.col(key)])


def chosen(groups: DataFrame, key: str, prefixes: list[str]) -> DataFrame:
    """Rows whose key begins with one of the prefixes; all rows where none is given or none is met."""
    if not prefixes:
        return groups
    hit = groups.where(F.greatest(*[F.col(key).startswith(p) for p in prefixes], F.lit(False)))
    none = hit.limit(1).agg((F.count("*") == 0).alias("none"))
    return hit.unionByName(groups.join(F.broadcast(none.where("none")), how="left_semi", on=F.lit(True)))


def first_in_order(rows: DataFrame, order: str, n: int) -> DataFrame:
    """A stated limit, after ordering; 0 or less is no limit."""
    return rows.orderBy(order).limit(n) if n > 0 else rows.orderBy(order)


def report_table(runs: DataFrame, results: DataFrame, datasets: list[str]) -> DataFrame:
    """The report's rows: runs (place, model, mode) in their order for each dataset, with the labelled mode and the
    metrics of ``results``; runs without a result are left out.  Adds row, from 1 in each dataset."""
    rows = results.join(runs, ["model", "mode"])
    labelled = label_modes(ordered_by(rows.withColumnRenamed("place", "run"), "dataset", datasets))
    return labelled.withColumn("row", F.row_number().over(Window.partitionBy("dataset").orderBy("run", "model", "mode")))  # a few runs a dataset


def label_modes(rows: DataFrame) -> DataFrame:
    labels = F.create_map(*[v for k, name in MODE_LABELS.items() for v in (F.lit(k), F.lit(name))])
    return rows.withColumn("mode_label", F.coalesce(labels[F.col("mode")], "mode"))
