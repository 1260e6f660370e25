"""Re-ranking of retrieved documents: forgetting score, memory weight and lifecycle, greedy diversity.

Candidate lists are bounded by the fetch size, so per-query arrays stay small.  Access records join by id; unknown
documents take the default score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import memory as M
from cairn.functions import vectors as V


def latest_records(records: DataFrame) -> DataFrame:
    """The last snapshot of every document: by save time, then by last access and counts.  Rows without id are left
    out; a null last access is that of creation."""
    order = F.struct("saved_at", F.coalesce("last_access_time", F.lit(0.0)), "access_count", "total_use_count", "correct_count")
    pick = records.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct("last_access_time", "access_count", "correct_count", "total_use_count", "created_time"), order).alias("r"))
    return pick.select("doc_id", F.coalesce("r.last_access_time", "r.created_time").alias("last_access_time"), "r.access_count", "r.correct_count", "r.total_use_count", "r.created_time")


def scored(records: DataFrame, now: float) -> DataFrame:
    return records.withColumn("forgetting_score", M.forgetting_score(F.col("last_access_time"), F.col("access_count"), F.col("total_use_count"), F.col("correct_count"), now))


def forgetting(hits: DataFrame, records: DataFrame, now: float, k: int, doc_key: str = "doc_id", threshold: float = M.THRESHOLD, weight: float = M.WEIGHT) -> tuple[DataFrame, DataFrame]:
    """(top, stats).  hits: query_id, doc key, similarity, rank.  Drops documents at the threshold or above, orders by
    the rounded final score, then by the first rank; stats: total_retrieved, filtered_count, old_snippet_ratio."""
    joined = hits.join(scored(records, now).select(F.col("doc_id").alias(doc_key), "forgetting_score"), doc_key, "left").withColumn("forgetting_score", F.coalesce("forgetting_score", F.lit(0.5)))
    final = joined.withColumn("final_score", F.round(M.final_score(F.col("similarity"), F.col("forgetting_score"), weight), 3))
    kept = final.where(F.col("forgetting_score") < threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "rank")
    top = kept.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= k)
    stats = final.groupBy("query_id").agg(
        F.count("*").alias("total_retrieved"), F.count_if(F.col("forgetting_score") >= threshold).alias("filtered_count"), F.round(F.count_if(F.col("forgetting_score") > 0.5) / F.greatest(F.count("*"), F.lit(1)), 3).alias("old_snippet_ratio")
    )
    return top, stats


def weighted(records: DataFrame, now: float, redundancy=None, masks: dict[str, float] | None = None) -> DataFrame:
    """Add w_time, w_feedback, w_redundancy (0.5 where not given), weight, state, attenuation.  ``masks`` scales the three
    weights, which are then brought back to sum 1."""
    m = {"time": 1.0, "feedback": 1.0, "redundancy": 1.0} | (masks or {})
    a, b, c = M.W_TIME * m["time"], M.W_FEEDBACK * m["feedback"], M.W_REDUNDANCY * m["redundancy"]
    total = (a + b + c) or 1.0
    out = records.withColumn("w_time", M.w_time(F.col("last_access_time"), now)).withColumn("w_feedback", M.w_feedback(F.col("correct_count"), F.col("total_use_count"))).withColumn("w_redundancy", F.lit(0.5) if redundancy is None else redundancy)
    out = out.withColumn("weight", M.memory_weight(F.col("w_time"), F.col("w_feedback"), F.col("w_redundancy"), a / total, b / total, c / total))
    return out.withColumn("state", M.lifecycle_state(F.col("weight"))).withColumn("attenuation", M.attenuation(F.col("state")))


def candidates(hits: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row a query: query_id, cands (array of rank, id, similarity, vec, by rank)."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vec"))
    return hits.join(v, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "similarity", "vec"))).alias("cands"))  # at most the fetch size


def mmr(cands: DataFrame, k: int, lam: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance: query_id, pick (from 1), id, similarity.  The first pick is the most similar;
    then lam x similarity - (1 - lam) x greatest cosine to a picked one; ties go to the better rank."""
    dot = "aggregate(zip_with({a}.vec, {b}.vec, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, v) -> s + v)"
    cos = f"{dot.format(a='c', b='p')} / nullif(sqrt({dot.format(a='c', b='c')}) * sqrt({dot.format(a='p', b='p')}), 0D)"
    step = f"""concat(acc, slice(array_sort(transform(filter(cands, c -> not exists(acc, p -> p.rank = c.rank)),
        c -> named_struct('loss', -({lam}D * c.similarity - {1 - lam}D * array_max(transform(acc, p -> coalesce({cos}, 0D)))), 'rank', c.rank, 'c', c))), 1, 1).c)"""
    picked = F.expr(f"aggregate(sequence(1, greatest({k} - 1, 0)), slice(cands, 1, 1), (acc, i) -> case when {k} > 1 then {step} else acc end)")
    out = cands.select("query_id", F.posexplode(picked).alias("pick", "c"))
    return out.select("query_id", (F.col("pick") + 1).alias("pick"), "c.id", "c.similarity").where(F.col("pick") <= k)


def diversity(cands: DataFrame, group: str = "query_id") -> DataFrame:
    """Mean of 1 - cosine over the pairs of a retrieved set; 0 for fewer than two documents."""
    pairs = cands.select(group, F.size("cands").alias("n"), F.expr("flatten(transform(cands, (a, i) -> transform(slice(cands, i + 2, size(cands)), b -> struct(a.vec as a, b.vec as b))))").alias("pairs"))
    sims = F.transform("pairs", lambda p: F.coalesce(V.cosine_similarity(p["a"], p["b"]), F.lit(0.0)))
    total = F.aggregate(F.transform(sims, lambda s: 1.0 - s), F.lit(0.0), lambda s, v: s + v)
    return pairs.select(group, F.when(F.col("n") < 2, 0.0).otherwise(total / F.greatest(F.size("pairs"), F.lit(1))).alias("diversity"))
