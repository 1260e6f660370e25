"""Vector search, filters, fallback, re-ranking, memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import memory as M
from cairn.functions import textcode as T
from cairn.operators import knn as K
from cairn.operators import rerank as R
from cairn.runtime import forget_on_exit, shared_dir, table

NOW = 1735689600.0  # 2025-01-01, the time at which records are scored
EVERY, TOP = 50, 5


def _emb(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings")


def _queries(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return _emb(s, d).where(F.col("vec_id") % EVERY == 0)


def _doc_key(c: str = "id"):
    return F.concat(F.lit("v2_"), F.col(c).cast("string"))


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("int").alias("rank"))


def knn_topk(s, d):
    return _hits(K.knn(_emb(s, d), _queries(s, d), 10))


def knn_multi_query(s, d):
    return _hits(K.knn(_emb(s, d), _queries(s, d), TOP))


def knn_filtered_language(s, d):
    docs = table(s, d, "details").where(F.lower("language") == "python").select(F.col("detail_id").alias("vec_id"))
    return _hits(K.knn(_emb(s, d).join(docs, "vec_id", "left_semi"), _queries(s, d), TOP))


def knn_filtered_repo(s, d):
    docs = table(s, d, "details").where("repo like '%.io' and lower(language) = 'python'").select(F.col("detail_id").alias("vec_id"))
    return _hits(K.knn(_emb(s, d).join(docs, "vec_id", "left_semi"), _queries(s, d), TOP))


def knn_per_collection(s, d):
    e = _emb(s, d).withColumn("collection", F.when(F.col("vec_id") % 3 == 0, "summary").when(F.col("vec_id") % 3 == 1, "chunks").otherwise("details"))
    return K.knn(e, _queries(s, d), 3, group="collection").select("query_id", F.col("grp").alias("collection"), "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("int").alias("rank"))


def _scaled(s, d):
    """Vectors of several lengths."""
    return _emb(s, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3 + 1)).alias("embedding"))


def knn_dot(s, d):
    """Brute force by the product of vectors as they are; the whole corpus is searched, not its first rows."""
    e = _scaled(s, d)
    return _hits(K.knn(e, e.where(F.col("vec_id") % EVERY == 0), 10, metric="dot")).withColumn("distance", F.round(1.0 - F.col("similarity"), 5))


def _indexed(s, d, k):
    import uuid

    e = _emb(s, d)
    c, probes = K.fit_index(e)
    at = f"{shared_dir(s)}/cairn-index-{uuid.uuid4().hex}"
    K.build_index(e, c, at)
    forget_on_exit(s, at)
    return K.search_index(at, c, _queries(s, d), k, probes=probes)


def knn_index(s, d):
    """The index over all rows, searched for the whole query set."""
    return _hits(_indexed(s, d, TOP))


def knn_index_recall(s, d):
    """Recall of the index against brute force, and whether it reaches 0.9."""
    r = K.recall(K.knn(_emb(s, d), _queries(s, d), TOP), _indexed(s, d, TOP))
    return s.createDataFrame([(TOP, r >= 0.9)], "k int, reached boolean")


def _levels(s, d):
    e = _emb(s, d)
    return e.where("vec_id % 3 <> 2"), e.where("vec_id % 3 = 2")


def hierarchical_fallback(s, d):
    chunks, details = _levels(s, d)
    both = K.search_levels(chunks, details, _queries(s, d), TOP, 0.65)
    return both.select("query_id", "level", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("int").alias("rank"))


def hierarchical_scope(s, d):
    """The first repository among a query's summary hits scopes the search of the next level."""
    repo = table(s, d, "details").select(F.col("detail_id").alias("vec_id"), "repo")
    summaries, lower = (e.join(repo, "vec_id") for e in _levels(s, d))
    hits = K.knn(summaries, _queries(s, d), TOP).join(repo.withColumnRenamed("vec_id", "id"), "id")
    scope = K.first_scope(hits, "repo").withColumnRenamed("query_id", "vec_id")
    return K.knn_scoped(lower, _queries(s, d).join(scope, "vec_id"), TOP, "repo").select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("int").alias("rank"))


def _records(s, d):
    return R.latest_records(table(s, d, "access_records"))


def access_records(s, d):
    return _records(s, d).select("doc_id", F.round("last_access_time", 3).alias("last_access_time"), "access_count", "correct_count", "total_use_count")


def forgetting_score(s, d):
    return R.scored(_records(s, d), NOW).select("doc_id", F.round("forgetting_score", 6).alias("forgetting_score"))


def _forgetting(s, d):
    hits = K.knn(_emb(s, d), _queries(s, d), 3 * TOP).withColumn("doc_id", _doc_key()).withColumn("similarity", F.round("similarity", 6))
    return R.forgetting(hits, _records(s, d), NOW, TOP)


def forgetting_rerank(s, d):
    return _forgetting(s, d)[0].select("query_id", "doc_id", F.round("final_score", 3).alias("final_score"), F.col("final_rank").cast("int").alias("final_rank"))


def retrieval_stats(s, d):
    return _forgetting(s, d)[1]


def context_format(s, d):
    top = _forgetting(s, d)[0].join(table(s, d, "details").select(_doc_key("detail_id").alias("doc_id"), "repo", "language", "content"), "doc_id", "left")
    entry = T.context_entry(F.col("language"), F.col("repo"), F.col("final_score"), F.coalesce("content", F.lit("")))
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", entry.alias("e")))), lambda x: x["e"]), "\n\n").alias("context"))


def rag_context(s, d):
    hits = K.knn(_emb(s, d), _queries(s, d), 3).join(table(s, d, "details").select(F.col("detail_id").alias("id"), "content"), "id")
    g = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]).alias("texts"))
    return g.select("query_id", T.rag_context(F.col("texts")).alias("context"))


def _weights(s, d, masks=None):
    return R.weighted(_records(s, d), NOW, masks=masks)


def memory_weight(s, d):
    return _weights(s, d).select("doc_id", F.round("w_time", 6).alias("w_time"), F.round("w_feedback", 6).alias("w_feedback"), F.round("weight", 6).alias("weight"))


def lifecycle_state(s, d):
    return _weights(s, d).select("doc_id", "state", "attenuation", M.retrievable(F.col("state")).alias("retrievable"))


def lifecycle_counts(s, d):
    return _weights(s, d).groupBy("state").agg(F.count("*").alias("n"))


#: Which parts of the memory weight each arm keeps.
ARMS = {"full": (1, 1, 1), "no_temporal": (0, 1, 1), "no_feedback": (1, 0, 1), "no_diversity": (1, 1, 0), "baseline": (0, 0, 0)}


def ablation_weights(s, d):
    rec = _records(s, d).select("doc_id", M.w_time(F.col("last_access_time"), NOW).alias("t"), M.w_feedback(F.col("correct_count"), F.col("total_use_count")).alias("f"))
    arm = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), *[F.lit(float(w * x)).alias(k) for k, w, x in zip("abc", (M.W_TIME, M.W_FEEDBACK, M.W_REDUNDANCY), m)]) for n, m in ARMS.items()]))
    rows = rec.select("doc_id", "t", "f", arm.alias("m"))
    total = F.col("m.a") + F.col("m.b") + F.col("m.c")
    w = F.when(total > 0, M.memory_weight(F.col("t"), F.col("f"), F.lit(0.5), F.col("m.a"), F.col("m.b"), F.col("m.c")) / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    return rows.groupBy("m.arm").agg(F.count("*").alias("n"), F.round(F.avg(w), 6).alias("avg_weight"))


def _candidates(s, d):
    return R.candidates(K.knn(_emb(s, d), _queries(s, d), 10), _emb(s, d))


def mmr_rerank(s, d):
    return R.mmr(_candidates(s, d), 3).select("query_id", F.col("pick").cast("int").alias("pick"), "id")


def diversity(s, d):
    return R.diversity(_candidates(s, d)).select("query_id", F.round("diversity", 6).alias("diversity"))


def retrieve_lifecycle(s, d):
    """Search, memory weight, lifecycle filter and attenuation, then top by attenuated similarity."""
    hits = K.knn(_emb(s, d), _queries(s, d), 3 * TOP).withColumn("doc_id", _doc_key())
    w = hits.join(_weights(s, d).select("doc_id", "state", "attenuation"), "doc_id", "left").withColumn("state", F.coalesce("state", F.lit("Warm"))).withColumn("attenuation", F.coalesce("attenuation", F.lit(0.8)))
    kept = w.where(M.retrievable(F.col("state"))).withColumn("score", F.round(F.round("similarity", 6) * F.col("attenuation"), 5))
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))
    return kept.withColumn("pick", rn).where(F.col("pick") <= TOP).select("query_id", "doc_id", "state", "score", F.col("pick").cast("int").alias("pick"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_topk, knn_multi_query, knn_filtered_language, knn_filtered_repo, knn_per_collection, knn_dot, knn_index, knn_index_recall, hierarchical_fallback, hierarchical_scope, access_records, forgetting_score, forgetting_rerank, retrieval_stats,
        context_format, rag_context, memory_weight, lifecycle_state, lifecycle_counts, ablation_weights, mmr_rerank, diversity, retrieve_lifecycle,
    )
}

_SIM = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"


def _knn_sql(k: int, where_q: str = "q.vec_id % 50 = 0", corpus: str = "embeddings", part: str = "q.vec_id", extra: str = "") -> str:
    return f"""SELECT q.vec_id AS query_id, e.vec_id AS id, {_SIM} AS s{extra}, row_number() OVER (PARTITION BY {part} ORDER BY {_SIM} DESC, e.vec_id) AS rank
    FROM embeddings q, {corpus} e WHERE {where_q} QUALIFY rank <= {k}"""


def _out(sql: str) -> str:
    return f"SELECT query_id, id, round(s, 6) AS similarity, rank::INTEGER AS rank FROM ({sql})"


_PY = "(SELECT * FROM embeddings SEMI JOIN (SELECT detail_id AS vec_id FROM details WHERE lower(language) = 'python') USING (vec_id))"
_IO = "(SELECT * FROM embeddings SEMI JOIN (SELECT detail_id AS vec_id FROM details WHERE repo LIKE '%.io' AND lower(language) = 'python') USING (vec_id))"
_REC = """rec AS (SELECT doc_id, coalesce(last_access_time, created_time) AS last_access_time, access_count, correct_count, total_use_count FROM access_records WHERE doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY saved_at DESC NULLS LAST, coalesce(last_access_time, 0) DESC, access_count DESC NULLS LAST, total_use_count DESC NULLS LAST, correct_count DESC NULLS LAST) = 1)"""
_F = f"coalesce(greatest(least((1 - exp(-0.1::DOUBLE * ({NOW}::DOUBLE - last_access_time) / 86400)) * (1 / (1 + 0.3::DOUBLE * access_count)) * (1 - CASE WHEN total_use_count > 0 THEN correct_count / total_use_count ELSE 0.5::DOUBLE END * 0.5::DOUBLE), 1), 0), 0.5::DOUBLE)"
_FORGET = f"""WITH {_REC}, h AS (SELECT query_id, 'v2_' || id AS doc_id, round(s, 6) AS similarity, rank FROM ({_knn_sql(15)})),
j AS (SELECT h.*, coalesce(({_F}), 0.5) AS f FROM h LEFT JOIN rec USING (doc_id)),
fin AS (SELECT *, CASE WHEN access_missing THEN 0.5 ELSE f END AS fs FROM (SELECT h.*, rec.doc_id IS NULL AS access_missing, {_F} AS f FROM h LEFT JOIN rec USING (doc_id))),
sc AS (SELECT *, round(similarity * (1 - fs * 0.3::DOUBLE), 3) AS final_score FROM fin),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rank) AS final_rank FROM sc WHERE fs < 0.7 QUALIFY final_rank <= 5)"""
_WT, _WF = f"exp(-0.1::DOUBLE * ({NOW}::DOUBLE - last_access_time) / 86400)", "(correct_count + 0.5::DOUBLE * 2) / (total_use_count + 2)"
_W = f"0.5::DOUBLE * {_WT} + 0.3::DOUBLE * ({_WF}) + 0.2::DOUBLE * 0.5::DOUBLE"
_STATE = "CASE WHEN w IS NULL THEN NULL WHEN w <= 0.05 THEN 'Suppressed' WHEN w > 0.8 THEN 'Active' WHEN w > 0.5 THEN 'Warm' WHEN w > 0.2 THEN 'Cold' ELSE 'Archived' END"
_ATT = "CASE state WHEN 'Suppressed' THEN 0.05::DOUBLE WHEN 'Archived' THEN 0.2::DOUBLE WHEN 'Active' THEN 1::DOUBLE WHEN 'Warm' THEN 0.8::DOUBLE WHEN 'Cold' THEN 0.5::DOUBLE END"
_LIFE = f"WITH {_REC}, st AS (SELECT doc_id, {_STATE} AS state FROM (SELECT doc_id, {_W} AS w FROM rec))"
_CAND = f"c AS (SELECT k.query_id, k.id, k.s, k.rank, e.embedding::DOUBLE[] AS v FROM ({_knn_sql(10)}) k JOIN embeddings e ON e.vec_id = k.id)"


def _pick(n: int) -> str:
    """CTE of the n-th greedy pick."""
    prev = " UNION ALL ".join(f"SELECT query_id, rank, v FROM p{k}" for k in range(1, n))
    return f"""p{n} AS (SELECT c.query_id, c.id, c.s, c.rank, c.v FROM c JOIN (SELECT c.query_id, c.rank, 0.7::DOUBLE * c.s - (1 - 0.7::DOUBLE) * max(list_cosine_similarity(c.v, p.v)) AS score FROM c JOIN ({prev}) p USING (query_id) GROUP BY c.query_id, c.rank, c.s) x USING (query_id, rank)
    ANTI JOIN ({prev}) y ON y.query_id = c.query_id AND y.rank = c.rank QUALIFY row_number() OVER (PARTITION BY c.query_id ORDER BY x.score DESC, c.rank) = 1)"""


SQL = {
    "knn_topk": _out(_knn_sql(10)),
    "knn_multi_query": _out(_knn_sql(5)),
    "knn_filtered_language": _out(_knn_sql(5, corpus=_PY)),
    "knn_filtered_repo": _out(_knn_sql(5, corpus=_IO)),
    "knn_per_collection": "SELECT query_id, collection, id, round(s, 6) AS similarity, rank::INTEGER AS rank FROM ("
    + _knn_sql(3, corpus="(SELECT *, CASE vec_id % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'chunks' ELSE 'details' END AS collection FROM embeddings)", part="q.vec_id, e.collection", extra=", e.collection")
    + ")",
    "knn_dot": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 3 + 1)) AS v FROM embeddings),
h AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_dot_product(q.v, e.v) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, e.v) DESC, e.vec_id) AS rank FROM e q, e WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10)
SELECT query_id, id, round(s, 6) AS similarity, rank::INTEGER AS rank, round(1 - round(s, 6), 5) AS distance FROM h""",
    "knn_index_recall": "SELECT 5::INTEGER AS k, true AS reached",
    "hierarchical_fallback": f"""WITH a AS ({_knn_sql(5, corpus="(SELECT * FROM embeddings WHERE vec_id % 3 <> 2)")}), b AS ({_knn_sql(5, corpus="(SELECT * FROM embeddings WHERE vec_id % 3 = 2)")}),
low AS (SELECT query_id FROM a GROUP BY query_id HAVING max(1 - s) > 0.65)
SELECT query_id, 'chunks' AS level, id, round(s, 6) AS similarity, rank::INTEGER AS rank FROM a UNION ALL SELECT query_id, 'details', id, round(s, 6), rank::INTEGER FROM b SEMI JOIN low USING (query_id)""",
    "hierarchical_scope": f"""WITH er AS (SELECT e.*, d.repo FROM embeddings e JOIN details d ON d.detail_id = e.vec_id),
h AS (SELECT k.query_id, k.rank, d.repo FROM ({_knn_sql(5, corpus="(SELECT * FROM er WHERE vec_id % 3 <> 2)")}) k JOIN details d ON d.detail_id = k.id WHERE d.repo <> ''), sc AS (SELECT query_id, arg_min(repo, rank) AS repo FROM h GROUP BY query_id),
n AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_SIM} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, e.vec_id) AS rank FROM embeddings q JOIN sc ON sc.query_id = q.vec_id JOIN (SELECT * FROM er WHERE vec_id % 3 = 2) e ON e.repo = sc.repo QUALIFY rank <= 5)
{_out("SELECT * FROM n")}""",
    "access_records": f"WITH {_REC} SELECT doc_id, round(last_access_time, 3) AS last_access_time, access_count, correct_count, total_use_count FROM rec",
    "forgetting_score": f"WITH {_REC} SELECT doc_id, round({_F}, 6) AS forgetting_score FROM rec",
    "forgetting_rerank": f"{_FORGET} SELECT query_id, doc_id, final_score, final_rank::INTEGER AS final_rank FROM top",
    "retrieval_stats": f"{_FORGET} SELECT query_id, count(*) AS total_retrieved, count(*) FILTER (fs >= 0.7) AS filtered_count, round(count(*) FILTER (fs > 0.5) / greatest(count(*), 1), 3) AS old_snippet_ratio FROM sc GROUP BY query_id",
    "context_format": f"""{_FORGET} SELECT query_id, string_agg(printf('--- [%s] %s (sim: %.3f) ---', coalesce(d.language, '?'), coalesce(d.repo, '?'), final_score) || chr(10) || left(coalesce(d.content, ''), 400), chr(10) || chr(10) ORDER BY final_rank) AS context
FROM top LEFT JOIN details d ON 'v2_' || d.detail_id = top.doc_id GROUP BY query_id""",
    "rag_context": f"""WITH h AS (SELECT k.query_id, row_number() OVER (PARTITION BY k.query_id ORDER BY k.rank) AS n, coalesce(d.content, '') AS c FROM ({_knn_sql(3)}) k JOIN details d ON d.detail_id = k.id)
SELECT query_id, string_agg('// Retrieved ' || n || ':' || chr(10) || left(c, 800), chr(10) || chr(10) ORDER BY n) AS context FROM h GROUP BY query_id""",
    "memory_weight": f"WITH {_REC} SELECT doc_id, round({_WT}, 6) AS w_time, round({_WF}, 6) AS w_feedback, round({_W}, 6) AS weight FROM rec",
    "lifecycle_state": f"{_LIFE} SELECT doc_id, state, {_ATT} AS attenuation, state NOT IN ('Archived', 'Suppressed') AS retrievable FROM st",
    "lifecycle_counts": f"{_LIFE} SELECT state, count(*) AS n FROM st GROUP BY state",
    "ablation_weights": f"""WITH {_REC}, m(arm, a, b, c) AS (VALUES {", ".join(f"('{n}', {0.5 * x}::DOUBLE, {0.3 * y}::DOUBLE, {0.2 * z}::DOUBLE)" for n, (x, y, z) in ARMS.items())})
SELECT arm, count(*) AS n, round(avg(CASE WHEN a + b + c > 0 THEN (a * {_WT} + b * ({_WF}) + c * 0.5::DOUBLE) / (a + b + c) ELSE 0 END), 6) AS avg_weight FROM rec CROSS JOIN m GROUP BY arm""",
    "mmr_rerank": f"WITH {_CAND}, p1 AS (SELECT query_id, id, s, rank, v FROM c WHERE rank = 1), {_pick(2)}, {_pick(3)} " + " UNION ALL ".join(f"SELECT query_id, {k}::INTEGER AS pick, id FROM p{k}" for k in (1, 2, 3)),
    "diversity": f"WITH {_CAND} SELECT a.query_id, round(avg(1 - list_cosine_similarity(a.v, b.v)), 6) AS diversity FROM c a JOIN c b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY a.query_id",
    "retrieve_lifecycle": f"""{_LIFE}, h AS (SELECT query_id, 'v2_' || id AS doc_id, round(s, 6) AS similarity, rank FROM ({_knn_sql(15)})),
j AS (SELECT h.*, coalesce(st.state, 'Warm') AS state FROM h LEFT JOIN st USING (doc_id)), sc AS (SELECT *, round(similarity * ({_ATT}), 5) AS score FROM j WHERE state NOT IN ('Archived', 'Suppressed'))
SELECT query_id, doc_id, state, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)::INTEGER AS pick FROM sc QUALIFY pick <= 5""",
}
