from __future__ import annotations

import numpy as np

from cairn.functions import memory as M
from cairn.functions import vectors as V
from cairn.operators import knn as K
from cairn.operators import rerank as R
from pyspark.sql import functions as F


def corpus(spark, vs):
    return spark.createDataFrame([(i, v) for i, v in vs], "vec_id long, embedding array<float>")


def test_knn_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    c = corpus(spark, [(i, v.tolist()) for i, v in enumerate(m)]).repartition(5)
    got = {}
    for r in K.knn(c, c.where("vec_id % 50 = 0"), 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        assert [i for _, i in sorted(got[q])] == np.argsort(-(u @ u[q]), kind="stable")[:4].tolist()


def test_knn_odd_vectors(spark):
    c = corpus(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, 0.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0])])
    hits = K.knn(c, c.where("vec_id = 1"), 9).orderBy("rank").collect()
    assert [(r.id, round(r.similarity, 6)) for r in hits] == [(1, 1.0), (2, 1.0), (7, 0.0), (7, 0.0)]  # ties to the smaller id
    assert K.knn(c.where("false"), c, 3).count() == 0
    assert K.knn(c, c.where("false"), 3).count() == 0


def test_groups_fallback_scope(spark):
    c = corpus(spark, [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])]).withColumn("g", F.when(F.col("vec_id") == 3, "b").otherwise("a"))
    q = c.where("vec_id = 1")
    assert sorted((r.grp, r.id) for r in K.knn(c, q, 1, group="g").collect()) == [("a", 1), ("b", 3)]
    near, far = K.knn(c, q, 2), K.knn(c, q, 3)
    assert K.with_fallback(near, near, 0.5).count() == 2
    assert K.with_fallback(far, near, 0.5).where("level = 'details'").count() == 2
    assert K.first_scope(near.withColumn("repo", F.when(F.col("rank") == 2, "r")), "repo").collect()[0].repo == "r"


def test_index_recall(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    m = np.concatenate([c + 0.3 * rng.normal(size=(60, 16)) for c in centres])
    c = corpus(spark, [(i, v.tolist()) for i, v in enumerate(m.astype(np.float32))])
    cc = K.fit_centres(c, cells=32)
    K.build_index(c, cc, str(tmp_path / "ix"))
    assert spark.read.parquet(str(tmp_path / "ix")).count() == 1200  # every row is indexed
    q = c.where("vec_id % 50 = 0")
    assert K.recall(K.knn(c, q, 5), K.search_index(str(tmp_path / "ix"), cc, q, 5, probes=8)) >= 0.9


def test_index_recall_on_given_data(spark, tmp_path):
    c = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    cc = K.fit_centres(c)
    K.build_index(c, cc, str(tmp_path / "ix"))
    q = c.where("vec_id % 50 = 0")
    assert K.recall(K.knn(c, q, 5), K.search_index(str(tmp_path / "ix"), cc, q, 5)) >= 0.9


DAY = 86400.0


def records(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, last_access_time double, access_count int, correct_count int, total_use_count int, created_time double, saved_at string").withColumn("saved_at", F.col("saved_at").cast("timestamp"))


def test_forgetting_score(spark):
    now = 100 * DAY
    rec = records(spark, [("old_wrong", now - 25 * DAY, 1, 0, 1, 0.0, "2024-01-01"), ("right", now - 25 * DAY, 1, 1, 1, 0.0, "2024-01-01"), ("often", 0.0, 2, 0, 2, 0.0, "2024-01-01"), ("now", now, 1, 0, 1, 0.0, "2024-01-01"), ("future", now + 9 * DAY, 1, 0, 1, 0.0, "2024-01-01"), ("unused", now - 30 * DAY, 0, 0, 0, 0.0, "2024-01-01")])
    s = {r.doc_id: r.forgetting_score for r in R.scored(rec, now).collect()}
    assert s["old_wrong"] >= 0.7 > s["right"] and s["often"] <= 0.625 and s["now"] == 0 and s["future"] == 0 and s["unused"] > 0.7
    hits = spark.createDataFrame([(1, d, 0.9 - k / 100, k + 1) for k, d in enumerate(["old_wrong", "right", "unknown", "now"])], "query_id long, doc_id string, similarity double, rank int")
    top, stats = R.forgetting(hits, R.latest_records(rec), now, 2)
    assert [r.doc_id for r in top.orderBy("final_rank").collect()] == ["now", "right"]
    assert tuple(stats.first())[1:] == (4, 1, 0.25)


def test_latest_record(spark):
    rec = records(spark, [("a", None, 1, 0, 1, 5.0, "2024-01-01"), ("a", 9.0, 2, 1, 2, 5.0, "2024-01-02"), ("a", 8.0, 1, 1, 2, 5.0, "2024-01-02"), (None, 1.0, 1, 1, 1, 1.0, "2024-01-01"), ("b", None, 1, 0, 1, 5.0, None)])
    assert sorted((r.doc_id, r.last_access_time, r.access_count) for r in R.latest_records(rec).collect()) == [("a", 9.0, 2), ("b", 5.0, 1)]


def test_lifecycle_bounds(spark):
    df = spark.createDataFrame([(w,) for w in (0.05, 0.2, 0.5, 0.8, 0.81, 0.051, None)], "w double").select("w", M.lifecycle_state(F.col("w")).alias("s"), M.attenuation(M.lifecycle_state(F.col("w"))).alias("a"))
    assert {r.w: (r.s, r.a) for r in df.collect()} == {0.05: ("Suppressed", 0.05), 0.2: ("Archived", 0.2), 0.5: ("Cold", 0.5), 0.8: ("Warm", 0.8), 0.81: ("Active", 1.0), 0.051: ("Archived", 0.2), None: (None, None)}


def test_mmr_and_diversity(spark):
    c = corpus(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])])
    q = spark.createDataFrame([(9, [1.0, 1.0])], "vec_id long, embedding array<float>")
    cands = R.candidates(K.knn(c, q, 3), c)
    assert [r.id for r in R.mmr(cands, 3).orderBy("pick").collect()] == [1, 3, 2]
    assert [r.id for r in R.mmr(cands, 3, lam=1.0).orderBy("pick").collect()] == [1, 2, 3]
    assert [r.id for r in R.mmr(cands, 1).collect()] == [1]
    assert abs(R.diversity(cands).first().diversity - (0 + 1 + 1) / 3) < 1e-6
    assert R.diversity(R.candidates(K.knn(c, q, 1), c)).first().diversity == 0


def test_embedder(spark):
    df = V.embed(spark.createDataFrame([("a b",), (None,), ("",)], "t string"), "t")
    n = [sum(x * x for x in r.embedding) for r in df.collect()]
    assert abs(n[0] - 1) < 1e-5 and n[1] == n[2] == 0
    pair = df.select(V.cosine_similarity(F.col("embedding"), F.col("embedding")).alias("c")).collect()
    assert abs(pair[0].c - 1) < 1e-6 and pair[1].c is None


def test_dot_takes_vectors_as_they_are(spark):
    c = corpus(spark, [(1, [1.0, 0.0]), (2, [3.0, 3.0]), (3, [0.0, 2.0])])
    q = c.where("vec_id = 1")
    assert [(r.id, r.similarity) for r in K.knn(c, q, 3, metric="dot").orderBy("rank").collect()] == [(2, 3.0), (1, 1.0), (3, 0.0)]
    assert [r.id for r in K.knn(c, q, 3).orderBy("rank").collect()] == [1, 2, 3]


def test_scoped_and_leveled_search(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(240, 6)).astype(np.float32)
    c = corpus(spark, [(i, v.tolist()) for i, v in enumerate(m)]).withColumn("repo", F.when(F.col("vec_id") % 7 > 0, F.concat(F.lit("r"), (F.col("vec_id") % 3).cast("string"))))
    q = c.where("vec_id % 40 = 1")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in K.knn_scoped(c.repartition(4), q, 3, "repo").orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for i in range(1, 240, 40):
        same = [j for j in range(240) if j % 7 and j % 3 == i % 3] if i % 7 else []
        assert got.get(i, []) == sorted(same, key=lambda j: (-(u[i] @ u[j]), j))[:3]
    first, second = c.where("vec_id % 2 = 0"), c.where("vec_id % 2 = 1")
    one = K.with_fallback(K.knn(first, q, 3), K.knn(second, q, 3), 0.4)
    two = K.search_levels(first, second, q, 3, 0.4)
    keys = ["query_id", "id", "level", "rank"]
    assert sorted(map(tuple, one.select(*keys).collect())) == sorted(map(tuple, two.select(*keys).collect()))
    assert K.search_levels(first.where("false"), second, q, 3, 0.4).where("level = 'details'").count() == 18
