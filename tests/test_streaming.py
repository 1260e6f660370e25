from __future__ import annotations

from cairn.runtime import table
from cairn.streaming import access as A
from pyspark.sql import functions as F


def test_stream_equals_batch(spark, sf, tmp_path):
    src = A.stream_of(spark, f"{sf}/events.parquet", table(spark, sf, "events"))
    A.run_available(A.tumbling(A.accesses(src)), str(tmp_path / "o"), str(tmp_path / "c"))
    batch = A.tumbling(A.accesses(table(spark, sf, "events")))
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.exceptAll(batch).count() == 0 and 0 <= batch.count() - got.count() <= 1  # the last window is still open


def test_checkpoint_resumes(spark, sf, tmp_path):
    src = lambda: A.stream_of(spark, f"{sf}/events.parquet", table(spark, sf, "events"))
    for _ in range(2):
        A.run_available(src(), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == table(spark, sf, "events").count()


def test_records_merge(spark, sf):
    log = A.accesses(table(spark, sf, "events"))
    cut_at = F.lit("2024-01-12").cast("timestamp")
    m = A.merge_records(A.record_upkeep(log.where(F.col("ts") < cut_at)), A.record_upkeep(log.where(F.col("ts") >= cut_at)))
    whole = A.record_upkeep(log)
    assert m.exceptAll(whole).count() == 0 and m.count() == whole.count()


def test_ttl(spark):
    assert A.ttl_hits([0, 10, 3600, 3601, 3602]) == [False, True, True, False, True]
    log = spark.createDataFrame([("a", t) for t in (0, 10, 3600, 3601, 3602)] + [("b", 5)], "doc_id string, s long").select("doc_id", F.timestamp_seconds("s").alias("ts"))
    assert sorted(map(tuple, A.replay_ttl(log).collect())) == [("a", 5, 3), ("b", 1, 0)]
    assert A.replay_ttl(log.where("false")).count() == 0


def test_lru(spark):
    keys = ["a", "b", "a", "c", "b", "a"]
    log = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "doc_id string, s long").select("doc_id", F.timestamp_seconds("s").alias("ts"))
    # capacity 2: a, b miss; a hits; c evicts b; b evicts a; a misses
    assert tuple(A.replay_lru(log, shards=1, capacity=2).first()) == (0, 6, 1)


def test_as_of(spark):
    left = spark.createDataFrame([(1, "k", 100), (2, "k", 90_000), (3, "k", 5), (4, "z", 100), (5, None, 1)], "i long, k string, t long").withColumn("t", F.timestamp_seconds("t"))
    right = spark.createDataFrame([("k", 10, 1.0), ("k", 100, 2.0), ("k", 95_000, 3.0)], "k string, t long, v double").withColumn("t", F.timestamp_seconds("t"))
    got = {r.i: r.v for r in A.as_of(left, right, "k", "t", "t", ["v"]).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: None, 4: None, 5: None}


def test_ttl_replay_by_segments(spark):
    """Segments of hot and cold keys over many slices, against one pass over each key."""
    import datetime as dt
    import random

    from cairn.streaming import access as A

    rng, rows = random.Random(3), []
    for key, n, mean in (("hot", 900, 700), ("cold", 40, 90_000), ("even", 60, 3600), ("once", 1, 1)):
        t = 1_700_000_000.0
        for _ in range(n):
            t += mean if key == "even" else rng.expovariate(1 / mean)
            rows.append((key, dt.datetime.fromtimestamp(round(t, 3), dt.timezone.utc), True))
    rows += rows[:5]
    log = spark.createDataFrame(rows, "doc_id string, ts timestamp, correct boolean").repartition(3)
    got = {r.doc_id: (r.uses, r.hits) for r in A.replay_ttl(log).collect()}
    want = {}
    for key in ("hot", "cold", "even", "once"):
        times = sorted(r[1].timestamp() for r in rows if r[0] == key)
        want[key] = (len(times), sum(A.ttl_hits(times)))
    assert got == want and 0 < want["hot"][1] < 905
    assert A.segments(log, 3600.0).where("doc_id = 'hot'").select("seg").distinct().count() > 1
    assert A.replay_ttl(log.where("false")).count() == 0
