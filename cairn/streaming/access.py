"""Access logs as streams: record upkeep, windows, sessions, cache replay, incremental append.

A watermark bounds state; NTZ times are cast, since watermarks need TIMESTAMP.  Every streaming operator equals its
batch form over the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TTL_SECONDS, CAPACITY = 3600.0, 256
#: Times the ttl that a slice of a key's accesses spans.
SLICE_TTLS = 24


def accesses(events: DataFrame) -> DataFrame:
    """doc_id, ts, correct of an event log; an error event is a wrong use.  Rows without time or user are left out."""
    return events.where("ts is not null and user_id is not null").select(F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("event_type") != "error", F.lit(True)).alias("correct"))


def record_upkeep(log: DataFrame) -> DataFrame:
    """Access records of a log (batch or stream): last access, counts, creation."""
    secs = F.unix_micros("ts") / 1e6
    return log.groupBy("doc_id").agg(F.max(secs).alias("last_access_time"), F.count("*").cast("int").alias("access_count"), F.count_if("correct").cast("int").alias("correct_count"), F.count("*").cast("int").alias("total_use_count"), F.min(secs).alias("created_time"))


def merge_records(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored records and those of new accesses: later access, added counts, earlier creation."""
    names = ("last_access_time", "access_count", "correct_count", "total_use_count", "created_time")
    n = new.select("doc_id", *[F.col(c).alias(f"n_{c}") for c in names])
    add = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"n_{c}", F.lit(0))).cast("int").alias(c)
    return stored.join(n, "doc_id", "full").select("doc_id", F.greatest("last_access_time", "n_last_access_time").alias("last_access_time"), add("access_count"), add("correct_count"), add("total_use_count"), F.least("created_time", "n_created_time").alias("created_time"))


def records_at(log: DataFrame, at: str) -> DataFrame:
    """Point in time: the records as they were, from accesses up to ``at``."""
    return record_upkeep(log.where(F.col("ts") <= F.lit(at).cast("timestamp")))


def tumbling(log: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """window_start, window_end, uses, correct of each window."""
    g = log.withWatermark("ts", delay).groupBy(F.window("ts", width)).agg(F.count("*").alias("uses"), F.count_if("correct").alias("correct"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "uses", "correct")


def sessions(log: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """doc_id, session_start, session_end, uses."""
    g = log.withWatermark("ts", delay).groupBy("doc_id", F.session_window("ts", gap)).agg(F.count("*").alias("uses"))
    return g.select("doc_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "uses")


def stream_of(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 1) -> DataFrame:
    """A file stream of a parquet directory or file, with the schema of its batch form."""
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what there is and stop; a second run with the same checkpoint goes on where this one ended."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(each) if each else w.format("parquet").option("path", sink)).start()
    q.awaitTermination()


def ttl_hits(times: list[float], ttl: float = TTL_SECONDS) -> list[bool]:
    """For accesses of one key in order: an entry lives ttl seconds from when it was put; hits don't extend it."""
    out, put = [], None
    for t in times:
        hit = put is not None and t - put <= ttl
        out.append(hit)
        if not hit:
            put = t
    return out


def segments(log: DataFrame, ttl: float) -> DataFrame:
    """doc_id, t, seg of every access; seg is the time of the last access that came more than ``ttl`` after the one before.
    Whatever a cache held of a key is dead by then, so segments are replayed apart.

    A key's accesses are looked at by time slice; between slices only their first and last times are carried."""
    rows = log.select("doc_id", (F.unix_micros("ts") / 1e6).alias("t")).withColumn("s", F.floor(F.col("t") / (SLICE_TTLS * ttl)))
    by_slice, so_far = Window.partitionBy("doc_id").orderBy("s"), Window.partitionBy("doc_id", "s").orderBy("t")
    ends = rows.groupBy("doc_id", "s").agg(F.max("t").alias("end")).select("doc_id", "s", F.lag("end").over(by_slice).alias("before"))
    gap = rows.join(ends, ["doc_id", "s"]).withColumn("prev", F.coalesce(F.lag("t").over(so_far), "before"))
    marked = gap.select("doc_id", "s", "t", F.when(F.col("prev").isNull() | (F.col("t") - F.col("prev") > ttl), F.col("t")).alias("start"))
    starts = marked.groupBy("doc_id", "s").agg(F.max("start").alias("start"))
    carried = starts.select("doc_id", "s", F.last("start", ignorenulls=True).over(by_slice.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    own = F.max("start").over(so_far.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("own", own).join(carried, ["doc_id", "s"]).select("doc_id", "t", F.coalesce("own", "carried").alias("seg"))


def replay_ttl(log: DataFrame, ttl: float = TTL_SECONDS) -> DataFrame:
    """doc_id, uses, hits of a cache without capacity limit.

    Each segment's times (see ``segments``) are streamed in order; only the time of the live entry is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, put, uses, hits = None, None, 0, 0
        for b in batches:
            done = []
            for d, seg, t in zip(b["doc_id"], b["seg"], b["t"]):
                if (d, seg) != key:
                    if key is not None:
                        done.append((key[0], uses, hits))
                    key, put, uses, hits = (d, seg), None, 0, 0
                uses += 1
                if put is not None and t - put <= ttl:
                    hits += 1
                else:
                    put = t
            if done:
                yield pd.DataFrame(done, columns=["doc_id", "uses", "hits"])
        if key is not None:
            yield pd.DataFrame([(key[0], uses, hits)], columns=["doc_id", "uses", "hits"])

    rows = segments(log, ttl).repartition("doc_id", "seg").sortWithinPartitions("doc_id", "seg", "t")
    return rows.mapInPandas(run, "doc_id string, uses long, hits long").groupBy("doc_id").agg(F.sum("uses").alias("uses"), F.sum("hits").alias("hits"))


def engine_stats(replayed: DataFrame, timed: DataFrame, seconds: str) -> DataFrame:
    """One row: queries, hits, misses, hit_rate (percent), avg_latency of a replayed cache and of timed queries."""
    counts = replayed.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("queries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    latency = timed.agg((F.coalesce(F.sum(seconds), F.lit(0.0)) / F.greatest(F.count(seconds), F.lit(1))).alias("avg_latency"))
    rate = F.when(F.col("queries") > 0, 100.0 * F.col("hits") / F.greatest("queries", F.lit(1))).otherwise(0.0)
    return counts.crossJoin(latency).select("queries", "hits", (F.col("queries") - F.col("hits")).alias("misses"), rate.alias("hit_rate"), "avg_latency")  # one row by one row


def replay_lru(log: DataFrame, shards: int = 64, capacity: int = CAPACITY, ttl: float = TTL_SECONDS) -> DataFrame:
    """shard, uses, hits of caches sharded by key, each with its own capacity and ttl: expired entries go on read, the
    least recently used is evicted.  State is at most ``capacity`` keys a shard."""
    from collections import OrderedDict

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, list] = {}
        for b in batches:
            for s, d, t in zip(b["shard"], b["doc_id"], b["t"]):
                cache, counts = state.setdefault(s, [OrderedDict(), [0, 0]])
                counts[0] += 1
                if d in cache and t - cache[d] <= ttl:
                    counts[1] += 1
                    cache.move_to_end(d)
                    continue
                cache.pop(d, None)
                cache[d] = t
                if len(cache) > capacity:
                    cache.popitem(last=False)
        yield pd.DataFrame([(s, c[0], c[1]) for s, (_, c) in state.items()], columns=["shard", "uses", "hits"])

    rows = log.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", (F.unix_micros("ts") / 1e6).alias("t"))
    return rows.repartition("shard").sortWithinPartitions("shard", "t", "doc_id").mapInPandas(run, "shard int, uses long, hits long")


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str], slice_seconds: int = 86_400) -> DataFrame:
    """Each left row with the values of the newest right row of its key up to its time (null if none).

    Rows of both sides are put in time slices; within a slice the newest value is carried by a window over key and
    slice, and what a slice inherits comes from the slices' last values, so a hot key is split by time."""
    l_cols, v = F.struct(*left.columns), F.struct(*values)
    l_type, v_type = left.select(l_cols.alias("x")).schema["x"].dataType, right.select(v.alias("x")).schema["x"].dataType
    tag = lambda df, k, at, side, l, val: df.select(l.alias("l"), F.col(k).alias("k"), F.col(at).alias("t"), F.lit(side).alias("side"), val.alias("v"))
    both = tag(left, key, left_at, 1, l_cols, F.lit(None).cast(v_type)).unionByName(tag(right, key, right_at, 0, F.lit(None).cast(l_type), v))
    both = both.withColumn("s", F.floor(F.unix_seconds(F.col("t").cast("timestamp")) / slice_seconds))
    upto = Window.partitionBy("k", "s").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = both.where("side = 0").groupBy("k", "s").agg(F.max_by("v", "t").alias("end"))
    slices = both.select("k", "s").distinct().join(last, ["k", "s"], "left")
    carried = slices.select("k", "s", F.last("end", ignorenulls=True).over(Window.partitionBy("k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    got = both.withColumn("v", F.last("v", ignorenulls=True).over(upto)).where("side = 1").join(carried, ["k", "s"], "left").withColumn("v", F.coalesce("v", "carried"))
    return got.select("l.*", *[F.col(f"v.{c}").alias(c) for c in values])
