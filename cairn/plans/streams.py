"""Access logs: streamed windows and sessions, record upkeep, point in time, cache replay, as-of join."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn.runtime import forget_on_exit, shared_dir, table
from cairn.streaming import access as A


def _log(s, d):
    return A.accesses(table(s, d, "events"))


def _streamed(s, d, op, name):
    """Run an operator over the event log as a stream, to its end, and read what it wrote."""
    at = f"{shared_dir(s)}/cairn-{name}-{uuid.uuid4().hex}"
    src = A.stream_of(s, f"{d}/events.parquet", table(s, d, "events"))
    A.run_available(op(A.accesses(src)), at + "/out", at + "/state")
    forget_on_exit(s, at)
    return s.read.parquet(at + "/out")


def _as_text(df, *times):
    """Times as text, so that no reader's time zone enters the result."""
    return df.withColumns({t: F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS") for t in times})


def stream_access_tumbling(s, d):
    return _as_text(_streamed(s, d, A.tumbling, "tumbling"), "window_start", "window_end")


def stream_session(s, d):
    return _as_text(_streamed(s, d, A.sessions, "sessions"), "session_start", "session_end")


def batch_tumbling(s, d):
    return _as_text(A.tumbling(_log(s, d)), "window_start", "window_end")


def records_from_log(s, d):
    return A.record_upkeep(_log(s, d)).select("doc_id", F.round("last_access_time", 3).alias("last_access_time"), "access_count", "correct_count", "total_use_count")


def merged_records(s, d):
    log = _log(s, d)
    half = F.lit("2024-01-15").cast("timestamp")
    m = A.merge_records(A.record_upkeep(log.where(F.col("ts") < half)), A.record_upkeep(log.where(F.col("ts") >= half)))
    return m.select("doc_id", F.round("last_access_time", 3).alias("last_access_time"), "access_count", "correct_count")


def records_at(s, d):
    return A.records_at(_log(s, d), "2024-01-10").select("doc_id", F.round("last_access_time", 3).alias("last_access_time"), "access_count")


def cache_replay_ttl(s, d):
    return A.replay_ttl(_log(s, d))


def engine_stats(s, d):
    """Hits, misses, rate and latency of an engine whose answers are cached, over the event log."""
    r = A.engine_stats(A.replay_ttl(_log(s, d)), table(s, d, "events"), "value")
    return r.select("queries", "hits", "misses", F.round("hit_rate", 6).alias("hit_rate"), F.round("avg_latency", 6).alias("avg_latency"))


def cache_replay_lru(s, d):
    return A.replay_lru(_log(s, d), shards=4, capacity=16)


def as_of_error(s, d):
    """Each purchase with the value of the user's last error before it."""
    e = table(s, d, "events").where("user_id is not null and ts is not null")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    errors = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("ets"), F.col("value").alias("error_value"))
    return A.as_of(buys, errors, "user_id", "ts", "ets", ["error_value"]).select("event_id", "user_id", "error_value")


QUERIES = {f.__name__: f for f in (stream_access_tumbling, stream_session, batch_tumbling, records_from_log, merged_records, records_at, cache_replay_ttl, engine_stats, cache_replay_lru, as_of_error)}

_LOG = "l AS (SELECT 'u_' || user_id AS doc_id, ts, coalesce(event_type <> 'error', true) AS ok FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)"
_WIN = "w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS b, count(*) AS uses, count(*) FILTER (ok) AS correct FROM l GROUP BY 1)"
_TEXT = "'%Y-%m-%d %H:%M:%S.%f'"
_COLS = f"strftime(b, {_TEXT}) AS window_start, strftime(b + INTERVAL 1 DAY, {_TEXT}) AS window_end, uses, correct"

SQL = {
    "stream_access_tumbling": f"WITH {_LOG}, {_WIN} SELECT {_COLS} FROM w WHERE b + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM l)",
    "batch_tumbling": f"WITH {_LOG}, {_WIN} SELECT {_COLS} FROM w",
    "stream_session": f"""WITH {_LOG}, n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY doc_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM l), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT doc_id, strftime(min(ts), {_TEXT}) AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, {_TEXT}) AS session_end, count(*) AS uses FROM g GROUP BY doc_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM l)""",
    "records_from_log": f"WITH {_LOG} SELECT doc_id, round(epoch(max(ts)), 3) AS last_access_time, count(*)::INTEGER AS access_count, (count(*) FILTER (ok))::INTEGER AS correct_count, count(*)::INTEGER AS total_use_count FROM l GROUP BY doc_id",
    "merged_records": f"WITH {_LOG} SELECT doc_id, round(epoch(max(ts)), 3) AS last_access_time, count(*)::INTEGER AS access_count, (count(*) FILTER (ok))::INTEGER AS correct_count FROM l GROUP BY doc_id",
    "records_at": f"WITH {_LOG} SELECT doc_id, round(epoch(max(ts)), 3) AS last_access_time, count(*)::INTEGER AS access_count FROM l WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY doc_id",
    "cache_replay_ttl": f"""WITH RECURSIVE {_LOG}, p AS (SELECT doc_id, min(ts) AS t FROM l GROUP BY doc_id UNION ALL
SELECT p.doc_id, (SELECT min(l.ts) FROM l WHERE l.doc_id = p.doc_id AND l.ts > p.t + INTERVAL 3600 SECOND) FROM p WHERE p.t IS NOT NULL)
SELECT doc_id, uses, uses - puts AS hits FROM (SELECT doc_id, count(*) AS uses FROM l GROUP BY doc_id) JOIN (SELECT doc_id, count(t) AS puts FROM p GROUP BY doc_id) USING (doc_id)""",
    "as_of_error": """SELECT b.event_id, b.user_id, e.value AS error_value FROM (SELECT * FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL AND ts IS NOT NULL) b
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error' AND user_id IS NOT NULL AND ts IS NOT NULL) e ON b.user_id = e.user_id AND b.ts >= e.ts""",
}
SQL["engine_stats"] = f"""SELECT sum(uses)::BIGINT AS queries, sum(hits)::BIGINT AS hits, (sum(uses) - sum(hits))::BIGINT AS misses, round(100::DOUBLE * sum(hits) / sum(uses), 6) AS hit_rate, (SELECT round(avg(value), 6) FROM events) AS avg_latency FROM ({SQL["cache_replay_ttl"]})"""
