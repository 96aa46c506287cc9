"""Streaming queries over the events table, run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.streaming import streams


def stream_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of user and type, each once."""
    return streams.run_to_end(streams.first_seen(streams.table_stream(spark, sf, "events"), ["user_id", "event_type"]))


def stream_throttled_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Errors that are notified, at most one in 720 minutes for each user."""
    errors = streams.table_stream(spark, sf, "events").filter("event_type = 'error'")
    return streams.throttled_to_end(errors, "user_id", "ts", "event_id", 720, "1 hour")


def stream_latest_event(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of each user, merged batch by batch."""
    events = streams.table_stream(spark, sf, "events").select("user_id", "event_id", "event_type")
    return streams.upsert_batches(events, "user_id", "event_id", streams.scratch(spark, "stream-merge"), streams.scratch(spark, "stream-state"))


def stream_dedupe_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Number of distinct user, type and day keys that pass the de-duplication."""
    events = streams.table_stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("at"), F.concat_ws("|", "user_id", "event_type", F.col("ts").cast("date")).alias("dedupe_key"))
    return streams.run_to_end(streams.deduplicated(events, "dedupe_key", "at", "40 days")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stream_first_seen, stream_throttled_errors, stream_latest_event, stream_dedupe_keys)}

ORACLE_SQL = {
    "stream_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_throttled_errors": "WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'error'), f AS (SELECT user_id, event_id, r, ts AS last, true AS notify FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.event_id, e.r, CASE WHEN e.ts - f.last >= INTERVAL 720 MINUTE THEN e.ts ELSE f.last END, e.ts - f.last >= INTERVAL 720 MINUTE FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1) SELECT user_id, event_id, r AS count, notify FROM f",
    "stream_latest_event": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "stream_dedupe_keys": "SELECT count(DISTINCT user_id || '|' || event_type || '|' || ts::DATE) AS n FROM events",
}
