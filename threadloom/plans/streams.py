"""Streams over the event and document tables, run to their end; the reference SQL is that of the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.session import ship
from threadloom.sources.tables import table
from threadloom.streaming import operators as st

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly_counts(spark, d):
    s = st.tumbling_counts(st.read_files(spark, f"{d}/events.parquet"), "event_type")
    return st.run_once(s, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) - k * INTERVAL 5 MINUTES AS start, event_type, count(*) AS n FROM events, range(3) r(k) GROUP BY ALL HAVING count(*) >= 3")
def stream_sliding_bursts(spark, d):
    s = st.sliding_bursts(st.read_files(spark, f"{d}/events.parquet"), "event_type")
    return st.run_once(s, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 8 HOURS OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def stream_sessions(spark, d):
    s = st.sessions(st.read_files(spark, f"{d}/events.parquet"), "user_id")
    return st.run_once(s, "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT id, count(*) AS n FROM (SELECT DISTINCT id FROM source_documents) GROUP BY id")
def stream_ingestion(spark, d):
    """Documents ingested once each, though some are delivered twice."""
    s = st.read_files(spark, f"{d}/source_documents.parquet").select("id", "ingested_at")
    return st.run_once(st.deduplicated(s, "id", "ingested_at")).groupBy("id").agg(F.count("*").alias("n"))


@query()
def stream_lockouts(spark, d):
    """Locks of each user's gate, with the events replayed a thousand times as fast; a sign-up is a success, all else a failure."""
    ship(spark)
    kind = F.when(F.col("event_type") == "signup", "signup").otherwise("error")
    begin = 1_704_067_200
    e = st.read_files(spark, f"{d}/events.parquet").withColumn("event_type", kind)
    e = e.withColumn("ts", F.timestamp_micros(((F.unix_micros("ts") - begin * 1_000_000) / 1000 + begin * 1_000_000).cast("bigint")))
    return st.run_once(st.lockouts(e)).groupBy("user_id").agg(F.count("*").alias("n_locks"))


@query("""SELECT id, created_at + INTERVAL 48 HOURS AS escalated_at FROM (SELECT id, min(created_at) AS created_at, min(resolved_at) AS resolved_at FROM access_requests WHERE created_at IS NOT NULL GROUP BY id)
WHERE (resolved_at IS NULL OR resolved_at >= created_at + INTERVAL 48 HOURS) AND created_at + INTERVAL 48 HOURS < (SELECT greatest(max(created_at), max(resolved_at)) FROM access_requests WHERE created_at IS NOT NULL)""")
def stream_escalations(spark, d):
    """Requests that stay open for 48 hours, by a timer on event time."""
    ship(spark)
    r = st.read_files(spark, f"{d}/access_requests.parquet").filter("created_at IS NOT NULL")
    e = r.select("id", F.explode(F.array(F.struct(F.col("created_at").alias("ts"), F.lit("created").alias("what")), F.struct(F.col("resolved_at").alias("ts"), F.lit("resolved").alias("what")))).alias("e")).select("id", "e.ts", "e.what").filter("ts IS NOT NULL")
    return st.run_once(st.escalations(e)).select("id", F.col("escalated_at").cast("timestamp_ntz").alias("escalated_at"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_totals(spark, d):
    """Running totals of a stream without windows, complete at its end."""
    s = st.read_files(spark, f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return st.run_once(s, "complete")
