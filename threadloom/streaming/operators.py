"""Windows over event time, idempotent ingestion and stateful lockout as streams.

The transformations take any streaming DataFrame. ``run_once`` drives one to its end over the files that are there,
with a checkpoint in the shared folder, and returns what it wrote.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Failures within the window that lock a key, the window and the lock in seconds; fixed values.
FAILURES, WINDOW_S, LOCK_S = 5, 900, 900


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Stream of a folder of parquet files (or of one file, through its name)."""
    schema = spark.read.parquet(path).schema
    folder, pattern = (path, "*.parquet") if os.path.isdir(path) else (os.path.dirname(path), os.path.basename(path))
    s = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    for f in s.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":  # event times of watermarks are instants
            s = s.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return s


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='threadloom-')}/stream-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that is there, in micro-batches; the output is read back from parquet (or memory for other modes)."""
    spark = stream.sparkSession
    at = shared_folder(spark)
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/state")
    if mode == "append":
        w.format("parquet").option("path", f"{at}/out").outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")

    def write(df: DataFrame, batch: int) -> None:
        # The last complete result replaces the one before; batches come in order.
        df.write.mode("overwrite").parquet(f"{at}/complete")

    w.outputMode(mode).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/complete")


def tumbling_counts(events: DataFrame, key: str, ts: str = "ts", width: str = "1 hour", late: str = "40 days") -> DataFrame:
    """Events per key and window; rows later than ``late`` behind the newest are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sliding_bursts(events: DataFrame, key: str, ts: str = "ts", width: str = "15 minutes", slide: str = "5 minutes", least: int = 3, late: str = "40 days") -> DataFrame:
    """Sliding windows that hold at least ``least`` events of a key; an approximation of bursts, not their definition."""
    c = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), key).agg(F.count("*").alias("n"))
    return c.filter(F.col("n") >= least).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "8 hours", late: str = "40 days") -> DataFrame:
    """Sessions of a key: a gap of ``gap`` without events ends one."""
    c = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return c.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(rows: DataFrame, key: str, ts: str, late: str = "400 days") -> DataFrame:
    """First delivery of each key within the watermark: idempotent ingestion."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def lockouts_of(times: list[tuple[float, str]], recent: list[float], locked: float, failure: str = "error", reset: str = "signup") -> tuple[list[float], list[float], float]:
    """(starts of locks, failures that still count, end of the lock) after ordered (time, kind) events of a key."""
    out = []
    for t, kind in times:
        if t < locked:
            continue
        if kind == reset:
            recent = []
        elif kind == failure:
            recent = [x for x in recent if t - x <= WINDOW_S] + [t]
            if len(recent) >= FAILURES:
                out.append(t)
                locked, recent = t + LOCK_S, []
    return out, recent, locked


def lockouts(events: DataFrame, key: str = "user_id", ts: str = "ts", kind: str = "event_type", late: str = "1 hour") -> DataFrame:
    """(key, locked_at) of keys with too many failures in the window; a success resets, a lock ignores what follows.

    State per key is the failures of one window and the end of a lock; it times out a window and a lock after the last
    event, once the watermark is past that. Rows of a micro-batch are ordered by time within their key.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        d = pd.concat(list(parts))
        recent, locked = (list(state.get[0]), state.get[1]) if state.exists else ([], -1.0)
        times = sorted(zip(d["t"].tolist(), d["k"].tolist()))
        hits, recent, locked = lockouts_of(times, recent, locked)
        state.update((recent, locked))
        state.setTimeoutTimestamp(max(int((times[-1][0] + WINDOW_S + LOCK_S) * 1000), state.getCurrentWatermarkMs() + 1))
        if hits:
            yield pd.DataFrame({key: [k[0]] * len(hits), "locked_at": hits})

    kt = events.schema[key].dataType.simpleString()
    src = events.withWatermark(ts, late).select(key, ts, (F.unix_micros(F.col(ts)) / 1e6).alias("t"), F.col(kind).alias("k"))
    return src.groupBy(key).applyInPandasWithState(step, f"{key} {kt}, locked_at double", "recent array<double>, locked double", "append", GroupStateTimeout.EventTimeTimeout)


#: How long a request may stay open, in seconds; a fixed value.
OPEN_S = 48 * 3600


def escalations(events: DataFrame, key: str = "id", ts: str = "ts", what: str = "what", late: str = "0 seconds") -> DataFrame:
    """(key, escalated_at) of keys that were created and not resolved within the time: an event-time timer per key.

    State is the time of creation; a timer fires once the watermark is past the term. A resolution that comes at the
    term or later finds it escalated. Events of a key in one micro-batch are taken in order of time.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        created = state.get[0] if state.exists else None
        out = lambda t: pd.DataFrame({key: [k[0]], "escalated_at": [pd.Timestamp(t + OPEN_S, unit="s", tz="UTC")]})
        if state.hasTimedOut:
            state.remove()
            yield out(created)
            return
        d = pd.concat(list(parts))
        done = False
        for t, w in sorted(zip(d["t"].tolist(), d["w"].tolist())):
            if w == "created" and created is None and not done:
                created = t
            elif w == "resolved" and created is not None:
                if t >= created + OPEN_S:
                    yield out(created)
                created, done = None, True
        if created is None:
            if state.exists:
                state.remove()
            return
        due = int((created + OPEN_S) * 1000)
        if due < state.getCurrentWatermarkMs():
            yield out(created)
            if state.exists:
                state.remove()
            return
        state.update((created,))
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    kt = events.schema[key].dataType.simpleString()
    src = events.withWatermark(ts, late).select(key, ts, (F.unix_micros(F.col(ts)) / 1e6).alias("t"), F.col(what).alias("w"))
    return src.groupBy(key).applyInPandasWithState(step, f"{key} {kt}, escalated_at timestamp", "created double", "append", GroupStateTimeout.EventTimeTimeout)
