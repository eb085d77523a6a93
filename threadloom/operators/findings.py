"""Findings: payments kept under a threshold, bursts of communication, and how they are presented."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import checkpoint

#: Payments from LOWER up to (not including) THRESHOLD are under the threshold; fixed values.
THRESHOLD, LOWER = 50_000.0, 40_000.0
#: Titles, severities and tags of the kinds of findings; fixed values.
PRESENTATION = [
    ("hub_and_spoke", "Highly Connected Entity Detected", "high", "#Hub #Association"),
    ("financial_structuring", "Suspicious Transaction", "medium", "#Financial #Suspicious"),
    ("communication_burst", "Communication Burst Identified", "medium", "#Phone #Pattern"),
]


def in_band(amount: Column) -> Column:
    return (amount >= LOWER) & (amount < THRESHOLD)


def structuring_by_document(payments: DataFrame, least: int = 3) -> DataFrame:
    """Documents with at least ``least`` payments in the band."""
    p = payments.filter(in_band(F.col("amount")))
    return p.groupBy("document_id").agg(F.count("*").alias("n_payments"), F.round(F.sum("amount"), 2).alias("total")).filter(F.col("n_payments") >= least)


def structuring_by_sender(payments: DataFrame, least: int = 3, receivers: int = 2) -> DataFrame:
    """Senders with payments in the band to at least ``receivers`` receivers, over all documents; null receivers don't count."""
    p = payments.filter(in_band(F.col("amount")) & F.col("sender").isNotNull())
    return (
        p.groupBy("sender")
        .agg(F.count("*").alias("n_payments"), F.round(F.sum("amount"), 2).alias("total"), F.count_distinct("receiver").alias("n_receivers"), F.count_distinct("document_id").alias("n_documents"))
        .filter((F.col("n_payments") >= least) & (F.col("n_receivers") >= receivers))
    )


def burst_members(calls: DataFrame, keys: list[str], ts: str, minutes: int = 15, least: int = 3) -> DataFrame:
    """Calls that are at least the ``least``-th within the inclusive window before them."""
    by = ", ".join(keys)
    n = F.expr(f"count(*) OVER (PARTITION BY {by} ORDER BY {ts} RANGE BETWEEN INTERVAL {minutes} MINUTES PRECEDING AND CURRENT ROW)")
    return calls.filter(F.col(ts).isNotNull()).withColumn("n_in_window", n).filter(F.col("n_in_window") >= least)


def burst_segments(calls: DataFrame, keys: list[str], ts: str, minutes: int = 15, least: int = 3) -> DataFrame:
    """Number of bursts and calls per key, by one pass over the sorted times.

    The window slides with its start; when it holds ``least`` calls and its last one is beyond what the last burst
    claimed, a burst begins and claims all calls within the window's length of its first call. Later windows slide on
    from the same start, so calls may serve two bursts. A task holds the calls of one window, not those of a key.
    """
    width = minutes * 60.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, window, claimed, calls_n, bursts, out = None, deque(), -1.0, 0, 0, []
        for b in batches:
            for *key, t in b.itertuples(index=False, name=None):
                if key != now:
                    if bursts:
                        out.append((*now, calls_n, bursts))
                    now, window, claimed, calls_n, bursts = key, deque(), -1.0, 0, 0
                calls_n += 1
                window.append(t)
                while window[0] < t - width:
                    window.popleft()
                if len(window) >= least and t > claimed:
                    bursts += 1
                    claimed = window[0] + width
            if out:
                yield pd.DataFrame(out, columns=[*keys, "n_calls", "n_bursts"])
                out = []
        if bursts:
            yield pd.DataFrame([(*now, calls_n, bursts)], columns=[*keys, "n_calls", "n_bursts"])

    src = calls.filter(F.col(ts).isNotNull()).select(*keys, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    kinds = ", ".join(f"{k} {calls.schema[k].dataType.simpleString()}" for k in keys)
    return src.repartition(*keys).sortWithinPartitions(*keys, "t").mapInPandas(run, f"{kinds}, n_calls int, n_bursts int")


def count_bursts(times: list[float], width: float = 900.0, least: int = 3) -> int:
    """The same fold in plain Python, for one key."""
    t = sorted(times)
    i = n = 0
    claimed = -1.0
    for j, x in enumerate(t):
        while t[i] < x - width:
            i += 1
        if j - i + 1 >= least and x > claimed:
            n += 1
            claimed = t[i] + width
    return n


def numbered(findings: DataFrame, group: str, by: str) -> DataFrame:
    """Findings with their number ``n`` within the group, from 0 in the order of ``by``.

    Rows are sorted over all tasks by range; each is numbered within its range, and the counts of the ranges before,
    one row a range and group, are added. No group is brought into one task.
    """
    x = checkpoint(findings.repartitionByRange(F.col(group), F.col(by)).withColumn("_part", F.spark_partition_id()))
    c = x.groupBy(group, "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    c = c.select(group, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(by)) - 1
    return x.withColumn("_k", inside).join(c, [group, "_part"]).withColumn("n", F.col("_k") + F.col("_before")).drop("_k", "_part", "_before")


def present(findings: DataFrame) -> DataFrame:
    """Findings (kind, subject) with title, severity and tags; other kinds get a title made of their name."""
    spark = findings.sparkSession
    p = spark.createDataFrame(PRESENTATION, "kind string, title string, severity string, tags string")
    x = findings.join(F.broadcast(p), "kind", "left")
    return x.select("kind", "subject", F.coalesce("title", F.initcap(F.replace("kind", F.lit("_"), F.lit(" ")))).alias("title"), F.coalesce("severity", F.lit("medium")).alias("severity"), F.coalesce("tags", F.lit("")).alias("tags"))
