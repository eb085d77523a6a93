"""Hash-chained ledgers: writing chains of ordered entries, and checking them in parallel."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import entry_hash

GENESIS_PREVIOUS = "0" * 64


def build_chains(entries: DataFrame, chain: str = "chain", order: str = "ordinal", kind: str = "event_type", payload: str = "payload") -> DataFrame:
    """(chain, sequence_number, event_type, payload, prev_hash, entry_hash), one chain per key.

    An entry's hash needs that of the entry before, so a chain is one pass over its ordered entries; chains are
    parallel. A partition is a sorted stream, of which a task holds one batch and the last hash.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, last = object(), 0, GENESIS_PREVIOUS
        for b in batches:
            numbers, before, hashes = [], [], []
            for c, k, p in zip(b["chain"], b["event_type"], b["payload"]):
                if c != now:
                    now, n, last = c, 0, GENESIS_PREVIOUS
                before.append(last)
                last = sha256("|".join(str(x) for x in (n, k, p, last) if x is not None).encode()).hexdigest()
                numbers.append(n)
                hashes.append(last)
                n += 1
            yield pd.DataFrame({chain: b["chain"], "sequence_number": numbers, "event_type": b["event_type"], "payload": b["payload"], "prev_hash": before, "entry_hash": hashes})

    src = entries.select(F.col(chain).alias("chain"), F.col(order).alias("o"), F.col(kind).alias("event_type"), F.col(payload).alias("payload"))
    rows = src.repartition("chain").sortWithinPartitions("chain", "o", "event_type", "payload").select("chain", "event_type", "payload")
    kt = entries.schema[chain].dataType.simpleString()
    return rows.mapInPandas(run, f"{chain} {kt}, sequence_number int, event_type string, payload string, prev_hash string, entry_hash string")


def verify_chains(ledger: DataFrame, chain: str = "chain") -> DataFrame:
    """(chain, intact, first_broken, entries_checked): genesis, links and hashes, each entry beside the one before.

    Every entry can be checked alone once it stands beside the entry before, so a long chain is checked in parallel
    after one sort. Losing entries at the end can't be seen.
    """
    w = Window.partitionBy(chain).orderBy("sequence_number")
    x = ledger.withColumn("previous", F.lag("entry_hash").over(w)).withColumn("n", F.row_number().over(w))
    good = (
        (F.col("sequence_number") == F.col("n") - 1)
        & (F.col("prev_hash") == F.when(F.col("n") == 1, GENESIS_PREVIOUS).otherwise(F.col("previous")))
        & (F.col("entry_hash") == entry_hash(F.col("sequence_number"), F.col("event_type"), F.col("payload"), F.col("prev_hash")))
    )
    x = x.withColumn("bad", ~F.coalesce(good, F.lit(False)))
    out = x.groupBy(chain).agg(F.min(F.when(F.col("bad"), F.col("n"))).alias("b"), F.count("*").alias("total"), F.min_by("sequence_number", F.when(F.col("bad"), F.col("n"))).alias("first_broken"))
    return out.select(chain, F.col("b").isNull().alias("intact"), F.when(F.col("b").isNotNull(), F.col("first_broken")).alias("first_broken"), F.coalesce("b", "total").alias("entries_checked"))
