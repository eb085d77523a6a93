"""Parquet scans of the input tables and the common clean-up of delivered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan ``folder/name.parquet``; pruning and pushdown are left to the optimizer."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, scan: DataFrame) -> DataFrame:
    """``df`` over all cores where its ``scan`` has less than half as many partitions, as small files do.

    Large inputs have a partition for every split and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def latest_delivery(df: DataFrame, key: str = "id", order: str = "ingested_at") -> DataFrame:
    """One row per key: the delivery with the latest ``order`` value (nulls lose).

    A row with a null key can't be told from another delivery, so such rows are all kept.
    One shuffle on ``key``; a key repeats only as often as its row was delivered, so no group grows.
    """
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | F.col(key).isNull()).drop("_n")


#: Repeated keys that are sent to every task; with more of them whole rows are shuffled instead.
MOST_REPEATED = 500_000


def latest_wide(df: DataFrame, key: str = "id", order: str = "ingested_at", most: int = MOST_REPEATED) -> DataFrame:
    """As ``latest_delivery``, for rows with long texts: only keys and times are shuffled.

    One aggregation finds the keys that were delivered more than once and their latest time. Up to ``most`` of them (a
    checked bound) are broadcast and the rows filtered in place; beyond it, or where two deliveries of a key have the
    same time, the repeated rows go through the window. Every way gives one row per key; null keys are all kept.
    """
    spark = df.sparkSession
    seen = df.filter(F.col(key).isNotNull()).groupBy(key, order).agg(F.count("*").alias("n"))
    several = seen.groupBy(key).agg(F.sum("n").alias("n"), F.max_by("n", order).alias("ties"), F.max(order).alias("_last")).filter("n > 1")
    found = several.select(key, "_last", ((F.col("ties") > 1) | F.col("_last").isNull()).alias("_tie")).limit(most + 1).collect()
    if len(found) > most:
        return latest_delivery(df, key, order)
    if not found:
        return df
    schema = T.StructType([df.schema[key], T.StructField("_last", df.schema[order].dataType), T.StructField("_tie", T.BooleanType())])
    marked = df.join(F.broadcast(spark.createDataFrame([tuple(r) for r in found], schema)), key, "left")
    once = marked.filter(F.col("_tie").isNull() | ~F.col("_tie") & (F.col(order) == F.col("_last"))).select(df.columns)
    if not any(r["_tie"] for r in found):
        return once
    return once.unionByName(latest_delivery(marked.filter("_tie").select(df.columns), key, order))


def clean_key(c: Column) -> Column:
    """Keys compare after trimming and lower-casing; blank becomes null."""
    k = F.lower(F.trim(c))
    return F.when(F.length(k) > 0, k)
