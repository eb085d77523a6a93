"""Synthetic case documents with known truth, from row numbers and hashes only, so they are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = ["Asha", "Bimal", "Charu", "Dinesh", "Esha", "Faisal", "Gita", "Hari"]
LAST = ["Arora", "Bose", "Chawla", "Dutta", "Ekka", "Faruqi", "Gill", "Handa"]
PLACES = ["Sector 4", "Lake Road", "Old Mandi", "Hill Colony"]


def _pick(values: list[str], salt: int, *key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(salt), *key), F.lit(len(values))) + 1).cast("int"))


def _phone(salt: int, *key: str) -> Column:
    return F.concat(F.lit("9"), F.lpad(F.pmod(F.xxhash64(F.lit(salt), *key), F.lit(1_000_000_000)).cast("string"), 9, "0"))


def reports(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, case_id, document_type, raw_text, person, phone, place): reports whose mentions are in columns."""
    d = spark.range(n).select("id", F.pmod("id", F.lit(max(1, n // 12))).alias("case_no"))
    d = d.withColumn("person", F.concat_ws(" ", _pick(FIRST, seed + 1, "id"), _pick(LAST, seed + 2, "id"))).withColumn("phone", _phone(seed + 3, "id")).withColumn("place", _pick(PLACES, seed + 4, "id"))
    text = F.concat(F.lit("Complainant "), "person", F.lit(" was seen at "), "place", F.lit(" and called from "), "phone", F.lit("."))
    return d.select(F.concat(F.lit("gen-"), "id").alias("id"), F.concat(F.lit("case-"), "case_no").alias("case_id"), F.lit("fir").alias("document_type"), text.alias("raw_text"), "person", "phone", "place")


def call_records(spark: SparkSession, n: int, seed: int = 0, burst_every: int = 10) -> DataFrame:
    """(document_id, caller, callee, ts, burst): every ``burst_every``-th record has four calls in ten minutes."""
    d = spark.range(n).withColumn("burst", F.pmod("id", F.lit(burst_every)) == 0)
    c = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    gap = F.when(F.col("burst"), F.col("k") * 200).otherwise(F.col("k") * 7200)
    return c.select(F.concat(F.lit("cdr-"), "id").alias("document_id"), _phone(seed + 1, "id").alias("caller"), _phone(seed + 2, "id").alias("callee"), F.timestamp_seconds(F.lit(1_767_225_600) + F.col("id") * 86_400 + gap).alias("ts"), "burst")


def payment_records(spark: SparkSession, n: int, seed: int = 0, structured_every: int = 10) -> DataFrame:
    """(document_id, sender, receiver, amount, structured): some records keep three payments under the threshold."""
    d = spark.range(n).withColumn("structured", F.pmod("id", F.lit(structured_every)) == 0)
    c = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    amount = F.when(F.col("structured"), 41_000 + F.col("k") * 3000).otherwise(900 + F.col("k") * 60_000)
    return c.select(F.concat(F.lit("pay-"), "id").alias("document_id"), _phone(seed + 5, "id").alias("sender"), F.concat(_phone(seed + 6, "id"), F.col("k")).alias("receiver"), amount.cast("double").alias("amount"), "structured")
