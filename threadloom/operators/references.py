"""References to records that do not exist, from signed counts per key.

Every change is a delta row ``(key, refs, exists, rows, created)``: a reference adds +1 to ``refs``, a written target
row +1 to ``rows`` and ``exists``, a withdrawal -1 to ``exists``. Summing the deltas per key is one partial + final
aggregation, so a key that holds a third of all references is reduced before the shuffle. Keys with positive ``refs``
and zero ``exists`` are the orphans; keys that exist but were created after a reference are its late targets.
Only keys of that report are joined back to their references.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import checkpoint
from threadloom.sources.tables import clean_key, latest_delivery


@dataclass(frozen=True)
class Reference:
    """A column of ``rows`` that points to keys of the target called ``target``."""

    src_table: str
    rows: DataFrame
    column: str
    target: str
    row_key: str = "id"


def reference_rows(refs: Iterable[Reference]) -> DataFrame:
    """(target, key, src_table, row_id, created_at) of every non-blank reference, one row per source row."""
    out = None
    for r in refs:
        rows = latest_delivery(
            r.rows.select(F.col(r.row_key).alias("row_id"), F.col(r.column).alias("raw_key"), "created_at", "ingested_at"),
            "row_id",
        )
        d = rows.select(
            F.lit(r.target).alias("target"), clean_key(F.col("raw_key")).alias("key"), F.lit(r.src_table).alias("src_table"), "row_id", "created_at"
        ).filter(F.col("key").isNotNull())
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise ValueError("no references given")
    return out


def target_deltas(target: str, rows: DataFrame, key: str) -> DataFrame:
    """Existence deltas of one target table: +1 for the written row and -1 for its withdrawal."""
    return rows.select(
        F.lit(target).alias("target"),
        clean_key(F.col(key)).alias("key"),
        F.lit(0).cast("long").alias("refs"),
        F.lit(1).cast("long").alias("rows"),
        F.when(F.col("deleted_at").isNull(), 1).otherwise(0).cast("long").alias("exists"),
        F.col("created_at").alias("created"),
        F.lit(None).cast("timestamp_ntz").alias("first_ref"),
    ).filter(F.col("key").isNotNull())


def key_counts(references: DataFrame, targets: Iterable[DataFrame]) -> DataFrame:
    """Signed counts per (target, key), summed from all deltas; mergeable with the counts of earlier runs."""
    deltas = references.select(
        "target",
        "key",
        F.lit(1).cast("long").alias("refs"),
        F.lit(0).cast("long").alias("rows"),
        F.lit(0).cast("long").alias("exists"),
        F.lit(None).cast("timestamp_ntz").alias("created"),
        F.col("created_at").cast("timestamp_ntz").alias("first_ref"),
    )
    for t in targets:
        deltas = deltas.unionByName(t.withColumn("created", F.col("created").cast("timestamp_ntz")))
    return merge_counts(deltas)


def merge_counts(counts: DataFrame) -> DataFrame:
    """Sum of counts per key; merging stored counts with the deltas of later changes gives the current counts."""
    return counts.groupBy("target", "key").agg(
        F.sum("refs").alias("refs"), F.sum("rows").alias("rows"), F.sum("exists").alias("exists"), F.min("created").alias("created"), F.min("first_ref").alias("first_ref")
    )


def change_events(references: DataFrame, targets: Iterable[tuple[str, DataFrame, str]]) -> DataFrame:
    """Delta rows with the time ``at`` of their change: a reference or target row when it is created, a withdrawal apart.

    ``targets``: (target, rows with created_at and deleted_at, key column). Rows without a time have a null ``at``.
    """
    no_time = F.lit(None).cast("timestamp_ntz")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    at = F.col("created_at").cast("timestamp_ntz")
    out = references.select("target", "key", one.alias("refs"), zero.alias("rows"), zero.alias("exists"), no_time.alias("created"), at.alias("first_ref"), at.alias("at"))
    for target, rows, key in targets:
        k = rows.select(F.lit(target).alias("target"), clean_key(F.col(key)).alias("key"), at.alias("created"), F.col("deleted_at").cast("timestamp_ntz").alias("gone")).filter(F.col("key").isNotNull())
        out = out.unionByName(k.select("target", "key", zero.alias("refs"), one.alias("rows"), one.alias("exists"), "created", no_time.alias("first_ref"), F.col("created").alias("at")))
        out = out.unionByName(
            k.filter("gone IS NOT NULL").select("target", "key", zero.alias("refs"), zero.alias("rows"), F.lit(-1).cast("long").alias("exists"), no_time.alias("created"), no_time.alias("first_ref"), F.col("gone").alias("at"))
        )
    return out


def maintain(stored: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """Counts after ``deltas`` are applied to ``stored`` ones; the result is written in the shared folder and cuts lineage.

    Only the stored counts and the new deltas are read, never the tables behind earlier deltas.
    """
    d = deltas.select("target", "key", "refs", "rows", "exists", "created", "first_ref")
    return checkpoint(merge_counts(d if stored is None else stored.unionByName(d)))


def orphan_keys(counts: DataFrame) -> DataFrame:
    """(target, key, refs, rows) of keys with references and no existing target row: the current orphan report by key."""
    return counts.filter((F.col("refs") > 0) & (F.col("exists") == 0)).select("target", "key", "refs", "rows")


def orphan_references(references: DataFrame, targets: Iterable[DataFrame]) -> DataFrame:
    """(src_table, row_id, kind, period_month, key) of each reference without a live target at its time.

    kind: ``missing`` (no target row ever), ``deleted`` (all target rows withdrawn), ``late`` (earliest target row is
    younger than the reference). Null and blank references give no rows; a null ``created_at`` of the reference gives a
    null month and is never late. Empty tables give an empty report.
    """
    counts = key_counts(references, targets)
    bad = counts.filter((F.col("refs") > 0) & ((F.col("exists") == 0) | (F.col("created") > F.col("first_ref")))).select("target", "key", "rows", "exists", "created")
    kind = (
        F.when(F.col("rows") == 0, "missing")
        .when(F.col("exists") == 0, "deleted")
        .when(F.col("created") > F.col("created_at"), "late")
    )
    return (
        references.join(bad, ["target", "key"])
        .withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select("src_table", "row_id", "kind", F.date_format("created_at", "yyyy-MM").alias("period_month"), "key")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per table, period and kind."""
    return orphans.groupBy("src_table", "period_month", "kind").agg(F.count("*").alias("n_refs"), F.count_distinct("key").alias("n_keys"))
