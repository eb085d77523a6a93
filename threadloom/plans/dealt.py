"""Queries of the core data-processing problems (5: nested payloads, 7: dangling references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.nested import flat_table, flatten_payloads, rejected_payloads
from threadloom.operators.references import Reference, change_events, maintain, orphan_keys, orphan_references, orphan_report, reference_rows, target_deltas
from threadloom.plans.jsonsql import elements
from threadloom.session import ship
from threadloom.sources.tables import latest_delivery, latest_wide, spread, table


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    scan = table(spark, d, "source_documents").select("id", "ingested_at", "structured")
    return spread(latest_wide(scan).filter("structured IS NOT NULL"), scan)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten_payloads(_payloads(spark, d), values=False).select("document_id", "node", "node_path", "parent_path")


def p5_calls(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of the call rows with their scalar fields."""
    nodes = flatten_payloads(_payloads(spark, d))
    return flat_table(nodes, "calls", {"caller": "string", "callee": "string", "timestamp": "string", "duration_seconds": "int"})


def p5_node_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of rows and of documents per flat table."""
    nodes = flatten_payloads(_payloads(spark, d), values=False)
    return nodes.groupBy("node").agg(F.count("*").alias("n_rows"), F.count_distinct("document_id").alias("n_documents"))


def p5_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that give no rows because they are no JSON, with the reason."""
    return rejected_payloads(_payloads(spark, d))


def _ends(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references, document rows, resolved rows)."""
    docs = latest_delivery(table(spark, d, "source_documents").select("id", "created_at", "deleted_at", "ingested_at"))
    resolved = table(spark, d, "resolved_entities").select("entity_id", "created_at", "deleted_at")
    refs = reference_rows(
        [
            Reference("entities", table(spark, d, "entities"), "source_document_id", "document"),
            Reference("evidence_links", table(spark, d, "evidence_links"), "entity_id", "resolved"),
            Reference("access_requests", table(spark, d, "access_requests"), "matched_entity_id", "resolved"),
        ]
    )
    return refs, docs, resolved


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs, docs, resolved = _ends(spark, d)
    return orphan_references(refs, [target_deltas("document", docs, "id"), target_deltas("resolved", resolved, "entity_id")])


#: Times between which changes arrive together in ``p7_maintained``.
BATCH_ENDS = ("2026-03-01", "2026-05-01")


def p7_maintained(spark: SparkSession, d: str) -> DataFrame:
    """Orphan keys from counts that are stored and brought up to date with one batch of changes after the other."""
    refs, docs, resolved = _ends(spark, d)
    events = change_events(refs, [("document", docs, "id"), ("resolved", resolved, "entity_id")])
    batch = sum((F.coalesce(F.col("at") >= F.lit(e).cast("timestamp_ntz"), F.lit(True)).cast("int") for e in BATCH_ENDS), F.lit(0))
    stored = None
    for k in range(len(BATCH_ENDS) + 1):
        stored = maintain(stored, events.filter(batch == k))
    return orphan_keys(stored)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("key")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p5_found, p5_calls, p5_node_counts, p5_rejects, p7_found, p7_report, p7_maintained)}

_P7 = """
WITH docs AS (SELECT lower(trim(id)) AS k, created_at, deleted_at FROM source_documents WHERE trim(id) <> ''
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1),
res AS (SELECT lower(trim(entity_id)) AS k, created_at, deleted_at FROM resolved_entities WHERE trim(entity_id) <> ''),
t AS (SELECT 'document' AS target, k, count(deleted_at) AS gone, count(*) AS n, min(created_at) AS first FROM docs GROUP BY k
      UNION ALL SELECT 'resolved', k, count(deleted_at), count(*), min(created_at) FROM res GROUP BY k),
r AS (SELECT DISTINCT 'entities' AS src_table, id AS row_id, lower(trim(source_document_id)) AS k, created_at, 'document' AS target FROM entities
      UNION SELECT DISTINCT 'evidence_links', id, lower(trim(entity_id)), created_at, 'resolved' FROM evidence_links
      UNION SELECT DISTINCT 'access_requests', id, lower(trim(matched_entity_id)), created_at, 'resolved' FROM access_requests),
o AS (SELECT src_table, row_id, r.k,
             CASE WHEN t.k IS NULL THEN 'missing' WHEN gone = n THEN 'deleted' WHEN first > r.created_at THEN 'late' END AS kind,
             strftime(r.created_at, '%Y-%m') AS period_month
      FROM r LEFT JOIN t ON r.target = t.target AND r.k = t.k WHERE r.k <> '')
"""
_P5_CALLS = f"SELECT id AS document_id, 'calls.' || i AS node_path, '' AS parent_path, CAST(i AS INT) AS ordinal, e->>'$.caller' AS caller, e->>'$.callee' AS callee, e->>'$.timestamp' AS timestamp, try_cast(e->>'$.duration_seconds' AS INT) AS duration_seconds FROM {elements('calls')}"
ORACLES = {
    "p5_calls": _P5_CALLS,
    "p7_found": _P7 + "SELECT src_table, row_id, kind, period_month FROM o WHERE kind IS NOT NULL",
    "p7_maintained": _P7
    + "SELECT r.target, r.k AS key, count(*) AS refs, coalesce(max(t.n), 0) AS rows FROM r LEFT JOIN t ON r.target = t.target AND r.k = t.k WHERE r.k <> '' AND coalesce(t.gone = t.n, true) GROUP BY 1, 2",
    "p7_report": _P7
    + "SELECT src_table, period_month, kind, count(*) AS n_refs, count(DISTINCT k) AS n_keys FROM o WHERE kind IS NOT NULL GROUP BY ALL",
}
