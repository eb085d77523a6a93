"""Graph, finding and ledger queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import findings, graph, ledger
from threadloom.plans.relational import _LINKS, links
from threadloom.session import ship
from threadloom.sources.tables import clean_key, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_E = "(SELECT 'C' || o_custkey AS src, 'S' || l_suppkey AS dst, l_returnflag AS relation_type, 1 - l_discount AS confidence, l_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_V = "(SELECT 'C' || c_custkey AS id, 'customer' AS type FROM customer UNION ALL SELECT 'S' || s_suppkey, 'supplier' FROM supplier)"
_U = f"(SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {_E} WHERE src <> dst)"


def trade(spark, d) -> DataFrame:
    """Directed edges customer to supplier, one per order line."""
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation_type"), (1 - F.col("l_discount")).alias("confidence"), "l_orderkey", "l_linenumber")


def traders(spark, d) -> DataFrame:
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.lit("customer").alias("type"))
    return c.unionByName(table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.lit("supplier").alias("type")))


def evidence_edges(spark, d) -> DataFrame:
    """Entity to document edges of each case."""
    return links(spark, d, "entity_id", "document_id", "case_id").select("case_id", clean_key(F.col("entity_id")).alias("src"), F.col("document_id").alias("dst")).filter("case_id IS NOT NULL").distinct()


@query(f"SELECT src, dst, relation_type, round(max(confidence), 4) AS confidence, count(*) AS n_evidence, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS first_evidence FROM {_E} GROUP BY ALL")
def edge_merge(spark, d):
    return graph.merge_edges(trade(spark, d), ["src", "dst", "relation_type"], "confidence", ["l_orderkey", "l_linenumber"], "l_orderkey").withColumn("confidence", F.round("confidence", 4))


@query(f"WITH d AS (SELECT v.id, count(e.id) AS degree FROM {_V} v LEFT JOIN (SELECT src AS id FROM {_E} UNION ALL SELECT dst FROM {_E}) e ON v.id = e.id GROUP BY v.id), s AS (SELECT avg(degree) + 2 * stddev_pop(degree) AS bound FROM d) SELECT id, degree, round(bound, 6) AS bound FROM d, s WHERE degree > bound")
def hub_entities(spark, d):
    return graph.hubs(trade(spark, d), traders(spark, d))


@query(f"SELECT u.a AS id, v.type, count(*) AS n FROM (SELECT a, b FROM {_U} UNION ALL SELECT b, a FROM {_U}) u JOIN {_V} v ON v.id = u.b GROUP BY ALL")
def neighbour_histogram(spark, d):
    return graph.neighbour_types(trade(spark, d), traders(spark, d))


@query(f"""WITH n AS (SELECT a AS v, b AS u FROM {_U} UNION ALL SELECT b, a FROM {_U}), g AS (SELECT v, count(*) AS d FROM n GROUP BY v HAVING count(*) > 1),
s AS (SELECT x.u AS a, y.u AS b, sum(1 / ln(g.d)) AS score, count(*) AS n_shared FROM n x JOIN n y ON x.v = y.v AND x.u < y.u JOIN g ON g.v = x.v WHERE x.u LIKE 'S%' AND y.u LIKE 'S%' GROUP BY ALL)
SELECT a, b, round(score, 4) AS score, n_shared FROM s ORDER BY round(score, 4) DESC, a, b LIMIT 10""")
def link_predictions(spark, d):
    """Ten best unlinked supplier pairs by their shared customers."""
    e = trade(spark, d).select("src", "dst").distinct()
    # Suppliers are never linked to each other; only pairs of suppliers are made.
    deg = e.groupBy("src").agg(F.count("*").alias("d")).filter("d > 1")
    m = e.join(deg, "src")
    two = m.select("src", F.col("dst").alias("a"), "d").join(m.select("src", F.col("dst").alias("b")), "src").filter("a < b")
    s = two.groupBy("a", "b").agg(F.round(F.sum(1.0 / F.log("d")), 4).alias("score"), F.count("*").alias("n_shared"))
    return s.orderBy(F.col("score").desc(), "a", "b").limit(10)


_RANK = ", ".join(
    f"""r{k + 1} AS (SELECT v.id, v.out, 0.15 / v.n + 0.85 * (coalesce(f.flow, 0) + l.lost / v.n) AS rank FROM v LEFT JOIN (SELECT e.dst AS id, sum(r.rank / r.out) AS flow FROM e JOIN r{k} r ON r.id = e.src GROUP BY e.dst) f ON f.id = v.id,
(SELECT coalesce(sum(rank) FILTER (out IS NULL), 0) AS lost FROM r{k}) l)"""
    for k in range(10)
)


@query(f"WITH e AS (SELECT DISTINCT src, dst FROM {_E} UNION SELECT DISTINCT dst, src FROM {_E} WHERE relation_type = 'R'), o AS (SELECT src, count(*) AS out FROM e GROUP BY src), v AS (SELECT x.id, o.out, count(*) OVER () AS n FROM {_V} x LEFT JOIN o ON o.src = x.id), r0 AS (SELECT id, out, 1.0 / n AS rank FROM v), {_RANK} SELECT id, round(rank, 9) AS rank FROM r10")
def pagerank_traders(spark, d):
    t = trade(spark, d)
    back = t.filter("relation_type = 'R'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.pagerank(t.select("src", "dst").unionByName(back), traders(spark, d)).select("id", F.round("rank", 9).alias("rank"))


@query(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT DISTINCT lower(trim(entity_id)) AS a, document_id AS b FROM {_LINKS} WHERE case_id IS NOT NULL AND trim(entity_id) <> '' AND document_id IS NOT NULL), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
cc(id, comp) USING KEY (id) AS (SELECT DISTINCT a, a FROM e UNION (SELECT e.b, min(x.comp) FROM cc x JOIN e ON e.a = x.id JOIN recurring.cc y ON y.id = e.b WHERE x.comp < y.comp GROUP BY e.b))
SELECT comp AS component, count(*) AS n_vertices FROM cc GROUP BY comp""")
def components_of_evidence(spark, d):
    """Components of entities and documents that evidence links connect, by size."""
    e = evidence_edges(spark, d).filter("src IS NOT NULL AND dst IS NOT NULL")
    c = graph.connected_components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return c.groupBy("component").agg(F.count("*").alias("n_vertices"))


@query()
def influencers(spark, d):
    """The five most central vertices of each case by betweenness; large cases are estimated and say so."""
    ship(spark)
    return graph.ranked(graph.betweenness(evidence_edges(spark, d)), "betweenness", 5, "case_id").withColumn("betweenness", F.round("betweenness", 6))


@query()
def case_communities(spark, d):
    ship(spark)
    c = graph.communities(evidence_edges(spark, d))
    return c.groupBy("case_id", "community").agg(F.count("*").alias("n_members"))


@query()
def case_eigenvector(spark, d):
    ship(spark)
    return graph.ranked(graph.eigenvector(evidence_edges(spark, d)), "eigenvector", 5, "case_id").withColumn("eigenvector", F.round("eigenvector", 6))


@query(f"SELECT 'out' AS direction, dst AS other, document_id, case_id FROM (SELECT DISTINCT case_id, lower(trim(entity_id)) AS src, document_id AS dst, document_id FROM {_LINKS} WHERE case_id IS NOT NULL) WHERE src = (SELECT min(lower(trim(entity_id))) FROM evidence_links)")
def evidence_trail(spark, d):
    """Edges of one entity with their documents."""
    one = table(spark, d, "evidence_links").agg(F.min(clean_key(F.col("entity_id"))).alias("src"))
    return evidence_edges(spark, d).join(F.broadcast(one), "src").select(F.lit("out").alias("direction"), F.col("dst").alias("other"), F.col("dst").alias("document_id"), "case_id")


def payments(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("sender"), F.col("l_partkey").alias("receiver"), F.col("l_extendedprice").alias("amount"))


@query("SELECT l_orderkey AS document_id, count(*) AS n_payments, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_extendedprice >= 40000 AND l_extendedprice < 50000 GROUP BY ALL HAVING count(*) >= 3")
def structuring_documents(spark, d):
    return findings.structuring_by_document(payments(spark, d))


@query("SELECT l_suppkey AS sender, count(*) AS n_payments, round(sum(l_extendedprice), 2) AS total, count(DISTINCT l_partkey) AS n_receivers, count(DISTINCT l_orderkey) AS n_documents FROM lineitem WHERE l_extendedprice >= 40000 AND l_extendedprice < 50000 GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT l_partkey) >= 2")
def structuring_senders(spark, d):
    return findings.structuring_by_sender(payments(spark, d))


@query("SELECT event_id, user_id, n_in_window FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW) AS n_in_window FROM events) WHERE n_in_window >= 3")
def burst_calls(spark, d):
    return findings.burst_members(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts").select("event_id", "user_id", "n_in_window")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS j FROM events WHERE ts IS NOT NULL),
w AS (SELECT *, min(t) OVER v AS first, j - min(j) OVER v + 1 AS inside FROM e WINDOW v AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)),
s(user_id, j, claimed, n) AS (SELECT DISTINCT user_id, 0::BIGINT, -1.0::DOUBLE, 0 FROM e UNION ALL
SELECT s.user_id, w.j, CASE WHEN w.inside >= 3 AND w.t > s.claimed THEN w.first + 21600 ELSE s.claimed END, s.n + CASE WHEN w.inside >= 3 AND w.t > s.claimed THEN 1 ELSE 0 END FROM s JOIN w ON w.user_id = s.user_id AND w.j = s.j + 1)
SELECT user_id, max(j)::INT AS n_calls, max(n) AS n_bursts FROM s GROUP BY user_id HAVING max(n) > 0""")
def burst_counts(spark, d):
    """Bursts per user, 6 hours long."""
    ship(spark)
    return findings.burst_segments(table(spark, d, "events").select("user_id", "ts"), ["user_id"], "ts", minutes=360)


@query("SELECT 'financial_structuring' AS kind, CAST(l_orderkey AS VARCHAR) AS subject, 'Suspicious Transaction' AS title, 'medium' AS severity, '#Financial #Suspicious' AS tags FROM lineitem WHERE l_extendedprice >= 40000 AND l_extendedprice < 50000 GROUP BY l_orderkey HAVING count(*) >= 3 UNION ALL SELECT 'late_shipping', CAST(l_orderkey AS VARCHAR), 'Late Shipping', 'medium', '' FROM lineitem GROUP BY l_orderkey HAVING count(*) > 6")
def presented_alerts(spark, d):
    """Findings of two detectors as one list with titles and tags."""
    a = findings.structuring_by_document(payments(spark, d)).select(F.lit("financial_structuring").alias("kind"), F.col("document_id").cast("string").alias("subject"))
    b = payments(spark, d).groupBy("document_id").agg(F.count("*").alias("n")).filter("n > 6").select(F.lit("late_shipping").alias("kind"), F.col("document_id").cast("string").alias("subject"))
    return findings.present(a.unionByName(b))


_CHAIN = """WITH RECURSIVE x AS (SELECT n_regionkey AS chain, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS sequence_number, 'case_created' AS event_type, n_name AS payload FROM nation),
c AS (SELECT chain, sequence_number, event_type, payload, repeat('0', 64) AS prev_hash, sha256(sequence_number || '|' || event_type || '|' || payload || '|' || repeat('0', 64)) AS entry_hash FROM x WHERE sequence_number = 0
UNION ALL SELECT x.chain, x.sequence_number, x.event_type, x.payload, c.entry_hash, sha256(x.sequence_number || '|' || x.event_type || '|' || x.payload || '|' || c.entry_hash) FROM c JOIN x ON x.chain = c.chain AND x.sequence_number = c.sequence_number + 1)"""


def _chains(spark, d) -> DataFrame:
    ship(spark)
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("chain"), F.col("n_nationkey").alias("ordinal"), F.lit("case_created").alias("event_type"), F.col("n_name").alias("payload"))
    return ledger.build_chains(n)


@query(_CHAIN + " SELECT * FROM c")
def ledger_chains(spark, d):
    return _chains(spark, d)


@query(_CHAIN + " SELECT chain, sequence_number, entry_hash FROM c ORDER BY chain, sequence_number")
def ledger_scan(spark, d):
    """All entries in the order of their chains: one sort by range."""
    return _chains(spark, d).select("chain", "sequence_number", "entry_hash").orderBy("chain", "sequence_number")


@query(_CHAIN + " SELECT chain, chain <> 2 AS intact, CASE WHEN chain = 2 THEN 3 ELSE -1 END AS first_broken, CASE WHEN chain = 2 THEN 4 ELSE count(*) END AS entries_checked FROM c GROUP BY chain")
def ledger_verification(spark, d):
    """Chains of which one was tampered with: its fourth payload differs from what was hashed."""
    t = (F.col("chain") == 2) & (F.col("sequence_number") == 3)
    return ledger.verify_chains(_chains(spark, d).withColumn("payload", F.when(t, F.lit("other")).otherwise(F.col("payload")))).fillna(-1, ["first_broken"])
