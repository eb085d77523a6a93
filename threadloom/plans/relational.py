"""Filters, joins, aggregations, windows, top-k, set operations and write patterns over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.sources.tables import clean_key, latest_delivery, latest_wide, spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_DOCS = "(SELECT * FROM source_documents QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1)"
_ENTS = "(SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1)"
_LINKS = "(SELECT * FROM evidence_links QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1)"
_REQS = "(SELECT * FROM access_requests QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1)"


def docs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    rows = table(spark, d, "source_documents").select("id", "ingested_at", *cols)
    return (spread(latest_wide(rows), rows) if {"raw_text", "structured"} & set(cols) else latest_delivery(rows)).drop("ingested_at")


def ents(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest_delivery(table(spark, d, "entities").select("id", "ingested_at", *cols)).drop("ingested_at")


def links(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest_delivery(table(spark, d, "evidence_links").select("id", "ingested_at", *cols)).drop("ingested_at")


def requests(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest_delivery(table(spark, d, "access_requests").select("id", "ingested_at", *cols)).drop("ingested_at")


# Scans, lookups and summaries -------------------------------------------------------------------------------------


@query(f"SELECT case_id, document_type, count(*) AS n_documents, max(created_at) AS last_created FROM {_DOCS} WHERE deleted_at IS NULL GROUP BY ALL")
def document_summary(spark, d):
    """Documents of each case by type: count and latest creation."""
    return docs(spark, d, "case_id", "document_type", "created_at", "deleted_at").filter("deleted_at IS NULL").groupBy("case_id", "document_type").agg(
        F.count("*").alias("n_documents"), F.max("created_at").alias("last_created")
    )


@query(f"SELECT id, document_type, created_at FROM {_DOCS} WHERE case_id = (SELECT min(case_id) FROM source_documents)")
def case_documents(spark, d):
    """Scan of one case: the key is a literal that reaches the parquet scan; the few rows left are told apart by delivery.

    A document belongs to one case in all its deliveries.
    """
    t = table(spark, d, "source_documents").select("id", "ingested_at", "case_id", "document_type", "created_at")
    key = t.agg(F.min("case_id")).first()[0]
    return latest_delivery(t.filter(F.col("case_id") == F.lit(key))).select("id", "document_type", "created_at")


@query("SELECT badge_id, count(*) AS n, min(id) AS user_id FROM users WHERE badge_id IS NOT NULL GROUP BY badge_id")
def user_by_badge(spark, d):
    """Lookup by the other unique key, with the number of rows that share it."""
    return table(spark, d, "users").filter("badge_id IS NOT NULL").groupBy("badge_id").agg(F.count("*").alias("n"), F.min("id").alias("user_id"))


@query(
    f"""SELECT id, CASE WHEN case_id IS NULL OR trim(case_id) = '' THEN 'missing case' WHEN raw_text IS NULL OR trim(raw_text) = '' THEN 'blank text'
    WHEN length(raw_text) > 200000 THEN 'text too long'
    WHEN lower(trim(document_type)) NOT IN ('fir','cdr','financial','surveillance','social','criminal_history','intel') OR document_type IS NULL THEN 'unknown type' END AS reason
    FROM {_DOCS} WHERE (case_id IS NULL OR trim(case_id) = '') OR raw_text IS NULL OR trim(raw_text) = '' OR length(raw_text) > 200000
    OR lower(trim(document_type)) NOT IN ('fir','cdr','financial','surveillance','social','criminal_history','intel') OR document_type IS NULL"""
)
def ingest_quarantine(spark, d):
    """Documents that fail validation, with the first reason."""
    types = ["fir", "cdr", "financial", "surveillance", "social", "criminal_history", "intel"]
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    reason = (
        F.when(blank("case_id"), "missing case")
        .when(blank("raw_text"), "blank text")
        .when(F.length("raw_text") > 200000, "text too long")
        .when(F.col("document_type").isNull() | ~F.lower(F.trim("document_type")).isin(types), "unknown type")
    )
    return docs(spark, d, "case_id", "raw_text", "document_type").select("id", reason.alias("reason")).filter("reason IS NOT NULL")


@query("SELECT id, count(*) AS deliveries, max(ingested_at) AS last_ingested FROM source_documents GROUP BY id HAVING count(*) > 1")
def duplicate_deliveries(spark, d):
    return table(spark, d, "source_documents").groupBy("id").agg(F.count("*").alias("deliveries"), F.max("ingested_at").alias("last_ingested")).filter("deliveries > 1")


# Visibility, masking, inboxes ---------------------------------------------------------------------------------------

_VISIBLE = """
SELECT u.id AS user_id, c.id AS case_id FROM users u JOIN cases c ON u.role = 'super_admin' OR (u.role IN ('admin', 'analyst') AND u.agency_id = c.agency_id)
OR (u.role = 'investigator' AND u.id = c.created_by_user_id)"""


def visible_counts(spark, d) -> DataFrame:
    """(user_id, role, n_cases): visible cases by role, from counts per agency and per creator; no pair is made."""
    u, c = table(spark, d, "users").select(F.col("id").alias("user_id"), "role", "agency_id"), table(spark, d, "cases").select("agency_id", "created_by_user_id")
    of_agency = c.groupBy("agency_id").agg(F.count("*").alias("n_agency"))
    own = c.groupBy(F.col("created_by_user_id").alias("user_id")).agg(F.count("*").alias("n_own"))
    every = c.agg(F.count("*").alias("n_all"))
    j = u.join(of_agency, "agency_id", "left").join(own, "user_id", "left").join(F.broadcast(every))  # one row
    n = F.when(F.col("role") == "super_admin", F.col("n_all")).when(F.col("role").isin("admin", "analyst"), F.col("n_agency")).when(F.col("role") == "investigator", F.col("n_own"))
    return j.select("user_id", "role", F.coalesce(n, F.lit(0)).alias("n_cases"), "n_all")


@query(f"SELECT user_id, count(*) AS n_cases FROM ({_VISIBLE}) GROUP BY user_id")
def visible_cases(spark, d):
    return visible_counts(spark, d).filter("n_cases > 0").select("user_id", "n_cases")


@query(f"SELECT u.id AS user_id, count(*) AS n_hidden FROM users u CROSS JOIN cases c WHERE u.role = 'analyst' AND NOT EXISTS (SELECT 1 FROM ({_VISIBLE}) v WHERE v.user_id = u.id AND v.case_id = c.id) GROUP BY u.id")
def hidden_cases(spark, d):
    """How many cases each analyst can't see: the complement of the visible ones."""
    return visible_counts(spark, d).filter("role = 'analyst' AND n_all > n_cases").select("user_id", (F.col("n_all") - F.col("n_cases")).alias("n_hidden"))


@query("SELECT id AS case_id, confidentiality, agency_id, CASE WHEN confidentiality = 'restricted' THEN NULL ELSE title END AS title, CASE WHEN confidentiality = 'restricted' THEN NULL ELSE status END AS status FROM cases")
def masked_cases(spark, d):
    """Restricted cases show their id, tier and agency only."""
    m = lambda c: F.when(F.col("confidentiality").eqNullSafe("restricted"), F.lit(None)).otherwise(F.col(c)).alias(c)
    return table(spark, d, "cases").select(F.col("id").alias("case_id"), "confidentiality", "agency_id", m("title"), m("status"))


@query(f"SELECT id, target_case_id, status, created_at FROM {_REQS} WHERE status LIKE 'pending%' AND target_case_id IN (SELECT id FROM cases WHERE created_by_user_id IS NOT NULL)")
def request_inbox(spark, d):
    """Pending requests for cases that have an investigator."""
    own = table(spark, d, "cases").filter("created_by_user_id IS NOT NULL").select(F.col("id").alias("target_case_id"))
    return requests(spark, d, "target_case_id", "status", "created_at").filter("status LIKE 'pending%'").join(own, "target_case_id", "left_semi").select("id", "target_case_id", "status", "created_at")


@query(f"SELECT status, escalated_at IS NOT NULL AS escalated, resolved_at IS NOT NULL AS resolved, coalesce(resolved_at, TIMESTAMP '2026-12-31') - created_at >= INTERVAL 48 HOURS AS over_48h, count(*) AS n FROM {_REQS} GROUP BY ALL")
def request_lifecycle(spark, d):
    """Requests by state and by whether they stayed open for 48 hours or more, against a fixed now."""
    late = F.coalesce("resolved_at", F.expr("TIMESTAMP_NTZ '2026-12-31 00:00:00'")) >= F.col("created_at") + F.expr("INTERVAL 48 HOURS")
    return requests(spark, d, "status", "escalated_at", "resolved_at", "created_at").groupBy(
        "status", F.col("escalated_at").isNotNull().alias("escalated"), F.col("resolved_at").isNotNull().alias("resolved"), late.alias("over_48h")
    ).agg(F.count("*").alias("n"))


@query(f"""SELECT 'confidence out of range' AS rule, count(*) AS n FROM {_ENTS} WHERE confidence < 0 OR confidence > 1 UNION ALL
SELECT 'empty text', count(*) FROM {_ENTS} WHERE raw_text IS NULL OR trim(raw_text) = '' UNION ALL
SELECT 'no document', count(*) FROM {_ENTS} WHERE source_document_id IS NULL OR trim(source_document_id) = '' UNION ALL
SELECT 'unknown type', count(*) FROM {_ENTS} WHERE entity_type NOT IN ('PERSON','LOCATION','PHONE','VEHICLE','ORGANIZATION','ACCOUNT')""")
def constraint_violations(spark, d):
    """Violations of the domain's constraints by rule, in one pass."""
    rules = {
        "confidence out of range": "confidence < 0 OR confidence > 1",
        "empty text": "raw_text IS NULL OR trim(raw_text) = ''",
        "no document": "source_document_id IS NULL OR trim(source_document_id) = ''",
        "unknown type": "entity_type NOT IN ('PERSON','LOCATION','PHONE','VEHICLE','ORGANIZATION','ACCOUNT')",
    }
    e = ents(spark, d, "confidence", "raw_text", "source_document_id", "entity_type")
    counts = e.agg(*[F.count_if(F.expr(r)).alias(str(i)) for i, r in enumerate(rules.values())])
    stack = ", ".join(f"'{k}', `{i}`" for i, k in enumerate(rules))
    return counts.selectExpr(f"stack({len(rules)}, {stack}) AS (rule, n)")


@query(f"SELECT id, raw_text FROM {_ENTS} WHERE entity_type = 'LOCATION' AND contains(lower(raw_text), 'sector')")
def label_search(spark, d):
    """Case-insensitive substring search with a type filter."""
    return ents(spark, d, "entity_type", "raw_text").filter((F.col("entity_type") == "LOCATION") & F.lower("raw_text").contains("sector")).select("id", "raw_text")


# Joins ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT d.case_id, e.entity_type, count(*) AS n_mentions FROM {_ENTS} e JOIN {_DOCS} d ON lower(trim(e.source_document_id)) = lower(d.id) GROUP BY ALL")
def mentions_by_case(spark, d):
    """Mentions joined to their documents; the keys are cleaned on both sides."""
    e = ents(spark, d, "entity_type", "source_document_id").withColumn("k", clean_key(F.col("source_document_id")))
    x = docs(spark, d, "case_id").withColumn("k", F.lower("id")).drop("id")
    return e.join(x, "k").groupBy("case_id", "entity_type").agg(F.count("*").alias("n_mentions"))


@query(f"""SELECT r.entity_id, count(DISTINCT l.document_id) AS n_documents, count(DISTINCT l.case_id) AS n_cases FROM
(SELECT DISTINCT entity_id FROM resolved_entities WHERE deleted_at IS NULL) r JOIN {_LINKS} l ON lower(trim(l.entity_id)) = r.entity_id GROUP BY ALL""")
def evidence_reach(spark, d):
    """Documents and cases that each live entity is linked to."""
    r = table(spark, d, "resolved_entities").filter("deleted_at IS NULL").select(F.col("entity_id").alias("k")).distinct()
    x = links(spark, d, "entity_id", "document_id", "case_id").withColumn("k", clean_key(F.col("entity_id"))).drop("entity_id")
    return r.join(x, "k").groupBy(F.col("k").alias("entity_id")).agg(F.count_distinct("document_id").alias("n_documents"), F.count_distinct("case_id").alias("n_cases"))


@query(f"SELECT m.mention_id, min(r.entity_id) AS entity_id, count(*) AS n FROM (SELECT entity_id, unnest(mention_ids) AS mention_id FROM resolved_entities WHERE deleted_at IS NULL) m JOIN resolved_entities r ON r.entity_id = m.entity_id AND r.deleted_at IS NULL JOIN {_ENTS} e ON e.id = m.mention_id GROUP BY m.mention_id")
def mention_to_resolved(spark, d):
    """Map of mentions to resolved entities, without the mentions that are not there."""
    r = table(spark, d, "resolved_entities").filter("deleted_at IS NULL").select("entity_id", F.explode("mention_ids").alias("mention_id"))
    again = table(spark, d, "resolved_entities").filter("deleted_at IS NULL").select("entity_id")
    known = ents(spark, d).select(F.col("id").alias("mention_id"))
    return r.join(again, "entity_id").join(known, "mention_id").groupBy("mention_id").agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS tok FROM part), b AS (SELECT DISTINCT p_partkey, tok FROM p WHERE tok <> ''),
n AS (SELECT tok, count(*) AS c FROM b GROUP BY tok) SELECT tok, c AS n_rows, c * (c - 1) // 2 AS n_pairs, c > 400 AS over_cap FROM n""")
def blocking_report(spark, d):
    """Size of each token's block and of its pairs; blocks over the cap are named, not dropped unseen."""
    b = table(spark, d, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("tok")).filter("tok <> ''").distinct()
    n = b.groupBy("tok").agg(F.count("*").alias("n_rows"))
    return n.select("tok", "n_rows", F.expr("n_rows * (n_rows - 1) div 2").alias("n_pairs"), (F.col("n_rows") > 400).alias("over_cap"))


@query("""SELECT e.event_id, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'signup' AND p.ts < e.ts) AS last_signup FROM events e WHERE e.event_type = 'purchase'""")
def asof_previous(spark, d):
    """Backward as-of join: for each purchase the user's latest earlier signup, by one window over both."""
    e = table(spark, d, "events").filter("event_type IN ('purchase', 'signup')").select("event_id", "user_id", "ts", "event_type")
    # Rows of the same instant do not count: the window reads the last signup strictly before.
    at = e.groupBy("user_id", "ts").agg(F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("s"))
    before = at.withColumn("last_signup", F.max("s").over(Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1))).select("user_id", "ts", "last_signup")
    return e.filter("event_type = 'purchase'").join(before, ["user_id", "ts"]).select("event_id", "last_signup")


@query("SELECT event_id, user_id, event_type, lead(event_id, 1, -1) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next_event FROM events")
def consecutive_pairs(spark, d):
    """Each event with the next one of the same user and type, -1 for the last."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.lead("event_id", 1, -1).over(w).alias("next_event"))


# Aggregations --------------------------------------------------------------------------------------------------------


@query(f"SELECT entity_type, count(*) AS n, floor(count(*) * 100.0 / sum(count(*)) OVER () + 0.5)::BIGINT AS share FROM {_ENTS} GROUP BY entity_type")
def type_shares(spark, d):
    g = ents(spark, d, "entity_type").groupBy("entity_type").agg(F.count("*").alias("n"))
    return g.select("entity_type", "n", F.floor(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()) + 0.5).alias("share"))


@query(f"SELECT count(*) AS entities, count(*) FILTER (entity_type = 'PHONE') AS phones, count(*) FILTER (entity_type = 'VEHICLE') AS vehicles, count(*) FILTER (entity_type = 'LOCATION') AS locations, count(*) FILTER (confidence < 0.6) AS unsure FROM {_ENTS}")
def dashboard_metrics(spark, d):
    e = ents(spark, d, "entity_type", "confidence")
    c = lambda t: F.count_if(F.col("entity_type") == t)
    return e.agg(F.count("*").alias("entities"), c("PHONE").alias("phones"), c("VEHICLE").alias("vehicles"), c("LOCATION").alias("locations"), F.count_if(F.col("confidence") < 0.6).alias("unsure"))


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total, coalesce(max(l_extendedprice), 0) AS largest, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey")
def transaction_statistics(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.coalesce(F.max("l_extendedprice"), F.lit(0.0)).alias("largest"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")
    )


@query(f"SELECT event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 900 SECONDS PRECEDING AND CURRENT ROW) AS failures FROM events")
def sliding_failures(spark, d):
    """Failures of the user in the 900 seconds up to each event."""
    near = "count_if(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 900 SECONDS PRECEDING AND CURRENT ROW)"
    return table(spark, d, "events").select("event_id", F.expr(near).alias("failures"))


# Sorting and limits --------------------------------------------------------------------------------------------------


@query(f"SELECT id, raw_text, confidence FROM {_ENTS} WHERE confidence IS NOT NULL ORDER BY confidence DESC, id LIMIT 10")
def top_mentions(spark, d):
    """Top ten by confidence, ties by id (the report's feature is its limit)."""
    return ents(spark, d, "raw_text", "confidence").filter("confidence IS NOT NULL").orderBy(F.col("confidence").desc(), "id").limit(10)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT least(50, 500) OFFSET 100")
def audit_page(spark, d):
    """Newest first, by offset and limit (at most 500)."""
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(100).limit(min(50, 500))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rn, n - 2 AS more FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE rn <= 2 AND n > 4")
def hub_collapse(spark, d):
    """Of nodes with more than four edges the first two and the number of the rest."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    n = li.groupBy("l_suppkey").agg(F.count("*").alias("n")).filter("n > 4")
    first = li.withColumn("rn", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))).filter("rn <= 2")
    return first.join(n, "l_suppkey").select("l_suppkey", "l_orderkey", "l_linenumber", "rn", (F.col("n") - 2).alias("more"))


# Set operations ------------------------------------------------------------------------------------------------------


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def shared_nations(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT least(o_custkey, l_suppkey) AS a, greatest(o_custkey, l_suppkey) AS b, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <> l_suppkey GROUP BY ALL HAVING count(*) > 2")
def unordered_pairs(spark, d):
    """Pairs counted without direction."""
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).filter("o_custkey <> l_suppkey")
    return j.groupBy(F.least("o_custkey", "l_suppkey").alias("a"), F.greatest("o_custkey", "l_suppkey").alias("b")).agg(F.count("*").alias("n")).filter("n > 2")


@query(f"SELECT id FROM {_DOCS} EXCEPT SELECT document_id FROM {_LINKS}")
def unlinked_documents(spark, d):
    """Documents without an evidence link."""
    return docs(spark, d).select("id").join(links(spark, d, "document_id").select(F.col("document_id").alias("id")), "id", "left_anti")


# Writes as tables: upsert, tombstones, insert if absent, merged maps ------------------------------------------------


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event, max(ts) AS at FROM events GROUP BY user_id")
def upsert_latest(spark, d):
    """Upsert as an event log: the newest decision of each key."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"), F.max("ts").alias("at"))


@query("SELECT user_id FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id) WHERE last <> 'logout'")
def tombstones(spark, d):
    """Deletes as tombstone rows: keys whose latest row is none."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last")).filter("last <> 'logout'").select("user_id")


@query(f"SELECT DISTINCT lower(trim(entity_id)) AS entity_id, document_id FROM {_LINKS} WHERE created_at >= TIMESTAMP '2026-06-01' EXCEPT SELECT lower(trim(entity_id)), document_id FROM {_LINKS} WHERE created_at < TIMESTAMP '2026-06-01'")
def insert_if_absent(spark, d):
    """Links of a later batch that the earlier ones do not hold: anti-join, then append."""
    x = links(spark, d, "entity_id", "document_id", "created_at").select(clean_key(F.col("entity_id")).alias("entity_id"), "document_id", "created_at")
    cut = F.expr("TIMESTAMP_NTZ '2026-06-01 00:00:00'")
    return x.filter(F.col("created_at") >= cut).select("entity_id", "document_id").distinct().join(x.filter(F.col("created_at") < cut), ["entity_id", "document_id"], "left_anti")


@query("SELECT user_id, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 GROUP BY user_id")
def merged_preferences(spark, d):
    """JSON maps merged per user, later keys winning."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max_by("props", F.struct("ts", "event_id")).alias("props"))
    m = F.from_json("props", "map<string,bigint>")
    return e.select("user_id", F.element_at(F.map_concat(F.create_map(F.lit("theme"), F.lit(0).cast("bigint")), m), "k").alias("k"))


# Exports -------------------------------------------------------------------------------------------------------------


@query("SELECT entity_id, entity_type, array_to_string(list_sort(mention_ids), ';') AS mentions, CASE WHEN needs_review THEN 'yes' ELSE 'no' END AS review FROM resolved_entities WHERE deleted_at IS NULL")
def csv_rows(spark, d):
    """Rows as the CSV export has them: arrays joined by a semicolon, flags as words."""
    r = table(spark, d, "resolved_entities").filter("deleted_at IS NULL")
    return r.select("entity_id", "entity_type", F.array_join(F.array_sort("mention_ids"), ";").alias("mentions"), F.when(F.col("needs_review"), "yes").otherwise("no").alias("review"))
