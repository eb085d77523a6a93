"""The graph of the cases, from mentions to vertices and edges, and its views; permissions and lifecycles of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.sql import register
from threadloom.operators.relate import nearest_person
from threadloom.plans import network
from threadloom.plans.case import _CALLS, _DIG, _SPANS, _digits, _mobile, _nodes, _PHONE, _spans
from threadloom.plans.case import ORACLES as CASE_SQL
from threadloom.plans.relational import _DOCS, _ENTS, _LINKS, _REQS, docs, ents, links, requests
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


# Relations, remapped to resolved entities --------------------------------------------------------------------------

#: Relation of a person with another mention, by its type.
KINDS = {"PHONE": "calls", "VEHICLE": "owns", "LOCATION": "present-at", "ORGANIZATION": "associated-with", "ACCOUNT": "transacts-with"}
_KIND = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
_REL = f"(SELECT doc_id, person_id AS a, other_id AS b, {_KIND} AS relation_type, CASE WHEN gap <= 20 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM ({CASE_SQL['nearby_persons']}))"
_MAP = "(SELECT m AS mention_id, min(entity_id) AS entity_id FROM (SELECT entity_id, unnest(mention_ids) AS m FROM resolved_entities WHERE deleted_at IS NULL) GROUP BY m)"
_EDGES = f"(SELECT x.entity_id AS src, y.entity_id AS dst, r.relation_type, r.confidence, r.doc_id, r.a, r.b FROM {_REL} r JOIN {_MAP} x ON x.mention_id = r.a JOIN {_MAP} y ON y.mention_id = r.b WHERE x.entity_id <> y.entity_id)"
_VERT = "(SELECT entity_id AS id, min(case_id) AS case_id, min(entity_type) AS entity_type, min(canonical_text) AS canonical_text, bool_or(needs_review) AS needs_review FROM resolved_entities WHERE deleted_at IS NULL GROUP BY entity_id)"
_DEG = f"(SELECT v.*, count(e.id) AS degree FROM {_VERT} v LEFT JOIN (SELECT src AS id FROM {_EDGES} UNION ALL SELECT dst FROM {_EDGES}) e ON e.id = v.id GROUP BY ALL)"


def _relations(spark, d) -> DataFrame:
    """Each other mention with the nearest person of its sentence."""
    n = nearest_person(_spans(spark, d))
    kind = F.coalesce(*[F.when(F.col("entity_type") == k, v) for k, v in KINDS.items()])
    return n.select("doc_id", F.col("person_id").alias("a"), F.col("other_id").alias("b"), kind.alias("relation_type"), F.when(F.col("gap") <= 20, 0.8).otherwise(0.6).alias("confidence"))


def _resolved_map(spark, d) -> DataFrame:
    r = table(spark, d, "resolved_entities").filter("deleted_at IS NULL").select("entity_id", F.explode("mention_ids").alias("mention_id"))
    return r.groupBy("mention_id").agg(F.min("entity_id").alias("entity_id"))


def resolved_relations(spark, d) -> DataFrame:
    """Relations with both ends as resolved entities; unknown ends and self-loops are dropped."""
    m = _resolved_map(spark, d)
    x = _relations(spark, d).join(m.toDF("a", "src"), "a").join(m.toDF("b", "dst"), "b")
    return x.filter("src <> dst").select("src", "dst", "relation_type", "confidence", "doc_id", "a", "b")


def vertices(spark, d) -> DataFrame:
    """All live resolved entities, isolated ones too, with how many relations touch them."""
    v = table(spark, d, "resolved_entities").filter("deleted_at IS NULL").groupBy(F.col("entity_id").alias("id")).agg(
        F.min("case_id").alias("case_id"), F.min("entity_type").alias("entity_type"), F.min("canonical_text").alias("canonical_text"), F.bool_or("needs_review").alias("needs_review")
    )
    e = resolved_relations(spark, d)
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return v.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


@query(f"SELECT r.doc_id, r.a, r.b, r.relation_type, r.confidence, d.case_id, d.document_type FROM {_REL} r JOIN {_DOCS} d ON d.id = r.doc_id")
def case_relations(spark, d):
    """Relations joined to the documents they stand in."""
    x = docs(spark, d, "case_id", "document_type").withColumnRenamed("id", "doc_id")
    return _relations(spark, d).join(x, "doc_id").select("doc_id", "a", "b", "relation_type", "confidence", "case_id", "document_type")


@query(f"""SELECT src, dst, relation_type, max(confidence) AS confidence, count(*) AS n_evidence, string_agg(doc_id, ';' ORDER BY doc_id, a, b) AS evidence, arg_min(doc_id, (doc_id, a, b)) AS first_evidence FROM {_EDGES} GROUP BY ALL""")
def graph_edges(spark, d):
    """Edges of the case graph: the surest confidence, all documents in order, the first of them."""
    one = F.struct("doc_id", "a", "b")
    g = resolved_relations(spark, d).groupBy("src", "dst", "relation_type")
    evidence = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["doc_id"]), ";")
    return g.agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_evidence"), evidence.alias("evidence"), F.min_by("doc_id", one).alias("first_evidence"))


@query(f"SELECT id, case_id, entity_type, canonical_text, needs_review, degree, degree = 0 AS isolated FROM {_DEG}")
def graph_vertices(spark, d):
    return vertices(spark, d).withColumn("isolated", F.col("degree") == 0)


@query(f"""WITH e AS (SELECT src, dst, relation_type, count(*) AS n_evidence FROM {_EDGES} GROUP BY ALL), t AS (SELECT 'out' AS direction, src AS id, dst AS other, relation_type, n_evidence FROM e UNION ALL SELECT 'in', dst, src, relation_type, n_evidence FROM e)
SELECT direction, t.id, v.entity_type, v.canonical_text, other, relation_type, n_evidence FROM t JOIN {_VERT} v ON v.id = t.id""")
def vertex_trail(spark, d):
    """Edges in and out of every vertex with its attributes."""
    e = resolved_relations(spark, d).groupBy("src", "dst", "relation_type").agg(F.count("*").alias("n_evidence"))
    t = e.select(F.lit("out").alias("direction"), F.col("src").alias("id"), F.col("dst").alias("other"), "relation_type", "n_evidence")
    t = t.unionByName(e.select(F.lit("in").alias("direction"), F.col("dst").alias("id"), F.col("src").alias("other"), "relation_type", "n_evidence"))
    return t.join(vertices(spark, d).select("id", "entity_type", "canonical_text"), "id").select("direction", "id", "entity_type", "canonical_text", "other", "relation_type", "n_evidence")


@query(f"SELECT id, entity_type, degree FROM {_DEG} ORDER BY degree DESC, id LIMIT 5")
def top_degree(spark, d):
    """The five vertices with most relations."""
    return vertices(spark, d).select("id", "entity_type", "degree").orderBy(F.col("degree").desc(), "id").limit(5)


@query(f"SELECT case_id, arg_min(id, (CASE WHEN entity_type = 'PERSON' AND degree > 0 THEN 0 ELSE 1 END, -degree, id)) AS id, count(*) AS n_vertices FROM {_DEG} WHERE case_id IS NOT NULL GROUP BY case_id")
def central_vertices(spark, d):
    """Of each case the person with most relations, else the vertex with most."""
    order = F.struct(F.when((F.col("entity_type") == "PERSON") & (F.col("degree") > 0), 0).otherwise(1), -F.col("degree"), "id")
    return vertices(spark, d).filter("case_id IS NOT NULL").groupBy("case_id").agg(F.min_by("id", order).alias("id"), F.count("*").alias("n_vertices"))


@query(f"""WITH e AS (SELECT v.case_id, count(DISTINCT (src, dst, relation_type)) AS n_edges FROM {_EDGES} e JOIN {_VERT} v ON v.id = e.src GROUP BY ALL),
n AS (SELECT case_id, entity_type, count(*) AS n_vertices, count(*) FILTER (needs_review) AS n_review FROM {_VERT} GROUP BY ALL)
SELECT n.case_id, n.entity_type, n_vertices, n_review, coalesce(n_edges, 0) AS n_edges_of_case FROM n LEFT JOIN e ON e.case_id IS NOT DISTINCT FROM n.case_id""")
def graph_statistics(spark, d):
    """Vertices of each case by type, those to review, and the edges that start in the case."""
    v = vertices(spark, d)
    n = v.groupBy("case_id", "entity_type").agg(F.count("*").alias("n_vertices"), F.count_if("needs_review").alias("n_review"))
    e = resolved_relations(spark, d).select("src", "dst", "relation_type").distinct().join(v.select(F.col("id").alias("src"), "case_id"), "src").groupBy("case_id").agg(F.count("*").alias("n_edges"))
    j = n.alias("n").join(e.alias("e"), F.col("n.case_id").eqNullSafe(F.col("e.case_id")), "left")
    return j.select("n.case_id", "n.entity_type", "n_vertices", "n_review", F.coalesce("n_edges", F.lit(0)).alias("n_edges_of_case"))


@query(f"SELECT a, b, score, n_shared, x.s_name AS name_a, y.s_name AS name_b FROM ({network.ORACLES['link_predictions']}) p JOIN supplier x ON 'S' || x.s_suppkey = p.a JOIN supplier y ON 'S' || y.s_suppkey = p.b")
def labelled_predictions(spark, d):
    """Predicted links with the labels of both ends; ten rows are looked up."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("k"), "s_name")
    p = F.broadcast(network.link_predictions(spark, d))
    return s.toDF("b", "name_b").join(F.broadcast(s.toDF("a", "name_a").join(p, "a")), "b").select("a", "b", "score", "n_shared", "name_a", "name_b")


@query(f"SELECT a.mention_id AS outer_id, b.mention_id AS inner_id, a.doc_id FROM {_SPANS} a JOIN {_SPANS} b ON a.doc_id = b.doc_id AND a.mention_id <> b.mention_id AND a.start_char <= b.start_char AND b.end_char <= a.end_char")
def contained_mentions(spark, d):
    """Interval containment: mentions inside others of their document."""
    m = _spans(spark, d).select("mention_id", "doc_id", "start_char", "end_char")
    a, b = m.toDF("outer_id", "doc_id", "s1", "e1"), m.toDF("inner_id", "doc_id", "s2", "e2")
    return a.join(b, "doc_id").filter("outer_id <> inner_id AND s1 <= s2 AND e2 <= e1").select("outer_id", "inner_id", "doc_id")


@query(f"SELECT doc_id, array_to_string(list_slice(list(entity_type || ' ' || mention_id ORDER BY start_char, mention_id), 1, 5), '; ') AS first_mentions, greatest(count(*) - 5, 0) AS more FROM {_SPANS} GROUP BY doc_id")
def first_mentions(spark, d):
    """The first five mentions of a document joined to one line, and how many more there are."""
    m = _spans(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "mention_id", "entity_type"))).alias("m"))
    line = F.array_join(F.transform(F.slice("m", 1, 5), lambda x: F.concat_ws(" ", x["entity_type"], x["mention_id"])), "; ")
    return m.select("doc_id", line.alias("first_mentions"), F.greatest(F.size("m") - 5, F.lit(0)).cast("bigint").alias("more"))


# Structured and text mentions united -------------------------------------------------------------------------------

_STRUCT = f"(SELECT DISTINCT lower(trim(id)) AS doc_id, unnest([a, b]) AS k FROM {_CALLS} WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)"
_TEXT = f"(SELECT DISTINCT lower(trim(source_document_id)) AS doc_id, {_mobile('raw_text')} AS k FROM {_ENTS} WHERE entity_type = 'PHONE' AND trim(source_document_id) <> '')"


@query(f"SELECT doc_id, k AS phone, 'structured' AS source FROM (SELECT DISTINCT * FROM {_STRUCT}) UNION ALL SELECT doc_id, k, 'text' FROM {_TEXT} t WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_STRUCT} s WHERE s.doc_id = t.doc_id AND s.k = t.k)")
def united_phones(spark, d):
    """Numbers of a document from its record and from its text, each once; the record's mention stays."""
    from threadloom.operators.nested import flat_table

    c = flat_table(_nodes(spark, d), "calls", {"caller": "string", "callee": "string"})
    c = c.select(clean_key(F.col("document_id")).alias("doc_id"), tx.phone_key(F.col("caller")).alias("a"), tx.phone_key(F.col("callee")).alias("b")).filter("a <> b")
    s = c.select("doc_id", F.explode(F.array("a", "b")).alias("phone")).distinct()
    e = ents(spark, d, "entity_type", "raw_text", "source_document_id").filter("entity_type = 'PHONE'")
    t = e.select(clean_key(F.col("source_document_id")).alias("doc_id"), tx.phone_key(F.col("raw_text")).alias("phone")).filter("doc_id IS NOT NULL AND phone IS NOT NULL").distinct()
    return s.withColumn("source", F.lit("structured")).unionByName(t.join(s, ["doc_id", "phone"], "left_anti").withColumn("source", F.lit("text")))


_CHAINED = f"""(SELECT DISTINCT x.doc_id, {_mobile('x.text')} AS a, {_mobile('y.text')} AS b FROM
(SELECT s.*, e.raw_text AS text, row_number() OVER (PARTITION BY s.doc_id, s.sentence ORDER BY s.start_char, s.mention_id) AS n FROM {_SPANS} s JOIN {_ENTS} e ON e.id = s.mention_id WHERE s.entity_type = 'PHONE') x JOIN
(SELECT s.*, e.raw_text AS text, row_number() OVER (PARTITION BY s.doc_id, s.sentence ORDER BY s.start_char, s.mention_id) AS n FROM {_SPANS} s JOIN {_ENTS} e ON e.id = s.mention_id WHERE s.entity_type = 'PHONE') y
ON x.doc_id = y.doc_id AND x.sentence = y.sentence AND y.n = x.n + 1)"""


@query(f"SELECT doc_id, a, b, 'record' AS source FROM (SELECT DISTINCT lower(trim(id)) AS doc_id, a, b FROM {_CALLS} WHERE a <> b) UNION ALL SELECT doc_id, a, b, 'text' FROM {_CHAINED} t WHERE a <> b AND NOT EXISTS (SELECT 1 FROM {_CALLS} c WHERE lower(trim(c.id)) = t.doc_id AND c.a = t.a AND c.b = t.b)")
def united_calls(spark, d):
    """Calls between numbers from the record, and from successive numbers of a sentence where the record has none of them."""
    from threadloom.operators.nested import flat_table

    c = flat_table(_nodes(spark, d), "calls", {"caller": "string", "callee": "string"})
    s = c.select(clean_key(F.col("document_id")).alias("doc_id"), tx.phone_key(F.col("caller")).alias("a"), tx.phone_key(F.col("callee")).alias("b")).filter("a <> b").distinct()
    w = Window.partitionBy("doc_id", "sentence").orderBy("start_char", "mention_id")
    p = _spans(spark, d).filter("entity_type = 'PHONE'").select("doc_id", "sentence", "start_char", "mention_id", tx.phone_key(F.col("text")).alias("a"))
    t = p.withColumn("b", F.lead("a").over(w)).filter("a <> b").select("doc_id", "a", "b").distinct()
    return s.withColumn("source", F.lit("record")).unionByName(t.join(s, ["doc_id", "a", "b"], "left_anti").withColumn("source", F.lit("text")))


_ROOT = f"(SELECT id, CASE WHEN json_type(s) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(s, '$')) THEN json_extract_string(s, '$') END ELSE s END AS p FROM (SELECT id, structured AS s FROM {_DOCS} WHERE json_valid(structured)))"


@query(f"""SELECT id AS document_id, role, {_digits('account')} AS account, trim(person) AS person FROM (SELECT id, 'sender' AS role, p->>'$.sender_account' AS account, p->>'$.sender_name' AS person FROM {_ROOT} UNION ALL SELECT id, 'receiver', p->>'$.receiver_account', p->>'$.receiver_name' FROM {_ROOT})
WHERE trim(person) <> '' AND length({_digits('account')}) BETWEEN 9 AND 18""")
def account_holders(spark, d):
    """Named holders of the accounts of payment records."""
    p = F.get_json_object("structured", "$")
    x = docs(spark, d, "structured").filter("structured IS NOT NULL").select(F.col("id").alias("document_id"), p.alias("p"))
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.get_json_object("p", f"$.{r}_account").alias("acc"), F.get_json_object("p", f"$.{r}_name").alias("person")) for r in ("sender", "receiver")]))
    x = x.select("document_id", roles.alias("r")).select("document_id", "r.role", F.regexp_replace(tx.ascii_digits(F.col("r.acc")), "[^0-9]", "").alias("account"), F.trim("r.person").alias("person"))
    return x.filter("person <> '' AND length(account) BETWEEN 9 AND 18")


# Lookups, functions by name, ledger tips -----------------------------------------------------------------------------


@query(f"SELECT id, case_id, document_type FROM {_DOCS} WHERE id = (SELECT min(id) FROM source_documents)")
def document_by_id(spark, d):
    """Point lookup: the key is a literal, so the filter reaches the scan."""
    key = table(spark, d, "source_documents").agg(F.min("id")).first()[0]
    t = table(spark, d, "source_documents").select("id", "ingested_at", "case_id", "document_type").filter(F.col("id") == key)
    return t.orderBy(F.col("ingested_at").desc_nulls_last()).limit(1).select("id", "case_id", "document_type")


@query("SELECT id, badge_id, role FROM users WHERE badge_id = (SELECT max(badge_id) FROM users)")
def one_user_by_badge(spark, d):
    """Lookup by the other unique key; more than one row is an error."""
    t = table(spark, d, "users").select("id", "badge_id", "role")
    badge = t.agg(F.max("badge_id")).first()[0]
    found = t.filter(F.col("badge_id") == badge).limit(2)
    return found.withColumn("_n", F.count("*").over(Window.partitionBy("badge_id"))).filter(F.assert_true(F.col("_n") == 1, "badge of several users").isNull()).drop("_n")


@query(f"SELECT id, CASE entity_type WHEN 'PHONE' THEN CASE WHEN regexp_matches({_PHONE}, '^[6-9][0-9]{{9}}$') THEN {_PHONE} END WHEN 'VEHICLE' THEN upper(regexp_replace(raw_text, '[\\s\\-]', '', 'g')) ELSE CASE WHEN contains(raw_text, '@') THEN lower(trim(raw_text)) ELSE {_DIG} END END AS k, CASE WHEN confidence >= 0.8 THEN 'auto' WHEN confidence >= 0.6 THEN 'review' ELSE 'reject' END AS tier FROM {_ENTS} WHERE entity_type IN ('PHONE', 'VEHICLE', 'ACCOUNT')")
def keys_by_function(spark, d):
    """Keys of the identifiers by functions that are registered by name."""
    register(spark)
    e = ents(spark, d, "entity_type", "raw_text", "confidence").filter("entity_type IN ('PHONE', 'VEHICLE', 'ACCOUNT')")
    return e.selectExpr("id", "CASE entity_type WHEN 'PHONE' THEN phone_key(raw_text) WHEN 'VEHICLE' THEN plate_key(raw_text) ELSE account_key(raw_text) END AS k", "merge_tier(confidence) AS tier")


@query(network._CHAIN + " SELECT chain, sequence_number + 1 AS sequence_number, prev AS prev_hash, sha256((sequence_number + 1) || '|case_created|appended|' || prev) AS entry_hash FROM (SELECT chain, max(sequence_number) AS sequence_number, arg_max(entry_hash, sequence_number) AS prev FROM c GROUP BY chain)")
def ledger_append(spark, d):
    """One entry appended at the tip of each chain: only the tips are read."""
    tip = network._chains(spark, d).groupBy("chain").agg(F.max("sequence_number").alias("s"), F.max_by("entry_hash", "sequence_number").alias("prev_hash"))
    n = F.col("s") + 1
    return tip.select("chain", n.alias("sequence_number"), "prev_hash", tx.entry_hash(n, F.lit("case_created"), F.lit("appended"), F.col("prev_hash")).alias("entry_hash"))


_OLD = f"SELECT lower(trim(entity_id)), document_id FROM {_LINKS} WHERE created_at < TIMESTAMP '2026-06-01'"


@query(f"""WITH n AS (SELECT DISTINCT lower(trim(entity_id)) AS entity_id, document_id, case_id FROM {_LINKS} WHERE created_at >= TIMESTAMP '2026-06-01' AND trim(entity_id) <> '' AND case_id IS NOT NULL AND (lower(trim(entity_id)), document_id) NOT IN ({_OLD} AND entity_id IS NOT NULL AND document_id IS NOT NULL))
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY entity_id, document_id) - 1 AS ordinal, 'evidence_linked' AS event_type, '{{"case_id": "' || case_id || '", "document_id": "' || document_id || '", "entity_id": "' || entity_id || '"}}' AS payload FROM n""")
def link_events(spark, d):
    """Ledger events of links that are new; links that were there give none."""
    x = links(spark, d, "entity_id", "document_id", "case_id", "created_at").select(clean_key(F.col("entity_id")).alias("entity_id"), "document_id", "case_id", "created_at").filter("entity_id IS NOT NULL AND document_id IS NOT NULL")
    cut = F.expr("TIMESTAMP_NTZ '2026-06-01 00:00:00'")
    old = x.filter(F.col("created_at") < cut).select("entity_id", "document_id")
    n = x.filter((F.col("created_at") >= cut) & F.col("case_id").isNotNull()).select("entity_id", "document_id", "case_id").distinct().join(old, ["entity_id", "document_id"], "left_anti")
    ordinal = F.row_number().over(Window.partitionBy("case_id").orderBy("entity_id", "document_id")) - 1
    payload = F.format_string('{"case_id": "%s", "document_id": "%s", "entity_id": "%s"}', "case_id", "document_id", "entity_id")
    return n.select("case_id", ordinal.alias("ordinal"), F.lit("evidence_linked").alias("event_type"), payload.alias("payload"))


@query(f"""WITH m AS (SELECT DISTINCT r.entity_id, lower(trim(e.source_document_id)) AS document_id FROM (SELECT entity_id, unnest(mention_ids) AS m FROM resolved_entities WHERE deleted_at IS NULL) r JOIN {_ENTS} e ON e.id = r.m WHERE trim(e.source_document_id) <> ''),
l AS (SELECT DISTINCT lower(trim(entity_id)) AS entity_id, lower(trim(document_id)) AS document_id FROM {_LINKS} WHERE trim(entity_id) <> '' AND trim(document_id) <> '')
SELECT 'link missing' AS kind, * FROM (SELECT * FROM m EXCEPT SELECT * FROM l) UNION ALL SELECT 'mention missing', * FROM (SELECT * FROM l EXCEPT SELECT * FROM m)""")
def pair_differences(spark, d):
    """Pairs of entity and document that only the mentions have, and that only the evidence links have."""
    r = table(spark, d, "resolved_entities").filter("deleted_at IS NULL").select("entity_id", F.explode("mention_ids").alias("id"))
    m = r.join(ents(spark, d, "source_document_id"), "id").select("entity_id", clean_key(F.col("source_document_id")).alias("document_id")).filter("document_id IS NOT NULL").distinct()
    x = links(spark, d, "entity_id", "document_id").select(clean_key(F.col("entity_id")).alias("entity_id"), clean_key(F.col("document_id")).alias("document_id")).filter("entity_id IS NOT NULL AND document_id IS NOT NULL").distinct()
    only = lambda a, b, k: a.join(b, ["entity_id", "document_id"], "left_anti").select(F.lit(k).alias("kind"), "entity_id", "document_id")
    return only(m, x, "link missing").unionByName(only(x, m, "mention missing"))


# Permissions and lifecycles of requests ------------------------------------------------------------------------------

#: What a role may act as; fixed values.
IMPLIED = [("super_admin", "super_admin"), ("super_admin", "admin"), ("super_admin", "analyst"), ("admin", "admin"), ("admin", "analyst"), ("analyst", "analyst"), ("investigator", "investigator")]
_IMPLIED = "(VALUES " + ", ".join(map(str, IMPLIED)) + ") AS i(role, acts_as)"
_TEAM = f"(SELECT id AS case_id, created_by_user_id AS user_id FROM cases WHERE created_by_user_id IS NOT NULL UNION SELECT target_case_id, requester_user_id FROM {_REQS} WHERE status = 'approved' AND target_case_id IS NOT NULL AND requester_user_id IS NOT NULL)"
_NOW = "TIMESTAMP '2026-12-31 00:00:00'"


def team(spark, d) -> DataFrame:
    """(case_id, user_id) bridge of cases and their investigators: who created them, and whose request was approved."""
    own = table(spark, d, "cases").select(F.col("id").alias("case_id"), F.col("created_by_user_id").alias("user_id")).filter("user_id IS NOT NULL")
    r = requests(spark, d, "target_case_id", "requester_user_id", "status").filter("status = 'approved'").select(F.col("target_case_id").alias("case_id"), F.col("requester_user_id").alias("user_id"))
    return own.unionByName(r.filter("case_id IS NOT NULL AND user_id IS NOT NULL")).distinct()


@query(f"SELECT u.id AS user_id, i.acts_as FROM users u JOIN {_IMPLIED} ON i.role = u.role")
def acts_as(spark, d):
    """Roles that each user's role implies."""
    i = F.broadcast(spark.createDataFrame(IMPLIED, "role string, acts_as string"))  # seven rows
    return table(spark, d, "users").join(i, "role").select(F.col("id").alias("user_id"), "acts_as")


@query(f"SELECT t.case_id, c.title, u.name, u.role FROM {_TEAM} t JOIN cases c ON c.id = t.case_id JOIN users u ON u.id = t.user_id")
def case_team(spark, d):
    """Cases joined to their investigators over the bridge."""
    c = table(spark, d, "cases").select(F.col("id").alias("case_id"), "title")
    u = table(spark, d, "users").select(F.col("id").alias("user_id"), "name", "role")
    return team(spark, d).join(c, "case_id").join(u, "user_id").select("case_id", "title", "name", "role")


@query(f"SELECT r.id, coalesce(u.role = 'super_admin' OR (u.role = 'investigator' AND t.case_id IS NOT NULL), false) AS may_write FROM {_REQS} r LEFT JOIN users u ON u.id = r.requester_user_id LEFT JOIN {_TEAM} t ON t.case_id = r.target_case_id AND t.user_id = r.requester_user_id")
def write_permissions(spark, d):
    """Whether the requester of each request may write to its case."""
    r = requests(spark, d, "requester_user_id", "target_case_id").withColumnsRenamed({"requester_user_id": "user_id", "target_case_id": "case_id"})
    u = table(spark, d, "users").select(F.col("id").alias("user_id"), "role")
    j = r.join(u, "user_id", "left").join(team(spark, d).withColumn("member", F.lit(True)), ["case_id", "user_id"], "left")
    may = (F.col("role") == "super_admin") | ((F.col("role") == "investigator") & F.col("member").isNotNull())
    return j.select("id", F.coalesce(may, F.lit(False)).alias("may_write"))


_SEEN = "((u.role = 'super_admin') OR (u.role IN ('admin', 'analyst') AND u.agency_id = c.agency_id) OR (u.role = 'investigator' AND u.id = c.created_by_user_id))"
_LINKED = f"(SELECT DISTINCT lower(trim(entity_id)) AS entity_id, case_id FROM {_LINKS} WHERE trim(entity_id) <> '' AND case_id IS NOT NULL)"


@query(f"""SELECT r.id, count(l.case_id) AS n_cases, count(c.id) FILTER ({_SEEN}) AS n_visible, count(l.case_id) = 0 OR count(c.id) FILTER ({_SEEN}) > 0 AS allowed FROM {_REQS} r LEFT JOIN {_LINKED} l ON l.entity_id = lower(trim(r.matched_entity_id)) LEFT JOIN cases c ON c.id = l.case_id LEFT JOIN users u ON u.id = r.requester_user_id GROUP BY r.id""")
def evidence_visibility(spark, d):
    """Whether the requester may see the evidence of the matched entity: denied where it is linked to cases and none of them is visible."""
    r = requests(spark, d, "matched_entity_id", "requester_user_id").select("id", clean_key(F.col("matched_entity_id")).alias("entity_id"), F.col("requester_user_id").alias("user_id"))
    x = links(spark, d, "entity_id", "case_id").select(clean_key(F.col("entity_id")).alias("entity_id"), "case_id").filter("entity_id IS NOT NULL AND case_id IS NOT NULL").distinct()
    c = table(spark, d, "cases").select(F.col("id").alias("case_id"), F.col("agency_id").alias("case_agency"), "created_by_user_id", F.lit(True).alias("found"))
    u = table(spark, d, "users").select(F.col("id").alias("user_id"), "role", "agency_id")
    j = r.join(x, "entity_id", "left").join(c, "case_id", "left").join(u, "user_id", "left")
    seen = (F.col("role") == "super_admin") | (F.col("role").isin("admin", "analyst") & (F.col("agency_id") == F.col("case_agency"))) | ((F.col("role") == "investigator") & (F.col("user_id") == F.col("created_by_user_id")))
    g = j.groupBy("id").agg(F.count("case_id").alias("n_cases"), F.count_if(F.coalesce(seen & F.col("found"), F.lit(False))).alias("n_visible"))
    return g.withColumn("allowed", (F.col("n_cases") == 0) | (F.col("n_visible") > 0))


@query(f"SELECT case_id, count(*) AS n_investigators, count(*) > 1 AS removable FROM {_TEAM} GROUP BY case_id")
def last_investigators(spark, d):
    """Guard of unassigning: the last investigator of a case stays."""
    return team(spark, d).groupBy("case_id").agg(F.count("*").alias("n_investigators"), (F.count("*") > 1).alias("removable"))


_STATE = f"CASE WHEN status IN ('approved', 'denied') THEN status WHEN escalated_at IS NOT NULL OR created_at + INTERVAL 48 HOURS <= {_NOW} THEN 'pending_admin' ELSE 'pending_investigator' END"


@query(f"SELECT id, {_STATE} AS state, escalated_at IS NULL AND status NOT IN ('approved', 'denied') AND created_at + INTERVAL 48 HOURS <= {_NOW} AS escalated_now FROM {_REQS} WHERE status IS NOT NULL AND created_at IS NOT NULL")
def request_states(spark, d):
    """State of each request as a fold of its times: open for 48 hours, it goes to the admins when it is read."""
    r = requests(spark, d, "status", "created_at", "escalated_at").filter("status IS NOT NULL AND created_at IS NOT NULL")
    late = F.expr("created_at + INTERVAL 48 HOURS <= TIMESTAMP_NTZ '2026-12-31 00:00:00'")
    final = F.col("status").isin("approved", "denied")
    state = F.when(final, F.col("status")).when(F.col("escalated_at").isNotNull() | late, "pending_admin").otherwise("pending_investigator")
    return r.select("id", state.alias("state"), (F.col("escalated_at").isNull() & ~final & late).alias("escalated_now"))


@query(f"""SELECT 'mine' AS inbox, t.user_id AS owner, count(*) AS n, min(r.created_at) AS oldest FROM {_REQS} r JOIN {_TEAM} t ON t.case_id = r.target_case_id WHERE r.status = 'pending_investigator' GROUP BY ALL UNION ALL
SELECT 'admins', c.agency_id, count(*), min(r.created_at) FROM {_REQS} r JOIN cases c ON c.id = r.target_case_id WHERE r.status = 'pending_admin' GROUP BY ALL UNION ALL
SELECT 'case', target_case_id, count(*), min(created_at) FROM {_REQS} WHERE target_case_id IS NOT NULL GROUP BY ALL""")
def request_inboxes(spark, d):
    """The three inboxes: pending for an investigator's cases, pending for the admins of an agency, all of a case."""
    r = requests(spark, d, "target_case_id", "status", "created_at").withColumnRenamed("target_case_id", "case_id")
    box = lambda x, k, owner: x.groupBy(F.lit(k).alias("inbox"), F.col(owner).alias("owner")).agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))
    mine = r.filter("status = 'pending_investigator'").join(team(spark, d), "case_id")
    admins = r.filter("status = 'pending_admin'").join(table(spark, d, "cases").select(F.col("id").alias("case_id"), "agency_id"), "case_id")
    return box(mine, "mine", "user_id").unionByName(box(admins, "admins", "agency_id")).unionByName(box(r.filter("case_id IS NOT NULL"), "case", "case_id"))


_CHECKS = {
    "case without title": ("cases", "title IS NULL OR trim(title) = ''"),
    "case of unknown status": ("cases", "status NOT IN ('open', 'under_review', 'closed') OR status IS NULL"),
    "case of unknown tier": ("cases", "confidentiality NOT IN ('normal', 'restricted') OR confidentiality IS NULL"),
    "request of unknown status": ("access_requests", "status NOT IN ('pending_investigator', 'pending_admin', 'approved', 'denied') OR status IS NULL"),
    "request without reason": ("access_requests", "reason IS NULL OR trim(reason) = ''"),
    "request resolved before it was made": ("access_requests", "resolved_at < created_at"),
    "entity withdrawn before it was made": ("resolved_entities", "deleted_at < created_at"),
    "entity without mentions": ("resolved_entities", "mention_ids IS NULL OR cardinality(mention_ids) = 0"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS n FROM {t} WHERE {c.replace('cardinality(', 'len(')}" for k, (t, c) in _CHECKS.items()) + f" UNION ALL SELECT 'relation with itself', count(*) FROM {_REL} r JOIN {_MAP} x ON x.mention_id = r.a JOIN {_MAP} y ON y.mention_id = r.b WHERE x.entity_id = y.entity_id")
def more_violations(spark, d):
    """Violations of the constraints of cases, requests, entities and relations; each table is read once."""
    out = None
    for t in dict.fromkeys(t for t, _ in _CHECKS.values()):
        rules = {k: c for k, (name, c) in _CHECKS.items() if name == t}
        counts = table(spark, d, t).agg(*[F.count_if(F.expr(c)).alias(str(i)) for i, c in enumerate(rules.values())])
        rows = counts.selectExpr(f"stack({len(rules)}, " + ", ".join(f"'{k}', `{i}`" for i, k in enumerate(rules)) + ") AS (rule, n)")
        out = rows if out is None else out.unionByName(rows)
    m = _resolved_map(spark, d)
    loops = _relations(spark, d).join(m.toDF("a", "x"), "a").join(m.toDF("b", "y"), "b").filter("x = y").agg(F.lit("relation with itself").alias("rule"), F.count("*").alias("n"))
    return out.unionByName(loops)


@query("SELECT user_id, k AS key, arg_max(v, (ts, event_id)) AS value FROM (SELECT user_id, ts, event_id, unnest(json_keys(props)) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events WHERE props IS NOT NULL) GROUP BY ALL")
def merged_maps(spark, d):
    """Successive JSON maps of a user merged, later values winning key by key."""
    m = F.from_json("props", "map<string,bigint>")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.explode(m).alias("key", "value"))
    return e.groupBy("user_id", "key").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))

