"""Further graph views, guards, span folds and combined findings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators import findings, graph
from threadloom.plans.case import _SPANS, _spans
from threadloom.plans.network import _E, _V, payments, trade, traders
from threadloom.plans.relational import _ENTS, _LINKS, _REQS, ents, links, requests
from threadloom.operators.evaluate import match_spans, pairwise_quality, quality
from threadloom.operators.extract import extract_mentions
from threadloom.operators.resolve import resolve_names
from threadloom.session import ship
from threadloom.sources.planted import gold_spans, planted_recall, rings
from threadloom.sources.generate import call_records, payment_records, reports
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


_N = f"(SELECT DISTINCT lower(trim(entity_id)) AS v, document_id AS doc FROM {_LINKS} WHERE trim(entity_id) <> '' AND document_id IS NOT NULL)"


@query(f"WITH n AS (SELECT * FROM {_N}), d AS (SELECT v, count(*) AS direct FROM n GROUP BY v), t AS (SELECT x.v, count(DISTINCT y.v) AS two_hop FROM n x JOIN n y ON x.doc = y.doc AND y.v <> x.v GROUP BY x.v) SELECT d.v AS entity_id, direct, coalesce(two_hop, 0) AS two_hop FROM d LEFT JOIN t ON d.v = t.v")
def two_hop_counts(spark, d):
    """Documents next to each linked entity, and the entities that are two steps away, through a document."""
    n = links(spark, d, "entity_id", "document_id").select(clean_key(F.col("entity_id")).alias("v"), F.col("document_id").alias("doc")).filter("v IS NOT NULL AND doc IS NOT NULL").distinct()
    direct = n.groupBy("v").agg(F.count("*").alias("direct"))
    two = n.join(n.select("doc", F.col("v").alias("w")), "doc").filter("w <> v").groupBy("v").agg(F.count_distinct("w").alias("two_hop"))
    return direct.join(two, "v", "left").select(F.col("v").alias("entity_id"), "direct", F.coalesce("two_hop", F.lit(0)).alias("two_hop"))


_K = f"(SELECT DISTINCT intake_id, entity_type, lower(trim(raw_text)) AS k, lower(trim(source_document_id)) AS doc FROM {_ENTS} WHERE trim(source_document_id) <> '' AND entity_type IN ('LOCATION', 'PHONE'))"


@query(f"""WITH p AS (SELECT DISTINCT x.intake_id, x.doc AS a, y.doc AS b FROM {_K} x JOIN {_K} y ON x.intake_id = y.intake_id AND x.entity_type = 'PHONE' AND y.entity_type = 'PHONE' AND x.k = y.k AND x.doc < y.doc),
l AS (SELECT x.intake_id, x.k, x.doc AS a, y.doc AS b FROM {_K} x JOIN {_K} y ON x.intake_id = y.intake_id AND x.entity_type = 'LOCATION' AND y.entity_type = 'LOCATION' AND x.k = y.k AND x.doc < y.doc)
SELECT l.intake_id, l.k AS place, count(*) AS n_pairs, count(p.a) AS n_corroborated, count(p.a) = 0 AS needs_review FROM l LEFT JOIN p ON l.intake_id = p.intake_id AND l.a = p.a AND l.b = p.b GROUP BY ALL""")
def uncorroborated_places(spark, d):
    """Places that join documents of an intake, and whether a shared number corroborates any of the joins."""
    e = ents(spark, d, "intake_id", "entity_type", "raw_text", "source_document_id").filter("entity_type IN ('LOCATION', 'PHONE')")
    k = e.select("intake_id", "entity_type", F.lower(F.trim("raw_text")).alias("k"), clean_key(F.col("source_document_id")).alias("doc")).filter("doc IS NOT NULL").distinct()

    def pairs(t):
        x = k.filter(F.col("entity_type") == t)
        return x.select("intake_id", "k", F.col("doc").alias("a")).join(x.select("intake_id", "k", F.col("doc").alias("b")), ["intake_id", "k"]).filter("a < b")

    p = pairs("PHONE").select("intake_id", "a", "b").distinct().withColumn("hit", F.lit(1))
    j = pairs("LOCATION").join(p, ["intake_id", "a", "b"], "left")
    return j.groupBy("intake_id", F.col("k").alias("place")).agg(F.count("*").alias("n_pairs"), F.count("hit").alias("n_corroborated"), (F.count("hit") == 0).alias("needs_review"))


@query(f"""WITH p AS (SELECT id AS a, lead(id) OVER (PARTITION BY intake_id ORDER BY id) AS b, entity_type AS ta, lead(entity_type) OVER (PARTITION BY intake_id ORDER BY id) AS tb, case_id AS ca, lead(case_id) OVER (PARTITION BY intake_id ORDER BY id) AS cb FROM {_ENTS})
SELECT a, b, CASE WHEN ca IS DISTINCT FROM cb THEN 'other case' WHEN ta <> tb THEN 'other type' WHEN ta IN ('PHONE', 'VEHICLE', 'ACCOUNT') THEN 'identifiers cannot be overridden' ELSE 'valid' END AS verdict FROM p WHERE b IS NOT NULL""")
def override_guards(spark, d):
    """Whether decisions on pairs of mentions may be written: one case, one type, no identifiers."""
    e = ents(spark, d, "intake_id", "entity_type", "case_id")
    w = Window.partitionBy("intake_id").orderBy("id")
    p = e.select(F.col("id").alias("a"), F.lead("id").over(w).alias("b"), F.col("entity_type").alias("ta"), F.lead("entity_type").over(w).alias("tb"), F.col("case_id").alias("ca"), F.lead("case_id").over(w).alias("cb")).filter("b IS NOT NULL")
    v = F.when(~F.col("ca").eqNullSafe(F.col("cb")), "other case").when(F.col("ta") != F.col("tb"), "other type").when(F.col("ta").isin("PHONE", "VEHICLE", "ACCOUNT"), "identifiers cannot be overridden").otherwise("valid")
    return p.select("a", "b", v.alias("verdict"))


_KEY = r"array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(lower(raw_text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')), ' ')"


@query(f"""WITH k AS (SELECT DISTINCT case_id, {_KEY} AS k FROM {_ENTS} WHERE entity_type = 'PERSON' AND case_id IS NOT NULL), m AS (SELECT k, count(*) AS n FROM k WHERE contains(k, ' ') GROUP BY k HAVING count(*) > 1)
SELECT k.case_id, CASE WHEN c.confidentiality = 'restricted' THEN NULL ELSE k.k END AS name, m.n - 1 AS other_cases FROM k JOIN m ON k.k = m.k JOIN cases c ON c.id = k.case_id""")
def cross_case_names(spark, d):
    """Full names that several cases hold, by their sorted tokens; restricted cases show no name."""
    k = ents(spark, d, "entity_type", "raw_text", "case_id").filter("entity_type = 'PERSON' AND case_id IS NOT NULL")
    k = k.select("case_id", F.array_join(F.array_sort(F.filter(F.split(F.trim(F.regexp_replace(F.lower("raw_text"), r"[^\p{L}\p{M}\p{N}]+", " ")), " "), lambda w: w != "")), " ").alias("k")).distinct()
    m = k.filter("contains(k, ' ')").groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    c = table(spark, d, "cases").select(F.col("id").alias("case_id"), "confidentiality")
    return k.join(m, "k").join(c, "case_id").select("case_id", F.when(~F.col("confidentiality").eqNullSafe("restricted"), F.col("k")).alias("name"), (F.col("n") - 1).alias("other_cases"))


@query(f"SELECT DISTINCT target_case_id AS case_id, requester_user_id AS user_id FROM {_REQS} WHERE status = 'approved' AND NOT EXISTS (SELECT 1 FROM cases c WHERE c.id = target_case_id AND c.created_by_user_id = requester_user_id)")
def access_grants(spark, d):
    """Assignments that approved requests add, without those that are there already."""
    r = requests(spark, d, "target_case_id", "requester_user_id", "status").filter("status = 'approved'").select(F.col("target_case_id").alias("case_id"), F.col("requester_user_id").alias("user_id")).distinct()
    own = table(spark, d, "cases").select(F.col("id").alias("case_id"), F.col("created_by_user_id").alias("user_id"))
    return r.join(own, ["case_id", "user_id"], "left_anti")


@query(f"SELECT a.mention_id AS a, b.mention_id AS b, round((least(a.end_char, b.end_char) - greatest(a.start_char, b.start_char)) * 1.0 / (greatest(a.end_char, b.end_char) - least(a.start_char, b.start_char)), 4) AS iou FROM {_SPANS} a JOIN {_SPANS} b ON a.doc_id = b.doc_id AND a.mention_id < b.mention_id AND a.start_char < b.end_char AND b.start_char < a.end_char")
def span_overlaps(spark, d):
    """Overlap ratio of mentions that share text."""
    m = _spans(spark, d).select("mention_id", "doc_id", "start_char", "end_char")
    a, b = m.toDF("a", "doc_id", "s1", "e1"), m.toDF("b", "doc_id", "s2", "e2")
    return a.join(b, "doc_id").filter("a < b AND s1 < e2 AND s2 < e1").select("a", "b", F.round(tx.span_overlap(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")), 4).alias("iou"))


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, mention_id, start_char, end_char, (start_char, -end_char, mention_id) AS o FROM {_SPANS}),
k AS (SELECT doc_id, arg_min(mention_id, o) AS mention_id, arg_min(end_char, o) AS e FROM s GROUP BY doc_id UNION ALL SELECT k.doc_id, arg_min(s.mention_id, s.o), arg_min(s.end_char, s.o) FROM k JOIN s ON s.doc_id = k.doc_id AND s.start_char >= k.e GROUP BY k.doc_id)
SELECT doc_id, mention_id FROM k""")
def kept_spans(spark, d):
    """Earliest, then longest mentions of each document without overlaps: a fold over its sorted spans."""
    m = _spans(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", (-F.col("end_char")).alias("e"), "mention_id"))).alias("m"))
    zero = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("kept"))

    def step(a, x):
        ok = x["start_char"] >= a["end"]
        return F.struct(F.when(ok, -x["e"]).otherwise(a["end"]).cast("int").alias("end"), F.when(ok, F.array_append(a["kept"], x["mention_id"])).otherwise(a["kept"]).alias("kept"))

    return m.select("doc_id", F.explode(F.aggregate("m", zero, step, lambda a: a["kept"])).alias("mention_id"))


@query(f"""WITH p AS (SELECT doc_id, mention_id, start_char, end_char, CASE WHEN start_char - max(end_char) OVER (PARTITION BY doc_id ORDER BY start_char, mention_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1 THEN 0 ELSE 1 END AS fresh FROM {_SPANS} WHERE entity_type = 'PERSON'),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start_char, mention_id ROWS UNBOUNDED PRECEDING) AS grp FROM p) SELECT doc_id, min(start_char) AS start_char, max(end_char) AS end_char, count(*) AS n FROM g GROUP BY doc_id, grp""")
def merged_persons(spark, d):
    """Person mentions with at most one character between them as one."""
    m = _spans(spark, d).filter("entity_type = 'PERSON'").select("doc_id", "mention_id", "start_char", "end_char")
    w = Window.partitionBy("doc_id").orderBy("start_char", "mention_id")
    m = m.withColumn("last", F.max("end_char").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    m = m.withColumn("grp", F.sum(F.when(F.col("start_char") - F.col("last") <= 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy("doc_id", "grp").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.count("*").alias("n")).drop("grp")


_BAND = "l_extendedprice >= 40000 AND l_extendedprice < 50000"


@query(f"""WITH d AS (SELECT v.id, count(e.id) AS degree FROM {_V} v LEFT JOIN (SELECT src AS id FROM {_E} UNION ALL SELECT dst FROM {_E}) e ON v.id = e.id GROUP BY v.id),
f AS (SELECT 'hub_and_spoke' AS kind, id AS subject FROM d WHERE degree > (SELECT avg(degree) + 2 * stddev_pop(degree) FROM d) UNION ALL
SELECT 'financial_structuring', 'D' || l_orderkey FROM lineitem WHERE {_BAND} GROUP BY l_orderkey HAVING count(*) >= 3 UNION ALL
SELECT 'financial_structuring', 'S' || l_suppkey FROM lineitem WHERE {_BAND} GROUP BY l_suppkey HAVING count(*) >= 3 AND count(DISTINCT l_partkey) >= 2 UNION ALL
SELECT DISTINCT 'communication_burst', 'U' || user_id FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n >= 3)
SELECT 'alert-' || (row_number() OVER (PARTITION BY kind ORDER BY subject) - 1) || '-' || subject || '-' || kind AS alert_id, kind, subject FROM f""")
def all_findings(spark, d):
    """Findings of the four detectors with numbered ids."""
    f = graph.hubs(trade(spark, d), traders(spark, d)).select(F.lit("hub_and_spoke").alias("kind"), F.col("id").alias("subject"))
    f = f.unionByName(findings.structuring_by_document(payments(spark, d)).select(F.lit("financial_structuring").alias("kind"), F.concat(F.lit("D"), "document_id").alias("subject")))
    f = f.unionByName(findings.structuring_by_sender(payments(spark, d)).select(F.lit("financial_structuring").alias("kind"), F.concat(F.lit("S"), "sender").alias("subject")))
    b = findings.burst_members(table(spark, d, "events").select("user_id", "ts"), ["user_id"], "ts").select(F.lit("communication_burst").alias("kind"), F.concat(F.lit("U"), "user_id").alias("subject")).distinct()
    return findings.numbered(f.unionByName(b), "kind", "subject").select(F.concat_ws("-", F.lit("alert"), "n", "subject", "kind").alias("alert_id"), "kind", "subject")


_RULES = [("calls", "PERSON", "PHONE"), ("owns", "PERSON", "VEHICLE"), ("present-at", "PERSON", "LOCATION"), ("associated-with", "PERSON", "ORGANIZATION"), ("transacts-with", "ACCOUNT", "ACCOUNT")]


@query(f"""WITH p AS (SELECT a.entity_type AS ta, b.entity_type AS tb, CASE b.entity_type WHEN 'PHONE' THEN 'calls' WHEN 'VEHICLE' THEN 'owns' WHEN 'LOCATION' THEN 'present-at' WHEN 'ORGANIZATION' THEN 'associated-with' ELSE 'transacts-with' END AS relation_type
FROM {_SPANS} a JOIN {_SPANS} b ON a.doc_id = b.doc_id AND a.sentence = b.sentence AND a.start_char < b.start_char)
SELECT relation_type, ta, tb, (ta = 'PERSON' AND tb IN ('PHONE', 'VEHICLE', 'LOCATION', 'ORGANIZATION')) OR (ta = 'ACCOUNT' AND tb = 'ACCOUNT') AS valid, count(*) AS n FROM p GROUP BY ALL""")
def endpoint_validity(spark, d):
    """Candidate relations of a sentence against the rules of what each type may connect."""
    m = _spans(spark, d).select("doc_id", "sentence", "start_char", "entity_type")
    a, b = m.toDF("doc_id", "sentence", "s", "ta"), m.toDF("doc_id", "sentence", "t", "tb")
    kind = F.coalesce(*[F.when(F.col("tb") == t, r) for r, _, t in _RULES[:4]], F.lit("transacts-with"))
    p = a.join(b, ["doc_id", "sentence"]).filter("s < t").select("ta", "tb", kind.alias("relation_type")).groupBy("relation_type", "ta", "tb").agg(F.count("*").alias("n"))
    rules = spark.createDataFrame(_RULES, "relation_type string, ta string, tb string").withColumn("ok", F.lit(True))
    return p.join(F.broadcast(rules), ["relation_type", "ta", "tb"], "left").select("relation_type", "ta", "tb", F.coalesce("ok", F.lit(False)).alias("valid"), "n")


@query()
def planted_quality(spark, d):
    """Recall over the planted mentions of as many generated reports as there are documents, by type."""
    ship(spark)
    r = rings(spark, table(spark, d, "source_documents").count())
    return planted_recall(gold_spans(r), extract_mentions(r))


@query()
def planted_f1(spark, d):
    """Precision, recall and F1 of extracted spans on generated reports, by type and over all of them (null type)."""
    ship(spark)
    r = rings(spark, table(spark, d, "source_documents").count())
    gold = gold_spans(r).filter("s IS NOT NULL").select("doc_id", "entity_type", "s", "e")
    found = extract_mentions(r).select("doc_id", "entity_type", F.col("start_char").alias("s"), F.col("end_char").alias("e"))
    m = match_spans(gold, found).rollup("entity_type").agg(F.sum("n_gold").alias("n_gold"), F.sum("n_found").alias("n_found"), F.sum("n_hit").alias("n_hit"))
    return m.select("*", *quality(F.col("n_hit"), F.col("n_found"), F.col("n_gold")))


@query()
def planted_resolution(spark, d):
    """Pairwise precision and recall of resolved persons against the members planted in generated rings."""
    ship(spark)
    r = rings(spark, table(spark, d, "source_documents").count())
    found = extract_mentions(r).select("mention_id", "doc_id", "entity_type", "text", "start_char", "end_char", "confidence")
    phone = found.filter("entity_type = 'PHONE'").select("doc_id", F.col("start_char").alias("at"), F.concat(F.lit("PHONE:"), tx.phone_key(F.col("text"))).alias("phone"))
    p = found.filter("entity_type = 'PERSON'").join(phone, "doc_id", "left")
    p = p.withColumn("phone", F.when((F.col("at") - F.col("end_char")).between(0, 60), F.col("phone"))).groupBy("doc_id", "mention_id", "text", "start_char", "end_char", "confidence").agg(F.collect_set("phone").alias("nearby"))
    none = F.lit(None).cast("string")
    m = p.join(r.select(F.col("id").alias("doc_id"), F.col("case_id").alias("scope")), "doc_id")
    rows = m.select("scope", F.col("mention_id").alias("id"), F.lit("PERSON").alias("entity_type"), "text", F.col("doc_id").alias("doc"), "confidence", none.alias("alias_group"), none.alias("alias_role"), "nearby")
    c = resolve_names(rows).select(F.explode("mention_ids").alias("mention_id"), F.col("entity_id").alias("found"))
    gold = gold_spans(r).filter("entity_type = 'PERSON'").select("doc_id", F.col("s").alias("start_char"), F.col("e").alias("end_char"), F.col("cluster").alias("gold"))
    return pairwise_quality(m.select("mention_id", "doc_id", "start_char", "end_char").join(gold, ["doc_id", "start_char", "end_char"]).join(c, "mention_id").select("gold", "found"))


@query()
def generated_records(spark, d):
    """Generated reports, calls and payments, as many as there are documents, by kind and planted flag."""
    n = table(spark, d, "source_documents").count()
    r = reports(spark, n).select(F.lit("report").alias("kind"), F.lit(False).alias("planted"))
    c = call_records(spark, n).select(F.lit("call"), "burst")
    p = payment_records(spark, n).select(F.lit("payment"), "structured")
    return r.union(c).union(p).groupBy("kind", "planted").agg(F.count("*").alias("n"))
