"""Text functions, extraction, relations, resolution and evaluation over the case tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators.evaluate import match_spans, pairwise_quality, quality
from threadloom.operators.extract import extract_mentions
from threadloom.operators.nested import flat_table, flatten_payloads
from threadloom.functions.lexicon import CALL_CUES, FAMILY_CUES, MONEY_CUES
from threadloom.operators.relate import RULES, identifier_chains, nearest_person, person_pairs, person_relations, with_sentences
from threadloom.operators.repair import known_words
from threadloom.operators.resolve import close_pairs, resolve_exact, resolve_names
from threadloom.plans.jsonsql import elements
from threadloom.plans.relational import _DOCS, _ENTS, docs, ents
from threadloom.session import checkpoint, ship
from threadloom.sources.tables import clean_key, latest_delivery, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Scalar functions ----------------------------------------------------------------------------------------------------

def _digits(c: str) -> str:
    return f"regexp_replace(translate({c}, '०१२३४५६७८९', '0123456789'), '[^0-9]', '', 'g')"


def _phone(c: str) -> str:
    """SQL of the ten digits of a number, whatever they are; ``_mobile`` checks them."""
    n = _digits(c)
    return f"CASE WHEN length({n}) = 12 AND {n} LIKE '91%' THEN substr({n}, 3) WHEN length({n}) = 11 AND {n} LIKE '0%' THEN substr({n}, 2) ELSE {n} END"


def _mobile(c: str) -> str:
    return f"CASE WHEN regexp_matches({_phone(c)}, '^[6-9][0-9]{{9}}$') THEN {_phone(c)} END"


_DIG, _PHONE = _digits("raw_text"), _phone("raw_text")


@query(f"""SELECT id, CASE WHEN regexp_matches(k, '^[6-9][0-9]{{9}}$') THEN k END AS phone FROM (SELECT id, {_PHONE} AS k FROM {_ENTS} WHERE entity_type = 'PHONE')""")
def phone_keys(spark, d):
    return ents(spark, d, "entity_type", "raw_text").filter("entity_type = 'PHONE'").select("id", tx.phone_key(F.col("raw_text")).alias("phone"))


@query(f"SELECT id, upper(regexp_replace(raw_text, '[\\s\\-]', '', 'g')) AS plate FROM {_ENTS} WHERE entity_type = 'VEHICLE'")
def plate_keys(spark, d):
    return ents(spark, d, "entity_type", "raw_text").filter("entity_type = 'VEHICLE'").select("id", tx.plate_key(F.col("raw_text")).alias("plate"))


@query(f"SELECT id, CASE WHEN contains(raw_text, '@') THEN lower(trim(raw_text)) ELSE {_DIG} END AS account, contains(raw_text, '@') OR length({_DIG}) BETWEEN 9 AND 18 AS valid FROM {_ENTS} WHERE entity_type = 'ACCOUNT'")
def account_keys(spark, d):
    """Account numbers and payment addresses by their keys."""
    e = ents(spark, d, "entity_type", "raw_text").filter("entity_type = 'ACCOUNT'")
    return e.select("id", tx.account_key(F.col("raw_text")).alias("account"), tx.valid_account(F.col("raw_text")).alias("valid"))


_HON = ", ".join(repr(h) for h in tx.HONORIFICS)


@query(f"SELECT id, array_to_string(list_filter(string_split(trim(regexp_replace(lower(raw_text), '[.,\\s]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({_HON})), ' ') AS person FROM {_ENTS} WHERE entity_type = 'PERSON'")
def person_keys(spark, d):
    return ents(spark, d, "entity_type", "raw_text").filter("entity_type = 'PERSON'").select("id", tx.person_key(F.col("raw_text")).alias("person"))


_PLACE = "regexp_replace(regexp_replace(lower(raw_text), '\\b([a-z])\\.([a-z])\\.', '\\1\\2', 'g'), '\\brd\\b\\.?', 'road', 'g')"


@query(f"SELECT id, trim(regexp_replace(regexp_replace({_PLACE}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS place FROM {_ENTS} WHERE entity_type IN ('LOCATION', 'ORGANIZATION')")
def place_keys(spark, d):
    return ents(spark, d, "entity_type", "raw_text").filter("entity_type IN ('LOCATION', 'ORGANIZATION')").select("id", tx.place_key(F.col("raw_text")).alias("place"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')), ' ') AS sorted_name,
lower(p_name) AS lowered FROM part""")
def token_sorted_names(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.sorted_tokens(F.col("p_name")).alias("sorted_name"), F.lower("p_name").alias("lowered"))


# Words of the persons' names: Latin letters only, as the phonetic key is one of Latin names.
_WORDS = f"SELECT DISTINCT unnest(string_split_regex(lower(raw_text), '[^a-z]+')) AS word FROM {_ENTS} WHERE entity_type = 'PERSON'"
_T = "word"
for _a, _b in tx.DIGRAPHS:
    _T = f"replace({_T}, '{_a}', '{_b}')"
_T = f"translate({_T}, '{tx.SINGLES[0]}', '{tx.SINGLES[1]}')"
for _c in "abcdefghijklmnopqrstuvwxyzCS":
    _T = f"regexp_replace({_T}, '{_c}{_c}+', '{_c}', 'g')"


@query(
    f"WITH w AS ({_WORDS}), t AS (SELECT word, {_T} AS t FROM w WHERE word <> '') "
    f"SELECT word, CASE WHEN word IN ({', '.join(repr(x) for x in tx.COURTESY)}) THEN '{tx.COURTESY_KEY}' ELSE substr(t, 1, 1) || regexp_replace(substr(t, 2), '[aeiou]', '', 'g') END AS phonetic FROM t"
)
def phonetic_keys(spark, d):
    """Phonetic key of every Latin word of the persons' names."""
    e = ents(spark, d, "entity_type", "raw_text").filter("entity_type = 'PERSON'")
    words = e.select(F.explode(F.split(F.lower("raw_text"), "[^a-z]+")).alias("word")).filter("word <> ''").distinct()
    return words.select("word", tx.phonetic_key(F.col("word")).alias("phonetic"))


@query(f"SELECT id, regexp_matches(raw_text, '[ऀ-ॿ]') AS devanagari FROM {_ENTS} WHERE raw_text IS NOT NULL")
def devanagari_mentions(spark, d):
    return ents(spark, d, "raw_text").filter("raw_text IS NOT NULL").select("id", tx.has_devanagari(F.col("raw_text")).alias("devanagari"))


@query("SELECT entity_id, created_at, 'resolved-' || substr(sha1(array_to_string(list_sort(mention_ids), '|')), 1, 12) AS resolved_id FROM resolved_entities")
def resolved_ids(spark, d):
    return table(spark, d, "resolved_entities").select("entity_id", "created_at", tx.resolved_id(F.col("mention_ids")).alias("resolved_id"))


@query("""WITH s AS (SELECT l_orderkey, round((1 - list_reduce(list_prepend(1.0::DOUBLE, list(1 - l_discount ORDER BY l_linenumber)), lambda a, b: a * b))::DECIMAL(20, 12), 4)::DOUBLE AS score FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, score, CASE WHEN score >= 0.8 THEN 'auto' WHEN score >= 0.6 THEN 'review' ELSE 'reject' END AS tier FROM s""")
def evidence_scores(spark, d):
    """Noisy-or of the evidence of each order, to four digits, and the tier it falls in."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount"))).alias("e"))
    s = g.withColumn("score", tx.combine_evidence(F.transform("e", lambda x: x["l_discount"])))
    return s.select("l_orderkey", "score", tx.merge_tier(F.col("score")).alias("tier"))


@query("SELECT s_suppkey, round(least(greatest((s_acctbal - 0) / 10000.0, 0), 1), 6) AS minmax, round(1 / (1 + exp(-s_acctbal / 10000.0)), 6) AS sigmoid FROM supplier")
def normalised_confidence(spark, d):
    b = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", F.round(tx.minmax_clip(b, 0, 10000.0), 6).alias("minmax"), F.round(tx.sigmoid(b / 10000.0), 6).alias("sigmoid"))


# Structured records --------------------------------------------------------------------------------------------------


def _nodes(spark, d) -> DataFrame:
    ship(spark)
    return flatten_payloads(docs(spark, d, "structured").filter("structured IS NOT NULL"))


_CALLS = f"(SELECT id, i, {_mobile('e->>{}')} AS a, {_mobile('e->>[]')} AS b, try_cast(e->>'$.duration_seconds' AS INT) AS s, try_cast(e->>'$.timestamp' AS TIMESTAMP) AS t FROM {elements('calls')})".replace("e->>{}", "(e->>'$.caller')").replace("e->>[]", "(e->>'$.callee')")


@query(f"SELECT id AS document_id, a, b, count(*) AS n_calls, CAST(sum(s) AS BIGINT) AS seconds, min(t) AS first_call, max(t) AS last_call, 0.99::DOUBLE AS confidence FROM {_CALLS} WHERE a <> b GROUP BY ALL")
def call_pairs(spark, d):
    """Calls, seconds and period of each directed pair of valid numbers in a document; calls to oneself are left out."""
    c = flat_table(_nodes(spark, d), "calls", {"caller": "string", "callee": "string", "timestamp": "string", "duration_seconds": "int"})
    c = c.select("document_id", tx.phone_key(F.col("caller")).alias("a"), tx.phone_key(F.col("callee")).alias("b"), F.col("duration_seconds").alias("s"), F.expr("try_cast(timestamp AS timestamp_ntz)").alias("t"))
    return c.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").groupBy("document_id", "a", "b").agg(
        F.count("*").alias("n_calls"), F.sum("s").alias("seconds"), F.min("t").alias("first_call"), F.max("t").alias("last_call"), F.lit(0.99).alias("confidence")
    )


@query(f"SELECT id AS document_id, 'calls.' || i AS node_path, CASE WHEN a IS NULL OR b IS NULL THEN 'invalid number' ELSE 'unreadable time' END AS reason FROM {_CALLS} WHERE a IS NULL OR b IS NULL OR t IS NULL")
def call_warnings(spark, d):
    """Call rows that can't be used, with the reason."""
    c = flat_table(_nodes(spark, d), "calls", {"caller": "string", "callee": "string", "timestamp": "string"})
    bad = F.when(tx.phone_key(F.col("caller")).isNull() | tx.phone_key(F.col("callee")).isNull(), "invalid number").when(F.expr("try_cast(timestamp AS timestamp_ntz)").isNull(), "unreadable time")
    return c.select("document_id", "node_path", bad.alias("reason")).filter("reason IS NOT NULL")


_PAID = f"(SELECT id, try_cast(e->>'$.amount' AS DOUBLE) AS amount FROM {elements('transactions')})"


@query(f"SELECT id AS document_id, count(amount) AS n_payments, round(sum(amount), 2) AS total, coalesce(max(amount), 0) AS largest, count(*) FILTER (amount IS NULL) AS n_unreadable FROM {_PAID} GROUP BY id")
def payment_totals(spark, d):
    """Payments, sum and largest amount of each record; amounts that are no numbers are counted apart."""
    t = flat_table(_nodes(spark, d), "transactions", {"amount": "double", "timestamp": "string", "currency": "string"})
    return t.groupBy("document_id").agg(F.count("amount").alias("n_payments"), F.round(F.sum("amount"), 2).alias("total"), F.coalesce(F.max("amount"), F.lit(0.0)).alias("largest"), F.count_if(F.col("amount").isNull()).alias("n_unreadable"))


_SUBS = f"""(WITH t AS (SELECT id, structured AS s FROM {_DOCS} WHERE json_valid(structured)),
r AS (SELECT id, CASE WHEN json_type(s) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(s, '$')) THEN json_extract_string(s, '$') END ELSE s END AS p FROM t),
f AS (SELECT id, CASE WHEN json_type(p, '$.subscribers') = 'VARCHAR' THEN json_extract_string(p, '$.subscribers') ELSE CAST(json_extract(p, '$.subscribers') AS VARCHAR) END AS c FROM r WHERE p IS NOT NULL AND json_type(p) = 'OBJECT'),
o AS (SELECT id, c FROM f WHERE c IS NOT NULL AND json_valid(c) AND json_type(c) = 'OBJECT')
SELECT id, unnest(json_keys(c)) AS k, c FROM o)"""


@query(f"SELECT id AS document_id, {_mobile('k')} AS phone, json_extract_string(c, '$.\"' || k || '\"') AS person FROM {_SUBS} WHERE {_mobile('k')} IS NOT NULL AND json_extract_string(c, '$.\"' || k || '\"') IS NOT NULL")
def subscriber_names(spark, d):
    """Named subscribers with their numbers."""
    n = _nodes(spark, d).filter("node = 'subscribers'")
    name = F.get(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>"), F.lit(0))
    return n.select("document_id", tx.phone_key(F.substring_index("node_path", ".", -1)).alias("phone"), name.alias("person")).filter("phone IS NOT NULL AND person IS NOT NULL")


@query(f"SELECT id AS document_id, format('{{}} payments with a total of {{:,.2f}}', count(amount), coalesce(sum(amount), 0)) AS prose FROM {_PAID} GROUP BY id")
def payment_prose(spark, d):
    """Payment records rendered as a sentence."""
    t = flat_table(_nodes(spark, d), "transactions", {"amount": "double"}).groupBy("document_id").agg(F.count("amount").alias("n"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("s"))
    return t.select("document_id", F.format_string("%d payments with a total of %s", F.col("n"), F.format_number("s", 2)).alias("prose"))


@query(f"SELECT id AS document_id, format('{{}} calls between {{}} pairs, {{}} seconds', count(*), count(DISTINCT (a, b)), coalesce(CAST(sum(s) AS BIGINT), 0)) AS prose FROM {_CALLS} WHERE a <> b GROUP BY id")
def call_prose(spark, d):
    """Call records rendered as a sentence."""
    c = call_pairs(spark, d).groupBy("document_id").agg(F.sum("n_calls").alias("n"), F.count("*").alias("p"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("s"))
    return c.select("document_id", F.format_string("%d calls between %d pairs, %d seconds", "n", "p", "s").alias("prose"))


# Mentions and relations ----------------------------------------------------------------------------------------------


@query(f"SELECT id, len(regexp_extract_all(raw_text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][a-z]+')) AS n_mail, length(regexp_extract_all(raw_text, 'Z[A-D][0-9][0-9][A-Z][A-Z][0-9][0-9][0-9][0-9]')) AS n_plates FROM {_DOCS} WHERE raw_text IS NOT NULL")
def pattern_counts(spark, d):
    """Offset-free pattern extraction in SQL."""
    x = docs(spark, d, "raw_text").filter("raw_text IS NOT NULL")
    n = F.size(F.regexp_extract_all("raw_text", F.lit("[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][a-z]+"), F.lit(0)))
    return x.select("id", n.cast("bigint").alias("n_mail"), F.size(F.regexp_extract_all("raw_text", F.lit("Z[A-D][0-9][0-9][A-Z][A-Z][0-9][0-9][0-9][0-9]"), F.lit(0))).alias("n_plates"))


@query()
def extracted_mentions(spark, d):
    ship(spark)
    return extract_mentions(docs(spark, d, "raw_text").filter("raw_text IS NOT NULL"))


@query()
def repaired_mentions(spark, d):
    """Mentions after the second pass, with words learnt of the mentions of an earlier run."""
    ship(spark)
    words = known_words(ents(spark, d, "entity_type", "raw_text").withColumnRenamed("raw_text", "text"))
    return extract_mentions(docs(spark, d, "raw_text").filter("raw_text IS NOT NULL"), names=words.names, words=words)


def _spans(spark, d) -> DataFrame:
    """Mentions of the entities table that lie in their document."""
    # Parsed before the deliveries are told apart, so that each JSON text is parsed once and only its fields are shuffled.
    m = F.from_json("metadata_json", "start_char int, end_char int, nearby_ids array<string>, alias_group string, alias_role string")
    t = table(spark, d, "entities").select("id", "ingested_at", "entity_type", "raw_text", "source_document_id", "confidence", m.alias("m"))
    x = latest_delivery(t).select(F.col("id").alias("mention_id"), "entity_type", F.col("raw_text").alias("text"), clean_key(F.col("source_document_id")).alias("doc_id"), "confidence", "m").select("*", "m.*").drop("m")
    x = x.filter("start_char IS NOT NULL AND end_char > start_char AND doc_id IS NOT NULL")
    return with_sentences(x, docs(spark, d, "raw_text").filter("raw_text IS NOT NULL"))


_SPANS = f"""(SELECT e.id AS mention_id, e.entity_type, d.id AS doc_id, d.raw_text AS doc_text, CAST(json_extract_string(e.metadata_json, '$.start_char') AS INT) AS start_char,
CAST(json_extract_string(e.metadata_json, '$.end_char') AS INT) AS end_char,
length(regexp_replace(substr(d.raw_text, 1, CAST(json_extract_string(e.metadata_json, '$.start_char') AS INT)), '[^.?!।\n]', '', 'g')) AS sentence
FROM {_ENTS} e JOIN {_DOCS} d ON lower(trim(e.source_document_id)) = d.id WHERE d.raw_text IS NOT NULL AND try_cast(json_extract_string(e.metadata_json, '$.end_char') AS INT) > CAST(json_extract_string(e.metadata_json, '$.start_char') AS INT))"""


@query(f"""SELECT o.doc_id, o.mention_id AS other_id, o.entity_type, arg_min(p.mention_id, (greatest(greatest(p.start_char, o.start_char) - least(p.end_char, o.end_char), 0), p.start_char, p.mention_id)) AS person_id,
min(greatest(greatest(p.start_char, o.start_char) - least(p.end_char, o.end_char), 0)) AS gap FROM {_SPANS} p JOIN {_SPANS} o ON p.doc_id = o.doc_id AND p.sentence = o.sentence AND p.entity_type = 'PERSON' AND o.entity_type <> 'PERSON'
WHERE greatest(greatest(p.start_char, o.start_char) - least(p.end_char, o.end_char), 0) <= 110 GROUP BY ALL""")
def nearby_persons(spark, d):
    """Nearest person of each identifier or place in its sentence."""
    return nearest_person(_spans(spark, d))


def _cue(text: str, cues: list[str]) -> str:
    """SQL of ``has_cue``: the pattern without looking back."""
    stems, whole = [c for c in cues if len(c) > 3 or not c.isascii()], [c for c in cues if len(c) <= 3 and c.isascii()]
    parts = ["(?:" + "|".join(stems) + ")"] * bool(stems) + ["(?:" + "|".join(whole) + r")(?:[^\p{L}\p{N}]|$)"] * bool(whole)
    return f"regexp_matches(lower({text}), '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}])(?:" + "|".join(parts) + ")')"


_GAP = "greatest(greatest(p.start_char, o.start_char) - least(p.end_char, o.end_char), 0)"
_AROUND = "substr(m.doc_text, greatest(1, m.start_char - 60), m.end_char - m.start_char + 120)"
_BETWEEN = "substr(substr(x.doc_text, x.end_char + 1, 160), 1, greatest(y.start_char - x.end_char, 0))"
_BY_TYPE = " ".join(f"WHEN '{t}' THEN " + (f"CASE WHEN {_cue(_AROUND, cues)} THEN '{name}' ELSE 'associated-with' END" if t == "ACCOUNT" else f"'{name}'") for t, (name, cues, _, _) in RULES.items())
_BY_CONF = " ".join(f"WHEN '{t}' THEN CASE WHEN {_cue(_AROUND, cues)} THEN {strong} ELSE {weak} END" for t, (_, cues, strong, weak) in RULES.items())
_RELATIONS = f"""WITH s AS (SELECT s.*, nullif(json_extract_string(e.metadata_json, '$.alias_group'), '') AS alias, (s.start_char + s.end_char) // 2 AS middle FROM {_SPANS} s JOIN {_ENTS} e ON e.id = s.mention_id),
near AS (SELECT o.doc_id, o.mention_id AS other_id, arg_min(p.mention_id, ({_GAP}, p.start_char, p.mention_id)) AS person_id FROM s p JOIN s o ON p.doc_id = o.doc_id AND p.sentence = o.sentence AND p.entity_type = 'PERSON' AND o.entity_type <> 'PERSON' GROUP BY ALL),
alone AS (SELECT *, start_char - length(regexp_extract(substr(doc_text, 1, start_char), '[^.?!।\n]*$')) AS begin FROM s WHERE entity_type <> 'PERSON' AND (doc_id, sentence) NOT IN (SELECT (doc_id, sentence) FROM s WHERE entity_type = 'PERSON')),
carried AS (SELECT a.doc_id, a.mention_id AS other_id, arg_max(p.mention_id, (p.middle, p.start_char, p.mention_id)) AS person_id FROM alone a JOIN s p ON p.doc_id = a.doc_id AND p.entity_type = 'PERSON' AND p.middle < a.begin
WHERE regexp_matches(substr(a.doc_text, a.begin + 1), '(?i)^[ \t\n]*(he|she|they|his|her|their|the[ \t]+(accused|suspect))\b') GROUP BY ALL),
pairs AS (SELECT x.doc_id, x.mention_id AS a, y.mention_id AS b, {_cue(_BETWEEN, MONEY_CUES)} AS money, {_cue(_BETWEEN, FAMILY_CUES)} AS family, greatest(y.start_char - x.end_char, 0) AS gap FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.sentence = y.sentence
AND x.entity_type = 'PERSON' AND y.entity_type = 'PERSON' AND (x.middle, x.start_char, x.mention_id) < (y.middle, y.start_char, y.mention_id) AND NOT coalesce(x.alias = y.alias, false)),
ids AS (SELECT *, lead(mention_id) OVER w AS b, lead(start_char) OVER w AS nxt FROM s WHERE entity_type IN ('PHONE', 'ACCOUNT') WINDOW w AS (PARTITION BY doc_id, sentence, entity_type ORDER BY start_char, mention_id)),
chain AS (SELECT *, substr(substr(doc_text, end_char + 1, 160), 1, greatest(0, nxt - end_char)) AS words FROM ids WHERE b IS NOT NULL AND nxt - end_char <= 160)
SELECT m.doc_id, n.person_id AS a, n.other_id AS b, CASE m.entity_type {_BY_TYPE} END AS relation_type, CASE m.entity_type {_BY_CONF} END::DOUBLE AS confidence FROM (SELECT * FROM near UNION ALL SELECT * FROM carried) n JOIN s m ON m.mention_id = n.other_id
UNION ALL SELECT doc_id, a, b, CASE WHEN money THEN 'transacts-with' ELSE 'associated-with' END, CASE WHEN money OR family THEN 0.80 ELSE 0.55 END::DOUBLE FROM pairs WHERE money OR family OR gap <= 60
UNION ALL SELECT doc_id, mention_id, b, CASE entity_type WHEN 'PHONE' THEN 'calls' ELSE 'transacts-with' END, 0.9::DOUBLE FROM chain WHERE CASE entity_type WHEN 'PHONE' THEN {_cue('words', [*CALL_CUES, 'and', 'again'])} ELSE {_cue('words', [*MONEY_CUES, 'to'])} END"""


@query(_RELATIONS)
def relations(spark, d):
    """Relations of all rules, with confidence; the spans with the words beside them are written once and read by each rule."""
    m = checkpoint(_spans(spark, d).drop("text", "confidence", "nearby_ids", "alias_role"))
    return person_relations(m).unionByName(person_pairs(m)).unionByName(identifier_chains(m))


@query(f"SELECT a.mention_id AS a, b.mention_id AS b FROM {_SPANS} a JOIN {_SPANS} b ON a.doc_id = b.doc_id AND a.mention_id < b.mention_id AND a.start_char < b.end_char AND b.start_char < a.end_char")
def overlapping_mentions(spark, d):
    """Interval join of mentions that overlap in a document."""
    m = _spans(spark, d).select("mention_id", "doc_id", "start_char", "end_char")
    a, b = m.toDF("a", "doc_id", "s1", "e1"), m.toDF("b", "doc_id", "s2", "e2")
    return a.join(b, "doc_id").filter("a < b AND s1 < e2 AND s2 < e1").select("a", "b")


# Resolution ----------------------------------------------------------------------------------------------------------


def _mentions(spark, d) -> DataFrame:
    e = ents(spark, d, "intake_id", "entity_type", "raw_text", "source_document_id", "metadata_json", "confidence")
    m = F.from_json("metadata_json", "nearby_ids array<string>, alias_group string, alias_role string")
    return e.select(F.col("intake_id").alias("scope"), "id", "entity_type", F.col("raw_text").alias("text"), clean_key(F.col("source_document_id")).alias("doc"), "confidence", m.alias("m")).select(
        "scope", "id", "entity_type", "text", "doc", "confidence", "m.alias_group", "m.alias_role", F.col("m.nearby_ids").alias("nearby")
    )


@query()
def resolved_names(spark, d):
    """Names resolved within each intake."""
    ship(spark)
    return resolve_names(_mentions(spark, d))


@query(f"""WITH k AS (SELECT intake_id AS scope, id, lower(trim(source_document_id)) AS doc, raw_text, {_PHONE} AS p FROM {_ENTS} WHERE entity_type = 'PHONE'),
g AS (SELECT scope, CASE WHEN regexp_matches(p, '^[6-9][0-9]{{9}}$') THEN p ELSE '?' || id END AS canonical_text, list_sort(list(DISTINCT id)) AS ids, count(DISTINCT nullif(doc, '')) AS n_documents FROM k GROUP BY ALL)
SELECT scope, 'resolved-' || substr(sha1(array_to_string(ids, '|')), 1, 12) AS entity_id, canonical_text, len(ids) AS n_mentions, n_documents FROM g""")
def resolved_phones(spark, d):
    r = resolve_exact(_mentions(spark, d).filter("entity_type = 'PHONE'"))
    return r.select("scope", "entity_id", "canonical_text", F.size("mention_ids").cast("bigint").alias("n_mentions"), "n_documents")


@query(f"""WITH k AS (SELECT DISTINCT case_id, {_PHONE} AS p FROM {_ENTS} WHERE entity_type = 'PHONE' AND case_id IS NOT NULL), v AS (SELECT p, count(*) AS n FROM k WHERE regexp_matches(p, '^[6-9][0-9]{{9}}$') GROUP BY p HAVING count(*) > 1)
SELECT k.case_id, k.p AS phone, v.n - 1 AS other_cases FROM k JOIN v ON k.p = v.p""")
def cross_case_phones(spark, d):
    """Numbers of each case that other cases hold too, and how many do."""
    k = ents(spark, d, "entity_type", "raw_text", "case_id").filter("entity_type = 'PHONE' AND case_id IS NOT NULL").select("case_id", tx.phone_key(F.col("raw_text")).alias("phone")).filter("phone IS NOT NULL").distinct()
    v = k.groupBy("phone").agg(F.count("*").alias("n")).filter("n > 1")
    return k.join(v, "phone").select("case_id", "phone", (F.col("n") - 1).alias("other_cases"))


@query()
def close_part_names(spark, d):
    """Part names of a brand that are nearly the same."""
    ship(spark)
    return close_pairs(table(spark, d, "part"), "p_name", "p_brand", 0.85)


# Evaluation ----------------------------------------------------------------------------------------------------------


@query()
def extraction_quality(spark, d):
    """Extracted spans of all documents against the mentions of an earlier run, by type and over all of them (null type)."""
    ship(spark)
    gold = _spans(spark, d).select("doc_id", "entity_type", F.col("start_char").alias("s"), F.col("end_char").alias("e")).distinct()
    found = extract_mentions(docs(spark, d, "raw_text").filter("raw_text IS NOT NULL")).select("doc_id", "entity_type", F.col("start_char").alias("s"), F.col("end_char").alias("e"))
    m = match_spans(gold, found).rollup("entity_type").agg(F.sum("n_gold").alias("n_gold"), F.sum("n_found").alias("n_found"), F.sum("n_hit").alias("n_hit"))
    return m.select("*", *quality(F.col("n_hit"), F.col("n_found"), F.col("n_gold")))


_LABELS = f"(SELECT e.intake_id || ':' || lower(e.normalized_text) AS gold, r.entity_id AS found FROM {_ENTS} e JOIN (SELECT m, min(entity_id) AS entity_id FROM (SELECT entity_id, unnest(mention_ids) AS m FROM resolved_entities WHERE deleted_at IS NULL) GROUP BY m) r ON r.m = e.id WHERE trim(e.normalized_text) <> '' AND e.intake_id IS NOT NULL)"


def _labels(spark, d) -> DataFrame:
    """(gold, found): normalised spelling within the intake, and the entity an earlier run gave the mention."""
    r = table(spark, d, "resolved_entities").filter("deleted_at IS NULL").select("entity_id", F.explode("mention_ids").alias("id")).groupBy("id").agg(F.min("entity_id").alias("found"))
    e = ents(spark, d, "intake_id", "normalized_text").filter("trim(normalized_text) <> '' AND intake_id IS NOT NULL")
    return e.join(r, "id").select(F.concat_ws(":", "intake_id", F.lower("normalized_text")).alias("gold"), "found")


@query(
    f"WITH l AS (SELECT * FROM {_LABELS}), a AS (SELECT sum(n * (n - 1) / 2) AS hit FROM (SELECT count(*) AS n FROM l GROUP BY gold, found)), g AS (SELECT sum(n * (n - 1) / 2) AS in_gold FROM (SELECT count(*) AS n FROM l GROUP BY gold)), f AS (SELECT sum(n * (n - 1) / 2) AS in_found FROM (SELECT count(*) AS n FROM l GROUP BY found)) SELECT hit, in_gold, in_found, round(hit / in_found, 3) AS precision, round(hit / in_gold, 3) AS recall, round(2 * (hit / in_found) * (hit / in_gold) / (hit / in_found + hit / in_gold), 3) AS f1 FROM a, g, f"
)
def clustering_quality(spark, d):
    """Pairs of mentions that an earlier run joined against those of one normalised spelling."""
    return pairwise_quality(_labels(spark, d))


@query(f"WITH l AS (SELECT DISTINCT * FROM {_LABELS}) SELECT (SELECT count(*) FROM (SELECT found FROM l GROUP BY found HAVING count(*) > 1)) AS n_false_merges, (SELECT count(*) FROM (SELECT gold FROM l GROUP BY gold HAVING count(*) > 1)) AS n_fragmented, (SELECT count(DISTINCT gold) FROM l) AS n_gold, (SELECT count(DISTINCT found) FROM l) AS n_found")
def clustering_errors(spark, d):
    """Entities that mix several spellings, and spellings in several entities."""
    x = _labels(spark, d).distinct()
    f, g = x.groupBy("found").agg(F.count("*").alias("n")), x.groupBy("gold").agg(F.count("*").alias("n"))
    a = f.agg(F.count_if(F.col("n") > 1).alias("n_false_merges"), F.count("*").alias("n_found"))
    b = g.agg(F.count_if(F.col("n") > 1).alias("n_fragmented"), F.count("*").alias("n_gold"))
    return a.join(F.broadcast(b)).select("n_false_merges", "n_fragmented", "n_gold", "n_found")  # one row each


@query(f"SELECT case_id, count(*) AS n_mentions, count(DISTINCT lower(trim(source_document_id))) AS n_documents, count(*) FILTER (confidence < 0.6) AS n_unsure, count(DISTINCT entity_type) AS n_types FROM {_ENTS} WHERE case_id IS NOT NULL AND trim(source_document_id) <> '' GROUP BY case_id")
def case_report(spark, d):
    """Counts of the report of each case."""
    e = ents(spark, d, "case_id", "source_document_id", "confidence", "entity_type").filter("case_id IS NOT NULL AND trim(source_document_id) <> ''")
    return e.groupBy("case_id").agg(F.count("*").alias("n_mentions"), F.count_distinct(clean_key(F.col("source_document_id"))).alias("n_documents"), F.count_if(F.col("confidence") < 0.6).alias("n_unsure"), F.count_distinct("entity_type").alias("n_types"))


@query(f"SELECT id, rn, n FROM (SELECT id, row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, id) AS rn, count(*) OVER (PARTITION BY case_id) AS n FROM {_ENTS} WHERE case_id IS NOT NULL AND confidence IS NOT NULL) WHERE rn <= 3")
def ranked_mentions(spark, d):
    """The three surest mentions of each case with their rank and the number of candidates."""
    e = ents(spark, d, "case_id", "confidence").filter("case_id IS NOT NULL AND confidence IS NOT NULL")
    n = e.groupBy("case_id").agg(F.count("*").alias("n"))
    r = e.withColumn("rn", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("confidence").desc(), "id"))).filter("rn <= 3")
    return r.join(n, "case_id").select("id", "rn", "n")
