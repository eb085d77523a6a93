"""Generated case files with their truth: rings of people, phones, plates and places, written in several formats.

Everything follows from row numbers and hashes, so a file is the same on every run and at every parallelism.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = ["Asha", "Bimal", "Charu", "Dinesh", "Esha", "Faisal", "Gita", "Hari", "Indu", "Javed", "Kiran", "Lata"]
LAST = ["Arora", "Bose", "Chawla", "Dutta", "Ekka", "Faruqi", "Gill", "Handa", "Iyer", "Joshi"]
PLACES = ["Lake Road", "Old Mandi", "Hill Colony", "Sector 4", "Fort Chowk"]
MEMBERS = 5


def _draw(n: int, salt: str, *key: Column) -> Column:
    """A number below ``n`` from a hash of the key."""
    return F.pmod(F.xxhash64(F.lit(salt), *key), F.lit(n)).cast("int")


def _pick(values: list[str], salt: str, *key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), _draw(len(values), salt, *key) + 1)


def phone_forms(ten: Column) -> list[Column]:
    """Ways to write a number of ten digits."""
    a, b = F.substring(ten, 1, 5), F.substring(ten, 6, 5)
    return [ten, F.concat_ws("-", a, b), F.concat(F.lit("+91 "), ten), F.concat(F.lit("0"), ten), F.concat_ws(" ", a, b)]


def plate_forms(state: Column, area: Column, letters: Column, number: Column) -> list[Column]:
    return [F.concat(state, area, letters, number), F.concat_ws(" ", state, area, letters, number), F.concat_ws("-", state, area, letters, number)]


def slip(word: Column, key: Column) -> Column:
    """A slip of the pen: two neighbours inside the word swapped."""
    k = _draw(1 << 30, "slip", key) % F.greatest(F.length(word) - 3, F.lit(1)) + 2
    return F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.lit(1)), F.substring(word, k, F.lit(1)), F.substring(word, k + 2, F.lit(1000)))


def _variant(forms: list[Column], salt: str, *key: Column) -> Column:
    return F.element_at(F.array(*forms), _draw(len(forms), salt, *key) + 1)


def rings(spark: SparkSession, n: int, seed: int = 0, noise: float = 0.1) -> DataFrame:
    """(id, case_id, raw_text, parts) of ``n`` reports; ``parts``: the mentions in order (text, entity_type, cluster).

    Twelve reports make a ring with five members who keep their phone and vehicle; names of ``noise`` of the mentions
    have a slip, numbers and plates come in several formats.
    """
    ring, s = F.floor(F.col("id") / 12), F.lit(seed)
    d = spark.range(n).withColumn("ring", ring)
    out = d
    for side in ("a", "b"):
        who = _draw(MEMBERS, "who" + side, s, F.col("id"))
        key = (s, F.col("ring"), F.col(side))
        out = out.withColumn(side, who if side == "a" else (F.col("a") + 1 + _draw(MEMBERS - 1, "other", s, F.col("id"))) % MEMBERS)
        first, last = _pick(FIRST, "first", *key), _pick(LAST, "last", *key)
        noisy = _draw(1000, "noise" + side, s, F.col("id")) < int(1000 * noise)
        out = out.withColumn("name_" + side, F.concat_ws(" ", first, F.when(noisy, slip(last, F.col("id"))).otherwise(last)))
    ten = F.concat(F.lit("9"), F.lpad(_draw(1_000_000_000, "phone", s, F.col("ring"), F.col("a")).cast("string"), 9, "0"))
    letters = F.concat(_pick(list("ABCDEFGH"), "l1", s, F.col("ring"), F.col("b")), _pick(list("JKLMNPQR"), "l2", s, F.col("ring"), F.col("b")))
    number = F.lpad(_draw(10_000, "plate", s, F.col("ring"), F.col("b")).cast("string"), 4, "0")
    out = out.withColumn("phone", _variant(phone_forms(ten), "pf", s, F.col("id"))).withColumn("place", _pick(PLACES, "place", s, F.col("id")))
    out = out.withColumn("plate", _variant(plate_forms(F.lit("ZA"), F.lpad((_draw(60, "area", s, F.col("ring"), F.col("b")) + 10).cast("string"), 2, "0"), letters, number), "vf", s, F.col("id")))
    text = F.concat(F.lit("Complainant "), "name_a", F.lit(" was seen at "), "place", F.lit(" and called from "), "phone", F.lit(". Witness "), "name_b", F.lit(" drove vehicle "), "plate", F.lit("."))
    cluster = lambda c: F.concat_ws("-", F.lit(c[0]), F.col("ring"), F.col(c[1]))
    part = lambda t, kind, c: F.struct(F.col(t).alias("text"), F.lit(kind).alias("entity_type"), c.alias("cluster"))
    parts = F.array(
        part("name_a", "PERSON", cluster(("P", "a"))), part("place", "LOCATION", F.concat_ws("-", F.lit("L"), "place")), part("phone", "PHONE", cluster(("T", "a"))),
        part("name_b", "PERSON", cluster(("P", "b"))), part("plate", "VEHICLE", cluster(("V", "b"))),
    )
    return out.select(F.concat(F.lit("ring-"), "id").alias("id"), F.concat(F.lit("case-"), "ring").alias("case_id"), text.alias("raw_text"), parts.alias("parts"))


def gold_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, entity_type, cluster, s, e) of each part: found in the text behind the part before it, by a moving cursor.

    A part that does not stand behind the cursor has null spans, and the cursor stays.
    """
    zero = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<text:string,entity_type:string,cluster:string,s:int,e:int>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = F.call_function("locate", x["text"], F.col("raw_text"), acc["at"])
        hit = at > 0
        found = F.struct(x["text"].alias("text"), x["entity_type"].alias("entity_type"), x["cluster"].alias("cluster"), F.when(hit, at - 1).alias("s"), F.when(hit, at - 1 + F.length(x["text"])).alias("e"))
        return F.struct(F.when(hit, at + F.length(x["text"])).otherwise(acc["at"]).alias("at"), F.array_append(acc["out"], found).alias("out"))

    d = docs.withColumn("g", F.aggregate("parts", zero, step, lambda a: a["out"]))
    return d.select(F.col("id").alias("doc_id"), F.explode("g").alias("g")).select("doc_id", "g.*")


def planted_recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(entity_type, n_planted, n_exact, n_found, recall): planted mentions that were found as they are, or within or around a mention of their type."""
    g = gold.select("doc_id", "entity_type", "text", F.monotonically_increasing_id().alias("n"))
    f = found.select("doc_id", "entity_type", F.col("text").alias("t"))
    same = F.col("text") == F.col("t")
    j = g.join(f, ["doc_id", "entity_type"], "left").groupBy("n", "entity_type").agg(
        F.coalesce(F.bool_or(same), F.lit(False)).alias("exact"), F.coalesce(F.bool_or(same | F.contains("t", "text") | F.contains("text", "t")), F.lit(False)).alias("hit")
    )
    return j.groupBy("entity_type").agg(F.count("*").alias("n_planted"), F.count_if("exact").alias("n_exact"), F.count_if("hit").alias("n_found"), F.round(F.count_if("hit") / F.count("*"), 3).alias("recall"))
