"""Name and text functions that need Python, in Arrow batches over distinct values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.similarity import canonical_json, canonical_place, name_evidence, name_tokens, recase_shouting, roman_devanagari
from threadloom.functions.text import combine_evidence, merge_tier
from threadloom.plans.relational import _ENTS, docs, ents
from threadloom.session import ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _string_udf(function):
    """Arrow-batched function of one string column; nulls stay null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else function(x))

    return F.pandas_udf(run, T.StringType())


@query
def recased_texts(spark, d):
    """Texts in capitals that were recased, with their length before and after."""
    ship(spark)
    x = docs(spark, d, "raw_text").filter("raw_text IS NOT NULL").withColumn("recased", _string_udf(recase_shouting)("raw_text"))
    return x.filter("recased <> raw_text").select("id", F.length("raw_text").alias("n_before"), F.length("recased").alias("n_after"))


@query
def canonical_places(spark, d):
    """Distinct places written in Devanagari with their English names."""
    ship(spark)
    e = ents(spark, d, "entity_type", "raw_text").filter("entity_type = 'LOCATION'").filter(F.col("raw_text").rlike("[\\u0900-\\u097F]"))
    return e.select("raw_text").distinct().select("raw_text", _string_udf(canonical_place)("raw_text").alias("place"))


@query
def romanised_names(spark, d):
    """Distinct Devanagari names in Latin letters."""
    ship(spark)
    e = ents(spark, d, "entity_type", "raw_text").filter("entity_type = 'PERSON'").filter(F.col("raw_text").rlike("[\\u0900-\\u097F]"))
    return e.select("raw_text").distinct().select("raw_text", _string_udf(roman_devanagari)("raw_text").alias("roman"))


_WORDS = f"(SELECT w, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(raw_text), '[^a-z]+')) AS w FROM {_ENTS} WHERE entity_type = 'PERSON') WHERE length(w) > 3 GROUP BY w)"


@query
def corrected_words(spark, d):
    """Words of names with the settled one they are a slip of: a tenth as frequent at most, one edit away, two in long words.

    Settled words are those with a thousandth of all words at least, so there are at most a thousand at any size.
    """
    e = ents(spark, d, "entity_type", "raw_text").filter("entity_type = 'PERSON'")
    w = e.select(F.explode(F.split(F.lower("raw_text"), "[^a-z]+")).alias("w")).filter("length(w) > 3").groupBy("w").agg(F.count("*").alias("n"))
    total = w.agg(F.sum("n")).first()[0] or 0
    settled = w.filter(F.col("n") * 1000 >= total).select(F.substring("w", 1, 1).alias("c"), F.col("w").alias("name"), F.col("n").alias("m"))
    j = w.withColumn("c", F.substring("w", 1, 1)).join(F.broadcast(settled), "c").filter(F.col("m") >= 10 * F.col("n"))
    j = j.withColumn("d", F.levenshtein("w", "name")).filter((F.col("d") <= 1) | (F.length("w") >= 8) & (F.col("d") <= 2))
    return j.groupBy("w", "n").agg(F.min_by("name", F.struct("d", -F.col("m"), "name")).alias("name"))


ORACLES["corrected_words"] = f"""WITH w AS {_WORDS}, s AS (SELECT w AS name, n AS m FROM w WHERE n * 1000 >= (SELECT sum(n) FROM w)),
j AS (SELECT w.w, w.n, s.name, s.m, levenshtein(w.w, s.name) AS d FROM w JOIN s ON substr(w.w, 1, 1) = substr(s.name, 1, 1) AND s.m >= 10 * w.n)
SELECT w, n, arg_min(name, (d, -m, name)) AS name FROM j WHERE d <= 1 OR (length(w) >= 8 AND d <= 2) GROUP BY w, n"""


@query
def canonical_payloads(spark, d):
    """Hashes of payloads in canonical form, which do not depend on the order of keys or on blanks."""
    ship(spark)
    x = docs(spark, d, "structured").filter("structured IS NOT NULL").withColumn("c", _string_udf(canonical_json)("structured"))
    return x.filter("c IS NOT NULL").select("id", F.sha2("c", 256).alias("payload_hash"))


@query
def pair_decisions(spark, d):
    """Name evidence of distinct person names of an intake that share their last word, with the tier it gives."""
    ship(spark)
    e = ents(spark, d, "intake_id", "entity_type", "raw_text").filter("entity_type = 'PERSON'").select("intake_id", "raw_text", F.lower(F.substring_index(F.trim("raw_text"), " ", -1)).alias("k")).distinct()
    p = e.select("intake_id", "k", F.col("raw_text").alias("a")).join(e.select("intake_id", "k", F.col("raw_text").alias("b")), ["intake_id", "k"]).filter("a < b").drop("k")

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = [name_evidence(name_tokens(x), name_tokens(y)) for x, y in zip(a, b)]
        return pd.DataFrame({"p": [g[0] for g in got], "how": [g[1] for g in got], "veto": [g[2] for g in got]})

    schema = T.StructType([T.StructField("p", T.DoubleType()), T.StructField("how", T.StringType()), T.StructField("veto", T.BooleanType())])
    x = p.withColumn("e", F.pandas_udf(run, schema)("a", "b"))
    score = combine_evidence(F.array(F.col("e.p")))
    return x.select("intake_id", "a", "b", F.col("e.how").alias("how"), F.col("e.veto").alias("veto"), score.alias("score"), merge_tier(score).alias("tier"))
