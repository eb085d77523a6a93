"""Relations between mentions of one sentence, as joins and windows over spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.lexicon import CALL_CUES, FAMILY_CUES, MONEY_CUES, OWN_CUES, PRESENT_CUES, WORK_CUES

#: Type of the other mention to relation, cues and confidence with and without a cue; fixed values.
RULES = {
    "PHONE": ("calls", CALL_CUES, 0.85, 0.70), "VEHICLE": ("owns", OWN_CUES, 0.80, 0.60), "LOCATION": ("present-at", PRESENT_CUES, 0.80, 0.60),
    "ORGANIZATION": ("associated-with", WORK_CUES, 0.75, 0.55), "ACCOUNT": ("transacts-with", MONEY_CUES, 0.75, 0.70),
}
#: Characters up to which an identifier counts as near, behind a person that are searched for a cue, between persons without one, and between identifiers.
NEAR, PERSON_CUE_GAP, PERSON_GAP, CHAIN_GAP = 110, 160, 60, 160
#: Begins a sentence that goes on about the person before it.
PRONOUN_START = r"(?iU)^\s*(he|she|they|his|her|their|the[^\S\n]+(accused|suspect))\b"


def with_sentences(mentions: DataFrame, docs: DataFrame, text: str = "raw_text") -> DataFrame:
    """Mentions with their sentence's number and the words that rules look at: sentences end at . ? ! danda and line breaks before a span.

    ``around`` is the mention with 60 signs on both sides, ``behind`` what follows it, ``begin`` where its sentence
    begins and ``opening`` the first words of that; each for the types whose rules read it. The text itself stays behind.
    """
    m = mentions.join(docs.select(F.col("id").alias("doc_id"), F.col(text).alias("doc_text")), "doc_id")
    before = F.expr("substring(doc_text, 1, start_char)")
    head = F.expr("length(substring_index(translate(substring(doc_text, 1, start_char), '.?!।', '\n\n\n\n'), '\n', -1))")
    m = m.withColumn("sentence", F.length(F.regexp_replace(before, "[^.?!।\n]", ""))).withColumn("begin", F.col("start_char") - head)
    return m.withColumns(
        {
            "around": F.expr("if(entity_type <> 'PERSON', substring(doc_text, greatest(1, start_char - 60), end_char - start_char + 120), null)"),
            "behind": F.expr(f"if(entity_type IN ('PERSON', 'PHONE', 'ACCOUNT'), substring(doc_text, end_char + 1, {max(PERSON_CUE_GAP, CHAIN_GAP)}), null)"),
            "opening": F.expr("if(entity_type <> 'PERSON', substring(doc_text, begin + 1, 60), null)"),
        }
    ).drop("doc_text")


def cue_pattern(cues: list[str]) -> str:
    """Cues at the beginning of a word; those of up to three letters only as whole words, so that "at" is not in "that" nor "own" in "town"."""
    stems, whole = [c for c in cues if len(c) > 3 or not c.isascii()], [c for c in cues if len(c) <= 3 and c.isascii()]
    parts = [p for p in (f"(?:{'|'.join(stems)})" if stems else "", f"(?:{'|'.join(whole)})(?![\\p{{L}}\\p{{N}}])" if whole else "") if p]
    return f"(?<![\\p{{L}}\\p{{M}}\\p{{N}}])(?:{'|'.join(parts)})"


def has_cue(text: Column, cues: list[str]) -> Column:
    return F.lower(text).rlike(cue_pattern(cues))


def _centre(p: str) -> Column:
    return (F.col(f"{p}.start_char") + F.col(f"{p}.end_char")) / 2


def _middle() -> Column:
    return F.expr("(start_char + end_char) div 2")


def nearest_person(m: DataFrame, most: int | None = NEAR) -> DataFrame:
    """For each other mention the nearest person of its sentence; the first person wins a tie.

    One shuffle: the mentions of a sentence come together and are compared there, so the spans are made once.
    """
    g = m.groupBy("doc_id", "sentence").agg(F.collect_list(F.struct("mention_id", "entity_type", "start_char", "end_char")).alias("all"))
    person = lambda x: x["entity_type"] == "PERSON"
    g = g.select("doc_id", F.filter("all", person).alias("persons"), F.filter("all", lambda x: x["entity_type"] != "PERSON").alias("others")).filter("size(persons) > 0")
    o = g.select("doc_id", "persons", F.explode("others").alias("o"))

    def gap(p: Column) -> Column:
        return F.greatest(F.greatest(p["start_char"], F.col("o.start_char")) - F.least(p["end_char"], F.col("o.end_char")), F.lit(0))

    near = F.array_min(F.transform("persons", lambda p: F.struct(gap(p).alias("gap"), p["start_char"].alias("s"), p["mention_id"].alias("person_id"))))
    out = o.select("doc_id", F.col("o.mention_id").alias("other_id"), F.col("o.entity_type").alias("entity_type"), near.alias("n"))
    out = out.select("doc_id", "other_id", "entity_type", "n.person_id", "n.gap")
    return out if most is None else out.filter(F.col("gap") <= most)


def carried_person(m: DataFrame) -> DataFrame:
    """For each other mention of a sentence without persons that begins with a pronoun, the last person before that sentence."""
    x = m.withColumn("is_person", F.col("entity_type") == "PERSON")
    x = x.withColumn("pronoun", ~F.col("is_person") & F.col("opening").rlike(PRONOUN_START)).select("doc_id", "sentence", "mention_id", "entity_type", "start_char", "end_char", "begin", "is_person", "pronoun")
    x = x.withColumn("alone", ~F.max("is_person").over(Window.partitionBy("doc_id", "sentence"))).withColumn("pos", F.when(F.col("is_person"), _middle()).otherwise(F.col("begin")))
    # A mention stands at the begin of its sentence, before persons of the same position.
    w = Window.partitionBy("doc_id").orderBy("pos", "is_person", "start_char", "mention_id").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("person_id", F.last(F.when(F.col("is_person"), F.col("mention_id")), True).over(w))
    return x.filter("pronoun AND alone AND person_id IS NOT NULL").select("doc_id", F.col("mention_id").alias("other_id"), "entity_type", "person_id")


def person_relations(m: DataFrame) -> DataFrame:
    """(doc_id, a, b, relation_type, confidence) of persons with the other mentions of their sentence, or of one that a pronoun carries on."""
    near = nearest_person(m, None).drop("gap").unionByName(carried_person(m))
    # Only the words around a mention are shuffled, not the whole text.
    spans = m.filter("entity_type <> 'PERSON'").select(F.col("mention_id").alias("other_id"), "around")
    x = near.join(spans, "other_id")
    kind, conf = F.lit(None).cast("string"), F.lit(None).cast("double")
    for t, (name, cues, strong, weak) in RULES.items():
        cue = has_cue(F.col("around"), cues)
        other = F.when(cue, name).otherwise("associated-with") if t == "ACCOUNT" else F.lit(name)
        kind = F.when(F.col("entity_type") == t, other).otherwise(kind)
        conf = F.when(F.col("entity_type") == t, F.when(cue, strong).otherwise(weak)).otherwise(conf)
    return x.select("doc_id", F.col("person_id").alias("a"), F.col("other_id").alias("b"), kind.alias("relation_type"), conf.alias("confidence"))


def person_pairs(m: DataFrame) -> DataFrame:
    """All pairs of persons of a sentence but those of one alias group: transacts-with or associated-with by a cue in the words behind the first, else by nearness."""
    p = m.filter("entity_type = 'PERSON'").withColumn("at", F.struct(_middle(), "start_char", "mention_id"))
    p = p.select("doc_id", "sentence", "mention_id", "at", "start_char", "end_char", F.expr("nullif(alias_group, '')").alias("alias"), F.substring("behind", 1, PERSON_CUE_GAP).alias("behind"))
    x, y = p.alias("x"), p.drop("behind", "end_char").alias("y")
    j = x.join(y, (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.sentence") == F.col("y.sentence")) & (F.col("x.at") < F.col("y.at")) & ~F.coalesce(F.col("x.alias") == F.col("y.alias"), F.lit(False)))
    gap = F.greatest(F.col("y.start_char") - F.col("x.end_char"), F.lit(0))
    between = F.substring(F.col("behind"), F.lit(1), gap)
    money, family = has_cue(between, MONEY_CUES), has_cue(between, FAMILY_CUES)
    kind = F.when(money, "transacts-with").when(family | (gap <= PERSON_GAP), "associated-with")
    conf = F.when(money | family, 0.80).otherwise(0.55)
    return j.select(F.col("x.doc_id").alias("doc_id"), F.col("x.mention_id").alias("a"), F.col("y.mention_id").alias("b"), kind.alias("relation_type"), conf.alias("confidence")).filter("relation_type IS NOT NULL")


def identifier_chains(m: DataFrame) -> DataFrame:
    """Successive phones or accounts of a sentence with a cue between them and at most CHAIN_GAP characters."""
    w = Window.partitionBy("doc_id", "sentence", "entity_type").orderBy("start_char", "mention_id")
    x = m.filter("entity_type IN ('PHONE', 'ACCOUNT')").withColumn("behind", F.substring("behind", 1, CHAIN_GAP))
    x = x.withColumn("b", F.lead("mention_id").over(w)).withColumn("to", F.lead("start_char").over(w)).filter("b IS NOT NULL")
    x = x.withColumn("between", F.expr("substring(behind, 1, greatest(0, to - end_char))")).filter(F.col("to") - F.col("end_char") <= CHAIN_GAP)
    cue = F.when(F.col("entity_type") == "PHONE", has_cue(F.col("between"), [*CALL_CUES, "and", "again"])).otherwise(has_cue(F.col("between"), [*MONEY_CUES, "to"]))
    kind = F.when(F.col("entity_type") == "PHONE", "calls").otherwise("transacts-with")
    return x.filter(cue).select("doc_id", F.col("mention_id").alias("a"), "b", kind.alias("relation_type"), F.lit(0.90).alias("confidence"))
