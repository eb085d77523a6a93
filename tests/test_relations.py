"""Relations of persons on small texts."""

import pytest

from threadloom.operators.relate import person_pairs, person_relations, with_sentences


@pytest.fixture()
def related(spark):
    def run(f, text, *mentions):
        rows = [(n, "d", kind, text.index(n), text.index(n) + len(n), group) for n, kind, group in mentions]
        m = spark.createDataFrame(rows, "mention_id string, doc_id string, entity_type string, start_char int, end_char int, alias_group string")
        return {(r.a, r.b): (r.relation_type, r.confidence) for r in f(with_sentences(m, spark.createDataFrame([("d", text)], "id string, raw_text string"))).collect()}

    return run


def test_all_pairs_of_a_sentence(related):
    got = related(person_pairs, "Asha met Binod and paid Chetan. Dev left", *[(n, "PERSON", None) for n in ("Asha", "Binod", "Chetan", "Dev")])
    assert got == {("Asha", "Binod"): ("associated-with", 0.55), ("Asha", "Chetan"): ("transacts-with", 0.8), ("Binod", "Chetan"): ("transacts-with", 0.8)}
    # The cue counts where it stands in the first 160 characters, however far the second person is.
    got = related(person_pairs, "Asha paid " + "x " * 100 + "Binod " + "x " * 100 + "Chetan", *[(n, "PERSON", None) for n in ("Asha", "Binod", "Chetan")])
    assert set(got) == {("Asha", "Binod"), ("Asha", "Chetan")}


def test_aliases_are_no_relation(related):
    text = "Asha alias Binod with Chetan"
    assert set(related(person_pairs, text, ("Asha", "PERSON", "g1"), ("Binod", "PERSON", "g1"), ("Chetan", "PERSON", "g2"))) == {("Asha", "Chetan"), ("Binod", "Chetan")}
    assert len(related(person_pairs, text, ("Asha", "PERSON", ""), ("Binod", "PERSON", ""), ("Chetan", "PERSON", None))) == 3


def test_pronoun_carry_over(related):
    people = [("Asha", "PERSON", None), ("Binod", "PERSON", None)]
    got = related(person_relations, "Asha saw Binod. He used 98765. The accused fled to Delhi. Here is Pune.", *people, ("98765", "PHONE", None), ("Delhi", "LOCATION", None), ("Pune", "LOCATION", None))
    assert {b: a for a, b in got} == {"98765": "Binod", "Delhi": "Binod"}
    assert set(related(person_relations, "He used 98765. Asha left. She met Binod in Delhi.", *people, ("98765", "PHONE", None), ("Delhi", "LOCATION", None))) == {("Binod", "Delhi")}
    assert not related(person_relations, "Asha left. He\nPune is far.", people[0], ("Pune", "LOCATION", None))


def test_cues_are_words(spark):
    from pyspark.sql import functions as F

    from threadloom.functions.lexicon import OWN_CUES, PRESENT_CUES
    from threadloom.operators.relate import has_cue

    rows = [("in the town", False, False), ("he owns it", False, False), ("his own car", True, False), ("that was all", False, False), ("seen at noon", False, True), ("near the gate", False, True), ("उसे वहाँ देखा", False, True), ("यह गाड़ी", True, False), ("", False, False), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, own boolean, present boolean")
    for r in df.select("*", has_cue(F.col("t"), OWN_CUES).alias("o"), has_cue(F.col("t"), PRESENT_CUES).alias("p")).collect():
        assert (r.o, r.p) == (r.own, r.present), r
