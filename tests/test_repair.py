"""Names in Devanagari and repairs of spans, on own examples."""

from threadloom.operators.extract import extract_mentions
from threadloom.operators.repair import Span, Words, devanagari_spans, grow_names, known_words, merge_places, retype, split_connectors

W = Words(frozenset("asha bimal रवि मीना".split()), frozenset("arora bose नायर".split()), frozenset(["lakeside", "पुणे", "नया पुर"]))


def texts(spans, t):
    return [(x.kind, t[x.s : x.e]) for x in spans]


def test_devanagari():
    t = "रवि नायर और मीना पुणे से शांति नगर गए। नायर ने देखा"
    assert texts(devanagari_spans(t, W), t) == [("PERSON", "रवि नायर"), ("PERSON", "मीना"), ("LOCATION", "पुणे"), ("LOCATION", "शांति नगर")]
    assert texts(devanagari_spans(t, W, [(0, 8)]), t)[0] == ("PERSON", "मीना") and devanagari_spans("", W) == []


def test_split():
    t = "Asha Bose at Hill View"
    assert texts(split_connectors([Span("PERSON", 0, len(t))], t, W), t) == [("PERSON", "Asha Bose"), ("PERSON", "Hill View")]
    assert split_connectors([Span("PHONE", 0, 4)], "12 at", W) == [Span("PHONE", 0, 4)]


def test_retype():
    for t, at, kind, want in [("Lakeside", 0, "PERSON", "LOCATION"), ("Green Colony", 0, "PERSON", "LOCATION"), ("Asha Bosse", 0, "LOCATION", "PERSON"), ("near Xanadu", 5, "PERSON", "LOCATION"), ("Dr. Xanadu", 4, "LOCATION", "PERSON"), ("Bus Stand", 0, "PERSON", "LOCATION"), ("near Asha Bose", 5, "PERSON", "PERSON")]:
        assert retype([Span(kind, at, len(t))], t, W)[0].kind == want, t


def test_grow():
    t = "Asha Bose met Bimal Arrora here"
    assert texts(grow_names([Span("PERSON", 5, 9), Span("PERSON", 14, 19)], t, W), t) == [("PERSON", "Asha Bose"), ("PERSON", "Bimal Arrora")]
    assert texts(grow_names([Span("PERSON", 5, 9), Span("ORGANIZATION", 0, 4)], t, W), t)[0] == ("PERSON", "Bose")


def test_places():
    t = "Hilltown Bus Stand and Sector 4, Lakeside and Riverton railway station"
    got = merge_places([Span("LOCATION", 0, 8), Span("LOCATION", 9, 18), Span("LOCATION", 23, 31), Span("LOCATION", 33, 41), Span("LOCATION", 46, 54)], t, W)
    assert texts(got, t) == [("LOCATION", "Hilltown Bus Stand"), ("LOCATION", "Sector 4, Lakeside"), ("LOCATION", "Riverton railway station")]


def test_second_pass(spark):
    rows = [("PERSON", "Asha Bose"), ("PERSON", "Asha Bose"), ("PERSON", "रवि नायर"), ("PERSON", "रवि नायर"), ("LOCATION", "Lakeside"), ("LOCATION", None)]
    w = known_words(spark.createDataFrame(rows, "entity_type string, text string"), 0.2)
    assert w.given == {"asha", "रवि"} and w.family == {"bose", "नायर"} and w.places == {"lakeside"}
    docs = spark.createDataFrame([("d", "Asha Bose called 9876543210. रवि नायर ने देखा"), ("e", None), ("f", "")], "id string, raw_text string")
    got = {(r.entity_type, r.text) for r in extract_mentions(docs, names=w.names, words=w).collect()}
    assert {("PERSON", "Asha Bose"), ("PHONE", "9876543210"), ("PERSON", "रवि नायर")} <= got
