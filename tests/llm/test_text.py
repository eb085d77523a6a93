"""Languages, personal spans, look-alikes, names, document forms."""

import random

import pandas as pd
import pytest

from threadloom.llm import quality as q
from threadloom.llm.languages import LanguageModel, document_languages, label_units, language_segments, tidy
from threadloom.llm.lookalikes import consistent_form, normalized, same_look_pairs
from threadloom.llm.names import Firm, Name, edits, jaro_winkler, link_firms, link_names, link_persons, same_firm, same_person, variant_pairs
from threadloom.llm.personal import SpanModel, find, masked, masked_texts, personal_spans


@pytest.fixture(scope="module")
def samples(small):
    s, w = pd.read_parquet(f"{small}/lang_samples.parquet"), pd.read_parquet(f"{small}/common_words.parquet")
    return sorted(zip(s.lang, s.sample_text)), sorted(zip(w.lang, w.word))


def test_language_held_out(samples):
    rows = list(samples[0])
    random.Random(5).shuffle(rows)
    cut = len(rows) * 3 // 4
    model = LanguageModel.fit(sorted(rows[:cut] + samples[1]))
    hits = sum(label_units(model, [tidy(t)])[0][0] == lang for lang, t in rows[cut:])
    assert hits / (len(rows) - cut) >= 0.95


def test_language_segments(spark, samples):
    model = LanguageModel.fit(sorted(samples[0] + samples[1]))
    text = "The bus reached the town before dawn and he left. Nothing was found there.\nलड़की को बाद में बाल गृह भेज दिया गया। यह नंबर कई दिनों से बंद है।"
    df = spark.createDataFrame([("a", text, "x"), ("b", None, "x"), ("c", "  ", "x"), ("d", "123 456", None), ("e", "", None)], "id string, raw_text string, lang string")
    rows = [(r.document_id, r.seg_no, r.lang) for r in language_segments(df, model).orderBy("document_id", "seg_no").collect()]
    assert rows == [("a", 1, "en"), ("a", 2, "hi"), ("d", 1, "und")]
    main = {r.document_id: (r.lang, r.n_langs) for r in document_languages(language_segments(df, model)).collect()}
    assert main["a"][1] == 2 and main["d"] == ("und", 1)
    assert language_segments(df.limit(0), model).count() == 0


TEXT = "Accused Ramesh Oberwal r/o House 12, Ward 3, Naya Ghat, PIN 900123 was contacted on mob +91 98765 43210. Mail r.o@mail.example.org, card no. ABC1234567, a/c no. 912345678901. Kesarwal Traders paid."


def test_personal_spans(spark):
    model = SpanModel.fit([TEXT] * 5)
    found = {(k, TEXT[s:e]) for k, s, e, _ in find(model, TEXT)}
    assert found == {("NAME", "Ramesh Oberwal"), ("ADDRESS", "House 12, Ward 3, Naya Ghat, PIN 900123"), ("PHONE", "+91 98765 43210"), ("EMAIL", "r.o@mail.example.org"), ("ID_NUMBER", "ABC1234567")}
    assert masked("ab", [("NAME", 0, 1, 0.9)]) == "[NAME]b"
    df = spark.createDataFrame([("a", TEXT, 1), ("b", None, 2), ("c", "", 3)], "id string, raw_text string, pii_type int")
    assert personal_spans(df, model).count() == 5
    out = {r.document_id: r.masked_text for r in masked_texts(df, model).collect()}
    assert "[NAME]" in out["a"] and "Oberwal" not in out["a"] and out["b"] is None and out["c"] == ""


def test_spans_with_invisible_signs():
    model = SpanModel.fit([TEXT] * 5)
    t = "Dr. Ram​esh Obеrwal was seen. Call 98765⁠ 43210 or a​b (at) mail.example.org"
    got = {k: t[s:e] for k, s, e, _ in find(model, t)}
    assert got["NAME"] == "Ram​esh Obеrwal" and got["PHONE"] == "98765⁠ 43210"


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Rаmesh", "Ramesh", True), ("Ｒａｍ", "Ram", True), ("Ram​esh", "Ramesh", True), ("é", "é", True), ("a\xa0b", "a b", True), ("98765‑4", "98765-4", True),
        ("क़", "क़", True), ("كتاب", "کتاب", True), ("Ram", "ram", False), ("é", "e", False), ("a  b", "a b", False), ("९", "9", False), ("র‍্য", "র্য", False), ("ΖΑ12", "ZA12", True),
        ("москва", "mockва", False),
    ],
)
def test_looks(a, b, same):
    assert (consistent_form(a) == consistent_form(b)) == same
    assert consistent_form(consistent_form(a)) == consistent_form(a)


def test_look_pairs(spark):
    rows = [("s", "1", "Ram"), ("s", "2", "Rаm"), ("s", "2", "Rаm"), ("s", "3", "Ram"), ("t", "4", "Rаm"), (None, "5", "Rаm"), ("s", "6", None), ("s", "7", " "), ("s", "8", "\xa0")]
    df = spark.createDataFrame(rows, "scope string, id string, text string")
    assert {(r.id_a, r.id_b) for r in same_look_pairs(df).collect()} == {("1", "2"), ("2", "3")}
    assert same_look_pairs(df.limit(0)).count() == 0
    assert [r.consistent_text for r in normalized(df.filter("id IN ('2', '6')"), "text").orderBy("id").collect()] == ["Ram", "Ram", None]


def test_name_pairs():
    yes = [("ramesh oberwal", "oberwal, ramesh"), ("ramesh oberwal", "रमेश ओबेरवाल"), ("krishan kant lohtia", "krishnakant lohtia"), ("sushila fatehwal", "susshila fathwal"), ("savita oberwal", "সবিতা ওবেরওয়াল"), ("qadir kumar rangota", "qadir rangota"), ("jaggi yelgaon", "jagmohan yelgaon"), ("ramesh oberwal", "رمیش اوبیروال")]
    no = [("ramesh oberwal", "rakesh oberwal"), ("savita oberwal", "kavita oberwal"), ("sunita fatehwal", "sushila fatehwal"), ("ramesh oberwal", "ramesh lohtia")]
    assert [same_person(Name(a), Name(b)) for a, b in yes] == [True] * len(yes)
    assert [same_person(Name(a), Name(b)) for a, b in no] == [False] * len(no)
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-3) and edits("ab", "ba", 1) == 1 and edits("abc", "x", 1) == 2


def test_short_names_join_only_one():
    e = frozenset()
    c = link_persons(["ramesh oberwal", "r. oberwal", "ramesh", "savita lohtia", "savita jhalotra", "savita"], [e] * 6, [e] * 6)
    assert c[0] == c[1] == c[2] and len({c[3], c[4], c[5]}) == 3
    g = lambda role: frozenset([("g", role)])
    c = link_persons(["ramesh oberwal", "chikna", "चिकना"], [e] * 3, [g("primary"), g("alias"), e])
    assert c[0] == c[1] == c[2]


def test_firms():
    assert same_firm(Firm("om vindhya finance and leasing"), Firm("finance & leasing om vindya pvt. ltd."))
    assert not same_firm(Firm("om vindhya traders"), Firm("om vindhya logistics"))
    c = link_firms(["sarthi path placement services (spps)", "m/s sarthi path placement", "sarthi path traders", "placement svcs sarthi path"])
    assert c[0] == c[1] == c[3] != c[2]


def test_link_names(spark):
    rows = [("s", "PERSON", "1", "Ramesh Oberwal"), ("s", "PERSON", "1", "Ramesh Oberwal"), ("s", "PERSON", "2", "OBERWAL RAMESH"), ("s", "ORGANIZATION", "3", "Ramesh Oberwal"), ("t", "PERSON", "4", "Ramesh Oberwal"), (None, "PERSON", "5", "x"), ("s", "PERSON", "6", None), ("s", "PHONE", "7", "1")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "scope string, kind string, id string, text string, near array<string>, alias_group string, alias_role string")
    links = link_names(df)
    assert {(r.id, r.entity) for r in links.collect()} == {("1", "1"), ("2", "1"), ("3", "3"), ("4", "4")}
    assert [(r.id_a, r.id_b) for r in variant_pairs(links, df).collect()] == [("1", "2")]
    assert link_names(df.limit(0)).count() == 0


COMMON = frozenset("the of and to a in was that is he on with".split())
FORMS = [
    ("prose", "He was seen on the road to the town. Nothing of value was found, and he left with a friend."),
    ("prose", "He was heard saying yes on the phone\nto a man of the town that is near. It was\nthe end of the day and he was in a\nhurry to leave with the money."),
    ("list", "Seized items\n• rope\n• torch\n• sim card\n• bed sheet"),
    ("list", "1. rope\n2. torch, broken\n3. ledger"),
    ("list", "rope; torch; ledger 4; bed sheet; sim card; phone"),
    ("table", "a,b,c\n1,2,x\n3,4,y\n5,6,z"),
    ("table", "| a | b |\n| 1 | 2 |\n| 3 | 4 |"),
    ("table", "caller      callee      date\n1111111111  2222222222  2026-01-01\n3333333333  4444444444  2026-01-02"),
    ("junk", "========\n--------\n########"),
    ("junk", "word word word word word word word word word word"),
    ("junk", "9f86d081884c7d659a2feaa0c55ad015\na3bf4f1b2b0b822cd15d6c15b0f00a08"),
    ("blank", " \n "),
]


@pytest.mark.parametrize("kind, text", FORMS)
def test_forms(kind, text):
    assert q.Form(text, COMMON).kind == kind


def test_statistics(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", None), (4, "x" * 200_000, None)], "doc_id long, text string, kind string")
    rows = {r.doc_id: r for r in q.text_statistics(df, COMMON).collect()}
    assert rows[2].kind == rows[3].kind == "blank" and rows[4].kind == "junk" and rows[1].n_words == 2
    assert q.text_statistics(df.limit(0), COMMON).count() == 0
    assert q.autocorrelation([1, 2, 1, 2, 1, 2], 2) > 0.5 and q.autocorrelation([1, 1], 1) == 0


def test_families_of_the_samples(samples):
    """Languages and families come from the labelled rows: a new one is learnt, one without rows is not guessed."""
    from threadloom.llm.languages import families_of

    fam = families_of(samples[0] + samples[1])
    assert fam == {"latin": ["en", "es", "fr", "hi-latn"], "devanagari": ["hi", "mr"], "arabic": ["ur"], "bengali": ["bn"], "thai": ["th"], "han": ["zh"]}
    ru = [("ru", "Автобус прибыл в город до рассвета."), ("uk", "Автобус прибув до міста ще до світанку, і він пішов.")] * 3
    model = LanguageModel.fit(samples[0] + ru)
    assert model.families["cyrillic"] == ["ru", "uk"] and label_units(model, ["Автобус прибыл в город."])[0][0] == "ru"
    assert label_units(LanguageModel.fit(samples[0]), ["Автобус прибыл в город."])[0][0] == "und"
