"""Sentence units: ambiguous marks in several scripts, and properties of all offsets."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm.sentences import sentence_units, unit_offsets

CASES = [
    ("The bag weighed 2.4 kg. and was red. He left at 5.30 p.m. with Dr. A. Rao.", ["The bag weighed 2.4 kg. and was red.", "He left at 5.30 p.m. with Dr. A. Rao."]),
    ("It was sold to Om Traders Pvt. Ltd. The price was Rs. 500.", ["It was sold to Om Traders Pvt. Ltd.", "The price was Rs. 500."]),
    ("“Leave!” shouted the guard. He said, “Stop. Wait here.” Then he ran.", ["“Leave!” shouted the guard.", "He said, “Stop. Wait here.”", "Then he ran."]),
    ("Write to a.b@mail.example.org or see www.x.example.org now.Later he came...", ["Write to a.b@mail.example.org or see www.x.example.org now.", "Later he came..."]),
    ("He waited... and left... Then rain.", ["He waited... and left...", "Then rain."]),
    ("वह आया। बस 3.5 किमी दूर है । गवाह ने कहा, “नहीं। कभी नहीं।” और चुप हो गया। डॉ. राव गए|", ["वह आया।", "बस 3.5 किमी दूर है ।", "गवाह ने कहा, “नहीं। कभी नहीं।” और चुप हो गया।", "डॉ. राव गए|"]),
    ("他来了。证人说：“没有。走了。”后来呢？", ["他来了。", "证人说：“没有。走了。”", "后来呢？"]),
    ("ฉันไม่รู้ เขาเห็น Ravi Nair ที่นี่", ["ฉันไม่รู้", "เขาเห็น Ravi Nair ที่นี่"]),
    ("Il a dit : « Non. Jamais. » puis il est parti. Voir p. 3, cf. l'annexe.", ["Il a dit : « Non. Jamais. » puis il est parti.", "Voir p. 3, cf. l'annexe."]),
    ("Heading\r\n\r\n  first line\n- item", ["Heading", "first line", "- item"]),
    ("بس آئی۔ کیا وہ تھا؟", ["بس آئی۔", "کیا وہ تھا؟"]),
    ("ALL CAPS ETC. AND MORE. NEXT ONE!!", ["ALL CAPS ETC. AND MORE.", "NEXT ONE!!"]),
]


@pytest.fixture(scope="module")
def split(spark):
    def run(texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", unit_offsets(F.col("t")).alias("u")).orderBy("i").collect()
        return [[(x.s, x.e) for x in r.u] for r in rows]

    return run


def test_cases(split):
    for (text, want), units in zip(CASES, split([c[0] for c in CASES])):
        assert [text[s:e] for s, e in units] == want


def test_dirt(split, spark):
    assert split([None, "", " \t\n ", "a"]) == [[], [], [], [(0, 1)]]
    long = "He came home. " * 3000 + "x" * 50_000
    (units,) = split([long])
    assert len(units) == 3001 and units[-1][1] == len(long)
    df = spark.createDataFrame([("d", "He sat. She ran.", 7)], "id string, raw_text string, unit_no int")
    assert [(r.unit_no, r.start_char) for r in sentence_units(df).orderBy("unit_no").collect()] == [(1, 0), (2, 8)]
    assert sentence_units(df.limit(0)).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aB. !?।“”«»。\n\r\t'3ก क­\xa0|e", max_size=40), min_size=1, max_size=20))
def test_offsets_cover_text(split, texts):
    for t, units in zip(texts, split(texts)):
        last = 0
        for s, e in units:
            assert last <= s < e <= len(t) and not t[s].isspace() and not t[e - 1].isspace() and "\n" not in t[s:e]
            assert not t[last:s].strip()
            last = e
        assert not t[last:].strip() and re.sub(r"\s", "", t) == re.sub(r"\s", "", "".join(t[s:e] for s, e in units))
