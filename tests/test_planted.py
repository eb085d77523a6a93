"""Generated rings, gold spans by a moving cursor, recall over planted mentions."""

from threadloom.operators.extract import extract_mentions
from threadloom.sources.planted import gold_spans, planted_recall, rings


def test_rings_and_gold(spark):
    d = rings(spark, 60, seed=3)
    rows = d.collect()
    assert rows == rings(spark.newSession(), 60, seed=3).collect() and len({r.case_id for r in rows}) == 5
    text = {r.id: r.raw_text for r in rows}
    gold = gold_spans(d).collect()
    assert len(gold) == 300 and all(text[g.doc_id][g.s : g.e] == g.text for g in gold)
    one = [(g.s, g.e) for g in gold if g.doc_id == "ring-7"]
    assert one == sorted(one)


def test_cursor(spark):
    df = spark.createDataFrame([("d", "ab ab cd", [("ab", "X", "1"), ("ab", "X", "2"), ("zz", "X", "3"), ("cd", "X", "4")])], "id string, raw_text string, parts array<struct<text:string,entity_type:string,cluster:string>>")
    assert [(g.s, g.e) for g in gold_spans(df).collect()] == [(0, 2), (3, 5), (None, None), (6, 8)]


def test_recall(spark):
    d = rings(spark, 240)
    got = {r.entity_type: r for r in planted_recall(gold_spans(d), extract_mentions(d)).collect()}
    assert got["PERSON"].n_planted == 480 and all(r.recall >= 0.95 for r in got.values()), got
    assert planted_recall(gold_spans(d), extract_mentions(d.limit(0))).collect()[0].recall == 0
