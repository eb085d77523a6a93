"""Files in and out, and planted truth end to end."""

from pyspark.sql import functions as F

from threadloom.operators import findings
from threadloom.operators.extract import extract_mentions
from threadloom.sources import files, generate


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  Report one.\nLine two. ")
    (tmp_path / "b.txt").write_text("   ")
    rows = files.text_files(spark, str(tmp_path)).collect()
    assert [r.raw_text for r in rows] == ["Report one.\nLine two."] and rows[0].id.startswith("doc-")


def test_validation(spark):
    d = spark.createDataFrame([("1", "c", "fir", "x"), ("2", "c", "novel", "x"), ("3", "c", "fir", " "), ("4", "z", "fir", "x"), ("5", "c", "cdr", "x"), ("5", "c", "cdr", "y"), (None, "c", "fir", "x"), ("6", "c", "fir", "x" * 200_001), ("7", "c", "FIR", "x")], "id string, case_id string, document_type string, raw_text string")
    good, bad = files.validated(d, spark.createDataFrame([("7",)], "id string"), spark.createDataFrame([("c",)], "id string"))
    assert [r.id for r in good.collect()] == ["1"]
    assert {(r.id, r.reason) for r in bad.collect()} == {("2", "unknown type"), ("3", "blank text"), ("4", "missing case"), ("5", "duplicate id"), (None, "no id"), ("6", "text too long"), ("7", "duplicate id")}


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([("a", ["x", "y"], True)], "id string, m array<string>, review boolean")
    files.csv_export(d, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first() == ("a", "x;y", "yes")
    v, e = spark.createDataFrame([("c", "1", "L", "T")], "case_id string, id string, label string, type string"), spark.createDataFrame([], "case_id string, src string, dst string, relation_type string, confidence double")
    assert files.graph_json(v, e).first().graph == '{"nodes":[{"id":"1","label":"L","type":"T"}],"edges":[]}'
    assert "| a |" in files.markdown_report("T", d.select("id"), d.select("id"))


def test_planted_truth(spark):
    r = generate.reports(spark, 200)
    m = extract_mentions(r, names=frozenset(x.lower() for x in generate.FIRST + generate.LAST))
    j = m.join(r, m.doc_id == r.id)
    for kind, col in (("PERSON", "person"), ("PHONE", "phone"), ("LOCATION", "place")):
        assert j.filter((F.col("entity_type") == kind) & (F.col("text") == F.col(col))).select("doc_id").distinct().count() >= 190, kind
    calls = generate.call_records(spark, 40)
    b = findings.burst_segments(calls, ["document_id"], "ts")
    assert {x.document_id for x in b.collect()} == {x.document_id for x in calls.filter("burst").select("document_id").distinct().collect()}
    pay = generate.payment_records(spark, 40)
    s = {x.document_id for x in findings.structuring_by_document(pay).collect()}
    assert s == {x.document_id for x in pay.filter("structured").select("document_id").distinct().collect()}
    assert {x.sender for x in findings.structuring_by_sender(pay).collect()} == {x.sender for x in pay.filter("structured").select("sender").distinct().collect()}


def test_latest_wide(spark):
    import datetime as dt

    from threadloom.sources.tables import latest_delivery, latest_wide

    at = lambda n: dt.datetime(2026, 1, n) if n else None
    rows = [("a", at(1), "old"), ("a", at(2), "new"), ("b", at(1), "one"), (None, at(1), "x"), (None, at(1), "y"), ("c", at(3), "same"), ("c", at(3), "same"), ("d", None, "n"), ("d", None, "n"), ("e", None, "p"), ("e", at(1), "q")]
    df = spark.createDataFrame(rows, "id string, ingested_at timestamp_ntz, text string")
    want = sorted(map(str, latest_delivery(df).collect()))
    assert sorted(map(str, latest_wide(df).collect())) == want
    assert sorted(map(str, latest_wide(df, most=1).collect())) == want  # beyond the bound
    assert latest_wide(df.limit(0)).count() == 0
    assert latest_wide(df.filter("id = 'b'")).count() == 1
