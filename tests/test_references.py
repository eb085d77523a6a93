"""Dangling references on a small fixture with every kind of dirt."""

from datetime import datetime as dt

from threadloom.operators.references import Reference, merge_counts, key_counts, orphan_references, orphan_report, reference_rows, target_deltas

REF = "id string, k string, created_at timestamp_ntz, ingested_at timestamp_ntz, kind string"
TGT = "key string, created_at timestamp_ntz, deleted_at timestamp_ntz"


def test_kinds(spark):
    t = lambda m, d=1: dt(2026, m, d)
    refs = spark.createDataFrame(
        [("1", " RES-a ", t(3), t(3), "x"), ("1", " RES-a ", t(3), t(4), "x"), ("2", "res-b", t(3), t(3), "x"), ("3", "res-c", t(3), t(3), "x"), ("4", "res-d", t(3), t(3), "x"), ("5", None, t(3), t(3), "x"), ("6", "  ", t(3), t(3), "x"), ("7", "res-e", t(3), t(3), None), ("8", "res-c", None, None, None)],
        REF,
    )
    target = spark.createDataFrame([("res-a", t(1), None), ("res-b", t(1), t(2)), ("res-b", t(2), t(3)), ("res-d", t(5), None), ("res-e", t(1), t(2)), ("res-e", t(4), None)], TGT)
    r = reference_rows([Reference("links", refs, "k", "t")])
    got = {(x.row_id, x.kind, x.period_month) for x in orphan_references(r, [target_deltas("t", target, "key")]).collect()}
    assert got == {("2", "deleted", "2026-03"), ("3", "missing", "2026-03"), ("4", "late", "2026-03"), ("8", "missing", None)}
    report = orphan_report(orphan_references(r, [target_deltas("t", target, "key")])).collect()
    assert sum(x.n_refs for x in report) == 4


def test_counts_merge(spark):
    refs = spark.createDataFrame([("1", "a", dt(2026, 1, 1), dt(2026, 1, 1), "")], REF)
    target = spark.createDataFrame([("a", dt(2026, 1, 1), None)], TGT)
    one = key_counts(reference_rows([Reference("s", refs, "k", "t")]), [target_deltas("t", target, "key")])
    two = merge_counts(one.unionByName(one)).first()
    assert (two.refs, two.exists, two.rows) == (2, 2, 2)


def test_empty(spark):
    refs = spark.createDataFrame([], REF)
    assert orphan_references(reference_rows([Reference("s", refs, "k", "t")]), [target_deltas("t", spark.createDataFrame([], TGT), "key")]).count() == 0


def test_counts_are_maintained(spark):
    """Stored counts and later deltas give what a rebuild gives, withdrawals and late targets included."""
    import datetime as dt

    from threadloom.operators.references import change_events, maintain, merge_counts, orphan_keys

    at = lambda n: dt.datetime(2026, 1, n) if n else None
    refs = spark.createDataFrame([("t", "a", at(2)), ("t", "a", at(9)), ("t", "b", at(3)), ("t", "c", None), ("t", "d", at(5))], "target string, key string, created_at timestamp_ntz")
    rows = spark.createDataFrame([("A ", at(1), at(8)), ("b", at(4), None), ("c", at(1), at(2)), ("c", at(6), None), (None, at(1), None), (" ", at(1), None)], "id string, created_at timestamp_ntz, deleted_at timestamp_ntz")
    events = change_events(refs, [("t", rows, "id")])
    stored = None
    for lo, hi in ((1, 3), (3, 6), (6, 32)):
        late = "at IS NULL OR" if hi == 32 else ""
        stored = maintain(stored, events.filter(f"{late} at >= '2026-01-{lo:02d}' AND at < '2026-01-{min(hi, 31):02d}'"))
    got = sorted(map(tuple, orphan_keys(stored).collect()))
    assert got == sorted(map(tuple, orphan_keys(merge_counts(events.drop("at"))).collect())) == [("t", "a", 2, 1), ("t", "d", 1, 0)]
    assert orphan_keys(maintain(None, events.limit(0))).count() == 0
