"""Graph, finding, ledger, resolution, extraction and evaluation operators on closed forms and negative cases."""

import math
from collections import defaultdict

import pytest

from threadloom.functions import similarity as sim
from threadloom.operators import evaluate, extract, findings, graph, ledger, resolve
from threadloom.streaming.operators import lockouts_of

M = resolve.Mention


def groups(ms, kind="PERSON", **kw):
    return [tuple(e["mention_ids"]) for e in resolve.resolve_group(ms, kind, **kw)]


def test_resolution_evidence():
    phone = frozenset(["PHONE:9"])
    full = resolve.resolve_group([M("1", "Ravi Nair", "a"), M("2", "Ravi Nair", "b")], "PERSON")
    assert full[0]["merge_confidence"] == 0.72 and full[0]["needs_review"]
    shared = resolve.resolve_group([M("1", "Ravi Nair", "a", nearby=phone), M("2", "Ravi Nair", "b", nearby=phone)], "PERSON")
    assert shared[0]["merge_confidence"] == 0.902 and not shared[0]["needs_review"]


def test_resolution_negative():
    phone = frozenset(["PHONE:9"])
    assert len(groups([M("1", "Ravi Nair", "a", nearby=phone), M("2", "Ravi Shah", "b", nearby=phone)])) == 2
    assert len(groups([M("1", "Sector 14", "a"), M("2", "Sector 15", "b")], "LOCATION")) == 2
    assert len(groups([M("1", "Ravi Nair", "a"), M("2", "Ravi Nair", "b")], never={("1", "2")})) == 2
    assert len(groups([M("1", "Ravi Nair", "a"), M("2", "Om Puri", "b")], force={("1", "2")})) == 1
    # A bare given name with the phones of two people does not join them.
    ms = [M("1", "Ravi Nair", "a", nearby=phone), M("2", "Ravi", "b", nearby=phone), M("3", "Ravi Shah", "c", nearby=phone)]
    assert all(len({"1", "3"} & set(g)) < 2 for g in groups(ms))
    assert groups(ms) == groups(ms[::-1])


def test_transliterated_names():
    assert sim.name_evidence(sim.name_tokens("रवि नायर"), sim.name_tokens("Ravi Nayar"))[0] > 0
    assert sim.indel_ratio("", "") == 1 and sim.damerau("surehs", "suresh") == 1
    assert sim.token_similarity("r", "ravi") == 0.7 and sim.token_similarity("r", "om") == 0.0


@pytest.mark.parametrize("times, want", [([0, 300, 600], 1), ([0, 21600, 43200], 0), ([i * 300 for i in range(7)], 4), ([0, 450, 900], 1), ([0, 450, 901], 0)])
def test_bursts(spark, times, want):
    assert findings.count_bursts([float(t) for t in times]) == want
    df = spark.createDataFrame([(1, t) for t in times], "k int, s int").selectExpr("k", "timestamp_seconds(s) AS ts")
    rows = findings.burst_segments(df, ["k"], "ts").collect()
    assert (rows[0].n_bursts if rows else 0) == want


def test_ledger_tampering(spark):
    from pyspark.sql import functions as F

    e = spark.createDataFrame([(c, i, "genesis" if i == 0 else "case_created", f"p{i}") for c in "ab" for i in range(5)], "chain string, ordinal int, event_type string, payload string")
    chains = ledger.build_chains(e)
    assert all(r.intact for r in ledger.verify_chains(chains).collect())
    edited = ledger.verify_chains(chains.withColumn("payload", F.when(F.expr("chain = 'a' AND sequence_number = 2"), "x").otherwise(F.col("payload"))))
    assert {r.chain: (r.intact, r.first_broken) for r in edited.collect()} == {"a": (False, 2), "b": (True, None)}
    gone = ledger.verify_chains(chains.filter("NOT (chain = 'b' AND sequence_number = 1)"))
    assert {r.chain: r.intact for r in gone.collect()} == {"a": True, "b": False}
    assert not ledger.verify_chains(chains.filter("sequence_number > 0")).first().intact
    assert ledger.verify_chains(chains.limit(0)).count() == 0


def test_components(spark):
    import random

    r = random.Random(4)
    pairs = [(f"v{r.randrange(120):03}", f"v{r.randrange(120):03}") for _ in range(70)] + [(f"w{i:03}", f"w{i + 1:03}") for i in range(40)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {x.id: x.component for x in graph.connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {v: find(v) for p in pairs for v in p}


def test_centralities():
    adj = defaultdict(set)
    for i in range(1, 5):
        adj["c"].add(f"l{i}")
        adj[f"l{i}"].add("c")
    b = graph.brandes(adj)
    assert b["c"] == pytest.approx(1.0) and b["l1"] == 0
    two = defaultdict(set)
    for g in ("a", "b"):
        for i in range(4):
            for j in range(4):
                if i != j:
                    two[f"{g}{i}"].add(f"{g}{j}")
    two["a0"].add("b0")
    two["b0"].add("a0")
    c = graph.louvain_levels(two)
    assert {c["a0"], c["a3"]} == {"a0"} and {c["b0"], c["b3"]} == {"b0"}


def test_link_prediction(spark):
    e = spark.createDataFrame([("A", "C"), ("B", "C"), ("A", "D"), ("B", "D"), ("E", "A")], "src string, dst string")
    best = graph.adamic_adar(e).orderBy("score", ascending=False).first()
    assert (best.a, best.b, best.n_shared) == ("A", "B", 2) or (best.a, best.b) == ("C", "D")
    assert graph.adamic_adar(e).filter("a = 'A' AND b = 'B'").first().score == pytest.approx(2 / math.log(2))


def test_extraction():
    text = "Accused Ravi Nair alias Kalu of Sector 14 called 98765-43210 from MH 12 AB 1234; a/c no. 123456789012 of Om Traders Pvt Ltd."
    found = extract.extract(text)
    kinds = {(m["entity_type"], text[m["s"] : m["e"]]) for m in found}
    assert ("PERSON", "Ravi Nair") in kinds and ("PHONE", "98765-43210") in kinds and ("VEHICLE", "MH 12 AB 1234") in kinds and ("ACCOUNT", "123456789012") in kinds
    assert all(a["e"] <= b["s"] for a, b in zip(found, found[1:]))
    assert {m.get("alias_role") for m in found if m["entity_type"] == "PERSON"} == {"primary", "alias"}
    assert extract.extract("") == [] and extract.earliest_longest([(0, 2), (0, 5), (4, 9), (5, 6)]) == [(0, 5), (5, 6)]


def test_evaluation(spark):
    assert evaluate.greedy_matches([("P", 0, 10)], [("P", 0, 6), ("P", 0, 9), ("Q", 0, 10)]) == [(0, 1, 0.9)]
    x = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 2, 2)], "id int, gold int, found int")
    r = evaluate.pairwise_quality(x).first()
    assert (r.hit, r.in_gold, r.in_found) == (1, 3, 2) and r.precision == 0.5


def test_lockouts():
    fail = [(float(t), "error") for t in range(0, 50, 10)]
    assert lockouts_of(fail, [], -1.0)[0] == [40.0]
    assert lockouts_of(fail[:3] + [(25.0, "signup")] + fail[3:], [], -1.0)[0] == []
    assert lockouts_of([(t * 1000.0, "error") for t in range(9)], [], -1.0)[0] == []


def test_stream_lockouts_equal_batch(spark, small):
    from threadloom.plans.streams import QUERIES

    got = {r.user_id: r.n_locks for r in QUERIES["stream_lockouts"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/events.parquet").selectExpr("user_id AS k", "cast((unix_micros(cast(ts AS timestamp)) - 1704067200000000) / 1000 + 1704067200000000 AS bigint) / 1e6 AS t", "if(event_type = 'signup', 'signup', 'error') AS e").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.k].append((float(r.t), r.e))
    want = {k: len(lockouts_of(sorted(v), [], -1.0)[0]) for k, v in by.items()}
    assert got == {k: n for k, n in want.items() if n} and len(got) > 1


def test_text_functions():
    assert sim.recase_shouting("THE FIR OF RAVI NAIR WAS LOST") == "The FIR Of Ravi Nair Was Lost"
    assert sim.recase_shouting("The FIR of Ravi Nair") == "The FIR of Ravi Nair"
    names = frozenset(["ramesh", "kavita"])
    assert sim.fuzzy_name("Rameesh", names) == "ramesh" and sim.fuzzy_name("Kavi", names) is None and sim.fuzzy_name("Kavitha", names) == "kavita"
    assert sim.canonical_json('{"b":1,"a":"é"}') == '{"a": "\\u00e9", "b": 1}' and sim.canonical_json("{") is None
    assert sim.roman_devanagari("रमेश 12") == "ramesh 12"


def test_betweenness_in_parts(spark):
    """Sources in chunks give the exact result; a case beyond the pivots says that it is estimated."""
    import random

    from threadloom.operators import graph

    r = random.Random(4)
    rows = [("c", f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(90)] + [("d", "x", "y"), ("d", "y", "z"), ("e", "x", "x")]
    df = spark.createDataFrame(rows, "case_id string, src string, dst string")
    adj = {}
    for c, a, b in rows:
        if c == "c" and a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    want = graph.brandes(adj)
    got = {(x.case_id, x.id): x for x in graph.betweenness(df, pivots=None, chunk=7).collect()}
    assert {i for c, i in got if c == "c"} == set(want) and all(abs(got["c", v].betweenness - b) < 1e-9 for v, b in want.items())
    assert got["d", "y"].betweenness == 1.0 and not any(x.estimated for x in got.values())
    assert {x.case_id for x in graph.betweenness(df, pivots=20).collect() if x.estimated} == {"c"}


def test_pagerank_settles(spark):
    from threadloom.operators import graph

    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    v = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    rank = {r.id: r["rank"] for r in graph.pagerank(e, v, rounds=100, tolerance=1e-6).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-6 and abs(rank["d"] - 0.0375) < 1e-6 and rank["a"] > rank["b"]
    with pytest.raises(RuntimeError):
        graph.pagerank(e, v, rounds=2, tolerance=1e-12)


def test_numbered_findings(spark):
    from threadloom.operators import findings

    df = spark.createDataFrame([("a", f"s{i:04d}") for i in range(500)] + [("b", "x")], "kind string, subject string").repartition(7)
    rows = findings.numbered(df, "kind", "subject").collect()
    assert sorted((r.kind, r.subject, r.n) for r in rows) == [("a", f"s{i:04d}", i) for i in range(500)] + [("b", "x", 0)]


def test_bursts_and_chains_by_stream(spark):
    """Long keys that span several batches."""
    from threadloom.operators import findings, ledger

    times = [(i % 3, i * (50 if i % 400 < 40 else 3000)) for i in range(6000)]
    df = spark.createDataFrame(times, "k int, s int").selectExpr("k", "timestamp_seconds(s) AS ts")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.k: r.n_bursts for r in findings.burst_segments(df, ["k"], "ts").collect()}
        e = spark.range(1000).selectExpr("1 AS chain", "id AS ordinal", "'x' AS event_type", "cast(id AS string) AS payload")
        assert ledger.verify_chains(ledger.build_chains(e)).collect()[0].entries_checked == 1000
        assert ledger.verify_chains(ledger.build_chains(e)).collect()[0].intact
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {k: findings.count_bursts([float(s) for j, s in times if j == k]) for k in range(3)}
    assert got == {k: n for k, n in want.items() if n}
