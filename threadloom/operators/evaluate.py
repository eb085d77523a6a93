"""Quality against gold labels: span matching, precision and recall, clustering pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_matches(gold: list[tuple], found: list[tuple], least: float = 0.5) -> list[tuple[int, int, float]]:
    """One-to-one matches of (type, start, end) spans of one type, best overlap first."""
    pairs = []
    for i, (t, s, e) in enumerate(gold):
        for j, (u, a, b) in enumerate(found):
            both = min(e, b) - max(s, a)
            if t == u and both > 0 and (o := both / (max(e, b) - min(s, a))) >= least:
                pairs.append((o, i, j))
    used_i, used_j, out = set(), set(), []
    for o, i, j in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append((i, j, o))
    return out


def match_spans(gold: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, entity_type, n_gold, n_found, n_hit) from rows doc_id, entity_type, s, e; documents are independent."""
    rows = gold.select("doc_id", "entity_type", "s", "e", F.lit(True).alias("g")).unionByName(found.select("doc_id", "entity_type", "s", "e", F.lit(False).alias("g")))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        spans = lambda x: list(x[["entity_type", "s", "e"]].itertuples(index=False, name=None))
        a, b = spans(d[d["g"]]), spans(d[~d["g"]])
        hits = greedy_matches(a, b, least)
        out = pd.DataFrame({"entity_type": sorted({x[0] for x in a + b})})
        out["doc_id"] = d["doc_id"].iloc[0]
        out["n_gold"] = [sum(x[0] == t for x in a) for t in out["entity_type"]]
        out["n_found"] = [sum(x[0] == t for x in b) for t in out["entity_type"]]
        out["n_hit"] = [sum(a[i][0] == t for i, _, _ in hits) for t in out["entity_type"]]
        return out[["doc_id", "entity_type", "n_gold", "n_found", "n_hit"]]

    return rows.groupBy("doc_id").applyInPandas(run, "doc_id string, entity_type string, n_gold long, n_found long, n_hit long")


def quality(hits: Column, found: Column, gold: Column) -> list[Column]:
    """precision, recall and f1, three digits; null where nothing is counted."""
    p, r = F.try_divide(hits, found), F.try_divide(hits, gold)
    return [F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 3).alias("f1")]


def pairwise_quality(labels: DataFrame) -> DataFrame:
    """Pairwise precision and recall of clusters from rows (id, gold, found), by counts only: no pair is made."""
    n2 = lambda c: c * (c - 1) / 2
    both = labels.groupBy("gold", "found").agg(F.count("*").alias("n")).agg(F.sum(n2(F.col("n"))).alias("hit"))
    g = labels.groupBy("gold").agg(F.count("*").alias("n")).agg(F.sum(n2(F.col("n"))).alias("in_gold"))
    f = labels.groupBy("found").agg(F.count("*").alias("n")).agg(F.sum(n2(F.col("n"))).alias("in_found"))
    return both.join(F.broadcast(g)).join(F.broadcast(f)).select("hit", "in_gold", "in_found", *quality(F.col("hit"), F.col("in_found"), F.col("in_gold")))
