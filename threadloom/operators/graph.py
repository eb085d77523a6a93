"""Graph operators over edge tables (src, dst, ...): merging, degrees, link prediction, centralities, components.

Set-based operators are joins and aggregations over all graphs at once. Iterative ones checkpoint every few rounds in
the shared folder. Algorithms that need a whole graph in hand (betweenness, communities) run per case, and take
documented pivots or levels where a case is large.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import checkpoint


def merge_edges(rows: DataFrame, keys: list[str], confidence: str, order: list[str], evidence: str) -> DataFrame:
    """One edge per key: highest confidence, number of evidence rows, the first piece of evidence by ``order``."""
    return rows.groupBy(*keys).agg(F.max(confidence).alias("confidence"), F.count("*").alias("n_evidence"), F.min_by(evidence, F.struct(*order)).alias("first_evidence"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) with parallel edges counted, in and out."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, vertices: DataFrame, deviations: float = 2.0, least: int = 4) -> DataFrame:
    """Vertices whose degree exceeds mean + ``deviations`` population deviations; isolated vertices count as 0."""
    deg = vertices.select("id").join(degrees(edges), "id", "left").fillna(0, ["degree"])
    s = deg.agg(F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("sd"), F.count("*").alias("n"))
    bound = s.filter((F.col("n") >= least) & (F.col("sd") > 0)).select((F.col("mean") + deviations * F.col("sd")).alias("bound"))
    return deg.join(F.broadcast(bound), F.col("degree") > F.col("bound")).select("id", "degree", F.round("bound", 6).alias("bound"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, without loops."""
    return edges.filter(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(pairs.select(F.col("b").alias("v"), F.col("a").alias("u")))


def neighbour_types(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct neighbours of each vertex by type."""
    n = both_ways(undirected(edges))
    return n.join(vertices.select(F.col("id").alias("u"), "type"), "u").groupBy(F.col("v").alias("id"), "type").agg(F.count("*").alias("n"))


def adamic_adar(edges: DataFrame, most_middle: int | None = None) -> DataFrame:
    """(a, b, score, n_shared) of unlinked pairs with common neighbours: sum of 1 / ln(degree of the neighbour).

    Only pairs two hops apart are made, which are those with a positive score. Neighbours of degree one have none.
    ``most_middle`` leaves out neighbours of a higher degree and is for exploration; by default all take part.
    """
    pairs = undirected(edges)
    n = both_ways(pairs)
    deg = n.groupBy("v").agg(F.count("*").alias("d")).filter("d > 1")
    if most_middle:
        deg = deg.filter(F.col("d") <= most_middle)
    mid = n.join(deg, "v").select(F.col("v").alias("mid"), "u", "d")
    two = mid.select("mid", F.col("u").alias("a"), "d").join(mid.select("mid", F.col("u").alias("b")), "mid").filter("a < b")
    score = two.groupBy("a", "b").agg(F.sum(1.0 / F.log("d")).alias("score"), F.count("*").alias("n_shared"))
    return score.join(pairs, ["a", "b"], "left_anti")


def connected_components(pairs: DataFrame, every: int = 1) -> DataFrame:
    """(id, component) of the undirected graph of ``pairs`` (a, b): the smallest id of each component.

    Alternating large-star and small-star rounds, which halve the depth of the trees each time, until the edges stay
    the same. Every round uses its edges several times, so each is checkpointed; nothing is collected but a count and
    a checksum.
    """
    e = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    loops = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    last = None
    for k in range(200):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(m, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(m2, "u").select(F.expr("CASE WHEN v = m THEN u ELSE v END").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        if k % every == every - 1 or k == 0:
            e = checkpoint(e)
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if tuple(now) == last:
                break
            last = tuple(now)
    else:
        raise RuntimeError("components did not settle within 200 rounds")
    comp = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return loops.join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def pagerank(edges: DataFrame, vertices: DataFrame, damping: float = 0.85, rounds: int = 10, every: int = 1, tolerance: float | None = None) -> DataFrame:
    """(id, rank) of the simple directed graph after ``rounds`` power iterations; dangling mass is spread evenly.

    With a ``tolerance`` it ends once the ranks change by less than that a vertex, all in all, and raises if they do not
    within ``rounds``.

    A round reads the ranks twice, so they are checkpointed every round; that keeps the plan from doubling.
    """
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    e = checkpoint(e.join(out, "src").repartition("src"))
    v = checkpoint(vertices.select("id").join(out.withColumnRenamed("src", "id"), "id", "left"))
    n = v.count()
    r, last = v.withColumn("rank", F.lit(1.0 / max(1, n))), None
    for k in range(rounds):
        flow = e.join(r.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("flow"))
        lost = r.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        r = v.join(flow, "id", "left").join(F.broadcast(lost)).select("id", "out", (F.lit((1 - damping) / max(1, n)) + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if k % every == every - 1 and k + 1 < rounds or tolerance is not None:
            before, r = last, checkpoint(r)
            last = r
            if tolerance is not None and before is not None:
                moved = r.join(before.select("id", F.col("rank").alias("was")), "id").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
                if (moved or 0.0) < tolerance * max(1, n):
                    return r.select("id", "rank")
    if tolerance is not None:
        raise RuntimeError(f"ranks did not settle within {rounds} rounds")
    return r.select("id", "rank")


def _adjacency(g: pd.DataFrame) -> dict:
    adj: dict = defaultdict(set)
    for a, b in zip(g["src"], g["dst"]):
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    return adj


def dependencies(adj: dict, sources: list) -> dict:
    """Brandes' sums of the dependencies of all vertices on the paths from ``sources``; the sums of parts add up."""
    score = dict.fromkeys(sorted(adj), 0.0)
    for s in sources:
        stack, pred, sigma, dist = [], defaultdict(list), {s: 1.0}, {s: 0}
        q = deque([s])
        while q:
            v = q.popleft()
            stack.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] = sigma.get(w, 0.0) + sigma[v]
                    pred[w].append(v)
        delta = dict.fromkeys(stack, 0.0)
        for w in reversed(stack):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    return score


def brandes(adj: dict, pivots: int | None = None) -> dict:
    """Normalised betweenness of an undirected graph; beyond ``pivots`` vertices from as many evenly drawn sources."""
    nodes = sorted(adj)
    n = len(nodes)
    sources = nodes if pivots is None or n <= pivots else [nodes[int(i * n / pivots)] for i in range(pivots)]
    scale = n / len(sources) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return {v: x * scale for v, x in dependencies(adj, sources).items()}


def betweenness(edges: DataFrame, case: str = "case_id", pivots: int | None = 256, chunk: int = 32) -> DataFrame:
    """(case_id, id, betweenness, estimated) of the undirected graph of each case, normalised.

    Exact with ``pivots`` None, and for cases of up to ``pivots`` vertices; larger ones are estimated from as many evenly
    drawn sources, and say so. Sources are worked on in chunks that any task may take, as their sums add up; a task
    holds the edges of one case.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for c, es, part, k in zip(d["c"], d["es"], d["part"], d["k"]):
                adj = _adjacency(pd.DataFrame(list(map(tuple, ((e["src"], e["dst"]) for e in es))), columns=["src", "dst"]))
                nodes = sorted(adj)
                n = len(nodes)
                sources = nodes if k >= n else [nodes[int(i * n / k)] for i in range(k)]
                score = dependencies(adj, sources[part * chunk : (part + 1) * chunk])
                scale = n / len(sources) / ((n - 1) * (n - 2)) if n > 2 else 0.0
                yield pd.DataFrame({"case_id": c, "id": nodes, "b": [score[v] * scale for v in nodes], "estimated": k < n})

    g = edges.filter("src <> dst").groupBy(F.col(case).alias("c")).agg(F.collect_set(F.struct("src", "dst")).alias("es"))
    n = F.size(F.array_distinct(F.flatten(F.transform("es", lambda e: F.array(e["src"], e["dst"])))))
    g = g.withColumn("k", n if pivots is None else F.least(n, F.lit(pivots)))
    parts = g.select("c", "es", F.explode(F.sequence(F.lit(0), F.floor((F.col("k") - 1) / chunk).cast("int"))).alias("part"), "k")
    out = parts.repartition("c", "part").mapInPandas(run, "case_id string, id string, b double, estimated boolean")
    return out.groupBy("case_id", "id").agg(F.sum("b").alias("betweenness"), F.bool_or("estimated").alias("estimated"))


def louvain_levels(adj: dict) -> dict:
    """Community of each vertex by modularity, moved in order of id until nothing gains; named by the smallest member."""
    weights = {v: {u: 1.0 for u in sorted(us)} for v, us in adj.items()}
    own = {v: v for v in adj}
    while True:
        m2 = sum(sum(w.values()) for w in weights.values()) or 1.0
        comm = {v: v for v in weights}
        tot = {v: sum(w.values()) for v, w in weights.items()}
        moved, again = False, True
        while again:
            again = False
            for v in sorted(weights):
                k = sum(weights[v].values())
                near: dict = defaultdict(float)
                for u, w in weights[v].items():
                    if u != v:
                        near[comm[u]] += w
                tot[comm[v]] -= k
                best, gain = comm[v], near.get(comm[v], 0.0) - tot[comm[v]] * k / m2
                for c in sorted(near):
                    g = near[c] - tot[c] * k / m2
                    if g > gain + 1e-12:
                        best, gain = c, g
                if best != comm[v]:
                    comm[v] = best
                    moved = again = True
                tot[best] = tot.get(best, 0.0) + k
        own = {v: comm[c] for v, c in own.items()}
        if not moved:
            break
        merged: dict = defaultdict(lambda: defaultdict(float))
        for v, w in weights.items():
            for u, x in w.items():
                merged[comm[v]][comm[u]] += x
        weights = {c: dict(w) for c, w in merged.items()}
    first: dict = {}
    for v in sorted(own):
        first.setdefault(own[v], v)
    return {v: first[c] for v, c in own.items()}


def communities(edges: DataFrame, case: str = "case_id") -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        c = louvain_levels(_adjacency(g))
        return pd.DataFrame({"case_id": g[case].iloc[0], "id": list(c), "community": list(c.values())})

    return edges.groupBy(case).applyInPandas(run, "case_id string, id string, community string")


def eigenvector(edges: DataFrame, case: str = "case_id", rounds: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """Eigenvector centrality per case by power iteration; 0 where it does not settle."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        adj = _adjacency(g)
        nodes = sorted(adj)
        at = {v: i for i, v in enumerate(nodes)}
        src = np.array([at[v] for v in nodes for _ in adj[v]], np.int64)
        dst = np.array([at[u] for v in nodes for u in sorted(adj[v])], np.int64)
        n = len(nodes)
        x, settled = np.full(n, 1.0 / max(1, n)), False
        for _ in range(rounds):
            y = x + np.bincount(src, weights=x[dst], minlength=n)
            y /= np.linalg.norm(y) or 1.0
            if np.abs(y - x).sum() < n * tolerance:
                settled = True
                x = y
                break
            x = y
        return pd.DataFrame({"case_id": g[case].iloc[0], "id": nodes, "eigenvector": x if settled else np.zeros(n)})

    return edges.groupBy(case).applyInPandas(run, "case_id string, id string, eigenvector double")


def ranked(scores: DataFrame, score: str, top: int = 5, case: str | None = None) -> DataFrame:
    """Rank by score, ties by id, with the number of candidates; per case if one is named."""
    w = Window.partitionBy(case) if case else Window.partitionBy(F.lit(1))
    out = scores.withColumn("rank", F.row_number().over(w.orderBy(F.col(score).desc(), "id"))).withColumn("n_candidates", F.count("*").over(w))
    return out.filter(F.col("rank") <= top)
