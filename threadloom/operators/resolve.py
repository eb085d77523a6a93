"""Entity resolution within a scope: exact keys, scored pairs, vetoes, overrides and constrained clustering.

Mentions with identifiers of their own (phones, plates, accounts) are clustered by their keys in SQL. Names are compared
within a scope: blocking keys make the candidate pairs, several signals are combined by a noisy-or, and pairs are
merged from the best down unless any two members of the clusters exclude each other. Decisions come as columns.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.similarity import closeness, name_evidence, name_tokens, noisy_or, phonetic, place_veto, token_sort_ratio
from threadloom.functions.text import account_key, phone_key, plate_key, resolved_id

#: Weights of the evidence beside the names, and the limits of their use; fixed values.
ALIAS_SAME_DOC, ALIAS_DECLARED, SAME_DOC_FULL, SAME_DOC_PARTIAL = 0.97, 0.62, 0.90, 0.70
SHARED_ID, SHARED_ACCOUNT, DOC_ID, CONTEXT, CONTEXT_MOST = 0.65, 0.70, 0.04, 0.03, 2
CONTEXT_FROM, DAMPING = 0.55, 0.85
AUTO, REVIEW = 0.80, 0.60
#: Cities say too little to join the documents that name them.
CITIES = frozenset("delhi,new delhi,mumbai,kolkata,chennai,bengaluru,bangalore,hyderabad,pune,ahmedabad,jaipur,lucknow,kanpur,nagpur,patna,bhopal,indore,surat,agra,varanasi,noida,gurgaon,gurugram,ghaziabad,faridabad,chandigarh,ranchi,guwahati".split(","))


@dataclass
class Mention:
    id: str
    text: str
    doc: str
    confidence: float = 0.5
    alias_group: str | None = None
    alias_role: str | None = None
    nearby: frozenset = frozenset()
    around: frozenset = frozenset()
    tokens: tuple = field(default=())

    def __post_init__(self):
        self.tokens = name_tokens(self.text)


def blocking_keys(m: Mention, kind: str) -> set[str]:
    keys = {f"t:{phonetic(t) or t}" for t in m.tokens if len(t) > 1} | {f"i:{i}" for i in m.nearby}
    if m.alias_group:
        keys.add(f"g:{m.alias_group}")
    if kind == "PERSON" and m.tokens:
        keys.add(f"n:{m.tokens[-1][:1]}{m.tokens[0][:1]}")
    return keys


@lru_cache(1 << 18)
def _evidence(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, str, bool]:
    return name_evidence(a, b)


def candidate_pairs(mentions: list[Mention], kind: str) -> set[tuple[int, int]]:
    """Pairs of one block that can have a score. Blocks have no bound: a block by name compares each two distinct
    forms once, as only an identifier or alias group, which have blocks of their own, joins what names don't."""
    blocks: dict[str, dict] = defaultdict(lambda: defaultdict(list))
    for i, m in enumerate(mentions):
        for k in blocking_keys(m, kind):
            blocks[k][m.tokens if kind == "PERSON" else m.text].append(i)
    known: dict[tuple, bool] = {}

    def joins(x: int, y: int, key: tuple) -> bool:
        if key not in known:
            if kind == "PERSON":
                score, _, veto = _evidence(mentions[x].tokens, mentions[y].tokens)
            else:
                score, _, veto = pair_score(mentions[x], mentions[y], kind, {})
            known[key] = score > 0 and not veto
        return known[key]

    pairs: set[tuple[int, int]] = set()
    for k, forms in blocks.items():
        fs = sorted(forms)
        for x, f in enumerate(fs):
            pairs.update(combinations(forms[f], 2))
            for g in fs[x + 1 :]:
                if k[0] in "ig" or joins(forms[f][0], forms[g][0], (f, g)):
                    pairs.update((i, j) if i < j else (j, i) for i in forms[f] for j in forms[g])
    return pairs


def pair_score(a: Mention, b: Mention, kind: str, context: dict[str, set], primaries: dict[str, Mention] | None = None) -> tuple[float, str, bool]:
    """(score, reason, veto) of two mentions of a kind. ``context``: identifiers of each document; ``primaries``: the
    primary mention of each alias group."""
    if kind != "PERSON":
        if kind == "LOCATION" and place_veto(a.text, b.text):
            return 0.0, "number differs", True
        r = token_sort_ratio(a.text, b.text)
        return (0.95, "same text", False) if r >= 99.99 else (0.85, "near text", False) if r >= 92 else (0.70, "similar text", False) if r >= 82 else (0.0, "", False)
    if a.doc == b.doc and a.alias_group and a.alias_group == b.alias_group:
        return ALIAS_SAME_DOC, "alias in one document", False
    p, how, veto = _evidence(a.tokens, b.tokens)
    if a.alias_group and b.alias_group and a.alias_group != b.alias_group and primaries:
        one, two = primaries.get(a.alias_group), primaries.get(b.alias_group)
        if one and two and _evidence(one.tokens, two.tokens)[2]:
            return 0.0, "alias of different people", True
    if veto:
        return 0.0, "names differ", True
    if a.doc == b.doc:
        if p >= 0.72:
            return SAME_DOC_FULL, "same name in one document", False
        return (SAME_DOC_PARTIAL, "part of the name in one document", False) if how == "partial" else (0.0, "", False)
    parts = [p] if p > 0 else []
    reasons = [f"{how} name"] if p > 0 else []
    if (a.alias_role == "alias") != (b.alias_role == "alias") and how in ("single", "exact", "partial"):
        parts.append(ALIAS_DECLARED)
        reasons.append("declared alias")
    shared = a.nearby & b.nearby
    for i in sorted(shared):
        parts.append(SHARED_ACCOUNT if i.startswith("ACCOUNT") else SHARED_ID)
        reasons.append(f"shared {i}")
    if p >= CONTEXT_FROM and (context.get(a.doc, set()) & context.get(b.doc, set())) - shared:
        parts.append(DOC_ID)
        reasons.append("documents share an identifier")
    if p >= CONTEXT_FROM:
        for what in ("LOCATION", "ORGANIZATION"):
            for key in sorted(x for x in a.around & b.around if x.startswith(what))[:CONTEXT_MOST]:
                parts.append(CONTEXT)
                reasons.append(f"both documents name {key}")
    if not parts:
        return 0.0, "", False
    score = noisy_or(parts)
    if a.nearby and b.nearby and not shared and p > 0:
        score = round(score * DAMPING, 4)
    return score, "; ".join(reasons), False


def resolve_group(mentions: list[Mention], kind: str, never: set[tuple[str, str]] = frozenset(), force: set[tuple[str, str]] = frozenset()) -> list[dict]:
    """Clusters of the mentions of one scope and kind; ``never`` and ``force`` hold sorted pairs of mention ids."""
    mentions = sorted(mentions, key=lambda m: m.id)
    context: dict[str, set] = defaultdict(set)
    for m in mentions:
        context[m.doc] |= set(m.nearby)
    primaries: dict[str, Mention] = {}
    for m in mentions:
        if m.alias_group and (m.alias_group not in primaries or m.alias_role == "primary" and primaries[m.alias_group].alias_role != "primary"):
            primaries[m.alias_group] = m
    known: dict[tuple[int, int], tuple[float, str, bool]] = {}

    def decide(i: int, j: int) -> tuple[float, str, bool]:
        key = (i, j) if i < j else (j, i)
        if key not in known:
            ids = (mentions[key[0]].id, mentions[key[1]].id)
            known[key] = (0.0, "kept apart", True) if ids in never else (1.0, "joined by hand", False) if ids in force else pair_score(mentions[key[0]], mentions[key[1]], kind, context, primaries)
        return known[key]

    pairs = candidate_pairs(mentions, kind)
    at = {m.id: i for i, m in enumerate(mentions)}
    pairs |= {tuple(sorted((at[a], at[b]))) for a, b in force if a in at and b in at}
    edges = [(s, i, j, why) for i, j in sorted(pairs) for s, why, veto in [decide(i, j)] if not veto and s >= REVIEW]
    # A weak mention (one token) whose weak partners exclude each other is left alone, and said to be ambiguous.
    near: dict[int, list[int]] = defaultdict(list)
    for s, i, j, _ in edges:
        if s < AUTO:
            near[i].append(j)
            near[j].append(i)
    ambiguous = {v for v, us in near.items() if len(mentions[v].tokens) <= 1 and any(decide(us[x], us[y])[2] for x in range(len(us)) for y in range(x + 1, len(us)))}
    edges = [e for e in edges if e[0] >= AUTO or not (e[1] in ambiguous or e[2] in ambiguous)]
    cluster = {i: {i} for i in range(len(mentions))}
    worst: dict[int, float] = {}
    why_of: dict[int, list[str]] = defaultdict(list)
    root = list(range(len(mentions)))
    for s, i, j, why in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        a, b = root[i], root[j]
        if a == b:
            continue
        forced = s == 1.0 and why == "joined by hand"
        if any(decide(x, y)[2] and not (forced and {x, y} == {i, j}) for x in cluster[a] for y in cluster[b]):
            continue
        a, b = min(a, b), max(a, b)
        cluster[a] |= cluster.pop(b)
        for x in cluster[a]:
            root[x] = a
        worst[a] = min(worst.get(a, 1.0), worst.pop(b, 1.0), s)
        why_of[a] += why_of.pop(b, []) + [why]
    out = []
    for r, members in sorted(cluster.items()):
        ms = [mentions[i] for i in sorted(members)]
        best = max(ms, key=lambda m: (len(m.tokens) if kind == "PERSON" else 0, m.alias_role == "primary", m.confidence, len(m.text)))
        ids = sorted(m.id for m in ms)
        score = worst.get(r, 1.0)
        out.append(
            {
                "entity_id": "resolved-" + hashlib.sha1("|".join(ids).encode()).hexdigest()[:12], "canonical_text": best.text, "mention_ids": ids, "n_documents": len({m.doc for m in ms}),
                "merge_confidence": score, "needs_review": score < AUTO or bool(members & ambiguous), "reasons": list(dict.fromkeys(why_of.get(r, [])))[:8],
                "aliases": sorted({m.text for m in ms} - {best.text}),
            }
        )
    return out


RESOLVED_SCHEMA = (
    "scope string, entity_type string, entity_id string, canonical_text string, mention_ids array<string>, n_documents int, merge_confidence double, needs_review boolean, reasons array<string>, aliases array<string>"
)


def resolve_names(mentions: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Resolved entities of PERSON, LOCATION and ORGANIZATION mentions, one group per scope and type.

    ``mentions``: scope, id, entity_type, text, doc, confidence, alias_group, alias_role, nearby array<string>;
    ``overrides``: scope, mention_a, mention_b, action, created_at (the newest decision on a pair counts).
    """
    m = mentions.filter(F.col("entity_type").isin("PERSON", "LOCATION", "ORGANIZATION") & (F.length(F.trim("text")) > 0)).withColumn("action", F.lit(None).cast("string")).withColumn("other", F.lit(None).cast("string"))
    cols = ["scope", "entity_type", "id", "text", "doc", "confidence", "alias_group", "alias_role", "nearby", "around", "action", "other"]
    # Places and organisations that a document names, for the persons in it.
    key = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+", " "))
    named = m.filter("entity_type <> 'PERSON' AND doc IS NOT NULL").select("scope", "doc", "entity_type", key.alias("key")).filter((F.col("key") != "") & ~F.col("key").isin(*CITIES))
    named = named.groupBy("scope", "doc").agg(F.array_sort(F.collect_set(F.concat_ws(":", "entity_type", "key"))).alias("around"))
    m = m.join(named, ["scope", "doc"], "left").withColumn("around", F.when(F.col("entity_type") == "PERSON", F.col("around")))
    rows = m.select(*cols)
    if overrides is not None:
        o = overrides.groupBy("scope", F.least("mention_a", "mention_b").alias("id"), F.greatest("mention_a", "mention_b").alias("other")).agg(F.max_by("action", "created_at").alias("action"))
        types = m.select("scope", "id", "entity_type")
        o = o.join(types, ["scope", "id"])
        null = {c: F.lit(None).cast(m.schema[c].dataType) for c in cols if c not in ("scope", "id", "entity_type", "action", "other")}
        rows = rows.unionByName(o.withColumns(null).select(*cols))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        kind, scope = g["entity_type"].iloc[0], g["scope"].iloc[0]
        own = g[g["action"].isna()].drop_duplicates("id")
        ms = [
            Mention(r.id, r.text, r.doc or "", float(r.confidence) if r.confidence == r.confidence and r.confidence is not None else 0.5, r.alias_group or None, r.alias_role or None, frozenset(r.nearby if r.nearby is not None else ()), frozenset(r.around if r.around is not None else ()))
            for r in own.itertuples()
        ]
        acts = g[g["action"].notna()]
        pick = lambda a: {(r.id, r.other) for r in acts.itertuples() if r.action == a}
        out = resolve_group(ms, kind, pick("never_merge"), pick("force_merge"))
        return pd.DataFrame([{"scope": scope, "entity_type": kind, **e} for e in out], columns=[c.split()[0] for c in RESOLVED_SCHEMA.split(", ")])

    return rows.groupBy("scope", "entity_type").applyInPandas(run, RESOLVED_SCHEMA)


def resolve_exact(mentions: DataFrame) -> DataFrame:
    """Phones, plates and accounts by their normalised keys, in SQL; mentions without a key stay alone."""
    key = F.when(F.col("entity_type") == "PHONE", phone_key(F.col("text"))).when(F.col("entity_type") == "VEHICLE", plate_key(F.col("text"))).when(F.col("entity_type") == "ACCOUNT", account_key(F.col("text")))
    m = mentions.filter(F.col("entity_type").isin("PHONE", "VEHICLE", "ACCOUNT")).withColumn("key", F.coalesce(key, F.concat(F.lit("?"), "id")))
    g = m.groupBy("scope", "entity_type", "key").agg(F.array_sort(F.collect_set("id")).alias("mention_ids"), F.count_distinct("doc").alias("n_documents"))
    return g.select("scope", "entity_type", resolved_id(F.col("mention_ids")).alias("entity_id"), F.col("key").alias("canonical_text"), "mention_ids", "n_documents")


@F.pandas_udf(T.DoubleType())
def _closeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else closeness(x, y) for x, y in zip(a, b)])


def close_pairs(values: DataFrame, text: str, block: str, least: float) -> DataFrame:
    """Pairs of distinct texts of one block with a similarity of at least ``least``; blocks join on their key."""
    v = values.select(F.col(block).alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL").distinct()
    j = v.select("k", F.col("t").alias("a")).join(v.select("k", F.col("t").alias("b")), "k").filter("a < b").select("a", "b").distinct()
    return j.withColumn("score", _closeness("a", "b")).filter(F.col("score") >= least)
