"""Typed mentions from free text by rules, one pass per document.

Engines claim spans in a fixed order (identifiers first, names last); a later engine may not touch what an earlier one
claimed, and of one engine's spans the earliest, then longest stay. Documents are independent, so the operator is a
map over Arrow batches. ``hook`` takes a model's spans after the rules'.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.lexicon import ALIAS_WORDS, NOT_NAMES, ORG_WORDS, PLACE_WORDS, ROLE_WORDS, TITLES
from threadloom.operators.repair import Words, repaired

_PHONE = re.compile(r"(?<![\d\w])(?:\(?\+?91\)?[ -]?|0)?[6-9]\d{2}[ -]?\d{2}[ -]?\d[ -]?\d{4}(?!\d)|(?<![\d\w])(?:\(?\+?91\)?[ -]?|0)?[6-9]\d{3}[ -]?\d{3}[ -]?\d{3}(?!\d)")
_PLATE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[ -]?\d{1,2}[ -]?[A-Z]{1,3}[ -]?\d{4}(?!\d)")
_ACCOUNT = re.compile(r"(?:a/c|account|खाता|खाते)\s*(?:no|number|सं|क्र)?[.:]?\s*(\d{9,18})(?!\d)", re.I)
_PAY = re.compile(r"(?<![\w.@])[a-z0-9._-]{3,}@(?:upi|ybl|okaxis|oksbi|okicici|paytm|ibl)(?![\w.])", re.I)
_CAPS = re.compile(r"(?:[A-ZÀ-Þ][\w'’]*\.?|&|of)(?: (?:[A-ZÀ-Þ][\w'’]*\.?|&|and(?= [A-Z])|\d{1,3}(?!\d)))*")
_WORD = re.compile(r"\S+")
#: Base confidence of the engines; fixed values.
BASE = {"regex": 0.90, "alias": 0.85, "gazetteer": 0.80, "recovered": 0.65, "model": 0.75}


def _clean(w: str) -> str:
    return w.strip(".,;:()'\"“”").lower()


def _trim(text: str, s: int, e: int) -> tuple[int, int]:
    """Leading titles, roles and sentence words, and trailing full stops, off a run of capitals."""
    while True:
        m = _WORD.match(text, s, e)
        if not m or _clean(m[0]) not in NOT_NAMES | TITLES | ROLE_WORDS and not (len(_clean(m[0])) == 1 and m[0] == "A"):
            break
        s = m.end()
        while s < e and text[s] == " ":
            s += 1
    while e > s and text[e - 1] in ". &":
        e -= 1
    return s, e


def extract(text: str, names: frozenset[str] = frozenset()) -> list[dict]:
    """Sorted, non-overlapping mentions: entity_type, s, e, engine, confidence, alias_group, alias_role."""
    claimed: list[tuple[int, int]] = []
    out: list[dict] = []

    def claim(kind: str, s: int, e: int, engine: str, bonus: float = 0.0, **more) -> None:
        if e > s and not any(a < e and s < b for a, b in claimed):
            claimed.append((s, e))
            out.append({"entity_type": kind, "s": s, "e": e, "engine": engine, "confidence": round(min(0.99, max(0.05, BASE[engine] + bonus)), 3), **more})

    for m in _ACCOUNT.finditer(text):
        claim("ACCOUNT", m.start(1), m.end(1), "regex")
    for m in _PAY.finditer(text):
        claim("ACCOUNT", m.start(), m.end(), "regex")
    for m in _PLATE.finditer(text):
        claim("VEHICLE", m.start(), m.end(), "regex")
    for m in _PHONE.finditer(text):
        claim("PHONE", m.start(), m.end(), "regex")
    runs = []
    for m in _CAPS.finditer(text):
        s, e = _trim(text, m.start(), m.end())
        if e - s > 2:
            runs.append((s, e))
    for n, (s, e) in enumerate(runs):
        words = [_clean(w) for w in text[s:e].split()]
        if any(w in ORG_WORDS for w in words) and len(words) > 1:
            claim("ORGANIZATION", s, e, "gazetteer")
        elif any(w in PLACE_WORDS for w in words) or words and words[0] in ("sector", "phase") or re.search(r"(?:at|near|towards|from|in) $", text[max(0, s - 8) : s]) and len(words) <= 3 and not set(words) & names:
            claim("LOCATION", s, e, "gazetteer")
    group = 0
    for s, e in runs:
        words = [_clean(w) for w in text[s:e].split()]
        before = _clean(text[max(0, s - 14) : s].split()[-1]) if text[max(0, s - 14) : s].split() else ""
        known = bool(set(words) & names)
        if len(words) > 4 or any(w in NOT_NAMES for w in words):
            continue
        if known or before in TITLES | ROLE_WORDS or before in ALIAS_WORDS or len(words) >= 2:
            bonus = (0.05 if names and all(w in names for w in words) else 0.0) - (0.05 if len(words) == 1 else 0.0) - (0.10 if not known and before not in TITLES | ROLE_WORDS else 0.0)
            role = None
            if before in ALIAS_WORDS and out and out[-1]["entity_type"] == "PERSON":
                group += 1
                out[-1].update(alias_group=f"g{group}", alias_role="primary")
                role = f"g{group}"
            claim("PERSON", s, e, "alias" if role else "gazetteer" if known else "recovered", bonus, **({"alias_group": role, "alias_role": "alias"} if role else {}))
    return sorted(out, key=lambda x: x["s"])


def earliest_longest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Non-overlapping spans, the earliest and of these the longest first."""
    kept: list[tuple[int, int]] = []
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not kept or s >= kept[-1][1]:
            kept.append((s, e))
    return kept


MENTION_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("mention_id", "doc_id", "entity_type", "text")]
    + [T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("confidence", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("engine", "alias_group", "alias_role")]
)


def extract_mentions(
    docs: DataFrame, id_col: str = "id", text_col: str = "raw_text", names: frozenset[str] = frozenset(), hook: Callable[[str], list[tuple[str, int, int]]] | None = None, words: Words | None = None
) -> DataFrame:
    """One row per mention; ids are hashes of document, type and span, so reruns agree. Null and blank texts have none.

    ``words`` (see ``repair.known_words``) turns on the second pass: names in Devanagari and repairs of the spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                found = extract(text, names)
                if hook:
                    for kind, s, e in hook(text):
                        if not any(m["s"] < e and s < m["e"] for m in found):
                            found.append({"entity_type": kind, "s": s, "e": e, "engine": "model", "confidence": BASE["model"]})
                if words:
                    known = {(m["s"], m["e"]): m for m in found}
                    found = [
                        {**known.get((x.s, x.e), {"confidence": BASE["gazetteer"]}), "entity_type": x.kind, "s": x.s, "e": x.e, "engine": x.engine if not x.fix else "gazetteer"} for x in repaired(text, found, words)
                    ]
                for m in found:
                    mid = sha1(f"{doc}|{m['entity_type']}|{m['s']}|{m['e']}".encode()).hexdigest()[:16]
                    g = m.get("alias_group")
                    rows.append((mid, doc, m["entity_type"], text[m["s"] : m["e"]], m["s"], m["e"], m["confidence"], m["engine"], g and f"{doc}-{g}", m.get("alias_role")))
            cols = list(zip(*rows)) or [[]] * len(MENTION_SCHEMA)
            types = [pa.string()] * 4 + [pa.int32(), pa.int32(), pa.float64()] + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=MENTION_SCHEMA.names)

    return docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, MENTION_SCHEMA)
