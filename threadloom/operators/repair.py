"""Second pass over mentions: names in Devanagari, and repairs of spans that a recogniser cut or typed wrongly.

A text's words are turned into one string of labels, a letter for each (given name, family name, place, suffix of a place,
hub of transit, anything else), and what makes a name or a place is a pattern over that string. Repairs are small
functions from the list of spans to a list of spans, applied in the order of ``REPAIRS``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of places, general ones of the languages; users extend them.
PLACE_SUFFIXES = frozenset("nagar vihar road marg chowk mandi ghat tiraha crossing khurd kalan jadid adda post colony market station gate bazar puri bagh ganj नगर विहार रोड मार्ग चौक मंडी घाट तिराहा खुर्द कलां जदीद अड्डा कॉलोनी बाज़ार बाजार स्टेशन गेट पुर गंज".split())
HUBS = ("bus stand", "bus stop", "bus adda", "railway station", "metro station", "isbt", "junction", "airport")
NUMBERED = re.compile(r"(?i)(?:sector|phase|block)[ -]?\d{1,3}[a-z]?")
CONNECTORS = frozenset("at near in from with and to by of on".split())
PLACE_BEFORE = re.compile(r"(?i)\b(?:at|near|towards|outside|reached|village|vill\.?|town|city|distt\.?|district)\s+$")
PERSON_BEFORE = re.compile(r"(?i)\b(?:mr|mrs|ms|dr|shri|smt|sh|km|accused|complainant|witness|victim|name|s/o|d/o|w/o)\.?\s+$")
_DEVANAGARI = re.compile(r"[ऀ-ॿ]+")
_TOKEN = re.compile(r"[^\W\d_][\w'’.-]*")


@dataclass(frozen=True)
class Span:
    kind: str
    s: int
    e: int
    engine: str = "model"
    fix: tuple[str, ...] = ()

    def fixed(self, how: str, **change) -> Span:
        return replace(self, fix=(*self.fix, how), **change)


@dataclass(frozen=True)
class Words:
    """What words can be: parts of names and whole places, lower case."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    places: frozenset[str] = frozenset()
    suffixes: frozenset[str] = PLACE_SUFFIXES
    hubs: tuple[str, ...] = HUBS
    names: frozenset[str] = field(init=False, default=frozenset())

    def __post_init__(self):
        object.__setattr__(self, "names", self.given | self.family)

    def label(self, word: str) -> str:
        w = word.lower().strip(".")
        return "g" if w in self.given else "f" if w in self.family else "p" if w in self.places else "s" if w in self.suffixes else "."

    def is_name(self, words: list[str]) -> bool:
        """A run of name parts: all of them close to a known part, one of them known as it is."""
        low = [w.lower().strip(".") for w in words]
        return bool(low) and all(w in self.names or _close(w, self.names) for w in low) and any(w in self.names for w in low)


def _close(word: str, known: frozenset[str]) -> bool:
    """Whether one letter left out, put in, changed or swapped gives a known word of five letters at least."""
    if len(word) < 5:
        return False
    cuts = {word[:i] + word[i + 1 :] for i in range(len(word))}
    swaps = {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    return bool((cuts | swaps) & known) or any(len(k) >= 5 and abs(len(k) - len(word)) <= 1 and any(k[:i] + k[i + 1 :] in cuts | {word} for i in range(len(k))) for k in known if k[:1] == word[:1] or k[1:2] == word[1:2])


#: A place before names before others; at most three parts make a name, one of them a given name.
_PATTERNS = (("LOCATION", re.compile(r"p-?s?|\.-s")), ("PERSON", re.compile(r"(?=[f-]*g)[gf](?:-[gf]){0,2}")))


def devanagari_spans(text: str, words: Words, taken: list[tuple[int, int]] = ()) -> list[Span]:
    """Persons and places written in Devanagari, by patterns over the labels of words; ``-`` joins words with one blank."""
    found = [(m.start(), m.end()) for m in _DEVANAGARI.finditer(text)]
    signs, at = [], []
    for k, (s, e) in enumerate(found):
        if k:
            signs.append("-" if text[found[k - 1][1] : s] == " " else "/")
            at.append(None)
        free = not any(a < e and s < b for a, b in taken)
        signs.append(words.label(text[s:e]) if free else "x")
        at.append((s, e))
    line, out = "".join(signs), []
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(line):
            a, b = m.start(), m.end() - (line[m.end() - 1] == "-")
            s, e = at[a][0], at[b - 1][1]
            if not any(x.s < e and s < x.e for x in out):
                out.append(Span(kind, s, e, "devanagari"))
    return sorted(out, key=lambda x: x.s)


def split_connectors(spans: list[Span], text: str, words: Words) -> list[Span]:
    """A name has no connector in it: the parts on both sides are mentions of their own."""
    out = []
    for x in spans:
        if x.kind not in ("PERSON", "LOCATION", "ORGANIZATION"):
            out.append(x)
            continue
        parts, start = [], None
        for m in re.finditer(r"\S+", text[x.s : x.e]):
            if m[0] in CONNECTORS:
                parts, start = [*parts, (start, end)] if start is not None else parts, None  # noqa: F821
            else:
                start, end = m.start() if start is None else start, m.end()
        if start is not None:
            parts.append((start, end))
        out += [x] if len(parts) == 1 and parts[0] == (0, x.e - x.s) else [x.fixed("split at connector", s=x.s + a, e=x.s + b) for a, b in parts]
    return out


def retype(spans: list[Span], text: str, words: Words) -> list[Span]:
    """Types by what is known of the words, then of the words before; the first rule that holds decides."""
    out = []
    for x in spans:
        if x.kind not in ("PERSON", "LOCATION", "ORGANIZATION") or x.engine in ("devanagari", "alias"):
            out.append(x)
            continue
        toks = [m[0].lower().strip(".") for m in _TOKEN.finditer(text[x.s : x.e])]
        phrase, before = " ".join(toks), text[max(0, x.s - 40) : x.s]
        rules = (
            ("hub of transit", "LOCATION", phrase in words.hubs),
            ("known place", "LOCATION", phrase in words.places),
            ("suffix of a place", "LOCATION", len(toks) > 1 and toks[-1] in words.suffixes and not all(t in words.names for t in toks[:-1])),
            ("word before a place", "LOCATION", bool(PLACE_BEFORE.search(before)) and not all(t in words.given for t in toks) and not words.is_name(toks)),
            ("known name", "PERSON", words.is_name(toks)),
            ("word before a person", "PERSON", x.kind == "LOCATION" and len(toks) <= 3 and bool(PERSON_BEFORE.search(before))),
        )
        kind, why = next(((k, w) for w, k, holds in rules if holds), (x.kind, ""))
        out.append(x if kind == x.kind else x.fixed(why, kind=kind))
    return out


def grow_names(spans: list[Span], text: str, words: Words) -> list[Span]:
    """Parts of names grow over known or nearly known parts beside them, two on each side, never into another mention."""
    out = list(spans)
    for k, x in enumerate(out):
        if x.kind != "PERSON" or x.engine in ("devanagari", "alias"):
            continue
        others = [(y.s, y.e) for y in out if y is not x]
        s, e = x.s, x.e
        for side in ("left", "right"):
            for _ in range(2):
                m = re.search(r"([A-ZÀ-Þ][\w'’]+\.?) $", text[max(0, s - 40) : s]) if side == "left" else re.match(r" ([A-ZÀ-Þ][\w'’]+)", text[e : e + 40])
                w = m[1].lower().strip(".") if m else ""
                a, b = (s - len(m[0]), s) if m and side == "left" else (e, e + len(m[0])) if m else (0, 0)
                if not m or not (w in words.names or _close(w, words.names)) or any(p < b and a < q for p, q in others):
                    break
                s, e = min(s, a), max(e, b)
        if (s, e) != (x.s, x.e):
            out[k] = x.fixed("grown", s=s, e=e)
    return out


def merge_places(spans: list[Span], text: str, words: Words) -> list[Span]:
    """A hub belongs to the place before it, and a numbered sector to the town behind it."""
    hub = re.compile(r" (?:" + "|".join(words.hubs) + r")\b", re.I)
    out: list[Span] = []
    for x in sorted(spans, key=lambda y: (y.s, -y.e)):
        last = out[-1] if out else None
        if last and last.kind == x.kind == "LOCATION":
            gap, low = text[last.e : x.s], text[x.s : x.e].lower()
            why = "hub" if gap == " " and low in words.hubs else "sector" if gap in (" ", ", ", ",") and NUMBERED.fullmatch(text[last.s : last.e]) and low in words.places else ""
            if why:
                out[-1] = last.fixed("merged " + why, e=x.e)
                continue
        out.append(x)
    for k, x in enumerate(out):  # over a hub that nobody claimed
        m = hub.match(text, x.e) if x.kind == "LOCATION" else None
        if m and not any(y is not x and y.s < m.end() and x.e < y.e for y in out):
            out[k] = x.fixed("merged hub", e=m.end())
    return out


REPAIRS: tuple[Callable[[list[Span], str, Words], list[Span]], ...] = (split_connectors, retype, grow_names, merge_places)


def repaired(text: str, found: list[dict], words: Words) -> list[Span]:
    """Mentions of a text after all repairs, with those in Devanagari, sorted and without overlaps."""
    spans = [Span(m["entity_type"], m["s"], m["e"], m["engine"]) for m in found]
    spans += devanagari_spans(text, words, [(x.s, x.e) for x in spans])
    for step in REPAIRS:
        spans = step(spans, text, words)
    out: list[Span] = []
    for x in sorted(spans, key=lambda y: (y.s, -y.e)):
        if x.e > x.s and (not out or x.s >= out[-1].e):
            out.append(x)
    return out


#: A word is known if at least this share of the mentions of its kind has it: a bounded list at every size.
LEAST_SHARE = 1e-3


def known_words(mentions: DataFrame, least: float = LEAST_SHARE) -> Words:
    """Words of the mentions (entity_type, text): given names stand alone or first, family names last; places as a whole."""
    m = mentions.filter("text IS NOT NULL AND entity_type IN ('PERSON', 'LOCATION')").select("entity_type", F.lower(F.trim("text")).alias("t"))
    n = {r[0]: r[1] for r in m.groupBy("entity_type").count().collect()}
    w = m.filter("entity_type = 'PERSON'").withColumn("w", F.split("t", "[ .]+")).select(F.size("w").alias("n"), F.posexplode("w").alias("k", "word")).filter("length(word) > 2 AND n <= 4 AND NOT contains(word, ',')")
    c = w.groupBy("word").agg(F.count_if((F.col("k") == 0)).alias("first"), F.count_if((F.col("k") > 0) & (F.col("k") == F.col("n") - 1)).alias("last"))
    c = c.filter(F.col("first") + F.col("last") >= max(1.0, least * n.get("PERSON", 0))).collect()
    p = m.filter("entity_type = 'LOCATION'").groupBy("t").count().filter(F.col("count") >= max(1.0, least * n.get("LOCATION", 0))).collect()
    return Words(frozenset(r[0] for r in c if r[1] >= r[2]), frozenset(r[0] for r in c if r[1] < r[2]), frozenset(r[0] for r in p))
