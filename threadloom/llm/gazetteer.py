"""Gazetteer of name parts learnt from the mentions of a corpus.

Tokens of all mentions are counted by the kind of mention they stand in, in one aggregation. Kept are tokens that at
least one in ``1 / LEAST_SHARE`` mentions of a kind has, so the table has a proven bound whatever the size of the corpus,
and slips of the pen, which are rare, stay out. Nothing here lists a name: what a part is (given, family, nickname, part
of an organisation or of a place) follows from the counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.chars import PLAIN_FROM, PLAIN_TO, ZERO_WIDTH

#: A token is kept if at least this share of the mentions of a kind has it: at most 1 / LEAST_SHARE tokens a word of a mention.
LEAST_SHARE = 1e-4
#: Share of the name parts of its script from which a token is a settled spelling, to which slips are compared.
SETTLED = 4e-3
#: Words of a mention that count; longer mentions are no names.
WORDS = 8


def script_of(token: str) -> str:
    c = ord(token[0])
    return "devanagari" if 0x900 <= c < 0x980 else "bengali" if 0x980 <= c < 0xA00 else "arabic" if 0x600 <= c < 0x700 else "latin" if c < 0x250 else "other"


def deletes(w: str) -> set[str]:
    """The word and all spellings with one letter less."""
    return {w[:i] + w[i + 1 :] for i in range(len(w))} | {w}


def squeezed(w: str) -> str:
    return re.sub(r"(.)\1+", r"\1", w)


def short_vowels(w: str) -> str:
    """Long vowels as they are written short; other scripts stay."""
    for a, b in (("aa", "a"), ("ee", "i"), ("oo", "u"), ("ou", "o")):
        w = w.replace(a, b)
    return w


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; ``most`` + 1 where it is larger than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            x = min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                x = min(x, before[j - 2] + 1)
            new.append(x)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def token_counts(mentions: DataFrame) -> DataFrame:
    """(token, first, last, alone, alias, org, place) over ``mentions``: kind, text, role.

    Mentions are counted by their text first, so a text is cut into tokens once; both aggregations are partial first.
    """
    texts = mentions.filter("text IS NOT NULL").groupBy("kind", "text", F.coalesce(F.col("role") == "alias", F.lit(False)).alias("is_alias")).agg(F.count("*").alias("rows"))
    t = F.lower(F.translate(F.translate("text", ZERO_WIDTH, ""), PLAIN_FROM, PLAIN_TO))
    words = F.filter(F.split(F.trim(F.regexp_replace(t, r"[^\p{L}\p{M}\-]+", " ")), " "), lambda w: F.length(w) > 1)
    m = texts.select("kind", "is_alias", "rows", words.alias("w"), t.contains(", ").alias("turned"))
    m = m.filter(F.size("w").between(1, WORDS)).select("kind", "is_alias", "rows", "turned", F.size("w").alias("n"), F.posexplode("w").alias("at", "token"))
    person = (F.col("kind") == "PERSON") & ~F.col("is_alias")
    head = (F.col("at") == 0) != F.col("turned")
    one = lambda c: F.sum(F.when(c, F.col("rows")).otherwise(0))
    return m.groupBy("token").agg(
        one(person & (F.col("n") > 1) & head).alias("first"), one(person & (F.col("n") > 1) & ~head).alias("last"), one(person & (F.col("n") == 1)).alias("alone"),
        one((F.col("kind") == "PERSON") & ~person).alias("alias"), one(F.col("kind") == "ORGANIZATION").alias("org"), one(F.col("kind") == "LOCATION").alias("place"),
    )


class Gazetteer:
    """What a token is: G given, S family, N nickname, O of organisations, L of places, or empty."""

    def __init__(self, counts: dict[str, tuple[int, int, int, int, int, int]] | None = None):
        self.kinds: dict[str, str] = {}
        self.person: dict[str, int] = {}
        total: dict[str, int] = defaultdict(int)
        merged: dict[str, list[int]] = {}
        for token, c in (counts or {}).items():
            k = unicodedata.normalize("NFC", token).strip("-")
            if len(k) > 1:
                merged[k] = [a + b for a, b in zip(merged.get(k, [0] * 6), c)]
        for token, (first, last, alone, alias, org, place) in merged.items():
            person = first + last + alone
            if alias > person and alias > org + place:
                self.kinds[token] = "N"
            elif 4 * person < org + place:
                self.kinds[token] = "O" if org >= place else "L"
            elif person:
                self.kinds[token] = "G" if first + alone >= last else "S"
                self.person[token] = person
                total[script_of(token)] += person
        self.settled = {t for t, n in self.person.items() if n >= SETTLED * total[script_of(t)]}
        self._near: dict[str, list[str]] | None = None
        self._seen: dict[str, str] = {}
        self.parts: dict[str, str] = {}  # kinds of words as they stand in texts, filled by its users

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_") and k != "parts"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._near, self._seen, self.parts = None, {}, {}

    def all_near(self, token: str) -> set[str]:
        """All settled given names one slip away; with several of them a form is a slip of either."""
        self.near(token)
        return {w for d in deletes(token) for form, w in self._near.get(d, ()) if self.kinds[w] == "G" and edits(token, form, 1) <= 1}

    def near(self, token: str) -> str | None:
        """The settled spelling one slip away from a token, long vowels aside; the more frequent, then the first."""
        if self._near is None:  # built once in each worker
            self._near = defaultdict(list)
            for w in sorted(self.settled, key=lambda x: (-self.person[x], x)):
                for form in {w, short_vowels(w)}:
                    for d in deletes(form):
                        self._near[d].append((form, w))
        script = script_of(token)
        if len(token) < 4:
            return None
        for x in (token, short_vowels(token)):
            for d in sorted(deletes(x), key=lambda y: (-len(y), y)):
                for form, w in self._near.get(d, ()):
                    if len(w) >= 5 and script_of(w) == script and edits(x, form, 1) <= 1:
                        return w
        if script == "latin":
            for _, w in self._near.get(squeezed(token), ()):
                if len(w) >= 4:
                    return w
        return None

    def kind(self, token: str) -> str:
        """Of a lower-case token without invisible signs."""
        hit = self._seen.get(token)
        if hit is None:
            if len(self._seen) > 200_000:
                self._seen.clear()
            k = self.kinds.get(token)
            if k is None:
                w = self.near(token)
                k = self.kinds[w] if w else ""
            hit = self._seen[token] = k
        return hit


def learn(mentions: DataFrame, least_share: float = LEAST_SHARE) -> Gazetteer:
    """The gazetteer of ``mentions`` (kind, text, role); the tokens that reach the driver are bounded by ``least_share``."""
    kinds = {r[0]: r[1] for r in mentions.filter(F.col("kind").isin("PERSON", "ORGANIZATION", "LOCATION")).groupBy("kind").count().collect()}
    if not kinds:
        return Gazetteer()
    need = {k: max(1.0, least_share * n) for k, n in kinds.items()}
    never = float("inf")
    c = token_counts(mentions.filter(F.col("kind").isin("PERSON", "ORGANIZATION", "LOCATION")))
    person = F.col("first") + F.col("last") + F.col("alone") + F.col("alias")
    kept = c.filter((person >= need.get("PERSON", never)) | (F.col("org") >= need.get("ORGANIZATION", never)) | (F.col("place") >= need.get("LOCATION", never)))
    return Gazetteer({r[0]: tuple(r[1:]) for r in kept.collect()})


#: Share of the scopes of a form in which another one has the same family name, from which the form stands for it.
TOGETHER, LEAST_SCOPES = 0.5, 3


def learn_variants(mentions: DataFrame, gazetteer: Gazetteer) -> dict[str, str]:
    """Short forms and other spellings of given names: form to settled name, learnt from who appears together.

    In the scopes where a form stands with a family name, the name it is short for stands with that family name too, far
    more often than any relative's. ``mentions``: scope, kind, text, role. Only tokens of the gazetteer are counted, so
    the pairs of a scope are bounded by it, and only forms with at least ``LEAST_SCOPES`` scopes are judged.
    """
    spark = mentions.sparkSession
    known = [(w, k) for w, k in gazetteer.kinds.items() if k in "GS" and script_of(w) == "latin"]
    if not known:
        return {}
    # Names of two plain words; those with odd signs only take no part in the counts.
    two = mentions.filter("kind = 'PERSON' AND scope IS NOT NULL AND text IS NOT NULL").select("scope", F.split(F.lower("text"), ",? ").alias("w")).filter(F.size("w") == 2)
    kinds = F.broadcast(spark.createDataFrame(known, "token string, k string"))
    two = two.select("scope", F.col("w")[0].alias("x"), F.col("w")[1].alias("y"))
    pairs = two.join(kinds.toDF("x", "kx"), "x").join(kinds.toDF("y", "ky"), "y").filter("kx <> ky")
    given = F.when(F.col("kx") == "G", F.col("x")).otherwise(F.col("y"))
    family = F.when(F.col("kx") == "G", F.col("y")).otherwise(F.col("x"))
    seen = pairs.select("scope", given.alias("g"), family.alias("f")).distinct()
    a, b = seen.toDF("scope", "form", "f"), seen.toDF("scope", "name", "f")
    unsettled = F.broadcast(spark.createDataFrame([(w,) for w, k in known if k == "G" and w not in gazetteer.settled] or [("",)], "form string"))
    a = a.join(unsettled, "form", "left_semi")
    both = a.join(b, ["scope", "f"]).filter("form <> name").groupBy("form", "name").agg(F.count("*").alias("n"))
    total = a.groupBy("form").agg(F.count("*").alias("total")).filter(F.col("total") >= LEAST_SCOPES)
    rows = both.join(total, "form").filter(F.col("n") >= TOGETHER * F.col("total")).collect()
    best: dict[str, tuple] = {}
    for form, name, n, _ in rows:
        if name in gazetteer.settled and name[:1] == form[:1] and len(gazetteer.all_near(form)) < 2:
            best[form] = max(best.get(form, (0, "")), (n, name))
    return {form: name for form, (_, name) in best.items()}


def entity_rows(entities: DataFrame) -> DataFrame:
    """(scope, kind, text, role) of the entities table."""
    role = F.when(F.contains("metadata_json", F.lit("alias_role")), F.get_json_object("metadata_json", "$.alias_role"))
    return entities.select(F.col("intake_id").alias("scope"), F.col("entity_type").alias("kind"), F.col("raw_text").alias("text"), role.alias("role"))
