"""One consistent form for text that looks the same but is made of other characters.

Each token's characters are resolved to the sets of scripts they can be written in, look-alikes counted with every
script that has a letter of that shape; the intersection over the token gives the scripts it can consistently be spelled
in. A token that mixes scripts is respelled in the script of its intersection, whichever that is. A token that several
scripts can spell, as one wholly made of look-alikes, gets the script that the other tokens of its text are bound to, or
else Latin. What is left (full-width and styled forms, ligatures, kinds of blank, signs without a shape, combining
accents, letter forms of one script with the same shape) is normalised by rule.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.chars import BLANKS, BREAKS, FULL_WIDTH, HALF_OF, INVISIBLE, LATIN_OF, LOOKALIKE, MORE_LOOKALIKES

def _script(ch: str) -> str:
    """Script of a letter by its place in the code charts or its name."""
    c = ord(ch)
    if 0x41 <= c < 0x250 and ch.isalpha() or 0x250 <= c < 0x2B0 or 0x1D00 <= c < 0x1D26 or 0x1E00 <= c < 0x1F00:
        return "latin"
    if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
        return "greek"
    if 0x400 <= c < 0x530:
        return "cyrillic"
    return unicodedata.name(ch, "other").split()[0].lower() if ch.isalpha() else ""


#: Latin letter of the same shape, of each look-alike; and by script, the letter of a shape.
_TO_LATIN: dict[str, str] = {}
_OF_SHAPE: dict[str, dict[str, str]] = {}
for _signs, _latin in ((LOOKALIKE, LATIN_OF), *MORE_LOOKALIKES.values()):
    for _a, _b in zip(_signs, _latin):
        _TO_LATIN.setdefault(_a, _b)
        _OF_SHAPE.setdefault(_script(_a), {}).setdefault(_b, _a)
#: A look-alike, or a letter of a script that has some: elsewhere no token needs another spelling.
_SUSPECT = re.compile("[" + "".join(_TO_LATIN) + "\u0370-\u058f\u13a0-\u13ff\ua4d0-\ua4ff]")
#: Styled letters and digits of mathematics, and ligatures, by their plain form.
_STYLED = {c: unicodedata.normalize("NFKC", chr(c)) for c in (*range(0x1D400, 0x1D800), *range(0x2100, 0x2150), *range(0xFB00, 0xFB07)) if unicodedata.decomposition(chr(c)).startswith(("<font>", "<compat> 0066", "<compat> 0073", "<compat> 017F"))}
_TOKEN = re.compile(r"\w+")
#: Letters of one script with the same shape in running text, as fixed pairs.
_SAME_SHAPE = {"ي": "ی", "ى": "ی", "ك": "ک", "ه": "ہ", "‐": "-", "‑": "-", "﹣": "-"}
#: Sequences that are drawn like one letter, as fixed pairs.
_SEQUENCES = [("अा", "आ"), ("अाे", "ओ"), ("आे", "ओ"), ("आै", "औ"), ("एे", "ऐ"), ("ाे", "ो"), ("ाै", "ौ"), ("অা", "আ"), ("ো", "ো")]
_SARA_AM = re.compile("ํ([่-๋]?)า")
_CHARS = {ord(a): b for a, b in zip(FULL_WIDTH, HALF_OF)} | dict.fromkeys(map(ord, BLANKS), " ") | {ord(a): b for a, b in _SAME_SHAPE.items()} | dict.fromkeys(map(ord, INVISIBLE)) | _STYLED
# Joiners shape the letters around a virama and between Arabic letters; elsewhere they have no shape.
_IDLE_JOINER = re.compile(r"(?<![्্੍્୍்్್്؀-ۿ])[‌‍](?![्্੍્୍்్್്])|(?<=[؀-ۿ])[‌‍](?![؀-ۿ])|‍(?=[؀-ۿ])")
_KEPT = 100_000
_cache: dict[str, frozenset[str] | None] = {}


def scripts(ch: str) -> frozenset[str]:
    """Scripts in which a character can be read; the empty set stands for any (digits, marks, signs)."""
    own = _script(ch)
    shape = _TO_LATIN.get(ch, ch)
    out = {own} if own else set()
    if ch in _TO_LATIN or own == "latin":
        out |= {s for s, letters in _OF_SHAPE.items() if shape in letters}
    if ch in _TO_LATIN:
        out.add("latin")
    return frozenset(out)


def possible_scripts(token: str) -> frozenset[str] | None:
    """Scripts that can spell the whole token; None if any can (no letters). Empty if none can."""
    hit = _cache.get(token, _MISSING)
    if hit is not _MISSING:
        return hit
    common: frozenset[str] | None = None
    for ch in token:
        if s := scripts(ch):
            common = s if common is None else common & s
    if common == frozenset() and _mostly_latin(token):
        common = frozenset(["latin"])
    if len(_cache) >= _KEPT:
        _cache.clear()
    _cache[token] = common
    return common


_MISSING = object()


def in_script(token: str, script: str) -> str:
    """The token with each look-alike as the letter of ``script``, where that has one of its shape."""
    letters = _OF_SHAPE.get(script, {})
    return "".join(_TO_LATIN.get(ch, ch) if script == "latin" else letters.get(_TO_LATIN.get(ch, ch), ch) if ch in _TO_LATIN or _script(ch) == "latin" else ch for ch in token)


def _mostly_latin(token: str) -> bool:
    """Whether the letters that cannot be Latin are of scripts without look-alikes, as where scripts meet without a blank."""
    return not any(s and "latin" not in s and s & _OF_SHAPE.keys() for s in map(scripts, token))


def respelled(text: str) -> str:
    """Text whose tokens are each in one script: that of their intersection, or the one that the text's other tokens need."""
    bound: Counter = Counter()
    open_tokens = False
    for m in _TOKEN.finditer(text):
        can = possible_scripts(m[0])
        if can and len(can) == 1:
            (script,) = can
            bound[script] += 1
        elif can:
            open_tokens = True
    # Scripts that could spell an open token, the most frequent first; Latin where none is bound or numbers are equal.
    order = sorted(bound, key=lambda s: (-bound[s], s != "latin", s)) if open_tokens else []

    def one(m: re.Match) -> str:
        can = possible_scripts(m[0])
        if not can:
            return m[0]
        if len(can) == 1:
            (script,) = can
            return in_script(m[0], script) if script == "latin" or script in _OF_SHAPE else m[0]
        return in_script(m[0], next((s for s in order if s in can), "latin" if "latin" in can else min(can)))

    return _TOKEN.sub(one, text)


def consistent_form(text: str) -> str:
    """The one form of all texts that look like this one. Letter case, spelling, accents and spacing are kept."""
    if text.isascii():
        return text.replace("\t", " ").replace("\r\n", "\n")
    t = unicodedata.normalize("NFC", text.translate(_CHARS))
    if "‍" in t or "‌" in t:
        t = unicodedata.normalize("NFC", _IDLE_JOINER.sub("", t))
    if _SUSPECT.search(t):
        t = respelled(t)
    if "ํ" in t:
        t = _SARA_AM.sub(r"\1ำ", t)
    for a, b in _SEQUENCES:
        if a in t:
            t = t.replace(a, b)
    return t.replace("\r\n", "\n")


@F.pandas_udf(T.StringType())
def consistent_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else consistent_form(t))


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("look", "look2", "raw", "raw2")]))
def look_and_raw(texts: pd.Series) -> pd.DataFrame:
    """Digests of the consistent form and of the code points, 128 bits each as two numbers, which hash aggregation can hold."""
    digests = bytearray()
    for t in texts:
        form = consistent_form(t)
        raw = blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        digests += raw if form == t else blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        digests += raw
    return pd.DataFrame(np.frombuffer(bytes(digests), np.int64).reshape(-1, 4), columns=["look", "look2", "raw", "raw2"])


def normalized(rows: DataFrame, text: str, out: str = "consistent_text") -> DataFrame:
    """Rows with the consistent form of ``text`` in column ``out``; null stays null."""
    return rows.withColumn(out, consistent_text(F.col(text)))


def same_look_pairs(rows: DataFrame, scope: str = "scope", key: str = "id", text: str = "text") -> DataFrame:
    """(scope, id_a, id_b) of rows of one scope whose texts look the same but differ in code points, id_a < id_b.

    Null and blank texts and null scopes give no pairs; a row delivered twice counts once. Only looks with more than
    one spelling are joined, so copies of one text never meet; the result holds nothing but true pairs.
    """
    src = rows.select(F.col(scope).alias("scope"), F.col(key).alias("id"), F.col(text).alias("text")).filter(
        F.col("scope").isNotNull() & F.col("id").isNotNull() & not_blank(F.col("text"))
    )
    k = _looks(src)
    several = _several(k)
    hot = k.join(several, ["scope", "look", "look2"], "left_semi")
    hot = hot.select("scope", "look", "look2", "id", "raw", "raw2")
    a, b = hot.toDF("scope", "look", "look2", "id_a", "raw_a", "raw2_a"), hot.toDF("scope", "look", "look2", "id_b", "raw_b", "raw2_b")
    return a.join(b, ["scope", "look", "look2"]).filter("id_a < id_b AND (raw_a <> raw_b OR raw2_a <> raw2_b)").select("scope", "id_a", "id_b")


def _looks(src: DataFrame) -> DataFrame:
    """(scope, id, look, look2, raw, raw2), one row per scope and id."""
    k = src.select("scope", "id", look_and_raw("text").alias("k")).groupBy("scope", "id").agg(F.min("k").alias("k"))
    return k.select("scope", "id", "k.look", "k.look2", "k.raw", "k.raw2")


def _several(k: DataFrame) -> DataFrame:
    """Looks of a scope with more than one spelling."""
    spread = F.min("raw") != F.max("raw"), F.min("raw2") != F.max("raw2")
    return k.groupBy("scope", "look", "look2").agg((spread[0] | spread[1]).alias("several")).filter("several").drop("several")


def look_classes(rows: DataFrame, scope: str = "scope", key: str = "id", text: str = "text") -> DataFrame:
    """(scope, id, class_id, n_rows, n_spellings) of every row whose look has several spellings in its scope.

    ``class_id`` is the least id of the look. One row per row, however large a class is: copies are not paired.
    """
    src = rows.select(F.col(scope).alias("scope"), F.col(key).alias("id"), F.col(text).alias("text")).filter(
        F.col("scope").isNotNull() & F.col("id").isNotNull() & not_blank(F.col("text"))
    )
    k = _looks(src)
    per = k.groupBy("scope", "look", "look2", "raw", "raw2").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = per.groupBy("scope", "look", "look2").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings")).filter("n_spellings > 1")
    return k.join(classes, ["scope", "look", "look2"]).select("scope", "id", "class_id", "n_rows", "n_spellings")


def not_blank(c: Column) -> Column:
    """Whether a text has anything but blanks of any kind."""
    return F.length(F.translate(c, BLANKS + BREAKS + " \n\r", "")) > 0
