"""Languages of documents and of the one-language stretches in them.

First the family of a sentence unit is read off its scripts; then, where a family has several languages, one-versus-one
linear support vector machines over hashed character n-grams of words vote. A linear score is a sum over words, so the
scores of a word are kept and each word is scored once per worker.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, groupby
from math import exp
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.chars import ZERO_WIDTH
from threadloom.llm.chars import plain as tidy
from threadloom.llm.sentences import unit_offsets

N_FEATURES = 1 << 15
#: Bound of the labelled sample that the classifier is fitted on.
MAX_SAMPLES = 5000
#: Times that the whole word counts as a feature beside its n-grams.
WHOLE = 3
_KEPT_WORDS, _KEPT_UNITS = 200_000, 50_000

_ADDRESS = re.compile(r"\S+@\S+|\S+ ?[\[(](?:at|AT)[\])] ?\S+(?: ?\[(?:dot|DOT)\] ?\w+)*|https?://\S+|www\.\S+")
_WORD = re.compile(r"[^\W\d_]+(?:['’़-्ऀ-ः॑-ॗঁ-ঃ়-্ัิ-ฺ็-๎ً-ٰٕ]+[^\W\d_]*)*")
_ASCII_WORD = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)*")
_ZERO = re.compile(f"[{ZERO_WIDTH}]")


@lru_cache(100_000)
def family_of(ch: str) -> str | None:
    """Family that a letter's script belongs to: its place in the code charts, else the script in its name."""
    c = ord(ch)
    if c < 0x250:
        return "latin"
    if 0x900 <= c < 0x980:
        return "devanagari"
    if 0x980 <= c < 0xA00:
        return "bengali"
    if 0x600 <= c < 0x780 or 0xFB50 <= c < 0xFE00 or 0xFE70 <= c < 0xFF00:
        return "arabic"
    if 0xE00 <= c < 0xE80:
        return "thai"
    if 0x3400 <= c < 0xA000 or 0x20000 <= c < 0x32000 or 0x3040 <= c < 0x3100:
        return "han"
    return unicodedata.name(ch, "other").split()[0].lower() if ch.isalpha() else None


def families_of(samples: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Family to its languages, sorted: a language is of the family that most letters of its samples have."""
    letters: dict[str, Counter] = {}
    for lang, text in samples:
        letters.setdefault(lang, Counter()).update(f for ch in text or "" if ch.isalpha() and (f := family_of(ch)))
    out: dict[str, list[str]] = {}
    for lang in sorted(letters):
        if letters[lang]:
            out.setdefault(max(sorted(letters[lang]), key=letters[lang].get), []).append(lang)
    return out


def words_of(text: str) -> list[str]:
    """Words of a tidied unit, without net addresses, numbers and invisible signs."""
    ascii_only = text.isascii()
    t = text if ascii_only else _ZERO.sub("", text)
    if "@" in t or "[" in t or "(" in t or "://" in t:
        t = _ADDRESS.sub(" ", t)
    return _ASCII_WORD.findall(t) if ascii_only else _WORD.findall(t)


def scored_words(words: list[str]) -> list[str]:
    """Words that speak for a language: without capitalised ones (mostly names), unless there are no others."""
    return [w for w in words if not w[0].isupper()] or words


def features(word: str) -> list[int]:
    """Hashed n-grams (1 to 4) and the whole of a word with its ends marked."""
    w = f"<{word.lower()}>"
    grams = [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)] + [c for c in w if c > "\x7f"] + [w + w] * WHOLE
    return [crc32(g.encode()) % N_FEATURES for g in grams]


def _fit_pair(x: np.ndarray, y: np.ndarray, rounds: int = 40, cost: float = 1.0) -> np.ndarray:
    """Linear L1-loss support vector machine by dual coordinate descent; y is +1 or -1."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    q = (x * x).sum(1) + 1e-9
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1
            a = min(max(alpha[i] - g / q[i], 0.0), cost)
            if a != alpha[i]:
                w += (a - alpha[i]) * y[i] * x[i]
                alpha[i] = a
    return w


class LanguageModel:
    """Family by script, then one-versus-one machines. ``pairs``: (first, second) to weights, positive for the first."""

    def __init__(self, pairs: dict[tuple[str, str], np.ndarray], families: dict[str, list[str]]):
        self.pairs, self.families = {k: v.astype(np.float32) for k, v in pairs.items()}, families
        self._cache: dict[str, tuple] = {}
        self._units: dict[str, tuple] = {}  # of short units, many of which come again
        self._stack = {f: np.stack([self.pairs[p] for p in combinations(ls, 2)]) for f, ls in families.items() if len(ls) > 1}

    def __getstate__(self):
        return {"pairs": self.pairs, "families": self.families}

    def __setstate__(self, state):
        self.__init__(**state)

    @classmethod
    def fit(cls, samples: list[tuple[str, str]]) -> LanguageModel:
        """From (language, text) rows; families and their languages are those of the rows."""
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in samples:
            v = np.zeros(N_FEATURES)
            for w in scored_words(words_of(tidy(text or ""))):
                for i in features(w):
                    v[i] += 1
            if n := np.linalg.norm(v):
                by.setdefault(lang, []).append(v / n)
        pairs = {}
        families = families_of(samples)
        for ls in families.values():
            for a, b in combinations(ls, 2):
                xa, xb = by.get(a, []), by.get(b, [])
                if xa and xb:
                    x, y = np.stack(xa + xb), np.array([1.0] * len(xa) + [-1.0] * len(xb))
                    # Only used columns take part, the rest keeps weight zero.
                    used = np.flatnonzero(x.any(0))
                    w = np.zeros(N_FEATURES)
                    w[used] = _fit_pair(x[:, used], y)
                    pairs[a, b] = w
                else:
                    pairs[a, b] = np.zeros(N_FEATURES)
        return cls(pairs, families)

    def word(self, w: str) -> tuple:
        """(family, weight of the word in the choice of the family, scores of the family's pairs)."""
        fam = family_of(w[0])
        if fam not in self.families:  # a script that no labelled language has
            return None, 1.0, None
        weight = 0.5 * len(w) if fam == "han" else len(w) / 4 if fam == "thai" else 0.25 if fam == "latin" and w[0].isupper() else 1.0
        score = self._stack[fam][:, features(w)].sum(1).tolist() if fam in self._stack else None
        if score is not None and len(self._cache) < _KEPT_WORDS:
            self._cache[w] = (fam, weight, score)
        return fam, weight, score

    def unit(self, text: str) -> tuple[str | None, list[float] | None, int, str | None, float]:
        """(family, summed pair scores, words of the family, language, confidence) of a unit; None without words."""
        hit = self._units.get(text)
        if hit is None:
            fam, scores, n = self._unit(text)
            hit = (fam, scores, n, *(self.decide(fam, scores) if fam else (None, 0.0)))
            if len(text) <= 160:
                if len(self._units) >= _KEPT_UNITS:
                    self._units.clear()
                self._units[text] = hit
        return hit

    def _unit(self, text: str) -> tuple[str | None, list[float] | None, int]:
        cache, word = self._cache, self.word
        found = [cache.get(w) or word(w) for w in words_of(text)]
        fams = {x[0] for x in found}
        fams.discard(None)
        if not fams:
            return None, None, 0
        if len(fams) == 1:
            (fam,) = fams
        else:
            weights = dict.fromkeys(fams, 0.0)
            for f, weight, _ in found:
                if f:
                    weights[f] += weight
            fam = max(sorted(weights), key=weights.get)
            found = [x for x in found if x[0] == fam]
        if fam not in self._stack:
            return fam, None, len(found)
        # Capitalised words (mostly names) have less weight and speak for a language only where there are no others.
        scores = [x[2] for x in found if x[1] == 1.0] or [x[2] for x in found if x[2]]
        return fam, list(map(sum, zip(*scores))), len(found)

    def decide(self, fam: str, scores: list[float] | None) -> tuple[str, float]:
        """Language of a family by the votes of its machines, with a confidence between 0.5 and 1."""
        ls = self.families[fam]
        if len(ls) == 1 or scores is None:
            return ls[0], 1.0
        wins, n = [0] * len(ls), len(ls)
        for (i, j), s in zip(_pairs(n), scores):
            wins[i if s >= 0 else j] += 1
        best = wins.index(max(wins))
        if wins.count(wins[best]) > 1:  # a circle of votes: the larger margin
            margin = [sum(s if i == k else -s for (i, j), s in zip(_pairs(n), scores) if k in (i, j)) for k in range(n)]
            best = max((k for k in range(n) if wins[k] == max(wins)), key=margin.__getitem__)
        low = min(abs(scores[k]) for k, pair in enumerate(_pairs(n)) if best in pair)
        return ls[best], 1 / (1 + exp(-low))


@lru_cache(None)
def _pairs(n: int) -> list[tuple[int, int]]:
    return list(combinations(range(n), 2))


#: A unit whose machines are less sure takes part in the choice of a neighbour of its family. Short ones need more.
SHORT_WORDS = 4
SURE, SURE_SHORT = 0.975, 0.975


def label_units(model: LanguageModel, units: list[str]) -> list[tuple[str, float]]:
    """(language, confidence) of successive units. Units without words go with the unit before, else after them."""
    raw = [model.unit(u) for u in units]
    out: list[tuple[str, float] | None] = []
    for i, (fam, scores, n, lang, sure) in enumerate(raw):
        if fam is None:
            out.append(None)
            continue
        if scores is not None and sure < (SURE_SHORT if n <= SHORT_WORDS else SURE):
            near = [raw[j][1] for j in (i + 1, i - 1) if 0 <= j < len(raw) and raw[j][0] == fam and raw[j][1] is not None]
            if near:
                lang, sure = model.decide(fam, [a + 0.5 * sum(b) for a, *b in zip(scores, *near)])
        out.append((lang, sure))
    if not any(out):
        return [("und", 1.0)] * len(units)
    last = None
    for i, x in enumerate(out):
        if x is None:
            out[i] = last and (last[0], 0.5)
        else:
            last = x
    last = None
    for i in range(len(out) - 1, -1, -1):
        if out[i] is None:
            out[i] = (last[0], 0.5)
        last = out[i]
    return out


def fit_model(samples: DataFrame, words: DataFrame | None = None, limit: int = MAX_SAMPLES) -> LanguageModel:
    """Fit on at most ``limit`` labelled rows of (lang, sample_text) and (lang, word), those of least hash; only these reach the driver."""
    rows = samples.select("lang", F.col("sample_text").alias("t"))
    if words is not None:
        rows = rows.unionByName(words.select("lang", F.col("word").alias("t")))
    rows = rows.filter("lang IS NOT NULL").orderBy(F.xxhash64("lang", "t"), "lang", "t").limit(limit)
    return LanguageModel.fit(sorted((r[0], r[1] or "") for r in rows.collect()))


SEGMENT_SCHEMA = T.StructType(
    [T.StructField("document_id", T.StringType()), T.StructField("seg_no", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]
    + [T.StructField(n, T.IntegerType()) for n in ("start_char", "end_char", "n_units")]
)


def language_segments(docs: DataFrame, model: LanguageModel, id_col: str = "id", text_col: str = "raw_text") -> DataFrame:
    """One row per longest run of sentence units of one language: its number, language, mean confidence and span.

    Null and blank texts have no rows; a text without words of any language is one run of ``und``. Map-only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            ids, texts, units = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            ends = units.offsets.to_pylist()
            flat = units.values
            s, e = flat.field(0).to_pylist(), flat.field(1).to_pylist()
            for i, (doc, text) in enumerate(zip(ids, texts)):
                lo, hi = ends[i], ends[i + 1]
                if lo == hi:
                    continue
                plain = tidy(text)
                labels = label_units(model, [plain[s[k] : e[k]] for k in range(lo, hi)])
                k = lo
                for no, (lang, group) in enumerate(groupby(labels, key=lambda x: x[0]), 1):
                    sure = [x[1] for x in group]
                    rows.append((doc, no, lang, round(sum(sure) / len(sure), 4), s[k], e[k + len(sure) - 1], len(sure)))
                    k += len(sure)
            cols = list(zip(*rows)) or [[]] * len(SEGMENT_SCHEMA)
            types = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=SEGMENT_SCHEMA.names)

    src = docs.select(F.col(id_col).cast("string").alias("document_id"), F.col(text_col).alias("t"), unit_offsets(F.col(text_col)).alias("u"))
    return src.mapInArrow(run, SEGMENT_SCHEMA)


def document_languages(segments: DataFrame) -> DataFrame:
    """Main language of each document: that of most characters, with the share of it as confidence."""
    per = segments.groupBy("document_id", "lang").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("n"), F.avg("confidence").alias("c"))
    best = F.max_by(F.struct("lang", "n", "c"), F.struct("n", "lang"))
    d = per.groupBy("document_id").agg(best.alias("b"), F.sum("n").alias("all"), F.count("*").alias("n_langs"))
    return d.select("document_id", F.col("b.lang").alias("lang"), F.round(F.col("b.c") * F.col("b.n") / F.col("all"), 4).alias("confidence"), "n_langs")
