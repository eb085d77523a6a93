"""Per-document statistics that tell prose from lists, tables and junk.

Three signals are vertical. Delimiters that stand in as many fields, or at the same columns, on successive lines are
alignment, which shows tables. Markers and indentation that return with a period show lists. The autocorrelation of the
line lengths tells lines of one make (entries, hard-wrapped prose) from lines of chance; without it no line is an entry
for being short, nor prose for being broken. Each line gets a form from these and from its words, symbols and
punctuation; the form with more than half of the characters is that of the document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Periodicity from which lines count as entries that return, of the centred series.
PERIODIC = 0.8
#: Share of markers that return with a period, and line-length autocorrelation, from which lines belong together.
RETURNS, EVEN, ALIKE = 0.5, 0.75, 0.5

_MARKER = re.compile(r"\s*(?:[-•*–·‣▪]\s+|\(?(?:\d{1,4}|[०-९]{1,4}|[a-z]|[ivxlc]{1,6})[.)]\s+|\((?:[A-Z]|[a-z]{2})\)\s+)")
#: Bars that part fields; after a letter of an Indic script a bar is a full stop.
_BAR = re.compile(r"(?<![ऀ-৿])\|")
_STOP = re.compile(r"[.!?।۔。！？…|](?=[\"”»')\]]*(?:\s|$))|[。！？]")
_WORD = re.compile(r"[^\W_][\w'’\u0300-\u036f़-्ऀ-ः॑-ॗঁ-ঃ়-্ัิ-ฺ็-๎ً-ٰٕ\u200b-\u200f\u2060\ufeff\xad]*")
_SYMBOL = re.compile(r"[{}\[\]<>\\^~#§¬|`=*_$€£%&@/+▯□■◆○●¦�¤•·]")
#: Signs that prose has between words, in the middle of words.
_MASHED = re.compile(r"[^\W\d_][;,./\\\[\]'][^\W\d_]")
_LATIN = re.compile(r"[a-z]{2,}")
_RUN = re.compile(r"[฀-๿一-鿿]{6,}")
_GAP = re.compile(r" {2,}|\t")
_TOKEN = re.compile(r"\S{20,}")
_DELIMITED = re.compile(r"[|\t]|,\S|;\S| {2,}\S")
_LETTER = re.compile(r"[^\W\d_]")


def _fields(line: str) -> dict[str, int]:
    """Number of fields by each delimiter that the line has."""
    out = {}
    if "|" in line:
        if n := len(_BAR.findall(line.strip().strip("|"))):
            out["|"] = n + 1
    if "\t" in line:
        out["\t"] = line.count("\t") + 1
    if '";"' in line or '","' in line:
        out['"'] = max(line.count('";"'), line.count('","')) + 1
    elif ";" in line:
        out[";"] = line.rstrip("; ").count(";") + 1
    if "," in line:
        out[","] = line.count(",") + 1
    gaps = len(_GAP.findall(line.strip()))
    if gaps:
        out[" "] = gaps + 1
    return out


def autocorrelation(values: list[int], lag: int) -> float:
    """Of a series at a lag; 0 where the series is short or constant."""
    n = len(values)
    if n <= lag + 1:
        return 0.0
    mean = sum(values) / n
    var = sum((v - mean) ** 2 for v in values)
    if not var:
        return 0.0
    return sum((values[i] - mean) * (values[i + lag] - mean) for i in range(n - lag)) / var


def periodicity(values: list[int]) -> float:
    """Strongest autocorrelation at lags of two to four lines, per pair of lines; 0 with fewer than three periods."""
    n = len(values)
    return max((min(1.0, autocorrelation(values, k) * n / (n - k)) for k in (2, 3, 4) if n >= 3 * k), default=0.0)


def echo(values: list[int], lags: tuple[int, ...] = (1, 2, 3, 4)) -> float:
    """Strongest autocorrelation of a series as it stands (not centred), per pair of values: 1 for a constant one.

    Of marks (0 and 1) it is the share of them that return with a period; of line lengths it is high where neighbours
    are of one length. 0 for a single value and for no marks.
    """
    n, power = len(values), sum(v * v for v in values)
    if n < 2 or not power:
        return 0.0
    return min(1.0, max(sum(a * b for a, b in zip(values, values[k:])) / power * n / (n - k) for k in lags if k == 1 or n >= 2 * k))


class Form:
    """Forms of the lines of a text and the statistics of the whole."""

    def __init__(self, text: str, common: frozenset[str]):
        lines = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
        self.n_chars, self.n_lines = len(text), len(lines)
        found = [_WORD.findall(x) for x in lines]
        words = [w for ws in found for w in ws]
        self.n_words = len(words)
        self.mean_word = sum(map(len, words)) / len(words) if words else 0.0
        solid = sum(map(len, (x.replace(" ", "") for x in lines))) or 1
        self.symbols = len(_SYMBOL.findall(text)) / solid
        self.ended = sum(1 for x in lines if _STOP.search(x[-3:])) / len(lines) if lines else 0.0
        per = [[w.lower() for w in ws] for ws in found]
        # Short texts hold few common words of any kind; scripts without blanks count their long runs.
        self.shares = [sum(w in common for w in ws) / len(ws) if ws else 0.0 for ws in per]
        self.common = sum(share * len(ws) for share, ws in zip(self.shares, per)) / len(words) if words else 0.0
        self.mashed = self.common < 0.06 and len(_MASHED.findall(text)) > 0.12 * len(words) and len(_LATIN.findall(text)) > 0.4 * len(words)
        lengths = [len(x) for x in lines]
        self.auto, self.even = periodicity(lengths), echo(lengths)
        indents = [len(x) - len(x.lstrip()) for x in lines]
        marks = [1 if _MARKER.match(x) else 0 for x in lines]
        self.marked = sum(marks) / len(lines) if lines else 0.0
        self.indent_period = max(echo(marks), periodicity(indents), periodicity(marks))
        # Lengths return by chance in short sentences, so they count only where most lines end without a stop.
        self.periodic = max(periodicity(indents), periodicity(marks)) >= PERIODIC or self.auto >= PERIODIC and self.ended <= 0.5
        self.aligned = self._aligned(lines)
        self.table = sum(len(x) for x, a in zip(lines, self.aligned) if a) / max(1, sum(lengths))
        counts = Counter(x.strip() for x in lines)
        wrapped = self._wrapped(lines, lengths, per)
        total = Counter()
        for i, x in enumerate(lines):
            total[self._line(x, i, per[i], marks, counts, wrapped, len(lines))] += len(x)
        if self._same_over(text, words, lines, counts):
            total = Counter(junk=1)
        all_chars = sum(total.values())
        best, n = total.most_common(1)[0] if total else ("blank", 0)
        self.kind = best if 2 * n > all_chars else "prose" if total else "blank"

    @staticmethod
    def _aligned(lines: list[str]) -> list[bool]:
        """Lines whose delimiters make as many fields as those of a neighbour, three at least for commas and blanks."""
        out = [False] * len(lines)
        if len(lines) < 2 or not any(_DELIMITED.search(x) for x in lines):
            return out
        fields = [_fields(x) if _DELIMITED.search(x) else {} for x in lines]
        least = {"|": 2, "\t": 2, '"': 2, " ": 2, ",": 3, ";": 3}
        for d, need in least.items():
            n = [f.get(d, 0) for f in fields]
            for i, k in enumerate(n):
                if k >= need and (i and n[i - 1] == k or i + 1 < len(n) and n[i + 1] == k):
                    if d in ",;" and (_STOP.search(lines[i]) or ", " in lines[i] and d == "," or "; " in lines[i]):
                        continue
                    out[i] = True
        # Fields that start at the same columns; blanks before a line are its indentation.
        cols = [tuple(m.end() for m in re.finditer(r"(?<=[^ ]) {2,}", x)) if "  " in x else () for x in lines]
        for i in range(len(lines)):
            near = [cols[j] for j in (i - 1, i + 1) if 0 <= j < len(lines) and cols[j]]
            if cols[i] and any(len(set(cols[i]) & set(c)) >= max(1, len(cols[i]) // 2) for c in near):
                out[i] = True
        return out

    def _wrapped(self, lines: list[str], lengths: list[int], per: list[list[str]]) -> bool:
        """Prose broken at a width: lines of even length, most of them with common words or a sentence's end inside."""
        if len(lines) < 2:
            return False
        # The last line ends anywhere; of two lines the first alone is the width.
        even = echo(lengths[:-1], (1,)) if len(lines) > 2 else float(lengths[0] >= 0.6 * lengths[1])
        inner = sum(1 for i, x in enumerate(lines) if self.shares[i] > 0.08 or _STOP.search(x[:-2]) or _RUN.search(x)) / len(lines)
        return even >= EVEN and inner >= 0.5 and self.marked < 0.5

    def _line(self, x: str, i: int, words: list[str], marks: list[int], counts: Counter, wrapped: bool, n_lines: int) -> str:
        """Form of one line."""
        if self.shares[i] > 0.1 and len(words) > 8 and not self.aligned[i] and not marks[i] and len(set(words)) > 5 and ";" not in x and not self.symbols > 0.05:
            return "prose"
        solid = x.replace(" ", "")
        if len(set(solid)) <= 2 and len(solid) >= 4:
            return "junk"
        if self.aligned[i]:
            return "table"
        if self.mashed:
            return "junk"
        long = _TOKEN.findall(x)
        if long and sum(map(len, long)) > 0.7 * len(x) and not _RUN.search(x) and "@" not in x and ", " not in x and "|" not in x:
            return "junk"
        if len(words) >= 6 and len(set(words)) <= 2:
            return "junk"
        odd = len(_SYMBOL.findall(x)) / max(1, len(solid))
        if odd > 0.1 and len(solid) > 20 and "@" not in x:
            return "junk"
        if marks[i]:
            # Markers make a list where they return; a single one with a sentence behind it is prose.
            if self.indent_period >= RETURNS:
                return "list"
        if self.periodic and not wrapped and self.shares[i] < 0.2:
            return "list"
        parts = [p for p in x.split(";") if p.strip()]
        if len(parts) >= 4 and sum(1 for p in parts if len(p) < 60 and not _STOP.search(p.strip()[:-1] if len(p) > 3 else "")) > 0.8 * len(parts):
            return "list"
        if wrapped or _RUN.search(x) and (len(x) > 25 or n_lines < 3):
            return "prose"
        stops = len(_STOP.findall(x))
        if stops and (self.shares[i] > 0.04 or len(words) > 7) or len(x) > 90 and self.shares[i] > 0.04:
            return "prose"
        if self.shares[i] >= 0.2 and len(words) >= 4:
            return "prose"
        if not stops and len(x) <= 80 and n_lines >= 3 and self.even >= ALIKE:
            return "list"
        parts = [p for p in re.split(r"[,،、]", x) if p.strip()]
        if len(parts) >= 5 and not stops and self.shares[i] < 0.04 and len(x) / len(parts) < 40:
            return "list"
        return "prose" if words or stops else "junk"

    @staticmethod
    def _same_over(text: str, words: list[str], lines: list[str], counts: Counter) -> bool:
        """One word, line or sign over and over."""
        if len(lines) >= 5 and counts.most_common(1)[0][1] > 0.6 * len(lines) and len(counts) <= max(2, len(lines) // 5):
            return True
        if len(words) >= 8 and len(set(words)) <= max(1, len(words) // 20) and len(set(words)) <= 3:
            return True
        solid = "".join(text.split())
        if len(solid) >= 8 and len(set(solid)) <= 2:
            return True
        return len(words) >= 40 and len(set(words)) <= 12 and len(zlib.compress(text.encode("utf-8", "replace"), 1)) < 0.06 * len(text.encode("utf-8", "replace"))


STATS_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("kind", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("n_chars", "n_lines", "n_words")]
    + [T.StructField(n, T.DoubleType()) for n in ("mean_word_length", "symbol_ratio", "ended_line_share", "common_word_share", "marker_share", "aligned_share", "line_autocorrelation", "line_evenness", "indent_period")]
)


#: Common words that fit the driver and every task; more are refused, none is left out.
MOST_WORDS = 1_000_000


def load_common_words(words: DataFrame, most: int = MOST_WORDS) -> frozenset[str]:
    """The common words, a small fixed table; raises where it has more than ``most`` rows."""
    rows = words.select("word").filter("word IS NOT NULL").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} common words")
    return frozenset(r[0].casefold() for r in rows if len(r[0]) > 1 or not r[0].isascii())


def text_statistics(docs: DataFrame, common: frozenset[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of statistics per document; kind is prose, list, table, junk or blank. Null texts count as blank. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = Form(t or "", common)
                rows.append((i, f.kind, f.n_chars, f.n_lines, f.n_words, *(round(v, 4) for v in (f.mean_word, f.symbols, f.ended, f.common, f.marked, f.table, f.auto, f.even, f.indent_period))))
            cols = list(zip(*rows)) or [[]] * len(STATS_SCHEMA)
            types = [pa.int64(), pa.string(), *[pa.int32()] * 3, *[pa.float64()] * 9]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=STATS_SCHEMA.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, STATS_SCHEMA)
