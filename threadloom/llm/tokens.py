"""Token ids of a public byte-level BPE vocabulary for a whole corpus.

Texts of an Arrow batch are one array of code points. The split into words is vectorised (classes of the code points,
runs, and the rules for blanks and contractions); the words of a batch are found by a hash, whose equality is checked on
the code points, and known by their text, so a word is encoded once per worker. New words are cut where no token of the
vocabulary has the two bytes side by side, which no merge can cross. The pieces are encoded by DuckDB: rows of (piece,
position, token) are joined with the merge table, and a recursive query contracts the leftmost pair of least rank of
each piece, with every further occurrence of that pair, until no piece has a pair that merges; an ordered aggregation
gives the ids of each piece. A merge makes a token of higher rank than its own, so the further occurrences are those
that would be contracted next, and one rule holds for pieces of every length.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File of the vocabulary and merges; a parameter of every operator here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Code points that are worked on at once, which bounds the memory of a worker.
CHUNK = 1_000_000
#: Words that a worker keeps the ids of; beyond that it starts anew.
KEPT_WORDS = 600_000

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_WHITE = frozenset([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def _class_of(c: int) -> int:
    if c in _WHITE:
        return _SPACE
    k = unicodedata.category(chr(c))[0]
    return _LETTER if k == "L" else _NUMBER if k == "N" else _OTHER


class WordSplitter:
    """Vectorised split of texts into the words of the vocabulary's pattern."""

    def __init__(self):
        self.classes = np.full(0x110000, 255, np.uint8)
        self._powers = np.ones(1, np.uint64)
        self._inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) <= n:
            p, q = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _BASE_INVERSE, np.uint64)
            p[0] = q[0] = 1
            with np.errstate(over="ignore"):
                self._powers, self._inverses = np.cumprod(p), np.cumprod(q)

    def split(self, cps: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of each word, hash of each word) of the code points of texts that begin at ``doc_starts``."""
        n = len(cps)
        cls = self.classes[cps]
        if (new := np.unique(cps[cls == 255])).size:
            self.classes[new] = [_class_of(int(c)) for c in new]
            cls = self.classes[cps]
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(cls[1:], cls[:-1], out=start[1:])
        start[doc_starts] = True
        space = cls == _SPACE
        # Last blank of a run before something else in the same text: apart from the run, and with what follows if U+0020.
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:]
        ends = doc_starts - 1
        last[ends[ends >= 0]] = False
        at = np.flatnonzero(last)
        start[at] = True
        joined = at[cps[at] == 32] + 1
        start[joined] = False
        # Contractions: an apostrophe that begins a word, before s t m d re ve ll.
        quote = np.flatnonzero((cps[:-1] == 39) & start[:-1] & (cls[1:] == _LETTER)) if n > 1 else np.empty(0, np.int64)
        if quote.size:
            same = np.ones(n + 2, bool)
            same[doc_starts] = False
            a = cps[quote + 1]
            b = np.where(quote + 2 < n, cps[np.minimum(quote + 2, n - 1)], 0)
            ok1 = same[quote + 1]
            one = ok1 & np.isin(a, [ord(c) for c in "stmd"])
            two = ok1 & same[quote + 2] & ((a == 114) & (b == 101) | (a == 118) & (b == 101) | (a == 108) & (b == 108))
            for size, pick in ((2, one), (3, two)):
                p = quote[pick]
                start[p + 1] = False
                q = p + size
                q = q[q < n]
                q = q[cls[q] == _LETTER]
                start[q] = True
        starts = np.flatnonzero(start)
        self._grow(n)
        with np.errstate(over="ignore"):
            mixed = (cps.astype(np.uint64) + np.uint64(0x51ED)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(mixed * self._powers[:n], out=total[1:])
            stops = np.append(starts[1:], n)
            h = (total[stops] - total[starts]) * self._inverses[starts]
            h ^= (stops - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        return starts, h


def byte_symbols() -> list[str]:
    """The printable sign that stands for each byte in the vocabulary."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class PairEncoder:
    """Byte-pair encoding of distinct words in DuckDB."""

    #: Symbols that are encoded at once, and rows of one recursive query, which bound the memory without a spill folder.
    BATCH, ROWS = 100_000, 3_000_000

    def __init__(self, path: str):
        import duckdb

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, symbols = model["vocab"], byte_symbols()
        self.bytes = np.array([vocab[s] for s in symbols], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = pa.table(
            {
                "l": pa.array([vocab[a] for a, _ in pairs], pa.int32()),
                "r": pa.array([vocab[b] for _, b in pairs], pa.int32()),
                "rank": pa.array(range(len(pairs)), pa.int32()),
                "made": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
            }
        )
        byte_of = {s: b for b, s in enumerate(symbols)}
        #: Whether two bytes stand side by side in any token: between others no merge can reach.
        self.together = np.zeros((256, 256), bool)
        for a, b in pairs:
            t = np.array([byte_of[c] for c in a + b])
            self.together[t[:-1], t[1:]] = True
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.con.register("merge_rows", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.con.unregister("merge_rows")

    CONTRACT = """
    CREATE OR REPLACE TEMP TABLE reached AS
    WITH RECURSIVE step(word, pos, tok, active, depth) AS (
        SELECT word, pos, tok, true, 0 FROM symbols
        UNION ALL
        (WITH paired AS (
            SELECT word, pos, tok, depth, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt FROM step WHERE active AND depth < {rounds}),
        ranked AS (
            SELECT p.*, m.rank, m.made, min(m.rank) OVER (PARTITION BY p.word) AS least
            FROM paired p LEFT JOIN merges m ON p.tok = m.l AND p.nxt = m.r),
        hits AS (  -- the least pair and its further occurrences; those side by side share a symbol
            SELECT *, coalesce(rank = least, false) AS hit, row_number() OVER (PARTITION BY word ORDER BY pos) AS k FROM ranked),
        chosen AS (  -- of a run of such occurrences every second one, from the left
            SELECT *, hit AND (k - max(CASE WHEN NOT hit THEN k ELSE 0 END) OVER (PARTITION BY word ORDER BY pos)) % 2 = 1 AS take FROM hits),
        marked AS (
            SELECT *, coalesce(lag(take) OVER (PARTITION BY word ORDER BY pos), false) AS gone FROM chosen)
        SELECT word, pos, CASE WHEN take THEN made ELSE tok END, least IS NOT NULL, depth + 1 FROM marked WHERE NOT gone)
    )
    SELECT word, pos, tok, active FROM step WHERE NOT active OR depth = {rounds}
    """

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each piece) of pieces that are worked on at once."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        firsts = np.cumsum(sizes) - sizes
        rows = pa.table(
            {
                "word": pa.array(np.repeat(np.arange(len(words), dtype=np.int32), sizes)),
                "pos": pa.array(np.arange(len(raw), dtype=np.int64) - np.repeat(firsts, sizes)),
                "tok": pa.array(self.bytes[raw]),
            }
        )
        done = []
        while rows.num_rows:
            self.con.register("symbol_rows", rows)
            self.con.execute("CREATE OR REPLACE TEMP TABLE symbols AS SELECT * FROM symbol_rows")
            self.con.unregister("symbol_rows")
            self.con.execute(self.CONTRACT.format(rounds=max(1, min(64, self.ROWS // rows.num_rows))))
            done.append(self.con.sql("SELECT word, list(tok ORDER BY pos) AS ids FROM reached WHERE NOT active GROUP BY word").to_arrow_table())
            rows = self.con.sql("SELECT word, pos, tok FROM reached WHERE active").to_arrow_table()
        got = pa.concat_tables(done).sort_by("word").combine_chunks()
        ids = got.column("ids").chunk(0)
        offsets = ids.offsets.to_numpy()
        return ids.values.to_numpy().astype(np.int32)[offsets[0] : offsets[-1]], np.diff(offsets)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each word)."""
        sizes = np.array([len(w) for w in words], np.int64)
        joined = b"".join(words)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        raw = np.frombuffer(joined, np.uint8)
        firsts = np.cumsum(sizes) - sizes
        start = np.ones(len(raw), bool)
        start[1:] = ~self.together[raw[:-1], raw[1:]]
        start[firsts[sizes > 0]] = True
        at = np.append(np.flatnonzero(start), len(raw)).tolist()
        known: dict[bytes, int] = {}
        piece = np.array([known.setdefault(joined[a:b], len(known)) for a, b in zip(at, at[1:])], np.int64)
        flats, counts, batch, size = [], [], [], 0
        for p in (*known, None):
            if p is None or size + len(p) > self.BATCH and batch:
                f, n = self._contract(batch)
                flats.append(f)
                counts.append(n)
                batch, size = [], 0
            if p is not None:
                batch.append(p)
                size += len(p)
        flat, n = np.concatenate(flats), np.concatenate(counts)
        begin = np.cumsum(n) - n
        per = n[piece]
        inside = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        total = np.concatenate([[0], np.cumsum(per)])
        bounds = np.searchsorted(at, np.append(firsts, len(raw)))
        return flat[np.repeat(begin[piece], per) + inside], np.diff(total[bounds])


class CorpusEncoder:
    """Ids of texts; keeps the ids of words that were met."""

    def __init__(self, path: str = TOKENIZER):
        self.splitter, self.pairs = WordSplitter(), PairEncoder(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        flat, sizes = self.pairs.encode([w.encode("utf-8", "replace") for w in words])
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words))))
        self.flat = np.concatenate([self.flat, flat])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of each known word in order, number of words of each text); learns new words first."""
        if len(self.known) > KEPT_WORDS:
            self._forget()
        counts = np.zeros(len(texts), np.int64)
        met: list[tuple[list[str], np.ndarray]] = []
        new: dict[str, None] = {}
        i = 0
        while i < len(texts):
            k, size = i, 0
            while k < len(texts) and (size == 0 or size + len(texts[k]) <= CHUNK):
                size += len(texts[k])
                k += 1
            if size:
                lens = np.array([len(t) for t in texts[i:k]], np.int64)
                begins = np.cumsum(lens) - lens
                joined = "".join(texts[i:k])
                cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
                starts, h = self.splitter.split(cps, begins[lens > 0])
                counts[i:k] = np.searchsorted(starts, begins + lens) - np.searchsorted(starts, begins)
                ends = np.append(starts[1:], len(cps))
                first, back = self._distinct(cps, starts, ends, h, joined)
                words = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
                new.update((w, None) for w in words if w not in self.known)
                met.append((words, back))
            i = k
        if new:
            self._learn(list(new))
        if not met:
            return np.empty(0, np.int64), counts
        return np.concatenate([np.array([self.known[w] for w in words], np.int64)[back] for words, back in met]), counts

    @staticmethod
    def _distinct(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """(first occurrence of each distinct word, number of its word of each occurrence)."""
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        size, like = ends - starts, first[back]
        if np.array_equal(size, size[like]) and np.array_equal(cps[starts[0] : ends[-1]], cps[np.arange(len(cps)) + np.repeat(starts[like] - starts, size)]):
            return first, back
        seen: dict[str, int] = {}  # two words with one hash: by their text instead
        at = []
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            if joined[a:b] not in seen:
                seen[joined[a:b]] = len(at)
                at.append(k)
        return np.array(at, np.int64), np.array([seen[joined[a:b]] for a, b in zip(starts.tolist(), ends.tolist())], np.int64)

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        w, counts = self.words([t or "" for t in texts])
        per = np.diff(self.offsets)[w]
        total = np.concatenate([[0], np.cumsum(per)])
        stops = np.cumsum(counts)
        return total[stops] - total[stops - counts]

    def encode(self, texts: list[str | None]) -> Iterator[pa.ListArray]:
        """Ids of the texts, in arrays over successive texts; null and empty texts have an empty list."""
        w, counts = self.words([t or "" for t in texts])
        per = np.diff(self.offsets)[w]
        stops = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(per)])
        lo = 0
        while lo < len(texts):
            first = stops[lo] - counts[lo]
            hi = max(lo + 1, int(np.searchsorted(total[stops], total[first] + 4 * CHUNK, side="right")))
            hi = min(hi, len(texts))
            a, b = first, stops[hi - 1]
            n = per[a:b]
            begin = np.repeat(self.offsets[w[a:b]], n)
            inside = np.arange(len(begin)) - np.repeat(np.cumsum(n) - n, n)
            ids = self.flat[begin + inside]
            cuts = np.concatenate([[0], total[stops[lo:hi]] - total[first]]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))
            lo = hi


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> CorpusEncoder:
    """The encoder of a worker, with the words that its earlier tasks met."""
    return CorpusEncoder(path)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens; strings that look like these are ordinary text.

    A null and an empty text give an empty list. Map-only; whole texts, in chunks that bound a worker's memory.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                at = 0
                for ids in enc.encode(part.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(ids)), ids], names=["doc_id", "ids"])
                    at += len(ids)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document; null and empty texts have 0."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(path)
        for b in batches:
            n = np.concatenate([enc.sizes(b.column(1).slice(k, 2000).to_pylist()) for k in range(0, b.num_rows, 2000)] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64))], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
