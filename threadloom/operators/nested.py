"""Deeply nested JSON payloads to linked rows, by vectorised structural indexing.

All payloads of an Arrow batch are one byte buffer. Bitmaps of quotes, brackets and delimiters are made with numpy; a
running sum of the unescaped quotes tells what lies inside strings, a running sum of the brackets gives the nesting
depth. Sorted by (document, depth), the delimiters of one container lie together, so element positions are counts
within it, and the delimiter before a bracket belongs to the container that encloses it. Paths and spans are read off
these arrays. Whether a text is valid JSON is decided on the same bitmaps, by the token that may follow another one in a
container of its kind; no tree is built, nothing is recursive, and a payload may be nested to any depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that hold arrays. A lone object there is an array of one; text there may be JSON text.
ARRAY_FIELDS = frozenset("calls handoffs devices sims periods tags transactions splits refs terminals attachments".split())
#: Fields that hold a map whose entries are rows.
MAP_FIELDS = frozenset(["subscribers"])

NODE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("document_id", "node", "node_path", "parent_path")] + [T.StructField("ordinal", T.IntegerType()), T.StructField("value", T.StringType())]
)

_OPEN, _CLOSE, _QUOTE, _BACKSLASH = (np.zeros(256, bool) for _ in range(4))
_OPEN[list(b"{[")] = True
_CLOSE[list(b"}]")] = True
_QUOTE[list(b'"')] = True
_BACKSLASH[list(b"\\")] = True
_DELIM = _OPEN | _CLOSE
_DELIM[list(b",:")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True


_SCALAR = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPE = np.zeros(256, bool)
_ESCAPE[list(b'"\\/bfnrtu')] = True


def check_payloads(texts: list[bytes]) -> list[tuple[str, int]]:
    """(reason why it is no JSON or "", first byte of the value) of each text, by vectorised checks of the whole batch.

    Reasons: blank, quotes (unbalanced), brackets (unbalanced or of two kinds), order (of the tokens), text (a bare
    control sign or a wrong escape in a string), value (a word that is no number, true, false or null).
    """
    out: list[tuple[str, int]] = [("", 0)] * len(texts)
    first = [t.lstrip(b" \t\r\n")[:1] for t in texts]
    live = []
    for i, f in enumerate(first):
        out[i] = ("blank", 0) if not f else ("order", 0) if texts[i].endswith(b"\\") else ("", f[0])  # a backslash may not reach the next text
        if not out[i][0]:
            live.append(i)

    def drop(bad: np.ndarray, reason: str) -> None:
        nonlocal live
        for k in np.flatnonzero(bad).tolist():
            out[live[k]] = (reason, 0)
        live = [i for i, b in zip(live, bad.tolist()) if not b]

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(texts[i]) for i in live], np.int64)
        return np.frombuffer(b"".join(texts[i] for i in live), np.uint8), np.cumsum(sizes) - sizes, np.cumsum(sizes)

    if not live:
        return out
    buf, starts, ends = joined()
    quotes = _unescaped(buf, np.flatnonzero(_QUOTE[buf]))
    # A backslash may stand outside strings only in invalid texts, which the values' check finds.
    odd = ((np.searchsorted(quotes, ends) - np.searchsorted(quotes, starts)) & 1).astype(bool)
    if odd.any():
        drop(odd, "quotes")
        if not live:
            return out
        buf, starts, ends = joined()
        quotes = _unescaped(buf, np.flatnonzero(_QUOTE[buf]))

    def brackets() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        marks = np.flatnonzero(_OPEN[buf] | _CLOSE[buf])
        marks = marks[(np.searchsorted(quotes, marks) & 1) == 0]
        step = np.where(_OPEN[buf[marks]], 1, -1)
        return marks, step, np.cumsum(step), np.searchsorted(ends, marks, side="right")

    marks, step, level, doc = brackets()
    lo, hi = np.searchsorted(marks, starts), np.searchsorted(marks, ends)
    base = np.concatenate([[0], level])[lo]
    wrong = np.concatenate([[0], level])[hi] != base
    below = np.flatnonzero(level - base[doc] < 0) if len(marks) else np.empty(0, np.int64)
    wrong[doc[below]] = True
    if wrong.any():
        drop(wrong, "brackets")
        if not live:
            return out
        buf, starts, ends = joined()
        quotes = _unescaped(buf, np.flatnonzero(_QUOTE[buf]))
        marks, step, level, doc = brackets()
    n_docs = len(live)
    bad = {r: np.zeros(n_docs, bool) for r in ("brackets", "order", "text", "value")}
    # Tokens in order: brackets, commas and colons as they are, strings as S, other words as V.
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[quotes[0::2]] = 1
    inside[quotes[1::2] + 1] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    word = ~(inside | _BLANK[buf] | _DELIM[buf])
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[starts] = word[starts]
    v_at = np.flatnonzero(begins)
    d_at = np.flatnonzero(_DELIM[buf] & ~inside)
    at = np.concatenate([d_at, quotes[0::2], v_at])
    kind = np.concatenate([buf[d_at], np.full(len(quotes) // 2, ord("S"), np.uint8), np.full(len(v_at), ord("V"), np.uint8)])
    order = np.argsort(at, kind="stable")
    at, kind = at[order], kind[order]
    doc = np.searchsorted(ends, at, side="right")
    opens, closes = _OPEN[kind], _CLOSE[kind]
    depth = np.cumsum(opens.astype(np.int64) - closes.astype(np.int64))
    # Container of a token: for brackets the one they make, for others the one that they are in. Sorted by depth, the
    # tokens of one container follow its opening bracket.
    own = depth + closes
    by = np.lexsort((np.arange(len(at)), own))
    opener = np.empty(len(at), np.int64)
    opener[by] = np.maximum.accumulate(np.where(opens[by] | (own[by] == 0), np.arange(len(by)), 0))
    holder = by[opener]  # the opening bracket, or the token itself at the root
    holds = kind[holder]
    root = own == 0
    bad["brackets"][doc[closes & (((kind == ord("}")) & (holds != ord("{"))) | ((kind == ord("]")) & (holds != ord("["))))]] = True
    # Kind of the container around the token: for an opening bracket that of its parent.
    around = np.where(root, ord("^"), holds)
    up = opens & (own > 1)
    if up.any():
        # The last opening bracket of the parent's depth before the token.
        o_at = np.flatnonzero(opens)
        key = own[o_at] * (len(at) + 1) + o_at
        sort = np.argsort(key, kind="stable")
        want = (own[up] - 1) * (len(at) + 1) + np.flatnonzero(up)
        found = o_at[sort][np.searchsorted(key[sort], want, side="left") - 1]
        around[up] = kind[found]
    around[opens & (own == 1)] = ord("^")
    previous = np.empty(len(kind), np.uint8)
    previous[1:] = kind[:-1]
    first_of = np.ones(len(kind), bool)
    first_of[1:] = doc[1:] != doc[:-1]
    previous[first_of] = ord("^")
    is_s, is_v = kind == ord("S"), kind == ord("V")
    in_obj, in_arr = around == ord("{"), around == ord("[")
    after_start = (previous == ord("{")) | (previous == ord(","))
    key_token = is_s & in_obj & after_start
    was_key = np.zeros(len(kind), bool)
    was_key[1:] = key_token[:-1]
    value_end = ((previous == ord("S")) & ~was_key) | (previous == ord("V")) | (previous == ord("}")) | (previous == ord("]"))
    begins_value = opens | is_v | (is_s & ~key_token)
    good = np.select(
        [begins_value & (around == ord("^")), begins_value & in_arr, begins_value, key_token, kind == ord(":"), kind == ord(","), kind == ord("}")],
        [previous == ord("^"), (previous == ord("[")) | (previous == ord(",")), previous == ord(":"), True, was_key & in_obj, value_end & (in_obj | in_arr), (previous == ord("{")) | value_end],
        (previous == ord("[")) | value_end,
    )
    bad["order"][doc[~good]] = True
    # Strings: no bare control signs, and every escape is a known one.
    control = np.flatnonzero((buf < 32) & inside)
    bad["text"][np.searchsorted(ends, control, side="right")] = True
    bs = np.flatnonzero(_BACKSLASH[buf] & inside)
    if len(bs):
        head = np.ones(len(bs), bool)
        head[1:] = bs[1:] != bs[:-1] + 1
        run = np.maximum.accumulate(np.where(head, np.arange(len(bs)), 0))
        esc = bs[((np.arange(len(bs)) - run) & 1) == 0]
        nxt = buf[np.minimum(esc + 1, len(buf) - 1)]
        fail = ~_ESCAPE[nxt]
        for k in range(2, 6):
            fail |= (nxt == ord("u")) & ~_HEX[buf[np.minimum(esc + k, len(buf) - 1)]]
        bad["text"][np.searchsorted(ends, esc[fail], side="right")] = True
    raw = buf.tobytes()
    stops = np.flatnonzero(word & ~np.append(word[1:], False))
    cut = np.searchsorted(ends, v_at, side="right")
    stop_at = np.minimum(stops[np.searchsorted(stops, v_at)] + 1, ends[cut]) if len(v_at) else v_at
    met: dict[bytes, bool] = {}
    for a, b, d in zip(v_at.tolist(), stop_at.tolist(), cut.tolist()):
        w = raw[a:b]
        ok = met.get(w)
        if ok is None:
            ok = met[w] = _SCALAR.fullmatch(w) is not None
        if not ok:
            bad["value"][d] = True
    for k in range(n_docs):
        for reason in ("brackets", "value", "text", "order"):
            if bad[reason][k]:
                out[live[k]] = (reason, 0)
                break
    return out


def _unescaped(buf: np.ndarray, quotes: np.ndarray) -> np.ndarray:
    """Positions of the quotes that no odd run of backslashes precedes."""
    bs = np.flatnonzero(_BACKSLASH[buf])
    if not len(bs):
        return quotes
    first = np.ones(len(bs), bool)
    first[1:] = bs[1:] != bs[:-1] + 1
    run = np.maximum.accumulate(np.where(first, np.arange(len(bs)), 0))
    parity = dict(zip((bs + 1).tolist(), ((np.arange(len(bs)) - run + 1) & 1).tolist()))  # of the run that ends before a place
    last = np.ones(len(bs), bool)
    last[:-1] = first[1:]
    odd = np.array([p for p in (bs[last] + 1).tolist() if parity[p]], dtype=np.int64)
    return quotes[~np.isin(quotes, odd)] if len(odd) else quotes


def index_payloads(texts: list[bytes], wanted: frozenset[str] = ARRAY_FIELDS, maps: frozenset[str] = MAP_FIELDS, values: bool = True):
    """Rows (i, node, path, parent, ordinal, value) of texts already known to be valid JSON, and texts found inside.

    Of the second list each is (i, field, path, parent, text): JSON text in place of an array or map.
    """
    rows: list[tuple] = []
    inner: list[tuple] = []
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return rows, inner
    raw = b"".join(texts)
    buf = np.frombuffer(raw, np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    quotes = _unescaped(buf, np.flatnonzero(_QUOTE[buf]))
    # Bitmap of string contents: valid texts have an even number of quotes, so one running sum serves the whole batch.
    marks = np.flatnonzero(_DELIM[buf])
    marks = marks[(np.searchsorted(quotes, marks) & 1) == 0]
    if not len(marks):
        return rows, inner
    ch = buf[marks]
    opens, closes = _OPEN[ch], _CLOSE[ch]
    depth = np.cumsum(opens.astype(np.int32) - closes.astype(np.int32)) + closes
    doc = np.searchsorted(ends, marks, side="right")
    order = np.lexsort((np.arange(len(marks)), depth, doc))
    container = np.empty(len(marks), np.int64)
    container[order] = np.cumsum(opens[order]) - 1  # the tokens of one container lie together
    opener = np.empty(int(opens.sum()), np.int64)
    closer = np.empty_like(opener)
    opener[container[opens]] = np.flatnonzero(opens)
    closer[container[closes]] = np.flatnonzero(closes)
    is_array = ch[opener] == ord("[")
    commas = (ch == ord(",")).astype(np.int64)
    seen = np.empty(len(marks), np.int64)
    seen[order] = np.cumsum(commas[order])
    ordinal = seen - seen[opener[container]]
    solid = np.flatnonzero(~_BLANK[buf])
    after = solid[np.minimum(np.searchsorted(solid, marks, side="right"), len(solid) - 1)]
    kind = buf[after]
    # Key of each colon: the two quotes before it.
    q = np.searchsorted(quotes, marks) - 1
    previous = np.arange(len(marks)) - 1
    first = np.searchsorted(marks, starts)  # of each text
    roots = np.zeros(len(marks), bool)
    roots[first[first < len(marks)]] = True

    L = {k: v.tolist() for k, v in dict(marks=marks, ch=ch, doc=doc, container=container, ordinal=ordinal, kind=kind, after=after, q=q).items()}
    quote_at, array_of, closes_at = quotes.tolist(), is_array.tolist(), marks[closer].tolist()
    m_ch, m_doc, m_con, m_ord, m_kind, m_after, m_q = (L[k] for k in ("ch", "doc", "container", "ordinal", "kind", "after", "q"))
    is_open, is_root = opens.tolist(), roots.tolist()
    n = len(opener)
    c_path, c_case, c_name, c_map = [""] * n, [""] * n, [""] * n, [False] * n
    end_list = ends.tolist()
    comma, colon, bracket, brace, quote = ord(","), ord(":"), ord("["), ord("{"), ord('"')
    pending: tuple | None = None  # (path, case, name, map) of the value that begins after this token
    names: dict[bytes, str] = {}

    def span(i: int) -> str:
        """Text of the value that begins at the mark after token i."""
        a = m_after[i]
        if m_kind[i] == brace or m_kind[i] == bracket:
            return raw[a : closes_at[m_con[i + 1]] + 1].decode()
        if m_kind[i] == quote:
            b = quote_at[quote_index[a] + 1] + 1
            return raw[a:b].decode()
        stop = L["marks"][i + 1] if i + 1 < len(m_ch) else end_list[m_doc[i]]
        return raw[a:stop].decode().strip()

    quote_index = _Index(quotes)
    for i, c in enumerate(m_ch):
        if is_open[i]:
            k = m_con[i]
            if is_root[i]:
                pending = ("", "", "", False)
            if pending is not None:
                c_path[k], c_case[k], c_name[k], c_map[k] = pending
            pending = None
            if c != bracket:
                continue
        elif c != comma and c != colon:
            pending = None
            continue
        k, d = m_con[i], m_doc[i]
        if c == colon:
            a, b = quote_at[m_q[i] - 1] + 1, quote_at[m_q[i]]
            key_bytes = raw[a:b]
            key = names.get(key_bytes)
            if key is None:
                key = names[key_bytes] = json.loads(raw[a - 1 : b + 1]) if b"\\" in key_bytes else key_bytes.decode()
            path = f"{c_path[k]}.{key}" if c_path[k] else key
            case, kd = c_case[k], m_kind[i]
            if c_map[k]:
                rows.append((d, c_name[k], path, case, m_ord[i], span(i) if values else None))
                pending = (path, path, key, False)
            elif key in wanted:
                if kd == brace:
                    path += ".0"
                    rows.append((d, key, path, case, 0, span(i) if values else None))
                    pending = (path, path, key, False)
                elif kd == quote:
                    inner.append((d, key, path, case, json.loads(span(i))))
                    pending = None
                else:
                    pending = (path, case, key, False)
            elif key in maps:
                if kd == quote:
                    inner.append((d, key, path, case, json.loads(span(i))))
                pending = (path, case, key, kd == brace)
            else:
                pending = (path, case, key, False)
        elif array_of[k]:
            kd = m_kind[i]
            path = f"{c_path[k]}.{m_ord[i]}" if c_path[k] else str(m_ord[i])
            if kd == brace or kd == quote:
                rows.append((d, c_name[k], path, c_case[k], m_ord[i], span(i) if values else None))
                pending = (path, path, c_name[k], False)
            else:
                pending = (path, c_case[k], c_name[k], False)
        else:
            pending = None
    return rows, inner


class _Index:
    """Position of a quote in the list of quotes."""

    def __init__(self, quotes: np.ndarray):
        self.quotes = quotes

    def __getitem__(self, at: int) -> int:
        return int(np.searchsorted(self.quotes, at))


def shred(ids: list, payloads: list, values: bool = True) -> list[tuple]:
    """(document_id, node, node_path, parent_path, ordinal, value) of all payloads of a batch."""
    out: list[tuple] = []
    # (id, field, path, parent, text): JSON text in JSON text is taken up again until none is left.
    work = [(i, None, "", "", t) for i, t in zip(ids, payloads)]
    while work:
        batch, again = [], []
        work = [w for w in work if w[4] is not None]
        checked = check_payloads([w[4].encode("utf-8", "surrogatepass") for w in work])
        for (i, field, path, parent, text), (reason, head) in zip(work, checked):
            if reason:
                continue
            if head == ord('"'):
                again.append((i, field, path, parent, json.loads(text)))
            elif head in b"{[":
                # Text inside a field is indexed as that field of a small document.
                batch.append((i, field, path, parent, text if field is None else "{" + json.dumps(field) + ":" + text + "}"))
        rows, inner = index_payloads([b[4].encode("utf-8", "surrogatepass") for b in batch], values=values)
        for d, node, p, up, ordinal, value in rows:
            i, field, path, parent, _ = batch[d]
            if field is not None:
                p = path + p[len(field) :]
                up = path + up[len(field) :] if up else parent
            out.append((i, node, p, up, ordinal, value))
        for d, name, p, up, text in inner:
            i, field, path, parent, _ = batch[d]
            if field is not None:
                p = path + p[len(field) :]
                up = path + up[len(field) :] if up else parent
            again.append((i, name, p, up, text))
        work = again
    return out


def flatten_payloads(docs: DataFrame, id_col: str = "id", payload_col: str = "structured", values: bool = True) -> DataFrame:
    """Linked rows of every payload: one per array element (object or string) and per map entry.

    Null, blank and invalid payloads give no rows; a null id gives rows with a null id; extra columns are ignored.
    Without ``values`` the JSON text of the elements is left out. Map-only: one pass over the scan, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = shred(b.column(0).to_pylist(), b.column(1).to_pylist(), values)
            for k in range(0, len(rows), 20_000):
                part = rows[k : k + 20_000]
                cols = list(zip(*part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[j], pa.string()) for j in range(4)] + [pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.string())], names=NODE_SCHEMA.names
                )

    src = docs.select(F.col(id_col).cast("string").alias("document_id"), F.col(payload_col).cast("string").alias("payload"))
    return src.filter(F.col("payload").isNotNull()).mapInArrow(run, NODE_SCHEMA)


REJECT_SCHEMA = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("n_bytes", T.IntegerType())])


def rejected_payloads(docs: DataFrame, id_col: str = "id", payload_col: str = "structured") -> DataFrame:
    """(document_id, reason, n_bytes) of every payload that is no JSON, also inside a JSON string. Nulls are no payloads. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            work = [(i, t, len(t.encode("utf-8", "surrogatepass"))) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            while work:
                again = []
                for (i, t, n), (reason, head) in zip(work, check_payloads([w[1].encode("utf-8", "surrogatepass") for w in work])):
                    if reason:
                        out.append((i, reason, n))
                    elif head == ord('"'):
                        again.append((i, json.loads(t), n))
                work = again
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], names=REJECT_SCHEMA.names)

    src = docs.select(F.col(id_col).cast("string").alias("document_id"), F.col(payload_col).cast("string").alias("payload"))
    return src.filter(F.col("payload").isNotNull()).mapInArrow(run, REJECT_SCHEMA)


def flat_table(nodes: DataFrame, node: str, fields: dict[str, str]) -> DataFrame:
    """One flat table of the linked rows called ``node``: its keys, ordinal and scalar ``fields`` (name to SQL type)."""
    out = nodes.filter(F.col("node") == node)
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    out = out.withColumn("_v", F.from_json("value", schema))
    cols = [F.expr(f"try_cast(_v.`{f}` AS {t})").alias(f) for f, t in fields.items()]
    return out.select("document_id", "node_path", "parent_path", "ordinal", *cols)
