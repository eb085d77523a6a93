"""Personal information in free text: spans of names, phones, mail addresses, identity numbers and home addresses.

Patterns propose spans: numbers, mail and home addresses by shape; names by known parts, by titles and roles before them,
and by runs of capitals inside a sentence. On each span labelers vote: patterns (shape), gazetteers (parts learnt from
the corpus, see ``gazetteer``) and contexts (words beside it); a labeler may abstain. Expectation-maximisation over the
votes of a bounded sample estimates how reliable each labeler is, without any labels and with the same modest prior for
all, and the resulting probabilities train a logistic span classifier over votes and shape, which makes the final choice
everywhere. Spans are then replaced by typed placeholders.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.chars import ZERO_WIDTH
from threadloom.llm.chars import plain as tidy
from threadloom.llm.gazetteer import Gazetteer
from threadloom.llm.names import KIND_WORDS, MIDDLE, TITLES, roman

TYPES = ("NAME", "PHONE", "EMAIL", "ID_NUMBER", "ADDRESS")
#: Documents that the labelers' reliabilities and the classifier are fitted on, at most: those of least hash.
MAX_DOCUMENTS = 3000
PLACE_WORDS = frozenset("sector phase road border post crossing chowk marg nagar vihar ghat mod mandi tiraha kalan khurd adda gate railway block ward street pur isbt station khera lane colony bridge market hospital school court".split())
#: Titles and roles that stand right before a name, by script; words of the languages, not of a corpus.
TITLE_CUES = "Mr Mrs Ms Miss Dr Shri Smt Sri Sh Km Kumari Prof Insp Const Sgt Sr Sra Srta Mme Mlle श्री श्रीमती डॉ कु सौ सुश्री ডা শ্রী শ্রীমতী জনাব ڈاکٹر جناب محترمہ".split()
ROLE_CUES = "complainant accused informant witness victim constable guard plaignant plaignante denunciante testigo acusado témoin accusé शिकायतकर्ता आरोपी मुखबिर गवाह माता पिता तक्रारदार साक्षीदार अभियुक्त অভিযোগকারী সাক্ষী আসামি شکایت گواہ ملزم".split()
ROLE_WORDS = frozenset(ROLE_CUES) | frozenset("bhai late met arrested".split())
RIGHT_WORDS = frozenset(
    "was and alias urf r/o told could examined stated works aged ne ko travelled changed said is has s/o met lives saw a fue habite vive examinó declaró और उर्फ ने को उस एक यांनी हा यांच्या कोणासाठी की निवासी জানান কে কি "
    "نے کو اس ने अने et y que".split()
)
#: Words before a place, and before another name of one who was named.
PLACE_CUES = frozenset("near at towards behind in on around opp via reached outside beside".split())
ALIAS_CUES = frozenset("alias urf उर्फ ওরফে عرف".split())
#: Capitalised words that are no names: days, months and labels.
CALENDAR = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december statement report vide".split())

_ZW = f"[{ZERO_WIDTH}]"
_ZERO = re.compile(_ZW)
_NOT_WORD = r"(?<![A-Za-z0-9])"
_EMAIL = re.compile(
    rf"[A-Za-z0-9](?:[A-Za-z0-9._+\-]|{_ZW})*(?:{_ZW}*@{_ZW}*|\s?[\[(]{_ZW}*(?i:a{_ZW}*t){_ZW}*[\])]\s?)(?:[A-Za-z0-9\-]|{_ZW})+(?:(?:{_ZW}*\.{_ZW}*|\s?[\[(]{_ZW}*(?i:d{_ZW}*o{_ZW}*t){_ZW}*[\])]\s?)(?:(?![A-Z][a-z]|{_ZW}*[A-Z][a-z])[A-Za-z0-9\-]|{_ZW}(?=[A-Za-z0-9]))+)+"
)
_DIGIT = r"[0-9०-९০-৯۰-۹]"
_NUMBER = re.compile(rf"(?:\(\+?91\)|\+)?[0-9०-९০-৯۰-۹ \-{ZERO_WIDTH}]{{10,}}")
_ID_ALNUM = re.compile(rf"{_NOT_WORD}(?:[A-Z]{_ZW}*[0-9](?:{_ZW}*[0-9]){{6}}|(?:[A-Z]{_ZW}*){{3}}[0-9](?:{_ZW}*[0-9]){{6}}|(?:[A-Z]{_ZW}*){{5}}(?:[0-9]{_ZW}*){{4}}[A-Z]|(?:[A-Z]{_ZW}*){{2}}[0-9]{_ZW}*[0-9]{_ZW}*[ \-]?(?:{_ZW}*[0-9]){{11}})(?![A-Za-z0-9])")
_ASCII_DIGITS = {ord(c): str(i % 10) for i, c in enumerate("०१२३४५६७८९০১২৩৪৫৬৭৮৯۰۱۲۳۴۵۶۷۸۹")}
_ID_CUE = re.compile(r"(?:identity|licen[cs]e|card|passport|aadha+r|voter|pan|epic|पहचान पत्र|ओळखपत्र|पासपोर्ट|आधार|परिचय|পরিচয়পত্র|শনাক্তকরণ|شناختی|carte|identité|identidad|pièce|documento|dni|身份证|证件|บัตร)\W*(?:no|number|id|सं|क्र|नं|নং|نمبر|n°|núm|号|号码|หมายเลข|d'identité)?[.:°]?\s*$", re.I)
_ACCOUNT_CUE = re.compile(r"(?:a/c|account|खाता|खाते|खात्या|হিসাব|کھاتہ|compte|cuenta|账户|บัญชี|receipt|slip|letter|fir|case|रसीद|report)\W*(?:no|number|सं|क्र|नं|নং|نمبر|n°|núm)?[.:°]?\s*(?:[०-९0-9 ]+ )?$", re.I)
_PHONE_CUE = re.compile(r"(?:mob|mobile|phone|tel|number|numéro|número|नंबर|मोबाइल|मोबाईल|क्रमांक|नम्बर|নম্বর|নং|نمبر|电话|โทรศัพท์|used|again on|call|and|on|तो|aur|between|called)\W*(?:no)?[.:]?\s*$", re.I)
_HOUSE = (
    rf"(?:(?:H\.? ?No\.?|House(?: No\.?)?|Flat(?: No\.?)?|Plot(?: No\.?)?|Door No\.?|Qtr\.?(?: No\.?)?|Room No\.?|Makan No\.?|म\.?\s?नं\.?|मकान(?: नं\.?| सं\.?)?|प्लॉट(?: नं\.?| सं\.?)?|फ्लैट(?: नं\.?)?|फ़्लैट(?: नं\.?)?|घर(?: क्र\.?| नं\.?)?|বাড়ি(?: নং)?|مکان(?: نمبر)?)\s{{0,2}}{_DIGIT}{{1,4}}(?:[-/][A-Z0-9०-९]{{1,4}})?"
    rf"|(?<![0-9/A-Za-z.\-]){_DIGIT}{{1,4}}/{_DIGIT}{{1,4}}(?=, ))"
)
_PLACE_LATIN = r"(?:No\.|[A-Z][\w'’]*)(?: (?:No\.|[A-Z][\w'’]*|\d{1,3}(?!\d)))*"
_PLACE_INDIC = r"[ऀ-ॿ]+\.?(?: (?!से |पर |में |के |को |का |की |कडे )(?:[ऀ-ॿ]+\.?|[0-9०-९]{1,3}(?![0-9०-९])))*"
_PIN = r"(?:,? ?(?:-|–)? ?(?:PIN|Pin|पिन)?[ :\-]{0,2}[0-9०-९]{3} ?[0-9०-९]{3}(?![0-9]))"
_ADDRESS = re.compile(rf"(?:{_HOUSE})(?:, (?:{_PLACE_LATIN}|{_PLACE_INDIC})(?:[ -][A-Z](?![a-z]))?)*(?:{_PIN})?")
_WORD = re.compile(rf"[A-Za-zÀ-ɏ\u0300-\u036fऀ-ॣॱ-ॿঀ-৥ৰ-৿؀-؋ؠ-ٟٮ-ۓە-ۯ'’{ZERO_WIDTH}]+(?:-[A-Za-z{ZERO_WIDTH}]+)*")
_AT = re.compile(rf"@|[\[(]{_ZW}*[aA]{_ZW}*[tT]{_ZW}*[\])]")
_HOUSE_NUMBER = re.compile(rf"{_DIGIT}[A-Z0-9०-९/\-{ZERO_WIDTH}]{{0,9}}, ")
_ID_TOKEN = re.compile(rf"[A-Z][A-Z0-9{ZERO_WIDTH}]{{3,14}}(?:[ \-][0-9{ZERO_WIDTH}]{{11,16}})?")


def bare(text: str) -> str:
    """Text without invisible signs."""
    return text if text.isascii() else _ZERO.sub("", text)


def part_of_name(token: str, gazetteer: Gazetteer) -> str:
    """G for a given name, S for a family name, M for a middle name, N for a nickname, O or L for parts of other names,
    T for a title or role, else empty."""
    t = unicodedata.normalize("NFC", bare(token)).casefold().strip("'’-")
    if not t:
        return ""
    return "M" if roman(t) in MIDDLE else gazetteer.kinds.get(t) or ("T" if t in _CUE_SET else gazetteer.kind(t))


_CUE_SET = frozenset(w.casefold() for w in (*TITLE_CUES, *ROLE_CUES))


class Span:
    """A proposed span with its votes: label name to +1 or -1, and numeric shape features."""

    __slots__ = ("kind", "s", "e", "votes", "shape")

    def __init__(self, kind: str, s: int, e: int, votes: dict[str, int], shape: tuple[float, ...] = ()):
        self.kind, self.s, self.e, self.votes, self.shape = kind, s, e, votes, shape


#: Labelers of each type, in a fixed order: + for those that speak for the type, - for those against it.
LABELERS = {
    "NAME": ["given", "family", "two_parts", "title", "role", "right", "capitals", "organisation", "place", "place_cue", "common"],
    "PHONE": ["shape", "phone_cue", "account_cue", "id_cue", "row"],
    "EMAIL": ["shape", "domain"],
    "ID_NUMBER": ["shape", "id_cue", "account_cue"],
    "ADDRESS": ["shape", "parts", "postal_code"],
}
#: Prior accuracy of every labeler, and how many spans the prior is worth.
PRIOR, PRIOR_WEIGHT = 0.85, 200.0


def _trim_zero_width(t: str, s: int, e: int) -> tuple[int, int]:
    while s < e and (t[s] in ZERO_WIDTH or t[s].isspace()):
        s += 1
    while e > s and (t[e - 1] in ZERO_WIDTH or t[e - 1].isspace()):
        e -= 1
    return s, e


def _numbers(t: str, taken: list[tuple[int, int]]) -> Iterator[Span]:
    for m in _NUMBER.finditer(t):
        s, e = _trim_zero_width(t, m.start(), m.end())
        while s < e and (t[s] in "- " or t[s] in ZERO_WIDTH):
            s += 1
        while s < e and (t[e - 1] in "- " or t[e - 1] in ZERO_WIDTH):
            e -= 1
        raw = t[s:e]
        digits = re.sub(r"[^0-9]", "", (raw if raw.isascii() else raw.translate(_ASCII_DIGITS)))
        if len(digits) < 10 or any(a < e and s < b for a, b in taken):
            continue
        if s and (t[s - 1].isascii() and (t[s - 1].isalnum() or t[s - 1] in "/@")) or e < len(t) and (t[e].isascii() and t[e].isalpha() or t[e] == "/"):
            continue
        before = bare(t[max(0, s - 32) : s])
        yield from _split_number(t, s, e, before)


_PHONE_FORM = re.compile(
    rf"(?:(?:\(\+?91\)|\+?91|\+91)[ \-]?|0)?(?:[6-9]\d{{4}}[ \-]?\d{{5}}|[6-9]\d{{2}}[ \-]\d{{3}}[ \-]\d{{4}}|[6-9]\d{{3}}[ \-]\d{{3}}[ \-]\d{{3}})(?!\d)"
)
_ID_FORM = re.compile(r"\d{4}[ \-]\d{4}[ \-]\d{4}(?!\d)|\d{12}(?!\d)")


def _split_number(t: str, s: int, e: int, before: str) -> Iterator[Span]:
    """Phones and identity numbers within a run of digits and blanks; positions count the invisible signs out."""
    at = [i for i in range(s, e) if t[i] not in ZERO_WIDTH]
    number = "".join(t[i] for i in at)
    if not number.isascii():
        number = number.translate(_ASCII_DIGITS)
    pos = 0
    while pos < len(number):
        if pos and number[pos - 1].isdigit() or number[pos] in " -":
            pos += 1
            continue
        m, phone = _ID_FORM.match(number, pos), _PHONE_FORM.match(number, pos)
        if not m and not phone:
            while pos < len(number) and number[pos].isdigit():
                pos += 1
            pos += pos < len(number) and not number[pos].isdigit()
            continue
        ctx = before if pos == 0 else ""
        a, b = bool(ctx and _ACCOUNT_CUE.search(ctx)), bool(ctx and _ID_CUE.search(ctx))
        if m and (b or not phone):
            yield Span("ID_NUMBER", at[pos], at[m.end() - 1] + 1, {"account_cue": -1} if a else {"shape": 1} | ({"id_cue": 1} if b else {}), (0.0,))
            pos = m.end()
            continue
        m = phone
        if m:
            # A number that is called one of an account or a paper is no phone for having the shape of one.
            votes = {} if a or b else {"shape": 1}
            if ctx and not a and not b and _PHONE_CUE.search(ctx):
                votes["phone_cue"] = 1
            if a:
                votes["account_cue"] = -1
            if b:
                votes["id_cue"] = -1
            line = t.rfind("\n", 0, s)
            if s - line < 40 and not any(c.isalpha() for c in t[line + 1 : s]):
                votes["row"] = 1
            yield Span("PHONE", at[pos], at[m.end() - 1] + 1, votes, (float(m.end() - pos > 10),))
            pos = m.end()
            continue
        while pos < len(number) and number[pos].isdigit():
            pos += 1


_LOCAL = re.compile(rf"(?:[A-Za-z0-9._+\-]|{_ZW})*$")


def _mail_at(t: str, at: re.Match) -> re.Match | None:
    """The address around an at-sign, of any length: back over all signs that a local part can have."""
    lo = at.start()
    if t[lo] != "@" and lo and t[lo - 1].isspace():
        lo -= 1
    while lo and (t[lo - 1] in ZERO_WIDTH or t[lo - 1] in "._+-" or t[lo - 1].isascii() and t[lo - 1].isalnum()):
        lo -= 1
    while lo < at.start():
        m = _EMAIL.match(t, lo)
        if m:
            return m if m.end() > at.start() else None
        lo += 1
    return None


def _address_at(t: str, number: re.Match) -> tuple[int, int] | None:
    """The address of a house number, to its last part: the mark before the number is at most 24 signs long."""
    lo, left = number.start(), 24
    while lo and left and t[lo - 1] != "\n":
        lo -= 1
        left -= t[lo] not in ZERO_WIDTH
    end = t.find("\n", number.end())
    line = t[lo : end if end >= 0 else len(t)]
    at = None
    if not line.isascii() and _ZERO.search(line):
        at = [i for i, c in enumerate(line) if c not in ZERO_WIDTH]
        line = "".join(line[i] for i in at)
    last = number.start() - lo + 9
    for k in range(min(last, len(line)) + 1):
        m = _ADDRESS.match(line, k)
        if m:
            s, e = (m.start(), m.end()) if at is None else (at[m.start()], at[m.end() - 1] + 1)
            return (s + lo, e + lo) if s + lo <= number.start() + 9 and number.start() < e + lo else None
    return None


def propose(text: str, gazetteer: Gazetteer, common: frozenset[str] = frozenset()) -> list[Span]:
    """All proposed spans of a text with the labelers' votes."""
    t = tidy(text)
    out: list[Span] = []
    taken: list[tuple[int, int]] = []
    for at in _AT.finditer(t) if "@" in t or "[" in t or "(" in t else ():
        m = _mail_at(t, at)
        if m and not any(a < m.end() and m.start() < b for a, b in taken):
            s, e = _trim_zero_width(t, m.start(), m.end())
            while t[e - 1] in ".-":
                e -= 1
            taken.append((s, e))
            out.append(Span("EMAIL", s, e, {"shape": 1, "domain": 1 if re.search(r"(?i)(\.|dot\s?[\])]\s?)[a-z]{2,}$", bare(t[s:e])) else -1}))
    for at in _HOUSE_NUMBER.finditer(t):
        span = _address_at(t, at)
        if span and not any(a < span[1] and span[0] < b for a, b in taken):
            body = bare(t[span[0] : span[1]])
            if ", " in body:
                taken.append(span)
                out.append(Span("ADDRESS", *span, {"shape": 1, "parts": 1} | ({"postal_code": 1} if re.search(r"[0-9०-९]{3}$", body) else {})))
    for m in _ID_TOKEN.finditer(t):
        m = _ID_ALNUM.match(t, m.start(), m.end())
        if not m or t[m.end() : m.end() + 1].isalnum():
            continue
        s, e = m.span()
        ctx = bare(t[max(0, s - 40) : s])
        votes = {"account_cue": -1} if _ACCOUNT_CUE.search(ctx) else {"shape": 1} | ({"id_cue": 1} if _ID_CUE.search(ctx) else {})
        taken.append((s, e))
        out.append(Span("ID_NUMBER", s, e, votes, (1.0,)))
    out.extend(_numbers(t, taken))
    out.extend(_names(t, taken, gazetteer, common))
    return out


_KNOWN = frozenset("GS")


def _names(t: str, taken: list[tuple[int, int]], gazetteer: Gazetteer, common: frozenset[str]) -> Iterator[Span]:
    words = [(*m.span(), m[0]) for m in _WORD.finditer(t)]
    seen = gazetteer.parts
    parts = []
    for w in words:
        p = seen.get(w[2])
        if p is None:
            if len(seen) > 200_000:
                seen.clear()
            p = seen[w[2]] = part_of_name(w[2], gazetteer)
        parts.append(p)
    n = len(words)
    i = 0
    found: list[tuple[int, int]] = []
    marked = [k for k, p in enumerate(parts) if p]
    for at in [k for k in marked if parts[k] in _KNOWN]:
        if at < i:
            continue
        i = at
        lo = hi = i
        # To the right and left: other parts, middle names and initials, with one blank, comma or full stop between.
        while hi + 1 < n and _gap(t, words, parts, hi) and (parts[hi + 1] in ("G", "S", "M") or _initial(t, words[hi + 1])):
            hi += 1
        while lo > 0 and i - lo < 5 and _initial(t, words[lo - 1]) and _gap(t, words, parts, lo - 1, dot=True):
            lo -= 1
        if i - lo == 1 and lo and words[lo][2] == "M" and words[lo - 1][2].casefold() in _BEFORE_MONSIEUR:
            lo = i
        if i - lo >= 3:
            lo = min(i, lo + 3)  # an abbreviation of three letters is that of a rank
        elif i - lo == 2 and words[lo][2] + words[lo + 1][2] in ("PS", "GD", "SI"):
            lo = i
        if parts[hi] == "M":
            hi -= 1
        i = hi + 1
        for lo2, hi2 in _persons(parts, lo, hi):
            s, e = words[lo2][0], words[hi2][1]
            if len(bare(words[hi2][2])) == 1 and t[e : e + 1] == ".":
                e += 1
            s, e = _trim_zero_width(t, s, e)
            if not any(a < e and s < b for a, b in taken):
                found.append((s, e))
                yield Span("NAME", s, e, *_name_votes(t, words, parts, lo2, hi2))
    yield from _unknown_names(t, taken + found, words, parts, [k for k in marked if parts[k] == "T"], common)


_BEFORE_MONSIEUR = frozenset("plaignant témoin accusé que à de et par avec".split())
_CAPITALS = re.compile(r"(?<![\w.\-/])[A-ZÀ-Þ][a-zß-ÿ'’]+(?: [A-ZÀ-Þ][a-zß-ÿ'’]+){1,2}(?![\w\-/])")
_AFTER_CUE = re.compile(r"\.? +(?=[^\W\d_])")
_RUN_WORD = re.compile(rf"[^\W\d_][\w'’\u0300-\u036f़-्ऀ-ः॑-ॗঁ-ঃ়-্ً-ٰٟ\-{ZERO_WIDTH}]*")


def _unknown_names(t: str, taken: list[tuple[int, int]], words: list, parts: list, cues: list[int], common: frozenset[str]) -> Iterator[Span]:
    """Spans around no known part: behind a title or role, and runs of two or three capitalised words in a sentence."""
    places = None
    spans = []
    for c in cues:
        m = _AFTER_CUE.match(t, words[c][1])
        shouted = words[c][2].isupper()
        if not m or shouted and bare(words[c][2]).casefold() not in _TITLE_SET:
            continue  # a role in capitals is followed by any word
        at, end, last = m.end(), m.end(), None
        for _ in range(3):
            w = _RUN_WORD.match(t, at)
            if not w:
                break
            x = bare(w[0])
            low = x.casefold()
            latin = x[:1].isascii() or x[:1] < "ɐ"
            if last is not None and latin != last or low in RIGHT_WORDS or low in common or low in CALENDAR or low in TITLES or low in ROLE_WORDS or len(x) < 2:
                break
            if latin and (not x[:1].isupper() or x.isupper() and len(x) > 1 and not shouted):
                break
            last, end = latin, w.end()
            if t[end : end + 1] != " ":
                break
            at = end + 1
        if last is None:
            continue
        # Scripts without capitals need a word behind that names are followed by.
        after = _RUN_WORD.match(t, end + 1) if t[end : end + 1] == " " else None
        if last or after and bare(after[0]).casefold() in RIGHT_WORDS:
            spans.append((m.end(), end))
    spans += [m.span() for m in _CAPITALS.finditer(t)]
    for s, e in spans:
        if any(a < e and s < b for a, b in taken):
            continue
        if places is None:
            places = {w[0]: k for k, w in enumerate(words)}
        k = lo = places.get(s)
        if lo is None:
            continue
        while k + 1 < len(words) and words[k + 1][1] <= e:
            k += 1
        if parts[lo] == "M" or "N" in parts[lo : k + 1] or lo and bare(words[lo - 1][2]).casefold() in ALIAS_CUES:
            continue
        taken.append((s, e))
        votes, shape = _name_votes(t, words, parts, lo, k)
        low = [bare(w[2]).casefold() for w in words[lo : k + 1]]
        if any(w in common or w in CALENDAR or w in TITLES or w in RIGHT_WORDS for w in low):
            votes["common"] = -1
        kinds = [roman(w) for w in low]
        if any(p == "O" for p in parts[lo : k + 1]) or any(w in KIND_WORDS for w in kinds):
            votes["organisation"] = -1
        if any(p == "L" for p in parts[lo : k + 1]) or any(w in PLACE_WORDS for w in kinds):
            votes["place"] = -1
        before = t[:s].rstrip(" ")[-1:]
        inside = bool(before) and before not in ".!?।۔\n:“\"|;"
        if not votes.keys() & {"title", "role", "right"} and not inside:
            continue  # capitals at the start of a sentence say nothing
        if votes.keys() & {"common", "organisation", "place", "place_cue"}:
            for k in ("two_parts", "role", "right"):  # these say nothing of what is called otherwise
                votes.pop(k, None)
        elif k > lo and inside:
            votes["capitals"] = 1
        yield Span("NAME", s, e, votes, shape)


def _gap(t: str, words: list, parts: list, k: int, dot: bool = False) -> bool:
    """Whether word ``k`` and the next can be parts of one name: a blank, or a comma and a blank, or an initial's full stop."""
    a, b = words[k], words[k + 1]
    if b[0] - a[1] > 2:
        return False
    g = t[a[1] : b[0]]
    if g in (" ", "  ", "-") or dot and g in (".", ". "):
        return True
    if g == ". " and (len(bare(a[2])) == 1 or bare(a[2]).casefold() in ("md", "mohd")) or g == "." and len(bare(a[2])) <= 2:
        return True
    # Family name, given name; in other orders a comma parts two names.
    return g == ", " and parts[k] == "S" and (parts[k + 1] == "G" or _initial(t, b))


def _initial(t: str, w: tuple) -> bool:
    if w[1] - w[0] > 3:
        return False
    letter = bare(w[2])
    return len(letter) == 1 and letter.isalpha() and t[w[1] : w[1] + 1] == "."


def _persons(parts: list, lo: int, hi: int) -> list[tuple[int, int]]:
    """A run of name parts cut into persons: a part of a kind that came before begins another one, unless it follows
    one of its kind, as the parts of a compound name do."""
    out, start = [], lo
    seen = ""
    for k in range(lo, hi + 1):
        p = parts[k]
        if p in _KNOWN and p in seen and parts[k - 1] != p:
            out.append((start, k - 1))
            start, seen = k, ""
        seen += p
    out.append((start, hi))
    return out


def _name_votes(t: str, words: list, parts: list, lo: int, hi: int) -> tuple[dict[str, int], tuple[float, ...]]:
    got = [parts[k] for k in range(lo, hi + 1)]
    votes: dict[str, int] = {}
    left = bare(words[lo - 1][2]).casefold() if lo else ""
    touches = lo and t[words[lo - 1][1] : words[lo][0]].strip(" .,") == ""
    if touches and (left in TITLES or left in _TITLE_SET):
        votes["title"] = 1
    elif touches and left in ROLE_WORDS:
        votes["role"] = 1
    after = words[hi + 1] if hi + 1 < len(words) else None
    right = bare(after[2]).casefold() if after and t[words[hi][1] : after[0]].strip(" .,") == "" else ""
    if right in RIGHT_WORDS:
        votes["right"] = 1
    kind = roman(right) if right else ""
    near = after and t[words[hi][1] : after[0]] in (" ", "  ", " & ", "-")
    beside = lo and t[words[lo - 1][1] : words[lo][0]] == " " and words[lo - 1][2][:1].isupper()
    own = ("G" in got) + ("S" in got)  # one known part alone may belong to another name
    proper = after and right not in RIGHT_WORDS and (after[2][:1].isupper() or not after[2][:1].isascii())
    if near and own <= 1 and (kind in KIND_WORDS - {"and", "of", "the", "company"} or proper and parts[hi + 1] == "O") or beside and own <= 1 and (roman(left) in KIND_WORDS - {"and", "of", "the"} or parts[lo - 1] == "O") and "title" not in votes:
        votes["organisation"] = -1
    if near and own <= 1 and (kind in PLACE_WORDS or proper and parts[hi + 1] == "L") or beside and own <= 1 and (roman(left) in PLACE_WORDS or parts[lo - 1] == "L"):
        votes["place"] = -1
    if own == 0 and touches and left in PLACE_CUES:
        votes["place_cue"] = -1
    # Gazetteers abstain where another name is around the part.
    if not votes.keys() & {"organisation", "place"}:
        if "G" in got:
            votes["given"] = 1
        if "S" in got:
            votes["family"] = 1
        if hi > lo:
            votes["two_parts"] = 1
    else:
        votes.pop("role", None)
        votes.pop("right", None)
    upper = bare(words[lo][2])[:1]
    latin_lower = upper.isascii() and upper.islower()
    return votes, (float(latin_lower), float(hi - lo))


_TITLE_SET = frozenset(w.casefold() for w in TITLE_CUES)


def _votes_matrix(spans: list[Span], kind: str) -> np.ndarray:
    names = LABELERS[kind]
    v = np.zeros((len(spans), len(names)))
    for i, sp in enumerate(spans):
        for k, x in sp.votes.items():
            v[i, names.index(k)] = x
    return v


def estimate(v: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each span, accuracy of each labeler) by expectation-maximisation over votes; 0 abstains.

    Spans are proposed freely, so the balance of true and false ones is no evidence and is held at one half.
    """
    acc = np.full(v.shape[1], PRIOR)
    p = np.full(len(v), 0.5)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(v @ np.log(acc / (1 - acc)))))
        agree = ((v > 0) * p[:, None] + (v < 0) * (1 - p)[:, None]).sum(0)
        acc = np.clip((agree + PRIOR * PRIOR_WEIGHT) / ((v != 0).sum(0) + PRIOR_WEIGHT), 0.5, 1 - 1e-4)
    return p, acc


class SpanModel:
    """One logistic classifier per type over votes and shape; ``accuracy`` has the labelers' estimated reliabilities."""

    def __init__(self, weights: dict[str, np.ndarray], accuracy: dict[str, dict[str, float]], gazetteer: Gazetteer, common: frozenset[str] = frozenset()):
        self.weights, self.accuracy, self.gazetteer, self.common = {k: w.tolist() for k, w in weights.items()}, accuracy, gazetteer, common
        self._by_name = {k: dict(zip(LABELERS[k], w[1:])) for k, w in self.weights.items()}

    @staticmethod
    def row(sp: Span) -> list[float]:
        votes = [float(sp.votes.get(n, 0)) for n in LABELERS[sp.kind]]
        return [1.0, *votes, *(sp.shape or (0.0,))]

    @classmethod
    def fit(cls, texts: list[str], gazetteer: Gazetteer | None = None, common: frozenset[str] = frozenset()) -> SpanModel:
        gazetteer = gazetteer or Gazetteer()
        by: dict[str, list[Span]] = {k: [] for k in TYPES}
        for t in texts:
            for sp in propose(t, gazetteer, common):
                by[sp.kind].append(sp)
        weights, accuracy = {}, {}
        for kind, spans in by.items():
            v = _votes_matrix(spans, kind) if spans else np.zeros((0, len(LABELERS[kind])))
            p, acc = estimate(v)
            accuracy[kind] = dict(zip(LABELERS[kind], acc.round(4).tolist()))
            n_shape = 2 if kind == "NAME" else 1
            start = np.concatenate([[0.0], np.log(acc / (1 - acc)), np.zeros(n_shape)])
            weights[kind] = cls._logistic(np.array([cls.row(s) for s in spans]), p, start) if spans else start
        return cls(weights, accuracy, gazetteer, common)

    @staticmethod
    def _logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, rounds: int = 200, rate: float = 0.5, keep: float = 0.01) -> np.ndarray:
        """Gradient descent on soft labels from the labelers' log odds, held near them where the sample says little."""
        w = start.copy()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(x @ w)))
            w -= rate * (x.T @ (p - y) / len(y) + keep * (w - start))
        return w

    def score(self, sp: Span) -> float:
        w, by = self.weights[sp.kind], self._by_name[sp.kind]
        z = w[0]
        for name, vote in sp.votes.items():
            z += by[name] * vote
        for a, b in zip(w[1 + len(by) :], sp.shape):
            z += a * b
        return 1 / (1 + float(np.exp(-z)))


def find(model: SpanModel, text: str, least: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(type, start, end, probability) of the spans of a text, in order and without overlaps; the surer one stays."""
    kept: list[tuple[str, int, int, float]] = []
    for sp in sorted(((model.score(s), s) for s in propose(text, model.gazetteer, model.common)), key=lambda x: (-x[0], x[1].s)):
        p, s = sp
        if p >= least and not any(a < s.e and s.s < b for _, a, b, _ in kept):
            kept.append((s.kind, s.s, s.e, round(p, 4)))
    return sorted(kept, key=lambda x: x[1])


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Text with each span replaced by its type in brackets."""
    out, at = [], 0
    for kind, s, e, _ in spans:
        out += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*out, text[at:]])


def fit_model(
    docs: DataFrame, gazetteer: Gazetteer | None = None, common: frozenset[str] = frozenset(), id_col: str = "id", text_col: str = "raw_text", limit: int = MAX_DOCUMENTS
) -> SpanModel:
    """Fit on the documents of the ``limit`` least hashes of their ids, whatever the layout of the files.

    The first pass sends hashes to the driver, the second only the texts of the sample.
    """
    h = F.xxhash64(F.col(id_col).cast("string"))
    last = docs.filter(F.col(id_col).isNotNull()).select(h.alias("h")).orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if last is None:
        return SpanModel.fit([], gazetteer, common)
    sample = docs.filter((h <= last) & (F.length(text_col) > 0)).select(h.alias("h"), text_col).distinct()
    rows = sample.orderBy("h", text_col).limit(limit).collect()
    return SpanModel.fit([r[1] for r in rows], gazetteer, common)


SPAN_SCHEMA = T.StructType(
    [T.StructField("document_id", T.StringType()), T.StructField("pii_type", T.StringType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("probability", T.DoubleType())]
)


def personal_spans(docs: DataFrame, model: SpanModel, id_col: str = "id", text_col: str = "raw_text") -> DataFrame:
    """One row per span found. Null and blank texts have none. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *sp) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for sp in find(model, t)]
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=SPAN_SCHEMA.names)

    return docs.select(F.col(id_col).cast("string").alias("document_id"), F.col(text_col).alias("t")).mapInArrow(run, SPAN_SCHEMA)


def masked_texts(docs: DataFrame, model: SpanModel, id_col: str = "id", text_col: str = "raw_text") -> DataFrame:
    """(document_id, masked_text, n_spans) of every text; null stays null."""
    schema = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("masked_text", T.StringType()), T.StructField("n_spans", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            spans = [find(model, t) if t else [] for t in texts]
            out = [None if t is None else masked(t, s) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array([len(s) for s in spans], pa.int32())], names=schema.names)

    return docs.select(F.col(id_col).cast("string").alias("document_id"), F.col(text_col).alias("t")).mapInArrow(run, schema)
