"""Variant spellings of the names of persons and organisations, linked within one scope (an intake).

Names are romanised, split into tokens and coded phonetically (consonant classes). Names that share the code of any of
their sorted tokens are candidates; candidates are compared token by token with Jaro-Winkler and edit distance, with a
table of nicknames, and accepted pairs are clustered by connected components. Names that are too short to stand alone
(initials, a given name, a declared alias) join a component only where that is the only one they fit.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.gazetteer import Gazetteer, edits, script_of, short_vowels, squeezed
from threadloom.llm.lookalikes import consistent_form

#: Short and colloquial forms of given names, to the full form: a small general table. What a corpus uses is learnt on
#: top of it (``gazetteer.learn_variants``); ``Lexicon(nicknames={})`` does without.
NICKNAMES = {
    "mohd": "mohammad", "md": "mohammad", "muhammad": "mohammad", "mohammed": "mohammad", "mohamed": "mohammad", "kk": "krishnakant", "krishna": "krishnakant", "krishan": "krishnakant",
    "raju": "rajendra", "rajinder": "rajendra", "rajender": "rajendra", "surinder": "surendra", "surender": "surendra", "mahinder": "mahendra", "mahender": "mahendra", "jitender": "jitendra", "jitu": "jitendra",
    "narinder": "narendra", "narender": "narendra", "dharam": "dharmendra", "nandu": "nandlal", "jaggi": "jagmohan", "bablu": "balbir", "pappu": "prakash", "guddu": "gulab", "sonu": "sunil", "monu": "manoj", "bittu": "vikram",
    "bill": "william", "bob": "robert", "dick": "richard", "jim": "james", "joe": "joseph", "liz": "elizabeth", "kate": "katherine", "peggy": "margaret", "ted": "edward", "tony": "anthony", "pepe": "jose", "paco": "francisco",
}
#: Common given names that differ in one or two letters only, for use without a corpus to learn from.
GIVEN = frozenset("ramesh rakesh mukesh mahesh suresh naresh dinesh rajesh umesh nitesh savita kavita sunita anita vinita lalita sarita sushila kamla vimla krishnakant".split())
MIDDLE = frozenset("kumar kumaar kumari kumaaree kmar devi devee lal laal singh".split())
TITLES = frozenset("mr mrs ms dr shri sri smt sh km kumari late prof insp asi si const sr sra srta mme mlle don".split())

_LATIN_EXTRA = str.maketrans({"ß": "ss", "ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe"})
_INDIC_CONSONANTS = "k kh g gh n ch chh j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v sh sh s h".split()  # in the order of the code charts
_INDIC_VOWELS = {0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ee", 0x09: "u", 0x0A: "oo", 0x0B: "ri", 0x0F: "e", 0x0D: "e", 0x10: "ai", 0x11: "o", 0x13: "o", 0x14: "au"}
_INDIC_SIGNS = {0x3E: "aa", 0x3F: "i", 0x40: "ee", 0x41: "u", 0x42: "oo", 0x43: "ri", 0x45: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4B: "o", 0x4C: "au"}
_NUKTA = {"k": "q", "kh": "kh", "g": "g", "j": "z", "ph": "f"}
_ARABIC = {
    "ا": "a", "آ": "a", "أ": "a", "ب": "b", "پ": "p", "ت": "t", "ٹ": "t", "ث": "s", "ج": "j", "چ": "ch", "ح": "h", "خ": "kh", "د": "d", "ڈ": "d", "ذ": "z", "ر": "r", "ڑ": "d", "ز": "z", "ژ": "z",
    "س": "s", "ش": "sh", "ص": "s", "ض": "z", "ط": "t", "ظ": "z", "ع": "a", "غ": "g", "ف": "f", "ق": "q", "ک": "k", "گ": "g", "ل": "l", "م": "m", "ن": "n", "ں": "n", "و": "v", "ؤ": "v", "ہ": "h",
    "ۃ": "h", "ھ": "h", "ی": "y", "ے": "e", "ئ": "y", "ء": "",
}


def _indic(text: str, base: int) -> str:
    """Roman letters of a text in a script of the Indic code charts that begins at ``base``."""
    out: list[str] = []
    i, n = 0, len(text)
    while i < n:
        o = ord(text[i]) - base
        if base == 0x980 and text[i] in "ওো" and text[i + 1 : i + 3] == "য়":  # drawn so for w
            out.append("o" if text[i] == "ো" else "")
            out.append("w")
            i += 3
            if not (i < n and 0x3E <= ord(text[i]) - base <= 0x4D):
                out.append("a")
            continue
        if 0x15 <= o <= 0x39:
            c = _INDIC_CONSONANTS[o - 0x15]
            if i + 1 < n and ord(text[i + 1]) - base == 0x3C:
                c = _NUKTA.get(c, c)
                i += 1
            out.append(c)
            nxt = ord(text[i + 1]) - base if i + 1 < n else -1
            if nxt == 0x4D:
                i += 1
            elif nxt not in _INDIC_SIGNS and i + 1 < n and text[i + 1].isalpha():
                out.append("a")
        elif o in _INDIC_VOWELS:
            out.append(_INDIC_VOWELS[o])
        elif o in _INDIC_SIGNS:
            out.append(_INDIC_SIGNS[o])
        elif o in (0x01, 0x02):
            labial = i + 1 < n and 0x2A <= ord(text[i + 1]) - base <= 0x2E
            out.append("m" if labial else "n")
        i += 1
    return "".join(out)


@lru_cache(200_000)
def roman(token: str) -> str:
    """A lower-case token in plain Latin letters."""
    if not token:
        return ""
    s = script_of(token)
    if s == "devanagari":
        return _indic(token, 0x900)
    if s == "bengali":
        return _indic(token, 0x980)
    if s == "arabic":
        return "".join(_ARABIC.get(c, "") for c in token)
    t = unicodedata.normalize("NFKD", token).translate(_LATIN_EXTRA)
    return "".join(c for c in t if not unicodedata.combining(c))


_CODE = [("chh", "c"), ("ch", "c"), ("ph", "f"), ("sh", "s"), ("zh", "j"), ("kh", "k"), ("gh", "g"), ("jh", "j"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("ck", "k"), ("w", "v"), ("z", "j"), ("q", "k"), ("x", "k")]


@lru_cache(200_000)
def code(word: str) -> str:
    """Consonant classes of a Roman word; a leading vowel counts as ``a``."""
    s = word
    for a, b in _CODE:
        s = s.replace(a, b)
    head = "a" if s[:1] in tuple("aeiou") else ""
    s = re.sub(r"[aeiouyh'’]", "", s)
    return head + re.sub(r"(.)\1+", r"\1", s)


def same_code(a: str, b: str, sa: str, sb: str) -> bool:
    """Equal codes, with what the scripts of the two leave open: Bengali has no v, Arabic writes v and long o alike."""
    if "bengali" in (sa, sb):
        a, b = (re.sub(r"(.)\1+", r"\1", x.replace("v", "b")) for x in (a, b))
    if "arabic" in (sa, sb):
        a, b = (re.sub(r"(.)\1+", r"\1", x.replace("v", "")) for x in (a, b))
    return a == b


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(la, lb) // 2 - 1
    used = [False] * lb
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(hits, (b[j] for j in range(lb) if used[j]))) / 2
    jaro = (m / la + m / lb + (m - t) / m) / 3
    p = 0
    while p < min(4, la, lb) and a[p] == b[p]:
        p += 1
    return jaro + 0.1 * p * (1 - jaro)


def _plain_sounds(word: str) -> str:
    for a, b in (("w", "v"), ("v", "b"), ("z", "j"), ("q", "k"), ("ph", "f"), ("y", "i"), ("ii", "i"), ("h", "")):
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


def _no_v(word_code: str) -> str:
    return squeezed(word_code.replace("v", ""))


class Lexicon:
    """Given names that are spellings of their own, and short forms; two different given names are never one.

    ``given``: settled Roman spellings; ``nicknames``: form to full form; ``other``: script to (Roman form of a settled
    spelling in it, to its Latin spelling).
    """

    def __init__(self, given: frozenset[str] = GIVEN, nicknames: dict[str, str] = NICKNAMES, other: dict[str, dict[str, str]] | None = None):
        self.given, self.nicknames, self.other = given, nicknames, other or {}
        self._build()

    def __getstate__(self) -> tuple:
        return self.given, self.nicknames, self.other

    def __setstate__(self, state: tuple) -> None:
        self.given, self.nicknames, self.other = state
        self._build()

    def _build(self) -> None:
        names = sorted(self.given)
        self._short = {short_vowels(g): g for g in names}
        by: dict[str, list[str]] = defaultdict(list)
        no_v: dict[str, list[str]] = defaultdict(list)
        with_b: dict[str, list[str]] = defaultdict(list)
        for g in names:
            by[code(g)].append(g)
            no_v[_no_v(code(g))].append(g)
            with_b[code(g).replace("v", "b")].append(g)
        self._code = {k: v[0] for k, v in by.items() if len(v) == 1}
        self._no_v = {k: v[0] for k, v in no_v.items() if len(v) == 1}
        self._with_b = dict(with_b)
        self._known: dict[tuple, str | None] = {}
        self._match: dict[tuple, bool] = {}

    def known(self, token: str, script: str) -> str | None:
        """The given name that a Roman token spells, if any."""
        key = (token, script)
        if key not in self._known:
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[key] = self._find(token, script)
        return self._known[key]

    def _find(self, token: str, script: str) -> str | None:
        t = token.replace("-", "")
        if hit := self.other.get(script, {}).get(t):
            return hit
        t = self.nicknames.get(t, t)
        if t in self.given:
            return t
        t = short_vowels(t)
        t = self.nicknames.get(t, t)
        if t in self._short:
            return self._short[t]
        if script == "arabic":
            c = code(token)
            if len(c) >= 3 and c in self._code:
                return self._code[c]
            return self._no_v.get(_no_v(c)) if len(_no_v(c)) >= 3 else None
        if script != "latin":
            for g in self._with_b.get(code(t).replace("v", "b"), ()):
                if jaro_winkler(_plain_sounds(t), _plain_sounds(g)) >= 0.85:
                    return g
        return None

    def compound(self, joined: str, script: str) -> bool:
        """Whether parts written together spell one longer given name."""
        if self.known(joined, script):
            return True
        c = code(joined)
        return len(c) >= 4 and (c in self._code or script == "arabic" and _no_v(c) in self._no_v)

    def match(self, a: str, b: str, sa: str, sb: str) -> bool:
        """Whether two full Roman tokens spell one name."""
        key = (a, b, sa, sb)
        if key not in self._match:
            if len(self._match) > 400_000:
                self._match.clear()
            self._match[key] = self._same(a, b, sa, sb)
        return self._match[key]

    def _same(self, a: str, b: str, sa: str, sb: str) -> bool:
        if a == b:
            return True
        na, nb = self.nicknames.get(a, a), self.nicknames.get(b, b)
        if na == nb:
            return True
        ga, gb = self.known(a, sa), self.known(b, sb)
        if ga and gb:
            return ga == gb
        ca, cb = code(a), code(b)
        if sa != sb or "arabic" in (sa, sb):
            if same_code(ca, cb, sa, sb) and min(len(ca), len(cb)) >= 2:
                return True
            ca, cb = code(na), code(nb)
            if same_code(ca, cb, sa, sb) and min(len(ca), len(cb)) >= 2:
                return True
            return min(len(ca), len(cb)) >= 3 and ca[0] == cb[0] and edits(ca, cb, 1) <= 1
        if ca == cb and len(ca) >= 3:
            return True
        n = min(len(a), len(b))
        most = 1 if n < 7 else 2
        if n < 3:
            return False
        return (edits(a, b, most) <= most and jaro_winkler(a, b) >= (0.86 if n >= 5 else 0.8)) or (edits(squeezed(a), squeezed(b), 1) <= 1 and n >= 4 and jaro_winkler(a, b) >= 0.85)


PLAIN_LEXICON = Lexicon()


def lexicon_of(gazetteer: Gazetteer, variants: dict[str, str], nicknames: dict[str, str] = NICKNAMES) -> Lexicon:
    """Settled given names of a corpus, each spelling in another script with the Latin one that it stands for."""
    latin: dict[str, int] = {}
    for w in gazetteer.settled:
        if gazetteer.kinds[w] == "G" and script_of(w) == "latin":
            latin[roman(w)] = latin.get(roman(w), 0) + gazetteer.person[w]
    plain = Lexicon(frozenset(latin), {})
    other: dict[str, dict[str, str]] = {}
    for w in sorted(gazetteer.settled):
        script = script_of(w)
        if gazetteer.kinds[w] == "G" and script != "latin":
            r = roman(w)
            hit = plain.known(r, script)
            if not hit:  # the closest Latin name whose consonants agree but for one
                near = [(jaro_winkler(_plain_sounds(r), _plain_sounds(g)), g) for g in sorted(latin) if edits(_no_v(code(r)), _no_v(code(g)), 1) <= 1]
                score, hit = max(near, default=(0.0, None))
                hit = hit if score >= 0.8 else None
            if hit:
                other.setdefault(script, {})[r] = hit
    learnt = {roman(a).replace("-", ""): roman(b) for a, b in variants.items() if roman(b) in latin and roman(a) not in latin}
    table = {k: v for k, v in nicknames.items() if k not in latin and v in latin} | learnt
    return Lexicon(frozenset(latin), table, other)


_SPLIT = re.compile(r"[^\w़-्ऀ-ः॑-ॗঁ-ঃ়-্ً-ٰٕ]+")


class Name:
    """A distinct spelling of a person's name within a scope."""

    __slots__ = ("text", "tokens", "initials", "scripts", "joined", "given", "lexicon")

    def __init__(self, text: str, lexicon: Lexicon = PLAIN_LEXICON):
        self.text, self.lexicon = text, lexicon
        parts = [p for p in _SPLIT.split(text.replace("'", "").replace("’", "")) if p and not p.isdigit()]
        dotted = re.match(r"^(\w)\.\s?(\w)\.", text)
        if dotted and dotted[1] + dotted[2] in lexicon.nicknames:  # two initials that stand for one name
            parts = [dotted[1] + dotted[2]] + parts[2:]
        parts = [p for p in parts if p not in TITLES] or parts
        full = [p for p in parts if len(p) > 1 or script_of(p) == "other"]
        if len(full) > 2:
            full = [p for p in full if roman(p) not in MIDDLE] or full
        self.initials = [roman(p) for p in parts if len(p) == 1]
        self.tokens = [roman(p) for p in full]
        self.scripts = [script_of(p) for p in full]
        if len(self.tokens) in (2, 3):  # a given name written apart
            for k in range(len(self.tokens) - 1):
                both = self.tokens[k] + self.tokens[k + 1]
                if not lexicon.known(self.tokens[k + 1], self.scripts[k]) and lexicon.compound(both, self.scripts[k]):
                    self.tokens[k : k + 2] = [both]
                    del self.scripts[k + 1]
                    break
        self.joined = "".join(self.tokens)
        self.given = frozenset(g for t, s in zip(self.tokens, self.scripts) if (g := lexicon.known(t, s)))

    def codes(self) -> set[str]:
        """Blocking keys: the phonetic codes of the sorted tokens, and the first classes of all of them."""
        nick = self.lexicon.nicknames
        keys = {re.sub("[bv]", "", code(nick.get(t, t)))[:3] for t in sorted(self.tokens)}
        return keys | {"+" + "".join(sorted(code(nick.get(t, t))[:1].replace("v", "b") for t in self.tokens))}


def part_codes(token: str, lexicon: Lexicon) -> set[str]:
    """Blocking keys of one part: its first consonant classes, the first and the last one, and its given name."""
    c = re.sub("[bv]", "", code(lexicon.nicknames.get(token, token)))
    keys = {c[:3], "^" + c[:1], "$" + c[-2:]}
    return keys | {"=" + g for s in ("latin", "devanagari", "bengali", "arabic") if (g := lexicon.known(token, s))}


def same_person(a: Name, b: Name) -> bool:
    """Whether two full names (two tokens at least) are spellings of one."""
    x, y = a.tokens, b.tokens
    sx, sy = a.scripts, b.scripts
    token_match = a.lexicon.match
    if len(x) == 2 and len(y) == 2:
        if token_match(x[0], y[0], sx[0], sy[0]) and token_match(x[1], y[1], sx[1], sy[1]):
            return True
        return token_match(x[0], y[1], sx[0], sy[1]) and token_match(x[1], y[0], sx[1], sy[0])
    if len(x) == len(y):
        return sorted(x) == sorted(y)
    # Parts written together or apart: the whole string counts, in any rotation.
    s, t = sx[0], sy[0]
    for i in range(len(y)):
        other = "".join(y[i:] + y[:i])
        for k in range(len(x)):
            if token_match("".join(x[k:] + x[:k]), other, s, t):
                return True
    return False


class Components:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link_persons(texts: list[str], phones: list[frozenset], groups: list[frozenset], lexicon: Lexicon = PLAIN_LEXICON) -> list[int]:
    """Component of each distinct name of a scope.

    ``phones``: identifiers seen near the spelling; ``groups``: (alias group, role) pairs it was declared in.
    """
    names = [Name(t, lexicon) for t in texts]
    token_match = lexicon.match
    comp = Components(len(names))
    full = [i for i, n in enumerate(names) if len(n.tokens) >= 2]
    blocks: dict[str, list[int]] = defaultdict(list)
    for i in full:
        for k in names[i].codes():
            blocks[k].append(i)
    seen = set()
    given = {i: set(names[i].given) for i in full}  # known given names of each component
    for block in blocks.values():
        for p, i in enumerate(block):
            for j in block[p + 1 :]:
                a, b = comp.find(i), comp.find(j)
                if a != b and (i, j) not in seen:
                    seen.add((i, j))
                    if (not given[a] or not given[b] or given[a] & given[b]) and same_person(names[i], names[j]):
                        comp.join(a, b)
                        given[min(a, b)] |= given[max(a, b)]

    def members() -> dict[int, list[int]]:
        out: dict[int, list[int]] = defaultdict(list)
        for i in full:
            out[comp.find(i)].append(i)
        return out

    clusters = members()
    # Components by the codes of their parts: short names meet only those they can belong to.
    by_part: dict[str, set[int]] = defaultdict(set)
    codes_of: dict[str, set[str]] = {}
    for c, m in clusters.items():
        for t in {t for j in m for t in names[j].tokens}:
            for k in codes_of.setdefault(t, part_codes(t, lexicon)):
                by_part[k].add(c)

    def near_parts(t: str) -> list[int]:
        return sorted(set().union(*(by_part[k] for k in part_codes(t, lexicon) if k in by_part)))

    near = {c: frozenset().union(*(phones[i] for i in m)) for c, m in clusters.items()}
    weak: dict[tuple, list[int]] = defaultdict(list)

    def attach(i: int, fits: list[int]) -> None:
        """To the only component that fits, or the only one of them with a shared identifier."""
        if len(fits) > 1:
            fits = [c for c in fits if near[c] & phones[i]]
        if len(fits) == 1:
            comp.join(i, fits[0])

    declared: dict[str, set[int]] = defaultdict(set)  # alias spelling to the components of its primaries
    primary: dict[str, int] = {}
    for i, g in enumerate(groups):
        for name, role in g:
            if role == "primary":
                primary[name] = i
    for i, n in enumerate(names):
        if len(n.tokens) >= 2 and i in clusters.get(comp.find(i), ()) and not any(r == "alias" for _, r in groups[i]):
            continue
        fits = []
        if len(n.tokens) >= 2:
            continue
        key = (tuple(n.tokens), tuple(n.initials))
        weak[key].append(i)
        if n.tokens and n.initials:
            t, s, first = n.tokens[0], n.scripts[0], n.initials[0][:1]
            for c in near_parts(t):
                for j in clusters[c]:
                    x = names[j]
                    if len(x.tokens) == 2 and any(
                        token_match(t, x.tokens[k], s, x.scripts[k]) and (x.tokens[1 - k][:1] == first or code(x.tokens[1 - k])[:1] == code(first)[:1] != "") for k in (0, 1)
                    ):
                        fits.append(c)
                        break
            attach(i, fits)
        elif n.tokens:
            t, s = n.tokens[0], n.scripts[0]
            for c in near_parts(t):
                m = clusters[c]
                if any(token_match(t, names[j].tokens[0], s, names[j].scripts[0]) or token_match(t, names[j].tokens[-1], s, names[j].scripts[-1]) for j in m):
                    fits.append(c)
            attach(i, fits)
    # Declared aliases: through their group to the primary; other rows of the alias where one person alone bears it.
    for i, g in enumerate(groups):
        for name, role in g:
            if role == "alias" and name in primary:
                declared[" ".join(names[i].tokens)].add(comp.find(primary[name]))
    declared_codes: dict[tuple, set[int]] = defaultdict(set)
    for i, g in enumerate(groups):
        if names[i].joined and any(r == "alias" and a in primary for a, r in g):
            declared_codes[code(names[i].joined), script_of(texts[i])] |= declared[" ".join(names[i].tokens)]
    for i, n in enumerate(names):
        key = " ".join(n.tokens)
        owners = {comp.find(c) for c in declared.get(key, ())}
        if n.joined and not n.initials and len(n.tokens) <= 2:  # the alias in other scripts
            mine = code(n.joined)
            for (k, script), cs in declared_codes.items():
                if script != script_of(n.text) and same_code(k, mine, script, script_of(n.text)):
                    owners |= {comp.find(c) for c in cs}
        if len(owners) == 1 and (len(n.tokens) == 1 or any(r == "alias" for _, r in groups[i])):
            comp.join(i, next(iter(owners)))
    # The same short spelling, however cased, is one name where it fits nowhere else.
    for same in weak.values():
        free = [i for i in same if comp.find(i) == i]
        for i in free[1:]:
            comp.join(free[0], i)
    return [comp.find(i) for i in range(len(names))]


LEGAL = frozenset("pvt private ltd limited p inc llp llc plc co corp corporation".split())
KINDS = {
    "svcs": "services", "service": "services", "consult": "consultants", "consultant": "consultants", "consultancy": "consultants", "co": "company", "agencies": "agency", "trader": "traders", "mill": "mills", "tour": "tours", "travel": "travels",
}
KIND_WORDS = frozenset("services placement job agency traders logistics textile mills hospitality tours travels finance leasing manpower consultants transport company and of the".split())


class Firm:
    """A distinct spelling of an organisation's name."""

    __slots__ = ("core", "kinds", "acronym", "letters")

    def __init__(self, text: str):
        t = re.sub(r"^\s*(m/s|messrs)\.?\s+", "", text)
        inner = re.findall(r"\(([^)]{2,8})\)", t)
        t = re.sub(r"\([^)]*\)", " ", t).replace("&", " and ")
        words = [roman(w) for w in _SPLIT.split(t) if w]
        while len(words) > 1 and words[-1] in LEGAL and words[-1] != "co":
            words.pop()
        words = [KINDS.get(w, w) for w in words]
        self.kinds = tuple(w for w in words if w in KIND_WORDS and w not in ("and", "of", "the"))
        core = [w for w in words if w not in KIND_WORDS]
        self.core = "".join(core)
        self.acronym = inner[0].lower() if inner else ""
        kinds = [w for w in words if w in KIND_WORDS]
        self.letters = "".join(w[0] for w in core + kinds)


def same_kinds(a: tuple, b: tuple) -> bool:
    """Equal kinds, or one a leading part of the other; typing errors allowed."""
    if len(a) > len(b):
        a, b = b, a
    return all(PLAIN_LEXICON.match(x, y, "latin", "latin") for x, y in zip(a, b))


def same_firm(a: Firm, b: Firm) -> bool:
    if not a.core or not b.core:
        return False
    most = 1 if min(len(a.core), len(b.core)) < 8 else 2
    ca, cb = code(a.core), code(b.core)
    if a.core != b.core and not (edits(a.core, b.core, most) <= most and jaro_winkler(a.core, b.core) >= 0.86) and not (ca == cb and len(ca) >= 4) and not (min(len(ca), len(cb)) >= 5 and edits(ca, cb, 1) <= 1 and jaro_winkler(a.core, b.core) >= 0.9):
        return False
    return bool(a.kinds) == bool(b.kinds) and same_kinds(a.kinds, b.kinds)


def core_codes(core: str) -> set[str]:
    """Blocking keys of a firm's core: its first letters, and its first and last consonant classes."""
    c = code(core)
    return {"<" + core[:3], "<" + core[:2] + core[3:4], c[:3], ">" + c[-3:]}


def link_firms(texts: list[str]) -> list[int]:
    firms = [Firm(t) for t in texts]
    comp = Components(len(firms))
    blocks: dict[str, list[int]] = defaultdict(list)
    for i, f in enumerate(firms):
        for k in {f.kinds[:1] + (f.core[:1],), ("", code(f.core)[:4]), ("", code(f.core)[-3:])}:
            blocks[k].append(i)
    for block in blocks.values():
        for p, i in enumerate(block):
            for j in block[p + 1 :]:
                if comp.find(i) != comp.find(j) and same_firm(firms[i], firms[j]):
                    comp.join(i, j)
    # A kind that was left out: to the only firm whose core is near, by blocks of cores, or whose initials it has.
    cores: dict[str, set[int]] = defaultdict(set)
    short: dict[str, set[int]] = defaultdict(set)
    for i, f in enumerate(firms):
        if f.kinds:
            cores[f.core].add(comp.find(i))
            for k in {f.letters, f.acronym}:
                short[k].add(i)
    core_blocks: dict[str, list[str]] = defaultdict(list)
    for k in cores:
        for b in core_codes(k):
            core_blocks[b].append(k)
    for i, f in enumerate(firms):
        if not f.kinds and f.core:
            near = {k for b in core_codes(f.core) for k in core_blocks.get(b, ())}
            owners = {comp.find(c) for k in near if k and (f.core == k or f.core.startswith(k) or edits(f.core, k, 1) <= 1) for c in cores[k]}
            if not owners and len(f.core) >= 3:
                owners = {comp.find(j) for j in short.get(f.core, ())}
            if len(owners) == 1:
                comp.join(i, next(iter(owners)))
    return [comp.find(i) for i in range(len(firms))]


def _link_group(kind: str, rows: list[tuple], lexicon: Lexicon) -> list[tuple[int, str, bool]]:
    """(hash, entity, whether that has several spellings) of the distinct spellings (hash, text, phones, [(alias group, role)], first id) of one scope and kind."""
    keys: dict[str, int] = {}
    phones: list[set] = []
    groups: list[set] = []
    at = []
    for _, text, near, declared, _ in rows:
        form = " ".join(consistent_form(text).casefold().split())
        k = keys.setdefault(form, len(keys))
        if k == len(phones):
            phones.append(set())
            groups.append(set())
        phones[k].update(x for x in near or () if x)
        groups[k].update((d["alias_group"], d["alias_role"]) for d in declared or () if d["alias_group"] and d["alias_role"])
        at.append(k)
    texts = list(keys)
    if kind == "PERSON":
        comp = link_persons(texts, [frozenset(p) for p in phones], [frozenset(g) for g in groups], lexicon)
    else:
        comp = link_firms(texts)
    first: dict[int, str] = {}
    for r, k in zip(rows, at):
        if comp[k] not in first or r[4] < first[comp[k]]:
            first[comp[k]] = r[4]
    n = Counter(comp[k] for k in at)
    return [(r[0], first[comp[k]], n[comp[k]] > 1) for r, k in zip(rows, at)]


SPELLING_SCHEMA = T.StructType([T.StructField("scope", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("h", T.LongType()), T.StructField("entity", T.StringType()), T.StructField("several", T.BooleanType())])


def link_names(rows: DataFrame, lexicon: Lexicon = PLAIN_LEXICON) -> DataFrame:
    """(scope, kind, id, entity, h, several) of each named row: ``entity`` is the smallest id of its component, ``h`` tells
    its text, ``several`` whether the component has more than one.

    ``rows``: scope, kind (PERSON or ORGANIZATION), id, text, near array<string>, alias_group, alias_role; blank texts
    and null scopes are left out, a row delivered twice counts once. Rows are first reduced to the distinct spellings of
    their scope; a task holds the spellings of one scope and kind at a time, not its rows, and rows get their entity by
    an equi-join on scope and spelling, so a scope with a third of all rows is spread by its spellings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, held = None, []

        def close() -> None:
            if held:
                out.extend((now[0], now[1], *linked) for linked in _link_group(now[1], held, lexicon))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=SPELLING_SCHEMA.names)

        for b in batches:
            for scope, kind, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if (scope, kind) != now:
                    close()
                    now, held = (scope, kind), []
                    if len(out) > 20_000:
                        yield flush()
                held.append(tuple(rest))
        close()
        yield flush()

    src = rows.select("scope", "kind", "id", "text", "near", "alias_group", "alias_role").filter(
        F.col("scope").isNotNull() & F.col("id").isNotNull() & F.col("kind").isin("PERSON", "ORGANIZATION") & (F.length(F.trim("text")) > 0)
    )
    src = src.withColumn("h", F.xxhash64("text", F.length("text")))
    declared = F.when(F.col("alias_group").isNotNull() & F.col("alias_role").isNotNull(), F.struct("alias_group", "alias_role"))
    spellings = src.groupBy("scope", "kind", "h").agg(
        F.min("text").alias("text"), F.array_distinct(F.flatten(F.collect_set("near"))).alias("near"), F.collect_set(declared).alias("declared"), F.min("id").alias("first_id")
    )
    spellings = spellings.select("scope", "kind", "h", "text", "near", "declared", "first_id").repartition("scope").sortWithinPartitions("scope", "kind", "h")
    linked = spellings.mapInArrow(run, SPELLING_SCHEMA)
    once = src.groupBy("scope", "kind", "id").agg(F.min("h").alias("h"))
    return once.join(linked, ["scope", "kind", "h"]).select("scope", "kind", "id", "entity", "h", "several")


def entity_mentions(entities: DataFrame) -> DataFrame:
    """Input rows of ``link_names`` from the entities table; broken metadata counts as none."""
    meta = F.from_json("metadata_json", "nearby_ids array<string>, alias_group string, alias_role string")
    return entities.select(F.col("intake_id").alias("scope"), F.col("entity_type").alias("kind"), "id", F.col("raw_text").alias("text"), meta.alias("m")).select(
        "scope", "kind", "id", "text", F.col("m.nearby_ids").alias("near"), "m.alias_group", "m.alias_role"
    )


def variant_pairs(links: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b) of linked rows whose texts differ in code points, id_a < id_b.

    The text of a row is told by the hash that ``link_names`` gives with it; only entities with several spellings are joined.
    """
    d = links.filter("several").select("entity", "kind", "id", "h")
    a, b = d.toDF("entity", "kind", "id_a", "h_a"), d.toDF("entity", "kind", "id_b", "h_b")
    return a.join(b, ["entity", "kind"]).filter("id_a < id_b AND h_a <> h_b").select("id_a", "id_b")
