"""Sentence units of documents in many scripts, as SQL expressions.

Marks that do not end a sentence (in decimals, dates, addresses of the net, initials, abbreviations and quoted speech)
are masked with private-use characters; then the terminators of each script that are left cut the text. Every step but
the last keeps the length, so the units are cut from the original text by offsets and need no unmasking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.chars import BLANKS, BREAKS, PLAIN_FROM, PLAIN_TO, ZERO_WIDTH

IN_QUOTE, FULL, SPOKEN, MASKED, CUT = map(chr, (0xE001, 0xE002, 0xE003, 0xE004, 0xE005))
OPEN, OPEN_2, OPEN_FIRST, CLOSE, CLOSE_2 = map(chr, (0xE006, 0xE007, 0xE008, 0xE009, 0xE00A))  # “ « (“ at the start of a unit) ” »
_PRIVATE = "".join(map(chr, range(0xE000, 0xE00B)))
#: Terminators of the scripts, all read as one sign.
SCRIPT_STOPS = "।॥۔؟。｡！？"

#: Abbreviations that are followed by more of the sentence.
NEVER_LAST = (
    "mr mrs ms messrs mohd md dr prof sh smt shri kum no nos sq approx viz opp vs cf fig pp vol art sec ref tel mob regd pvt insp const supdt gen col capt lt sgt rs inr st "
    "sr sra sres srta ud uds núm pág págs mme mlle डॉ श्री सं क्र नं म कि मी प्रो रु मो चि सौ पो ता जि ডা ডঃ মো নং"
).split()
#: Abbreviations that may also be the last word of a sentence: they end it before a capital letter.
MAYBE_LAST = "ltd etc consult kg km gm ft yrs yr hrs hr min inc co bros svcs corp dept mg cm mm".split()
#: Words with which a sentence goes on where all letters are capitals.
GOES_ON = "AND BUT OR WHILE WHICH WHO WHOM WHOSE THAT LISTS LIST DOES DID DO WAS WERE IS HAS HAD TODAVÍA N'A ET Y PERO MAIS AUR LEKIN OF NEAR".split()
#: Words before an initial that are no names.
ROLES = "Accused Complainant Witness Informant Constable Inspector Officer Victim By To Of Shri Smt Mr Mrs Ms Dr Sh Km Sr Sra Mme Insp Plaignant Denunciante Testigo Témoin".split()
#: Words that carry on after quoted speech in scripts without capitals.
AFTER_SPEECH = "और पर तो आणि पण एवं এবং কিন্তু اور مگر และ แต่ 然后 并".split()

_Z = f"[{ZERO_WIDTH}]{{0,2}}"
_UP = "A-ZÀ-ÖØ-Þ"
_LOW = "a-zß-öø-ÿ"
_DIGIT = "0-9०-९০-৯۰-۹"
_TERMINATORS = "!?" + FULL


def _after(words: list[str], tail: str = "") -> str:
    """Look-behinds for a full stop after one of the words, one for each length, so each is tried at one place only.

    Invisible signs inside a Latin word are allowed for by a second, slower set that is tried near such a sign only.
    """
    head = r"(?<![\p{L}\p{M}&&[^\p{IsHan}]])"
    by: dict[int, list[str]] = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    fast = "|".join(rf"(?<={head}(?i:{'|'.join(ws)})\.)" for _, ws in sorted(by.items()))
    slow = "|".join(_Z.join(w) for w in words if w.isascii() and len(w) > 1)
    return rf"(?:{fast}|(?<=[{ZERO_WIDTH}].{{0,8}}\.)(?<={head}(?i:{slow}){_Z}\.)){tail}"


def _masks() -> str:
    """Full stops that end no sentence; the pattern looks at full stops only.

    What it looks back or ahead over is bounded by what the sign can be part of: 64 signs before an at-sign and 253 behind
    it are the limits of mail addresses, 40 letters those of a name before an initial.
    """
    word = r"(?<![\p{L}\p{M}&&[^\p{IsHan}]])"
    letter = rf"\p{{L}}\p{{M}}{{0,2}}{_Z}"
    capital = rf"(?=[ ]*[\"‘({OPEN}-{OPEN_FIRST}]?[{_UP}])(?![ ]*(?:{'|'.join(GOES_ON)})\b)"
    end = r"[ ]*+(?:\n|$)"
    surname = rf"(?:(?<![{_UP}][{_LOW}]{{2,40}} \p{{L}}\.)|(?<=(?:{'|'.join(ROLES)}) \p{{L}}\.))"  # or the initial of one: no end
    return r"\.(?<![a-z]{8}\.(?=[ \n]|$))(?:" + "|".join(
        [
            rf"(?={_Z}[{_DIGIT}])(?<=[{_DIGIT}]{_Z}\.)",
            rf"(?={_Z}[a-z0-9])(?<=[a-zA-Z0-9_+\-]{_Z}\.)",
            r"(?=[A-Z0-9._+\-]{1,64} ?(?:@|[\[(](?i:at)[\])]))",
            r"(?=[A-Z]{2})(?<=[@)\]] ?[A-Z0-9.\-]{1,253}\.)",
            # Initials: more of them, or a name, or more of the sentence follows.
            rf"(?<={word}{letter}\.)(?:(?={letter}\.)|(?<=\p{{L}}{_Z}\.{letter}\.)(?!{end})|(?<!\p{{L}}\.{letter}\.)(?:(?![ ]++[{_UP}]|{end})|(?=[ ]++[{_UP}]){surname}))",
            rf"(?<={word}(?i:[ap]{_Z}\.{_Z}m)\.)(?!{capital})(?!{end})",
            r"(?<=(?i:e\.g|i\.e)\.)",
            _after(NEVER_LAST),
            _after(MAYBE_LAST, rf"(?!{capital})(?!{end})"),
            rf"(?<={word}(?<![0-9] )(?i:km)\.)(?=[ ]+\p{{L}})",
        ]
    ) + ")"


def _cuts() -> str:
    close = rf"(?:[{CLOSE}\")\]'’{SPOKEN}]|[ ]?{CLOSE_2})*+"
    speech = rf"{IN_QUOTE}[ ]?[{CLOSE}{CLOSE_2}](?![ ]*+(?:[{_LOW},;:，]|(?:{'|'.join(AFTER_SPEECH)})[ ]?))"
    ways = "|".join(
        [
            rf"\.{{3,}}+(?![ ]*+(?:[{_LOW},;:]|(?:{'|'.join(GOES_ON)})\b)){close}",
            rf"(?<!\.)(?!\.{{3}})[.{_TERMINATORS}]++{close}(?![.,;]|{SPOKEN})",
            r"(?=\n)",
            r"\|(?<=[ऀ-৿][ ]?\|)(?![|])",
            speech,
        ]
    )
    # The end of a unit and the blanks after it are two groups, so that both can be cut.
    return rf"(?=[.\n|!?{IN_QUOTE}-{FULL}])({ways})([ \n]*+)"


_THAI = "[ก-๛]"
#: Blanks between Thai words end a sentence; those beside other letters only before a long stretch of these.
_THAI_CUT = rf" (?<=[฀-๿\xad\u2000-\u206f\ufeff] )(?<={_THAI}[{ZERO_WIDTH}]? )[ ]*+(?=[{ZERO_WIDTH}]?{_THAI}|[ऀ-৿؀-ۿ]|[\"{OPEN}-{OPEN_FIRST}]?[A-Z][^฀-๿\n]{{40}})(?!ๆ)"


def unit_offsets(text: Column) -> Column:
    """array<struct<s: int, e: int>> of the sentence units of a text, in order; empty for null and blank texts.

    A line break always ends a unit. A unit keeps its closing marks and quotes and has no white space around it.
    """
    stops = [c for c in SCRIPT_STOPS if c not in PLAIN_FROM]
    from_ = PLAIN_FROM + BREAKS + "\r" + _PRIVATE + "".join(stops) + "“«”»"
    to = PLAIN_TO + "\n" * (len(BREAKS) + 1) + " " * len(_PRIVATE) + FULL * len(stops) + OPEN + OPEN_2 + CLOSE + CLOSE_2
    m = F.translate(text, from_, to)
    # Speech that opens a unit goes on after its quotes; marks inside closed quotes are masked.
    m = F.regexp_replace(m, rf"{OPEN}(?=[^{CLOSE}\n]*+{CLOSE})(?<=(?:^|[\n.!?{FULL}|{CLOSE}])[ ]{{0,3}}{OPEN})", OPEN_FIRST)
    m = F.regexp_replace(m, rf"((?:[{OPEN}-{OPEN_FIRST}](?=[^{CLOSE}-{CLOSE_2}\n]*+[{CLOSE}-{CLOSE_2}])|\G(?!^))[^{CLOSE}-{CLOSE_2}\n.!?{FULL}]*+)[.!?{FULL}]", f"$1{IN_QUOTE}")
    m = F.regexp_replace(m, rf"{OPEN_FIRST}([^{CLOSE}\n]*+){CLOSE}", f"{OPEN_FIRST}$1{SPOKEN}")
    m = F.regexp_replace(m, _masks(), MASKED)
    m = F.regexp_replace(m, _cuts(), f"$1{CUT}$2{CUT}")
    m = F.regexp_replace(m, _THAI_CUT, f"{CUT}$0{CUT}")
    pieces = F.split(m, CUT)  # units and the blanks between them in turn
    zero = F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<s:int,e:int>>").alias("u"))

    def step(a: Column, x: Column) -> Column:
        n = F.length(x)
        right = F.length(F.rtrim(x))
        left = right - F.length(F.ltrim(F.rtrim(x)))
        unit = F.struct((a["p"] + left).cast("int").alias("s"), (a["p"] + right).cast("int").alias("e"))
        return F.struct((a["p"] + n).cast("int").alias("p"), F.when(x.rlike("[^ \n]"), F.array_append(a["u"], unit)).otherwise(a["u"]).alias("u"))

    units = F.aggregate(pieces, zero, step, lambda a: a["u"])
    return F.coalesce(units, F.array().cast("array<struct<s:int,e:int>>"))


def sentence_units(docs: DataFrame, id_col: str = "id", text_col: str = "raw_text") -> DataFrame:
    """(document_id, unit_no, start_char, end_char) of every unit; map-only. Null and blank texts have none."""
    rows = docs.select(F.col(id_col).alias("document_id"), F.posexplode(unit_offsets(F.col(text_col))).alias("unit_no", "u"))
    return rows.select("document_id", (F.col("unit_no") + 1).alias("unit_no"), F.col("u.s").alias("start_char"), F.col("u.e").alias("end_char"))
