"""Character tables shared by the text operators; all of them keep the length of a text."""

from __future__ import annotations

import re

#: Letters of other scripts that look like Latin letters, in the order of LATIN_OF. Fixed values (Unicode confusables).
LOOKALIKE = "АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝѵɑɡᴏΑΒΕΖΗΙΚΜΝΟΡΤΥΧΥαιονρυϲ"
LATIN_OF = "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwvagoABEZHIKMNOPTYXYaiovpuc"
assert len(LOOKALIKE) == len(LATIN_OF)

#: Letters of further scripts that are drawn like a Latin letter: script to (its letters, the Latin ones). Fixed values
#: (Unicode confusables, whole-shape ones only).
MORE_LOOKALIKES = {
    "armenian": ("ՍՕօսոհցզյ", "UOounhgqj"),
    "cherokee": ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ"),
    "lisu": ("ꓮꓐꓚꓓꓰꓝꓖꓧꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHJKLMNOPRSTUVWXYZ"),
}

#: Every kind of blank but the line breaks.
BLANKS = "\t  " + "".join(map(chr, range(0x2000, 0x200B))) + "  　"
BREAKS = "\x0b\x0c\x85  "
#: Signs without a shape of their own.
INVISIBLE = "­͏؜᠎​‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
JOINERS = "‌‍"
ZERO_WIDTH = INVISIBLE + JOINERS

FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF_OF = "".join(map(chr, range(0x21, 0x7F)))
DASHES, DASH_OF = "‐‑‒–−﹘﹣", "-------"

#: For matching only: full-width forms, look-alikes, blanks and dashes to the ordinary sign, one for one.
PLAIN_FROM = FULL_WIDTH + LOOKALIKE + BLANKS + DASHES + "’ʼ"
PLAIN_TO = HALF_OF + LATIN_OF + " " * len(BLANKS) + DASH_OF + "''"


_RARE = re.compile("[" + re.escape(PLAIN_FROM) + "]")
_PLAIN_SIGN = dict(zip(PLAIN_FROM, PLAIN_TO))


def plain(text: str) -> str:
    """Text of the same length with full-width forms, look-alikes, blanks and dashes made ordinary."""
    return text if text.isascii() and "\t" not in text else _RARE.sub(lambda m: _PLAIN_SIGN[m[0]], text)
