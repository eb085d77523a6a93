"""Scalar text functions as column expressions: normalisation, validators, phonetics, hashing, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEVANAGARI_DIGITS = "०१२३४५६७८९"
#: Titles that are no part of a name; fixed values.
HONORIFICS = ["mr", "mrs", "ms", "dr", "shri", "smt", "sri", "km", "sh", "late", "insp", "asi"]


def ascii_digits(c: Column) -> Column:
    """Devanagari digits to ASCII; the length is kept."""
    return F.translate(c, DEVANAGARI_DIGITS, "0123456789")


def phone_key(c: Column) -> Column:
    """Ten digits of a phone number without country prefix or trunk zero; null where it is no mobile number."""
    d = F.regexp_replace(ascii_digits(c), "[^0-9]", "")
    d = F.when((F.length(d) == 12) & d.startswith("91"), F.substring(d, 3, 10)).when((F.length(d) == 11) & d.startswith("0"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(d.rlike("^[6-9][0-9]{9}$"), d)


def plate_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[\s\-]", ""))


def account_key(c: Column) -> Column:
    """Lower-cased payment address, or the digits of an account number."""
    return F.when(F.contains(c, F.lit("@")), F.lower(F.trim(c))).otherwise(F.regexp_replace(ascii_digits(c), "[^0-9]", ""))


def valid_account(c: Column) -> Column:
    n = F.length(account_key(c))
    return F.contains(c, F.lit("@")) | n.between(9, 18)


def person_key(c: Column) -> Column:
    """Lower-cased name without titles, punctuation and doubled blanks."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[.,\s]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(HONORIFICS) & (w != "")), " ")


def place_key(c: Column) -> Column:
    """Place or organisation: initials joined, `rd` spelled out, one blank between words."""
    t = F.regexp_replace(F.lower(c), r"\b([a-z])\.([a-z])\.", "$1$2")
    t = F.regexp_replace(t, r"\brd\b\.?", "road")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s]", " "), r"\s+", " "))


def sorted_tokens(c: Column) -> Column:
    """Tokens of a text in order, so that word order does not count."""
    return F.array_join(F.array_sort(F.filter(F.split(place_key(c), " "), lambda w: w != "")), " ")


#: Digraphs of Indian names to one sound, applied in this order (capitals stand for sounds of two letters), then single
#: letters, and the courtesy name whose spellings count as one, with its key; fixed values.
DIGRAPHS = [
    ("chh", "C"), ("ch", "C"), ("sh", "S"), ("kh", "k"), ("gh", "g"), ("jh", "j"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("ph", "f"), ("ck", "k"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u"), ("aa", "a"),
    ("ai", "e"), ("ay", "e"), ("ei", "e"), ("au", "o"), ("ou", "o"), ("aw", "o"), ("ow", "o"),
]
SINGLES = ("wzqcxy", "vjkkki")
COURTESY, COURTESY_KEY = ["mohammad", "mohd", "md", "mohammed", "muhammad", "mohamed", "muhammed", "mahammad"], "mhmd"


def phonetic_key(c: Column) -> Column:
    """Consonant skeleton of a Latin name: digraphs, equal-sounding letters, no doubles, only a leading vowel."""
    w = F.regexp_replace(F.lower(c), "[^a-z]", "")
    t = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), DIGRAPHS, w)
    t = F.regexp_replace(F.translate(t, *SINGLES), r"(.)\1+", "$1")
    key = F.concat(F.substring(t, 1, 1), F.regexp_replace(F.substring(t, 2, 1000000), "[aeiou]", ""))
    return F.when(w.isin(COURTESY), COURTESY_KEY).otherwise(key)


def has_devanagari(c: Column) -> Column:
    return c.rlike("[\\u0900-\\u097F]")


def resolved_id(ids: Column) -> Column:
    """Stable id of a set of mention ids: does not depend on their order."""
    return F.concat(F.lit("resolved-"), F.substring(F.sha1(F.array_join(F.array_sort(ids), "|").cast("binary")), 1, 12))


def entry_hash(sequence: Column, kind: Column, payload: Column, previous: Column) -> Column:
    return F.sha2(F.concat_ws("|", sequence.cast("string"), kind, payload, previous), 256)


def combine_evidence(scores: Column, digits: int | None = 4) -> Column:
    """Noisy-or of independent evidence, rounded to ``digits`` if these are given."""
    clamped = F.transform(scores, lambda s: F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))
    score = F.lit(1.0) - F.aggregate(clamped, F.lit(1.0), lambda a, s: a * (F.lit(1.0) - s))
    # As a decimal, so that a tie is one of the written number and not of its binary fraction.
    return score if digits is None else F.round(score.cast("decimal(20,12)"), digits).cast("double")


def merge_tier(score: Column) -> Column:
    return F.when(score >= 0.8, "auto").when(score >= 0.6, "review").otherwise("reject")


def minmax_clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest((c - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def span_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two spans."""
    both = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    union = (e1 - s1) + (e2 - s2) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))
