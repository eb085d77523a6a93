"""Look-alikes towards every script, styled forms, classes of looks."""

import pytest

from threadloom.llm.lookalikes import consistent_form, look_classes, same_look_pairs


@pytest.mark.parametrize(
    "a, b, form",
    [
        ("Мocква", "Москва", "Москва"),  # Latin o and c in a Cyrillic word
        ("Aθήνα", "Αθήνα", "Αθήνα"),  # Latin A in a Greek word
        ("сор", "cop", "cop"),  # any script: Latin, alone
        ("Москва сор", "Москва cop", "Москва сор"),  # and that of the text's other words
        ("the сор", "the cop", "the cop"),
        ("𝐁𝐨𝐛", "Bob", "Bob"), ("oﬃce ﬁle", "office file", "office file"), ("ℂat", "Cat", "Cat"),
        ("ᎪᏴᏟ", "ABC", "ABC"), ("ꓠꓳ", "NO", "NO"), ("Հօ", "Հo", "Հօ"),
    ],
)
def test_every_script(a, b, form):
    assert consistent_form(a) == consistent_form(b) == form
    assert consistent_form(form) == form


@pytest.mark.parametrize("a, b", [("x²", "x2"), ("½", "1/2"), ("кот", "kot"), ("Ω", "O"), ("①", "1")])
def test_visible_differences(a, b):
    assert consistent_form(a) != consistent_form(b)


def test_classes(spark):
    rows = [("s", f"{i:03d}", "Москва" if i % 3 else "Мocква") for i in range(30)] + [("s", "x", "alone"), ("s", "y", None), (None, "z", "Москва"), ("t", "w", "Москва"), ("s", "000", "Мocква")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "scope string, id string, text string, look int")
    got = look_classes(df).collect()
    assert len(got) == 30 and {(r.class_id, r.n_rows, r.n_spellings) for r in got} == {("000", 30, 2)}
    assert same_look_pairs(df).count() == 10 * 20 and look_classes(df.limit(0)).count() == 0
