"""Lists that only the period of their lines tells from prose."""

from threadloom.llm.quality import Form

COMMON = frozenset("the was of and he at in near".split())


def test_indentation_period():
    rows = [f"Room {k} Bishanpur warehouse, ground floor, east wing, left side.\n    Torch lamp beside window, broken glass, dented rim, no battery.\n    Rope coil beside ladder, blue cotton, frayed ends, ten metres." for k in range(1, 6)]
    assert Form("\n".join(rows), COMMON).kind == "list"
    # The same words without the period stay prose.
    assert Form("\n".join(rows).replace("    ", ""), COMMON).kind == "prose"


def test_line_length_period():
    rows = [f"Witness {n}, resident near Bishanpur market. Statement taken outside Naya Ghat station, deposited with inspector {n}\nPhone 98{n}7654\nHeight about six feet. Build slim" for n in range(10, 16)]
    assert Form("\n".join(rows), COMMON).kind == "list"
    assert Form("\n".join(sorted(rows[0].split("\n") * 6)), COMMON).auto < 0.8


def test_prose_keeps_its_form():
    text = "\n".join(["The man was at the gate and he ran.", "    He was in the house near the mill."] * 5)
    assert Form(text, COMMON).kind == "prose"


def test_signals_decide(monkeypatch):
    """Lists by returning markers and by lines of one make; without the signals they are none."""
    from threadloom.llm import quality

    marked = "\n".join(f"- the order of the clerk for number {i} was to wait and to write it down" for i in range(8))
    plain = "\n".join(["blue ledger", "steel trunk", "cash box", "rent book", "bed sheet", "rope 8 m"] * 3)
    prose = "- the order of the clerk was to wait. He wrote it down and left for the day.\nThe guard saw it and said so to the others."
    common = frozenset("the of for was to and it he saw so".split())
    kind = lambda t: quality.Form(t, common).kind
    assert (kind(marked), kind(plain), kind(prose)) == ("list", "list", "prose")
    monkeypatch.setattr(quality, "echo", lambda v, lags=(1,): 0.0)
    monkeypatch.setattr(quality, "periodicity", lambda v: 0.0)
    assert kind(marked) != "list" and kind(plain) != "list"


def test_echo():
    from threadloom.llm.quality import echo

    assert echo([]) == echo([5]) == echo([0, 0, 0]) == 0.0
    assert echo([1] * 9) == 1.0 and echo([1, 0] * 6) == 1.0
    assert echo([0, 1, 0, 0, 0, 0]) == 0.0
