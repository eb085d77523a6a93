"""Personal names that stand in no list, and the gazetteer that is learnt."""

import pickle

from threadloom.llm.gazetteer import Gazetteer, learn
from threadloom.llm.personal import SpanModel, estimate, find, propose

TEXTS = [
    "Complainant John Smith and Priya Sharma met Anil Kumar near Sonpur Border Post.",
    "He told Peter Novak that Mrs. Grace Hopper lives at House No. 12, Long Lane, Oldtown 123456.",
    "The clerk of Blue River Traders gave his number 98765 43210 to Mary Jones.",
    "शिकायतकर्ता मोहन वर्मा ने बताया कि डॉ. नीता जोशी ने जांच की.",
]


def names(model, t):
    return [t[s:e] for k, s, e, _ in find(model, t) if k == "NAME"]


def test_names_in_no_list():
    model = SpanModel.fit(TEXTS * 3)
    assert names(model, TEXTS[0]) == ["John Smith", "Priya Sharma", "Anil Kumar"]
    assert names(model, TEXTS[1]) == ["Peter Novak", "Grace Hopper"]
    assert names(model, TEXTS[2]) == ["Mary Jones"]
    assert names(model, TEXTS[3]) == ["मोहन वर्मा", "नीता जोशी"]


def test_learnt_gazetteer(spark):
    rows = [("PERSON", f"{a} {b}", None) for a in ("Tomas", "Alena", "Marek") for b in ("Dvorak", "Svoboda")] * 4
    rows += [("PERSON", "Dvorak, Alena", None), ("PERSON", "Grizzly", "alias"), ("ORGANIZATION", "Dvorak Tours", None), ("LOCATION", "Sector 4", None), ("PERSON", None, None), ("PERSON", " ", None), (None, "x", None)]
    df = spark.createDataFrame(rows, "kind string, text string, role string")
    g = learn(df)
    assert (g.kind("tomas"), g.kind("dvorak"), g.kind("grizzly"), g.kind("tours"), g.kind("sector"), g.kind("other")) == ("G", "S", "N", "O", "L", "")
    assert g.kind("dvorrak") == "S" and g.kind("aleena") == "G"  # slips and long vowels
    assert pickle.loads(pickle.dumps(g)).kind("dvorak") == "S"
    assert learn(df.limit(0)).kinds == {}
    few = learn(df, least_share=0.4)  # parts that fewer mentions have stay out
    assert "grizzly" not in few.kinds and "dvorak" in few.kinds
    model = SpanModel.fit(["Alena Dvorak was seen. Dvorak Tours was shut."] * 9, g)
    assert names(model, "yesterday alena dvorak came with Grizzly") == ["alena dvorak"]
    assert names(model, "The bus of Dvorak Tours left.") == []


def test_long_addresses_are_whole():
    local = "a" * 300
    t = f"write to {local}@mail.example.org or House No. 4, " + ", ".join(["Long Lane"] * 60) + " 123456 now"
    got = {sp.kind: t[sp.s : sp.e] for sp in propose(t, Gazetteer())}
    assert got["EMAIL"] == f"{local}@mail.example.org" and got["ADDRESS"].endswith("123456") and len(got["ADDRESS"]) > 600


def test_reliabilities_are_estimated():
    import numpy as np

    v = np.array([[1, 1, 1]] * 900 + [[-1, -1, 1]] * 900)
    p, acc = estimate(v)
    assert p[0] > 0.9 > 0.1 > p[-1] and acc[2] < 0.65 < acc[0]
