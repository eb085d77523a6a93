"""Given names and short forms learnt of the mentions, short names and firms through blocks."""

import pickle

from threadloom.llm.gazetteer import learn, learn_variants
from threadloom.llm.names import GIVEN, Lexicon, Name, lexicon_of, link_firms, link_names, link_persons, same_person, variant_pairs


def mentions(spark):
    rows = []
    for k in range(12):
        rows += [(f"s{k}", "PERSON", t, None) for t in ("Teodora Novak", "Fedora Novak", "Milan Kral", "Novak, Teodora")]
        if k % 2:
            rows += [(f"s{k}", "PERSON", "Teo Novak", None)]
    rows += [("s1", "PERSON", "Grizzly", "alias"), (None, "PERSON", "Teodora Novak", None), ("s2", "PERSON", None, None)]
    rows += [(f"z{i}", "PERSON", f"Other{chr(97 + i % 20)} Fam{chr(97 + i % 15)}", None) for i in range(400)]
    return spark.createDataFrame(rows, "scope string, kind string, text string, role string")


def test_learnt_lexicon(spark):
    m = mentions(spark)
    g = learn(m)
    assert "teodora" in g.settled and g.kind("novak") == "S"
    g.settled.discard("teo")  # a form that is rarer than settled ones
    v = learn_variants(m, g)
    assert v.get("teo") == "teodora"
    lex = pickle.loads(pickle.dumps(lexicon_of(g, v, {})))
    assert same_person(Name("teo novak", lex), Name("novak teodora", lex))
    assert not same_person(Name("teodora novak", lex), Name("fedora novak", lex))
    assert learn_variants(m.limit(0), g) == {} and learn_variants(m, learn(m.limit(0))) == {}


def test_without_any_list():
    none = Lexicon(frozenset(), {})
    assert GIVEN and same_person(Name("milan kral", none), Name("kral, millan", none))
    e = frozenset()
    c = link_persons(["milan kral", "m. kral", "kral", "milan", "petra svoboda", "svoboda"], [e] * 6, [e] * 6, none)
    assert c[0] == c[1] == c[2] == c[3] != c[4] == c[5]


def test_firms_without_kind():
    c = link_firms(["north star traders", "north star", "norht star", "blue river logistics", "nst", "zzz"])
    assert c[0] == c[1] == c[2] == c[4] and len({c[0], c[3], c[5]}) == 3


def test_rows_of_one_spelling(spark):
    rows = [("s", "PERSON", f"{i:04d}", "Milan Kral" if i % 2 else "KRAL MILAN") for i in range(300)] + [("s", "PERSON", "0001", "Milan Kral")]
    df = spark.createDataFrame([(*r, None, None, None, 1) for r in rows], "scope string, kind string, id string, text string, near array<string>, alias_group string, alias_role string, h int")
    links = link_names(df)
    assert links.count() == 300 and links.select("entity").distinct().count() == 1
    assert variant_pairs(links).count() == 150 * 150
