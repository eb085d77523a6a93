"""Nested payloads against a walk over the parsed tree."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.operators.nested import ARRAY_FIELDS, MAP_FIELDS, flat_table, flatten_payloads, shred


def walk(doc, text):
    out = []

    def value(v, name, path, parent):
        if isinstance(v, dict):
            for k, x in v.items():
                field(k, x, path, parent)
        elif isinstance(v, list):
            for n, x in enumerate(v):
                p = f"{path}.{n}" if path else str(n)
                if isinstance(x, (dict, str)):
                    out.append((doc, name, p, parent))
                    value(x, name, p, p)
                else:
                    value(x, name, p, parent)

    def field(k, x, path, parent):
        p = f"{path}.{k}" if path else k
        if k in ARRAY_FIELDS | MAP_FIELDS:
            while isinstance(x, str):
                try:
                    x = json.loads(x)
                except ValueError:
                    return
        if k in MAP_FIELDS and isinstance(x, dict):
            for a, b in x.items():
                out.append((doc, k, f"{p}.{a}", parent))
                value(b, a, f"{p}.{a}", f"{p}.{a}")
        elif k in ARRAY_FIELDS and isinstance(x, dict):
            out.append((doc, k, p + ".0", parent))
            value(x, k, p + ".0", p + ".0")
        else:
            value(x, k, p, parent)

    try:
        v = json.loads(text)
        while isinstance(v, str):
            v = json.loads(v)
    except ValueError:
        return []
    value(v, "", "", "")
    return out


KEYS = st.sampled_from(["calls", "tags", "cell", "handoffs", "refs", "x", "a b", "na\"me", "subscribers", "ü"])
TREE = st.recursive(st.none() | st.integers(-9, 9) | st.booleans() | st.text('ab"\\{}[],: é', max_size=6), lambda c: st.lists(c, max_size=4) | st.dictionaries(KEYS, c, max_size=4), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(KEYS, TREE, max_size=4), min_size=1, max_size=4), st.booleans(), st.sampled_from([None, 1]))
def test_same_as_tree(docs, wrapped, indent):
    texts = [json.dumps(json.dumps(d, indent=indent) if wrapped else d, indent=indent) for d in docs]
    got = [r[:4] for r in shred(list(map(str, range(len(texts)))), texts)]
    want = [r for i, t in enumerate(texts) for r in walk(str(i), t)]
    assert sorted(got) == sorted(want)


def test_forms_and_dirt():
    rows = shred(["d"] * 6, ['{"calls": {"tags": "[\\"x\\"]"}}', "", '{"calls": [', "null", "[]", '"{\\"refs\\":[{}]}"'])
    assert [(r[1], r[2], r[3]) for r in rows] == [("calls", "calls.0", ""), ("tags", "calls.0.tags.0", "calls.0"), ("refs", "refs.0", "")] or sorted(r[2] for r in rows) == ["calls.0", "calls.0.tags.0", "refs.0"]


def test_operator(spark):
    df = spark.createDataFrame([("a", '{"calls":[{"caller":"1","duration_seconds":5},{"caller":"2"}]}', 1), ("b", None, 2), (None, '{"refs":{}}', 3)], "id string, structured string, node int")
    rows = flatten_payloads(df)
    assert rows.count() == 3
    flat = flat_table(rows, "calls", {"caller": "string", "duration_seconds": "int"}).orderBy("ordinal").collect()
    assert [(r.caller, r.duration_seconds) for r in flat] == [("1", 5), ("2", None)]
    assert flatten_payloads(df.limit(0)).count() == 0


def test_checks_agree_with_a_parser():
    """Random damage to payloads: the vectorised check accepts what a strict parser accepts."""
    import json
    import random

    from threadloom.operators.nested import check_payloads

    def strict(t):
        try:
            json.JSONDecoder(parse_constant=lambda _: 1 / 0).decode(t)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    r = random.Random(11)
    seeds = ['{"a":[1,2,{"b":"x\\\\\\"y"}],"c":null}', "[]", '"s"', "1", '[{"a":{}},[[]],true]', ' {"k" : -1.5e3 , "l":[ ] } ', '"\\u12ab\\n"', '{"a":"{\\"b\\":[1]}"}', ""]
    cases = list(seeds)
    for _ in range(6000):
        t = list(r.choice(seeds))
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(t) + 1)
            if r.random() < 0.4 and t:
                t.pop(min(k, len(t) - 1))
            else:
                t.insert(k, r.choice('{}[]",:1ae\\ntruefalsn. -u0\t\n'))
        cases.append("".join(t))
    for k in range(0, len(cases), 700):
        part = cases[k : k + 700]
        assert [not reason for reason, _ in check_payloads([t.encode() for t in part])] == [strict(t) for t in part]


def test_any_depth(spark):
    from threadloom.operators.nested import flatten_payloads, rejected_payloads

    n = 8000
    deep = '{"calls":[' + '{"periods":[' * n + '"x"' + "]}" * n + "]}"
    df = spark.createDataFrame([("d", deep), ("e", deep[:-1]), ("f", '"{\\"calls\\":[1,}"'), ("g", None), ("h", " "), ("i", '{"calls":[{}]}')], "id string, structured string")
    got = flatten_payloads(df, values=False).groupBy("document_id").count().collect()
    assert {r["document_id"]: r["count"] for r in got} == {"d": n + 1, "i": 1}
    assert {(r.document_id, r.reason) for r in rejected_payloads(df).collect()} == {("e", "brackets"), ("f", "brackets"), ("h", "blank")}
