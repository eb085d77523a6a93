"""Large blocks, aliases of different people and shared places in name resolution."""

from threadloom.operators import resolve

M = resolve.Mention


def test_large_blocks_make_pairs():
    ms = [M(f"{i:03}", f"R{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}xq Nair", f"d{i}") for i in range(450)] + [M("x", "Ravi Nair", "a"), M("y", "R Nair", "b")]
    assert (450, 451) in resolve.candidate_pairs(ms, "PERSON")
    # A shared phone of many mentions still counts.
    phone = frozenset(["PHONE:9"])
    out = resolve.resolve_group([M(f"{i:03}", "Ravi Nair", f"d{i}", nearby=phone) for i in range(401)], "PERSON")
    assert len(out) == 1 and not out[0]["needs_review"]


def test_one_nickname_of_two_people():
    ms = [M("1", "Mahesh Pandey", "a", alias_group="g1", alias_role="primary"), M("2", "Monu", "a", alias_group="g1", alias_role="alias")]
    ms += [M("3", "Gopal Yadav", "b", alias_group="g2", alias_role="primary"), M("4", "Monu", "b", alias_group="g2", alias_role="alias")]
    assert resolve.pair_score(ms[1], ms[3], "PERSON", {}, {"g1": ms[0], "g2": ms[2]})[2]
    assert sorted(e["mention_ids"] for e in resolve.resolve_group(ms, "PERSON")) == [["1", "2"], ["3", "4"]]


def test_shared_places(spark):
    rows = [("s", str(i), kind, text, doc, 0.9, None, None, None) for i, (kind, text, doc) in enumerate([("PERSON", "Ravi Nair", "a"), ("PERSON", "Ravi Nair", "b"), ("LOCATION", "Naya Ghat", "a"), ("LOCATION", "naya ghat", "b"), ("LOCATION", "Delhi", "a"), ("LOCATION", "Delhi", "b")])]
    df = spark.createDataFrame(rows, "scope string, id string, entity_type string, text string, doc string, confidence double, alias_group string, alias_role string, nearby array<string>")
    e = resolve.resolve_names(df).filter("entity_type = 'PERSON'").first()
    assert e.merge_confidence > 0.72 and e.reasons == ["exact name; both documents name LOCATION:naya ghat"]
