"""Token ids against the tokenizer's own library, and packing against brute force."""

import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadloom.llm import packing as pk
from threadloom.llm.tokens import TOKENIZER, CorpusEncoder, encode_corpus, token_counts

OWN = Tokenizer.from_file(TOKENIZER)
OWN.encode_special_tokens = True
ENC = CorpusEncoder()


def own(texts):
    return [e.ids for e in OWN.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def ours(texts):
    return [x.as_py() for part in ENC.encode(texts) for x in part]


def test_corpus(small):
    texts = [t if isinstance(t, str) else None for t in pd.read_parquet(f"{small}/documents.parquet").text]
    assert ours(texts) == own(texts)
    assert ENC.sizes(texts).tolist() == list(map(len, own(texts)))


def test_hard_texts():
    t = ["", None, "'s", "x's they're I'll 'store it''s", "a  b\n\n c ", "<|endoftext|> <|endoftext|>", "a" * 5000 + " " + "!" * 3000, "é é​　日本 語。 12345678901", "\t\tx", " 's\n's", "😀😀 x"]
    assert ours(t) == own(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abest'rlvm \n\t12é९क　!?.日-A​", max_size=30), min_size=1, max_size=12))
def test_any_text(texts):
    assert ours(texts) == own(texts)


def test_operator(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (1, "Hello world")], "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS ids")
    rows = encode_corpus(df).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in rows) == sorted([(1, tuple(own(["Hello world"])[0]))] * 2 + [(2, ()), (3, ())])
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts(df).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert encode_corpus(df.limit(0)).count() == 0


def first_fit(sizes, capacity):
    free, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = next((k for k, f in enumerate(free) if f >= sizes[i]), None)
        if b is None:
            b = len(free)
            free.append(capacity)
        free[b] -= sizes[i]
        out[i] = b
    return [out[i] for i in range(len(sizes))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60), st.integers(20, 40))
def test_tournament_tree(sizes, capacity):
    got, n = pk.first_fit_decreasing(sizes, capacity)
    assert got == first_fit(sizes, capacity)
    assert n == (max(got) + 1 if got else 0)


def test_pack(spark):
    r = random.Random(3)
    items = [(i, r.choice([0, 3, 50, 99, 100, 101, 350])) for i in range(900)] + [(1000, None)]
    df = spark.createDataFrame(items, "doc_id long, n long")
    p = pk.pack(df, [(1, 100), (2, 400)], "doc_id", "n", len(items), group_items=200).toPandas()
    for (profile, cap), g in p.groupby(["profile_id", "capacity"]):
        assert (g.groupby("container_id").n_units.sum() <= cap).all()
        assert g.groupby("item_id").n_units.sum().to_dict() == {i: n or 0 for i, n in items}
        assert (g[g.n_units.lt(cap) & g.piece_no.eq(0)].groupby("item_id").size() == 1).all()
        assert g.n_units.sum() / (g.container_id.nunique() * cap) > 0.9
        assert not ((g.groupby("item_id").size() > 1) & ~(g.groupby("item_id").n_units.sum() > cap)).any()
    assert pk.fill_report(pk.pack(df.limit(0), [(1, 100)], "doc_id", "n", 0)).count() == 0


def test_long_words_by_the_same_rule():
    import random

    from tokenizers import Tokenizer

    from threadloom.llm.tokens import TOKENIZER, CorpusEncoder

    lib = Tokenizer.from_file(TOKENIZER)
    lib.encode_special_tokens = True
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), "a" * 50_001, "ab" * 9_999, "警察搜查了" * 3_000, "ตำรวจ" * 2_000]
    enc = CorpusEncoder()
    enc.pairs.ROWS = 200_000  # several queries for one word
    got = [x for part in enc.encode(words) for x in part.to_pylist()]
    assert got == [lib.encode(w, add_special_tokens=False).ids for w in words]


def test_words_with_one_hash():
    """Two words whose hashes are equal are told apart by their text."""
    import numpy as np

    from threadloom.llm.tokens import CorpusEncoder

    text = "ab cd ab"
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts, ends = np.array([0, 2, 5]), np.array([2, 5, 8])
    first, back = CorpusEncoder._distinct(cps, starts, ends, np.zeros(3, np.uint64), text)
    assert [text[starts[f] : ends[f]] for f in first] == ["ab", " cd", " ab"] and back.tolist() == [0, 1, 2]
