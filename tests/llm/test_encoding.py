import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import encoding as en

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def merges():
    return en.Merges(VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def split(ids, count):
    ends = np.cumsum(count)
    return [ids[e - c : e].tolist() for e, c in zip(ends, count)]


TEXTS = ["", "a", " ", "<|endoftext|>", "Hello <|endoftext|> world", "a" * 5001, "aaa aaaa aaaaa", "ab" * 3000, "\x00\x01\x1c\x85​", "naïve ﬁ Ⅷ² 🤦🏽‍♂️", "　  z\n\n\t x ", "I'LL it's we'd", "ὔ क्षि 한국어"]


def test_ids_equal_the_public_library(merges, reference):
    assert split(*en.Encoder(merges).encode(TEXTS)) == reference(TEXTS)


def test_sizes_and_kept_words(merges, reference, monkeypatch):
    monkeypatch.setattr(en, "KEPT_WORDS", 20)
    e, rng = en.Encoder(merges), random.Random(1)
    for _ in range(5):
        texts = ["".join(rng.choice("abc de\n1é") for _ in range(rng.randrange(80))) for _ in range(30)]
        want = reference(texts)
        assert split(*e.encode(texts)) == want
        assert e.sizes(texts).tolist() == [len(x) for x in want]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_any_text(merges, reference, texts):
    assert split(*en.Encoder(merges).encode(texts)) == reference(texts)


def test_ids_give_back_the_text(spark, merges):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "id long, text string")
    rows = en.encode(df, "id", "text", VOCABULARY).collect()
    assert {r["id"]: t.decode(r["ids"], skip_special_tokens=False) for r in rows} == {i: x for i, x in enumerate(TEXTS)}


def test_null_empty_repeated_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "a b", 5), (2, "a b", 5)], "doc long, text string, id long")
    got = sorted((tuple(r) for r in en.encode(df, "doc", "text", VOCABULARY).collect()), key=str)
    assert got == sorted([(1, []), (1, []), (None, [64, 275]), (2, [64, 275])], key=str)
    assert en.encode(df.limit(0), "doc", "text", VOCABULARY).collect() == []
    counted = en.count(df, ["doc", "id"], "text", VOCABULARY).collect()
    assert sorted((tuple(r) for r in counted), key=str) == sorted([(1, 5, 0), (1, 5, 0), (None, 5, 2), (2, 5, 2)], key=str)
