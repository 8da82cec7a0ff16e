"""The queries of the training-data operators against their SQL on the smallest tables."""

import os

import pytest

from graphloom.llm import oracles, queries
from tests.test_queries import SF, duck, forms

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
__all__ = ["duck"]




@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) & set(oracles.ORACLES)))
def test_query(spark, duck, name):  # noqa: F811
    got = queries.QUERIES[name](spark, SF)
    assert forms(got.toPandas()) == forms(duck.execute(oracles.ORACLES[name]).df())


def test_every_text_has_the_ids_of_the_public_library(spark):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    library.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] for r in queries._table(spark, SF, "documents").select("doc_id", "text").collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in queries.p6_ids(spark, SF).collect()}
    assert got == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}


def test_mixes_hold_their_shares(spark):
    documents = queries.p7_documents(spark, SF).collect()
    report = queries.p7_shares(spark, SF).collect()
    targets = {(r["mix_name"], r["source"]): r for r in queries._table(spark, SF, "mix_targets").collect()}
    assert {(r["mix_name"], r["source"]) for r in report} == set(targets) and len(report) == len(targets)
    added, largest = {}, {}
    for r in documents:
        k = r["mix_name"], r["source"]
        added[k] = added.get(k, 0) + r["tokens"] * r["copies"]
        largest[k] = max(largest.get(k, 0), r["tokens"])
        assert 1 <= r["copies"] <= targets[k]["max_repeats"]
    for r in report:
        k = r["mix_name"], r["source"]
        assert r["tokens"] == added.get(k, 0)
        planned = r["share_of_planned"] and r["tokens"] / r["share_of_planned"]
        if r["tokens"] and r["repeats"] < targets[k]["max_repeats"] - 1e-9:
            assert abs(r["tokens"] - r["target_share"] * planned) <= largest[k]


def test_links_are_between_tables_and_given_once(spark):
    links = queries.p5_links(spark, SF).collect()
    space = lambda k: k[:4]
    assert len({(r["key_a"], r["key_b"]) for r in links}) == len(links) > 100
    assert all(r["key_a"] < r["key_b"] and 0.5 <= r["confidence"] <= 1 and space(r["key_a"]) != space(r["key_b"]) for r in links)
    assert {(r["key_a"], r["key_b"]) for r in queries.p5_found(spark, SF).collect()} == {(r["key_a"], r["key_b"]) for r in links}


def test_cut_texts_lack_an_end_and_rates_add_up(spark):
    cut = [r["doc_id"] for r in queries.p8_found(spark, SF).collect()]
    texts = {r["doc_id"]: r["text"] for r in queries._table(spark, SF, "documents").select("doc_id", "text").collect()}
    assert cut and len(set(cut)) == len(cut) and all(texts[k].strip() for k in cut)
    assert not any(texts[k].rstrip().endswith(("sentence.", "?", "!")) for k in cut)
    assert sum(r["cut"] for r in queries.p8_rates(spark, SF).collect()) == len(cut)
