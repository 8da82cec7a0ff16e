import math
import random

import pytest

from graphloom.llm import mixing

TARGETS = "mix_name string, source string, target_share double, max_repeats int, total_factor double"


def mixed(spark, sizes, targets, **kw):
    df = spark.createDataFrame(sizes, "id long, source string, tokens long").repartition(3)
    docs, report = mixing.mix(df, spark.createDataFrame(targets, TARGETS), **kw)
    return [r.asDict() for r in docs.collect()], {(r["mix_name"], r["source"]): r for r in report.collect()}


def corpus(n=600, seed=4):
    rng = random.Random(seed)
    return [(i, rng.choice("aaaab"), rng.randrange(1, 60)) for i in range(n)]


def test_shares_are_hit_to_half_a_document(spark):
    sizes = corpus()
    docs, report = mixed(spark, sizes, [("m", "a", 0.3, 1, 1.0), ("m", "b", 0.7, 9, 1.0)])
    total = sum(t for _, _, t in sizes)
    for source, share in (("a", 0.3), ("b", 0.7)):
        got = sum(r["tokens"] * r["copies"] for r in docs if r["source"] == source)
        assert got == report["m", source]["tokens"] and abs(got - share * total) <= 30
    copies = {r["copies"] for r in docs if r["source"] == "b"}
    own = sum(t for _, s, t in sizes if s == "b")
    whole = math.floor(0.7 * total / own)
    assert copies <= {whole, whole + 1} and len(copies) == 2
    assert sum(1 for r in docs if r["source"] == "b") == sum(1 for _, s, _ in sizes if s == "b")


def test_repeats_are_capped(spark):
    docs, report = mixed(spark, [(1, "a", 10), (2, "b", 1000)], [("m", "a", 0.5, 3, 1.0), ("m", "b", 0.5, 1, 1.0)])
    assert report["m", "a"]["tokens"] == 30 and report["m", "a"]["repeats"] == 3.0
    assert max(r["copies"] for r in docs if r["source"] == "a") == 3
    assert report["m", "a"]["share_of_planned"] == pytest.approx(30 / 1010)


def test_missing_sources_nulls_and_empty_texts(spark):
    sizes = [(1, "a", 10), (2, None, 10), (3, "a", 0), (None, "a", 10)]
    docs, report = mixed(spark, sizes, [("m", "a", 0.5, 1, 1.0), ("m", "none", 0.5, 5, 1.0), (None, "a", 1.0, 1, 1.0), ("n", "a", None, None, None), ("m", "a", 0.9, 1, 1.0)])
    assert set(report) == {("m", "a"), ("m", "none"), ("n", "a")}
    assert report["m", "none"]["tokens"] == 0 and report["n", "a"]["tokens"] == 0
    assert {r["id"] for r in docs} <= {1}


def test_empty_tables(spark):
    assert mixed(spark, [], [("m", "a", 1.0, 1, 1.0)])[0] == []
    assert mixed(spark, corpus(10), []) == ([], {})


def test_selection_is_the_pareto_order_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_DOCUMENTS", 2)
    monkeypatch.setattr(mixing, "BINS", 4)
    sizes = corpus(300)
    docs, _ = mixed(spark, sizes, [("m", "a", 0.25, 1, 1.0), ("m", "b", 0.01, 1, 1.0)])
    odds = odds_by_brute_force([t for _, s, t in sizes if s == "a"], 0.25 * sum(t for _, _, t in sizes))
    stratum = [{"source": "a", "rest": 0.25 * sum(t for _, _, t in sizes)}]
    mixing.set_odds(spark.createDataFrame(sizes, "id long, source string, tokens long"), stratum)
    assert stratum[0]["odds"] == pytest.approx(odds, rel=0.02)
    odds = stratum[0]["odds"]
    df = mixing._ranked(spark.createDataFrame(sizes, "id long, source string, tokens long"), [dict(stratum=0, mix_name="m", source="a", target_share=0.25, max_repeats=1, mix_tokens=1.0, source_tokens=sum(t for _, s, t in sizes if s == "a"), wanted=0.0, whole=0, rest=0.25 * sum(t for _, _, t in sizes), odds=odds, last_rank=0.0, last_id=0)], 7)
    ranked = sorted((r["rank"], r["id"], r["tokens"], r["rest"]) for r in df.collect())
    want, added = set(), 0
    for _, i, t, rest in ranked:
        if added + t - t / 2 > rest:
            break
        added += t
        want.add(i)
    assert {r["id"] for r in docs if r["source"] == "a"} == want


def test_same_documents_at_any_partitioning(spark):
    sizes, targets = corpus(), [("m", "a", 0.2, 1, 1.0)]
    once = {(r["id"], r["copies"]) for r in mixed(spark, sizes, targets)[0]}
    assert once == {(r["id"], r["copies"]) for r in mixed(spark, sizes[::-1], targets)[0]}
    assert once != {(r["id"], r["copies"]) for r in mixed(spark, sizes, targets, seed=8)[0]}


def odds_by_brute_force(tokens, rest):
    """The factor at which min(1, factor * size) * size adds up to rest, by halving."""
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1, mid * t) * t for t in tokens) < rest else (low, mid)
    return high


def test_inclusion_rates_are_in_proportion_to_size(spark):
    tokens = list(range(1, 1001))
    names = [f"m{k}" for k in range(400)]
    docs, report = mixed(spark, [(t, "a", t) for t in tokens], [(m, "a", 0.3, 1, 1.0) for m in names])
    assert all(abs(report[m, "a"]["actual_share"] - 1) < 1e-9 and abs(report[m, "a"]["repeats"] - 0.3) < 0.002 for m in names)
    odds = odds_by_brute_force(tokens, 0.3 * sum(tokens))
    for low in range(1, 1001, 100):
        group = range(low, low + 100)
        got = sum(1 for r in docs if r["id"] in group) / 100 / len(names)
        assert got == pytest.approx(sum(min(1, odds * t) for t in group) / 100, abs=0.02)


def test_largest_documents_are_certain(spark):
    sizes = [(i, "a", 1) for i in range(3000)] + [(9000 + i, "a", 1000) for i in range(3)]
    docs, _ = mixed(spark, sizes, [(f"m{k}", "a", 0.7, 1, 1.0) for k in range(20)])
    big = [r for r in docs if r["id"] >= 9000]
    small = [r for r in docs if r["id"] < 9000]
    assert len(big) == 60 and abs(len(small) / 20 - (0.7 * 6000 - 3000)) <= 1


def test_targets_go_in_blocks(spark, monkeypatch):
    targets = [(f"m{k}", s, 0.1 + 0.04 * k, 2, 1.0) for k in range(5) for s in "ab"]
    once = mixed(spark, corpus(), targets)
    monkeypatch.setattr(mixing, "BLOCK_TARGETS", 3)
    key = lambda rows: sorted(tuple(r.values()) for r in rows)
    again = mixed(spark, corpus(), targets)
    assert key(once[0]) == key(again[0]) and once[1] == again[1]
