import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import components as cc


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def run(spark, edges, limit=cc.FOREST_EDGES, parts=5):
    df = spark.createDataFrame(edges, "left string, right string").repartition(parts)
    rows = cc.groups(cc.linked(df, "left", "right"), limit).collect()
    assert len(rows) == len({r["member"] for r in rows})
    return {r["member"]: r["group"] for r in rows}


def test_chain_star_and_random_graphs_in_many_partitions(spark):
    rng = random.Random(3)
    ids = [f"n{rng.randrange(10**6):06d}" for _ in range(400)]
    chain, star = list(zip(ids, ids[1:])), [(ids[0], x) for x in ids[1:]]
    rnd = [(f"{rng.randrange(500)}", f"{rng.randrange(500)}") for _ in range(400)]
    for edges in (chain, star, rnd):
        rng.shuffle(edges)
        assert run(spark, edges, limit=50) == brute(edges) == run(spark, edges)


def test_loops_nulls_blanks_and_repetitions(spark):
    edges = [("a", "a"), ("b", "b"), ("b", "c"), ("c", "b"), ("é", "z"), ("z", "é"), (None, "q"), ("q", " "), (" ", "q")]
    assert run(spark, edges) == {"a": "a", "b": "b", "c": "b", "z": "z", "é": "z"}


def test_smallest_by_bytes(spark):
    assert run(spark, [("ab", "a"), ("B", "a"), ("￿", "\U00010000")]) == {"ab": "B", "a": "B", "B": "B", "￿": "￿", "\U00010000": "￿"}


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([("x", "y", "1", "2")], "left string, right string, v string, root string")
    assert {tuple(r) for r in cc.groups(cc.linked(df, "left", "right")).collect()} == {("x", "x"), ("y", "x")}


def test_two_components_share_no_group(spark):
    edges = [("a", "b"), ("c", "d")]
    assert run(spark, edges) == {"a": "a", "b": "a", "c": "c", "d": "c"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
def test_union_find_in_arrays(edges):
    a, b = (np.array(x) for x in zip(*edges))
    got = cc.least_roots(a, b, 31)
    assert all(got[x] == r for x, r in brute(edges).items())
