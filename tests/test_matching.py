"""Candidates and their scores against the reference's rule in plain Python."""

import difflib
import re

import pytest

from graphloom.operators import matching

A = [("A1", "kinase beta"), ("A2", "regopakeamide"), ("A3", "vizaten dystrophy"), ("A4", "aspirin"), ("A5", "xy"), ("A6", "renal kinase gamma factor"), ("A7", "kinase beta"), ("A8", "zeta")]
B = [("B1", "kinase betta"), ("B2", "regopakeamid"), ("B3", "dystrophy of vizaten type"), ("A4", "salicylate"), ("B5", "xy"), ("B6", "kinase"), ("B7", "kinase beta"), ("B8", "omega")]
EDGES_A = [("a1", "A2"), ("A2", "MONDO:9"), ("A3", "A4"), ("A5", "A8"), ("A8", "MONDO:9")]
EDGES_B = [("B1", "B2"), ("B2", "mondo:9"), ("B3", "A4"), ("B7", "MONDO:9"), ("B5", "B8")]
IDENTITY = [("A8", "B8")]


def wanted(a, b, edges_a, edges_b, identity, small):
    def near(entities, edges):
        label = {i.lower(): x for i, x in entities}
        out = {i: set() for i, _ in entities}
        for s, o in edges:
            for x, y in ((s, o), (o, s)):
                for i, _ in entities:
                    if i.lower() == x.lower():
                        out[i].add(label.get(y.lower(), y.lower().split(":")[-1]))
        return out

    na, nb, found = near(a, edges_a), near(b, edges_b), {}
    for i, x in a:
        for j, y in b:
            long = lambda t: {w for w in t.split() if len(w) >= 3}
            if len(a) * len(b) > small and not (i == j or (i, j) in identity or long(x) & long(y) or na[i] & nb[j]):
                continue
            exact = 1.0 if i == j or (i, j) in identity else 0.0
            p, q = set(re.findall(r"\w+", x)), set(re.findall(r"\w+", y))
            s = max(difflib.SequenceMatcher(None, x, y).ratio(), len(p & q) / len(p | q))
            label = 0.95 if x == y else s if s >= 0.7 else 0.75 if min(len(x), len(y)) >= 3 and (x in y or y in x) else 0.0
            st = len(na[i] & nb[j]) / len(na[i] | nb[j]) if na[i] and nb[j] else 0.0
            if (score := min(1.0, exact + 0.75 * label + 0.3 * st)) > 0:
                found[i, j] = round(score, 4)
    return found


@pytest.mark.parametrize("small", [0, 1000])
def test_candidates_follow_the_reference(spark, small):
    a, b = (spark.createDataFrame(x, "id string, label string") for x in (A, B))
    near = [matching.neighbour_labels(x, spark.createDataFrame(e, "s string, o string")) for x, e in ((a, EDGES_A), (b, EDGES_B))]
    got = matching.scored_pairs(a, b, *near, spark.createDataFrame(IDENTITY, "id_a string, id_b string"), small=small).collect()
    assert len(got) == len({(r["id_a"], r["id_b"]) for r in got})
    assert {(r["id_a"], r["id_b"]): r["score"] for r in got} == wanted(A, B, EDGES_A, EDGES_B, IDENTITY, small)
    assert ("A2", "B2") in {(r["id_a"], r["id_b"]) for r in got}  # a neighbour leads to it, and only the ratio scores it
