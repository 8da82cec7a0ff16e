"""Pairs scored by classes of labels, against every pair scored by itself, and with labels so common that their pairs can't be made."""

import random
import re

from pyspark.sql import functions as F

from graphloom.operators import matching, skew
from graphloom.scratch import write_table

NEAR = "id string, neighbour string"


def worlds():
    names = ["unknown", "kinase beta", "renal factor alpha two b", "renal factor alpha two c", "renal factor alpha two b x", "xy"]
    a = [(f"A{i}", names[i % 6]) for i in range(18)] + [("C1", "unknown"), ("C2", "kinase beta"), ("C3", "zeta")]
    b = [(f"B{i}", names[i % 6]) for i in range(12)] + [("C1", "unknown"), ("C2", "omega"), ("C3", "zeta factor")]
    near_a = [(f"a{i}", f"n{j}") for i in range(0, 18, 2) for j in range(i % 5)] + [("c1", "n1"), ("c2", "n2")]
    near_b = [(f"b{i}", f"n{j}") for i in range(0, 12, 3) for j in range(i % 4)] + [("c1", "n1"), ("c1", "n2")]
    return a, b, near_a, near_b


def wanted():
    a, b, near_a, near_b = worlds()
    near = lambda rows, i: {n for x, n in rows if x == i.lower()}
    out = {}
    for i, x in a:
        for j, y in b:
            p, q, na, nb = set(re.findall(r"\w+", x)), set(re.findall(r"\w+", y)), near(near_a, i), near(near_b, j)
            jaccard = len(p & q) / len(p | q)
            if i == j or x == y or jaccard >= 0.7:
                label = 0.95 if x == y else jaccard if jaccard >= 0.7 else 0.75 if x in y or y in x else 0.0
                out[i, j] = round(min(1.0, (i == j) + 0.75 * label + 0.3 * (len(na & nb) / len(na | nb) if na & nb else 0.0)), 6)
    return out


def scores(spark):
    a, b, near_a, near_b = worlds()
    entities = [spark.createDataFrame(x, "id string, label string") for x in (a, b)]
    return matching.class_scores(*entities, *(spark.createDataFrame(x, NEAR) for x in (near_a, near_b)))


def common_label(spark, n):
    """n entities a side with one label; one pair shares its only neighbour, another its id."""
    side = lambda s: spark.range(n).select(F.concat(F.lit(s), F.col("id").cast("string")).alias("id"), F.lit("unknown").alias("label"))
    one = spark.createDataFrame([("both", "unknown")], "id string, label string")
    near = [spark.createDataFrame([(x, "n1")], NEAR) for x in ("a7", "b9")]
    return matching.class_scores(side("A").union(one), side("B").union(one), *near)


def test_rows_are_those_of_single_pairs(spark):
    got = scores(spark).rows().collect()
    assert len(got) == len(wanted())
    assert {(r["id_a"], r["id_b"]): r["score"] for r in got} == wanted()


def test_counts_are_those_of_single_pairs(spark):
    found = {}
    for x in wanted().values():
        decision = "MERGE" if x >= 0.88 else "REVIEW" if x >= 0.65 else "KEEP"
        found[decision] = found.get(decision, 0) + 1
    got = scores(spark).counts().groupBy("decision").agg(F.sum("pairs").alias("n")).collect()
    assert {r["decision"]: r["n"] for r in got} == found


def test_counts_of_a_label_that_all_share(spark):
    got = {(r["decision"], r["method"]): r["pairs"] for r in common_label(spark, 300_000).counts().collect()}
    assert got == {("MERGE", "exact_id"): 1, ("MERGE", "normalized_label"): 1, ("REVIEW", "normalized_label"): 300_001**2 - 2}


def repeated_scores(spark):
    a, b, near_a, near_b = worlds()
    entities = [spark.createDataFrame(x, "id string, label string") for x in (a, b)]
    return matching.class_scores(*entities, *(spark.createDataFrame(x + x[::2], NEAR) for x in (near_a, near_b)))


def test_counts_with_repeated_neighbours(spark):
    want = {(r["decision"], r["method"]): r["pairs"] for r in scores(spark).counts().collect()}
    assert {(r["decision"], r["method"]): r["pairs"] for r in repeated_scores(spark).counts().collect()} == want


def test_neighbours_of_ids_that_are_no_entities_are_not_written(spark, monkeypatch):
    a, b, near_a, near_b = worlds()
    written = []

    def counted(df):
        table = write_table(df)
        written.append(table.count())
        return table

    monkeypatch.setattr(matching, "write_table", counted)
    entities = [spark.createDataFrame(x, "id string, label string") for x in (a, b)]
    others = spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("id"), F.lit("n1").alias("neighbour"))
    got = matching.class_scores(*entities, *(spark.createDataFrame(x, NEAR).union(others) for x in (near_a, near_b)))
    assert max(written) < 5_000
    assert {(r["id_a"], r["id_b"]): r["score"] for r in got.rows().collect()} == wanted()


def test_possible_members_are_all_members_and_few_others(spark):
    rows = spark.range(-20_000, 20_000).select(F.col("id").cast("string").alias("k")).union(spark.createDataFrame([(None,)], "k string"))
    keys = spark.range(500).select(F.col("id").cast("string")).union(spark.createDataFrame([(None,)], "k string"))
    kept = {r["k"] for r in skew.possible_members(rows, "k", keys).collect()}
    assert {str(i) for i in range(500)} <= kept and None not in kept and len(kept) < 5_000
    assert skew.possible_members(rows, "k", keys, most=64).where("k is not null").count() <= 40_000
    assert {str(i) for i in range(500)} <= {r["k"] for r in skew.possible_members(rows, "k", keys, most=1024).collect()}
    assert skew.possible_members(rows, "k", keys.limit(0)).count() == 0


def test_best_are_those_of_single_pairs(spark):
    by = {}
    for (i, j), x in wanted().items():
        by.setdefault(i, []).append((-x, j))
    want = {(i, j, -x, n + 1) for i, rows in by.items() for n, (x, j) in enumerate(sorted(rows)[:3])}
    assert {(r["id_a"], r["id_b"], r["score"], r["rank"]) for r in scores(spark).best(3).collect()} == want


def test_best_with_repeated_neighbours(spark):
    assert {tuple(r) for r in repeated_scores(spark).best(3).collect()} == {tuple(r) for r in scores(spark).best(3).collect()}


def test_similar_sets_are_those_of_single_pairs(spark):
    draw = random.Random(1)
    sets = lambda s: [(f"{s}{i}", draw.sample("abcdefghijkl", draw.randint(1, 8))) for i in range(150)]
    a, b = sets("A"), sets("B")
    frames = [spark.createDataFrame(x, "id string, tokens array<string>") for x in (a, b)]
    for threshold in (0.5, 0.7, 1.0):
        want = {(i, j): len({*x} & {*y}) / len({*x} | {*y}) for i, x in a for j, y in b}
        got = {(r["id_a"], r["id_b"]): r["similarity"] for r in matching.similar_sets(*frames, threshold).collect()}
        assert got == {k: v for k, v in want.items() if v >= threshold}


def test_best_of_a_label_that_all_share(spark):
    found = common_label(spark, 100_000).best(2)
    assert found.count() == 200_002
    assert [(r["id_b"], r["rank"]) for r in found.where("id_a = 'A7'").orderBy("rank").collect()] == [("B9", 1), ("B0", 2)]
    assert [(r["id_b"], r["rank"]) for r in found.where("id_a = 'both'").orderBy("rank").collect()] == [("both", 1), ("B0", 2)]


def test_merged_are_those_of_single_pairs(spark):
    assert {(r["id_a"], r["id_b"]) for r in scores(spark).merged().collect()} == {k for k, x in wanted().items() if x >= 0.88}


def test_merged_of_a_label_that_all_share(spark):
    assert {tuple(r) for r in common_label(spark, 300_000).merged().collect()} == {("A7", "B9"), ("both", "both")}
