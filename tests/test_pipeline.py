import pytest
from pyspark.sql import functions as F

from graphloom.operators import lifecycle, matching, provenance, search
from graphloom.plans import pipeline

FACTS = "seq long, graph string, s string, p string, o string, confidence double, source string"


def entities(spark, rows):
    return spark.createDataFrame(rows, "id string, label string")


def test_two_graphs_become_one(spark):
    a = entities(spark, [("A1", "metformin"), ("A2", "type 2 diabetes"), ("A3", "aspirin")])
    b = entities(spark, [("B1", "metformin"), ("B2", "type 2 diabetes"), ("A3", "aspirin")])
    facts = spark.createDataFrame([(1, "a", "A1", "treats", "A2", 0.9, "x"), (2, "b", "B1", "treats", "B2", 0.8, "y"), (3, "b", "B1", "contraindicated_in", "B2", 0.1, "y"), (4, "a", "A3", "treats", "A2", None, "x")], FACTS)
    weights = dict(matching.WEIGHTS)
    matching.WEIGHTS["label"] = 1.0
    try:
        out = pipeline.fuse(a, b, facts, [("treats", "contraindicated_in")], [], reject=True)
        stages = {r["stage"]: r["rows"] for r in out.stages.collect()}
    finally:
        matching.WEIGHTS.update(weights)
    assert stages == {"entities_a": 3, "entities_b": 3, "facts_in": 4, "pairs": 3, "merged": 3, "redirected_ids": 5, "conflicts": 1, "facts_out": 2}
    assert {(r["s"], r["o"], r["statements"]) for r in out.facts.collect()} == {("A1", "A2", 2), ("A3", "A2", 1)}
    assert pipeline.problems(out).count() == 0


def test_one_graph_is_not_enough(spark):
    with pytest.raises(ValueError):
        pipeline.fuse(entities(spark, []), entities(spark, [("a", "b")]), spark.createDataFrame([], FACTS), [], [])


def test_projection_life(spark):
    p = lifecycle.Projections(spark, "parquet")
    good, bad = spark.range(0), spark.range(2)
    assert p.build("v1", lambda: spark.range(3)).count() == 3 and p.validate("v1", good)
    p.activate("v1")
    assert p.build("v2", lambda: spark.range(1).select(F.raise_error(F.lit("broken")).cast("string").alias("x"))) is None and p.status("v2") == "failed"
    p.build("v3", lambda: spark.range(1))
    assert not p.validate("v3", bad) and p.status("v3") == "quarantined"
    with pytest.raises(ValueError):
        p.activate("v3")
    p.build("v4", lambda: spark.range(1))
    p.validate("v4", good)
    p.activate("v4")
    assert p.rollback() == "v1" and p.active() == "v1" and p.status("v4") == "retained"
    assert p.log().where("status = 'active'").count() == 3


def test_smoke(spark):
    checks = lambda df, c: {r["check"]: r["ok"] for r in lifecycle.smoke(df, c).collect()}
    assert checks(spark.range(2), ["id"]) == {"columns": True, "rows": True, "keys": True}
    assert checks(spark.range(0), ["id", "x"])["rows"] is False and checks(spark.range(1), ["x"])["columns"] is False


def test_tiers_ratios_and_overlaps(spark):
    a = entities(spark, [("1", "alpha beta"), ("2", "gamma"), ("3", "one two three four five"), ("4", "x")])
    b = entities(spark, [("1", "zeta"), ("5", "alpha beta"), ("6", "alpha x"), ("7", "gamma delta kappa"), ("8", "nine two")])
    got = {(r["id_a"], r["id_b"]): r["method"] for r in matching.tiered_pairs(a, b).collect()}
    assert got == {("1", "1"): "exact_uri", ("1", "5"): "normalized_label", ("1", "6"): "domain_symbol_match", ("2", "7"): "domain_symbol_match", ("4", "6"): "domain_symbol_match"}
    pairs = spark.createDataFrame([("alpha", "alpho"), ("alpha", "a"), ("alpha", "omega")], "label_a string, label_b string")
    assert [(r["label_b"], round(r["ratio"], 2)) for r in matching.ratio_pairs(pairs, 0.7).collect()] == [("alpho", 0.8)]
    assert sorted(tuple(r) for r in matching.overlapping_labels(spark.createDataFrame([("red ring",), ("Red",), ("blue ring",), (None,)], "label string")).collect()) == [("blue ring", "red ring", 0.78), ("red", "red ring", 0.88)]


def test_vector_search_in_blocks(spark):
    v = spark.range(60).select(F.col("id").alias("key"), F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("vector")).repartition(5)
    q = v.where("key % 10 = 0").select(F.col("key").alias("query"), F.col("vector").alias("q"))
    rows = {r["key"]: r["vector"] for r in v.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for block in (2, 100):
        got = {}
        for r in search.nearest_many(v, q, 3, block=block).collect():
            got.setdefault(r["query"], []).append((-r["score"], r["key"]))
        assert {k: sorted(x) for k, x in got.items()} == {k: sorted((-dot(rows[k], y), j) for j, y in rows.items())[:3] for k in range(0, 60, 10)}
    many = {(r["query"], r["key"]) for r in search.nearest_many(v, q, floor=30.0).collect()}
    assert many == {(k, j) for k in range(0, 60, 10) for j, y in rows.items() if dot(rows[k], y) >= 30}
    assert search.nearest_many(v, q.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        search.nearest_many(v, q)


def test_provenance(spark):
    df = spark.createDataFrame([(["x:1", "artifact:2", "artifact:3"],), (["artifact_9"],), ([],), (None,)], "refs array<string>")
    assert [r[0] for r in df.select(provenance.source_artifact(F.col("refs"))).collect()] == ["artifact:2", "artifact:artifact_9", None, None]
    g = spark.createDataFrame([("graph_a", None, "n"), (None, "artifact:graph_a:1", "n"), (None, None, "load:graph_a"), (None, None, "graph_ab")], "g string, a string, n string")
    assert [r[0] for r in g.select(provenance.from_graph(F.col("g"), F.col("a"), F.col("n"), "graph_a")).collect()] == [True, True, False, False]
    log = spark.createDataFrame([(1, 1, "candidate", 1), (1, 2, "verified", 2), (1, 3, "promotion_review", 3), (2, 4, "candidate", 1)], "assertion_id long, event_id long, to_state string, ts long")
    said = spark.createDataFrame([(1, 10, True, 9), (2, 11, True, 9), (2, 12, False, 9)], "assertion_id long, event_id long, accept boolean, ts long")
    assert {r["event_id"]: r["allowed"] for r in provenance.decided(log, said).collect()} == {10: True, 11: False, 12: True}
