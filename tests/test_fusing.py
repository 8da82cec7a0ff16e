from graphloom.plans import pipeline

FACTS = "seq long, graph string, s string, p string, o string, confidence double, source string"


def entities(spark, rows):
    return spark.createDataFrame(rows, "id string, label string")


def test_structure_and_identity_merge_different_ids(spark):
    """With the weights of production, an equal label alone decides nothing; neighbours or an identity key do."""
    a = entities(spark, [("A1", "metformin"), ("A2", "type 2 diabetes"), ("A3", "aspirin"), ("A4", "zeta")])
    b = entities(spark, [("B1", "metformin"), ("B2", "type 2 diabetes"), ("B3", "aspirin"), ("B4", "omega")])
    facts = spark.createDataFrame([(1, "graph_a", "A1", "treats", "A2", 0.9, "x"), (2, "graph_b", "B1", "treats", "B2", 0.8, "y"), (3, "graph_b", "B3", "binds", "B4", 0.8, "y")], FACTS)
    out = pipeline.fuse(a, b, facts, [], [], identity=spark.createDataFrame([("A4", "B4")], "id_a string, id_b string"))
    assert {(r["id_a"], r["id_b"]): r["decision"] for r in out.pairs.collect()} == {("A1", "B1"): "MERGE", ("A2", "B2"): "MERGE", ("A3", "B3"): "REVIEW", ("A4", "B4"): "MERGE"}
    assert {(r["s"], r["o"], r["statements"]) for r in out.facts.collect()} == {("A1", "A2", 2), ("B3", "A4", 1)}
    assert pipeline.problems(out).count() == 0


def test_disjoint_kinds_are_no_pairs_and_predicates_are_aligned(spark):
    a, b = entities(spark, [("A1", "alpha"), ("A2", "beta")]), entities(spark, [("A1", "alpha"), ("A2", "beta")])
    facts = spark.createDataFrame([(1, "graph_a", "A1", "treats", "A2", 0.9, "x"), (2, "graph_b", "A1", "unfit_for", "A2", 0.8, "y")], FACTS)
    kinds = spark.createDataFrame([("A1", "drug"), ("A2", "disease")], "id string, kind string")
    mappings = spark.createDataFrame([("unfit_for", "graph_b", "contraindicated_in", 1.0)], "predicate string, role string, target string, confidence double")
    identity = spark.createDataFrame([("A1", "A2")], "id_a string, id_b string")
    out = pipeline.fuse(a, b, facts, [("treats", "contraindicated_in")], [], True, identity, kinds=kinds, disjoint=spark.createDataFrame([("disease", "drug")], "x string, y string"), mappings=mappings)
    stages = {r["stage"]: r["rows"] for r in out.stages.collect()}
    assert {(r["id_a"], r["id_b"]) for r in out.pairs.collect()} == {("A1", "A1"), ("A2", "A2")}
    assert stages["pairs_before_veto"] == 3 and stages["aligned_facts"] == 1 and stages["conflicts"] == 1 and stages["facts_out"] == 1
