"""Small cases of validators, conflict modes, datasets, saved releases, presets, adapters and the benchmark."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import presets
from graphloom.functions import normalizers
from graphloom.operators import alignment, conflicts, evaluation, policies, projections, releases
from graphloom.sources import adapters

CHECKED = "id long, source_type string, candidate_type string, source_tax_id string, candidate_tax_id string, predicate string, is_salt boolean, is_active_moiety boolean, action string, is_isoform boolean, is_gene_locus boolean, source_granularity string, candidate_granularity string, has_required_evidence boolean, is_deprecated boolean, has_replacement boolean"


def test_entity_checks(spark):
    rows = [
        (1, "Protein", "Gene", "9606", "10090", "binds", True, True, "merge", True, True, "drug", "class", None, True, None),
        (2, None, "Gene", "9606", "10090", "orthologous_to", True, True, "keep", True, None, "drug", "", True, True, True),
    ]
    got = {(r["target"], r["check"]): (r["severity"], r["status"]) for r in policies.validate_entities(spark.createDataFrame(rows, CHECKED), "id").collect()}
    severities = {"BIO-TYPE-001": "BLOCKER", "BIO-TAXON-001": "ERROR", "BIO-DRUG-001": "BLOCKER", "BIO-ISOFORM-001": "ERROR", "BIO-GRANULARITY-001": "BLOCKER", "BIO-EVIDENCE-001": "BLOCKER", "BIO-ID-001": "ERROR"}
    assert {k[1]: v for k, v in got.items() if k[0] == "1"} == {c: (s, "FAIL") for c, s in severities.items()}
    assert {v for k, v in got.items() if k[0] == "2"} == {("INFO", "PASS")} and len(got) == 14


def test_policies_name_thresholds_they_have():
    good = {"conditions": {"sure": {"gte": ["score", "high"]}}, "thresholds": {"high": 0.9}}
    assert policies.load_policy(json.dumps(good))["conditions"] == [("sure", {"gte": ["score", "high"]})]
    with pytest.raises(ValueError):
        policies.load_policy(json.dumps(good | {"thresholds": {}}))


FACTS = "seq long, s string, p string, o string, confidence double"


def test_conflict_modes(spark):
    facts = spark.createDataFrame([(1, "a", "treats", "x", 0.5), (2, "a", "avoids", "x", 0.9), (3, "a", "treats", "x", 0.9), (4, "g", "encodes", "p", 1.0), (5, "g", "encodes", "q", 0.1), (6, "b", "binds", "x", None)], FACTS)
    run = lambda mode: {r["seq"]: (r["kept"], r["reason"], r["against"], r["action"], r["review"]) for r in conflicts.resolve(facts, [("treats", "avoids")], ["encodes"], mode).collect()}
    review = run("review")
    assert review[2] == (True, "contradiction", 1, "FLAGGED_FOR_HUMAN_REVIEW", True) and review[3] == (True, "repetition", 1, "EXACT_TRIPLE_PRESERVED", False)
    assert review[5][1] == "collision" and review[1] == review[6] == (True, None, None, None, False)
    assert {k: v[3] for k, v in run("preserve").items() if v[3]} == {2: "PRESERVED_BOTH_CLAIMS", 3: "EXACT_TRIPLE_PRESERVED", 5: "PRESERVED_BOTH_CLAIMS"}
    policy = run("policy")
    assert policy == run("reject") and not policy[1][0] and policy[2][0] and not policy[3][0] and policy[4][0] and not policy[5][0]


def test_preserving_modes_find_what_the_fold_finds(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice(["treats", "avoids", "encodes", "binds"]), rng.choice("xyz"), rng.random()) for i in range(80)]
    facts = spark.createDataFrame(rows, FACTS)
    folded = {(r["seq"], r["reason"], r["against"]) for r in conflicts.fold(facts, [("treats", "avoids")], ["encodes"], False).collect()}
    assert folded == {(r["seq"], r["reason"], r["against"]) for r in conflicts.resolve(facts, [("treats", "avoids")], ["encodes"], "preserve").collect()}


def test_preferred_sources(spark):
    rows = spark.createDataFrame([(("encodes", "HGNC", 1), ("encodes", "x", 2)), (("encodes", "x", 3), ("encodes", "hgnc", 4)), (("encodes", "x", 5), ("encodes", None, 6)), (("binds", "x", 7), ("binds", "hgnc", 8))], "a struct<p:string,source:string,seq:long>, b struct<p:string,source:string,seq:long>")
    of = lambda s: [tuple(r) for r in rows.select(*[c.alias(n) for c, n in zip(conflicts.by_authority("a", "b", s), ("w", "r"))]).collect()]
    assert of(conflicts.STRATEGIES[2]) == [(1, False), (4, False), (None, True), (7, False)]
    assert of(conflicts.STRATEGIES[0]) == [(None, False)] * 4 and of(conflicts.STRATEGIES[1]) == [(None, True)] * 4
    with pytest.raises(ValueError):
        conflicts.by_authority("a", "b", "any")


def test_saved_releases_keep_their_identity(spark):
    schema = "release_id string, " + ", ".join(f"{c} string" for c in releases.IDENTITY)
    old = spark.createDataFrame([("r1", "f", "a", "b", "d", "m"), ("r2", None, "a", "b", "d", "m")], schema)
    new = spark.createDataFrame([("r1", "f", "a", "b", "d", "m"), ("r2", "f", "a", "b", "d", "m"), ("r3", None, None, None, None, None), ("r3", "z", None, None, None, None)], schema)
    assert {tuple(r) for r in releases.save(old, new).collect()} == {("r1", "returned"), ("r2", "collision"), ("r3", "saved")}
    m = spark.createDataFrame([("p", "active", 5), ("q", "built", 1)], "projection_id string, status string, at long")
    u = spark.createDataFrame([("p", "retained", 1), ("n", "built", None)], m.schema)
    assert {tuple(r) for r in releases.upsert(m, u, "at").collect()} == {("p", "retained", 1), ("q", "built", 1), ("n", "built", None)}
    log = spark.createDataFrame([("r1", "PUBLISHED")], "release_id string, status string")
    asked = spark.createDataFrame([("r1", "PUBLISHED"), ("r2", "PUBLISHED")], log.schema)
    assert {tuple(r) for r in releases.status_change(log, asked).collect()} == {("r1", "repeated"), ("r2", "appended")}
    assert releases.status_change(log, spark.createDataFrame([("r1", "DRAFT")], log.schema).select("*")).first()["outcome"] == "conflict"


def test_profile_checks_and_property_differences(spark):
    rows = spark.createDataFrame([("a", "keeps"), ("b", "odd")], "subject string, predicate string")
    profile = projections.Profile(dropped=("gone",), unsupported=("odd",), on_unsupported="skip")
    run = lambda *args: {r["code"]: r["status"] for r in projections.profile_checks(rows, profile, ("n", "1"), ("n", "1"), *args).collect()}
    assert run(["gone"], ["odd"]) == {"profile_mismatch": "PASS", "undeclared_drop": "PASS", "undeclared_unsupported": "PASS", "unsupported_behavior": "FAIL"}
    assert run(["else"], ["what"])["undeclared_drop"] == run([], ["what"])["undeclared_unsupported"] == "FAIL"
    schema = "kind string, key string, identifier string, assertion_id string"
    x = spark.createDataFrame([("e", "1", "i", None), ("e", "2", "i", "a"), ("r", "3", "i", "a"), ("r", "4", None, "a")], schema)
    y = spark.createDataFrame([("e", "1", "i", None), ("e", "2", "j", "b"), ("r", "4", None, "b"), ("r", "5", None, None)], schema)
    assert {tuple(r) for r in projections.property_differences(x, y).collect()} == {("e", "2", "identifier_mismatch"), ("r", "3", "missing"), ("r", "4", "assertion_mismatch"), ("r", "5", "unexpected")}


def test_ways_of_reconciliation(spark):
    schema = "kind string, key string, digest string"
    x = spark.createDataFrame([("assertion", "1", "d"), ("entity", "e", "d"), ("relation", "r", "d")], schema)
    y = spark.createDataFrame([("assertion", "1", "d"), ("entity", "e", "x")], schema)
    run = lambda a, b, s: tuple(projections.reconcile(a, b, s).first())
    assert run(x, y, "rebuild") == run(x, y, "row_by_row") == (1, 1, 1, True, 1, 0, 1)
    assert run(x, y, "digest") == run(x, y, "stats") == (1, 1, 1, True, 0, 0, 0)
    assert run(x, y.where("kind <> 'assertion'"), "digest") == (1, 1, 1, False, 2, 0, 1)
    assert run(x.limit(0), y.limit(0), "rebuild") == (0, 0, 0, True, 0, 0, 0)
    with pytest.raises(ValueError):
        projections.reconcile(x, y, "any")


def test_normalizers(spark):
    df = spark.createDataFrame([(1, " A  b\tC "), (2, None), (3, "é __x__ y")], "id long, v string")
    chain = [("space", normalizers.white_space), ("nfc", normalizers.unicode), ("title", normalizers.case("title")), ("id", normalizers.identifier)]
    got = {(r["id"], r["step"]): (r["input"], r["output"], r["changed"]) for r in normalizers.run(df, "id", "v", chain).collect()}
    assert got[1, "space"] == (" A  b\tC ", "A b C", True) and got[1, "id"] == ("A B C", "A_B_C", True)
    assert got[2, "id"] == (None, None, False) and got[3, "nfc"][1] == "é __x__ y" and got[3, "id"][1] == "É_X_Y"
    assert spark.createDataFrame([("' a  b '",)], "v string").select(normalizers.literal(F.col("v"))).first()[0] == " a b "
    with pytest.raises(ValueError):
        normalizers.run(df, "id", "v", [("x", F.lower), ("x", F.lower)])


def test_presets(spark):
    rows = alignment.directional(spark.createDataFrame(presets.GENERAL.mappings(), "predicate string, target string, kind string, confidence double"))
    facts = spark.createDataFrame([("a", "worksAt", "b", "graph_b"), ("a", "fullName", "B", "graph_a"), ("a", "knows", "c", "graph_a")], "s string, p string, o string, graph string")
    assert [r["aligned"] for r in alignment.align_predicates(facts, rows).orderBy("p").collect()] == ["name", "knows", "employedBy"]
    with pytest.raises(ValueError):
        presets.Preset("x", high=0.5, review=0.6)


def test_disease_and_chemical_registries(spark):
    mondo = adapters.mondo_observations(spark.createDataFrame([('{"id":"MONDO:5","lbl":"flu"}',), ("{}",), ("broken",)], "json string"))
    assert [(r["source"], r["observation_id"]) for r in mondo.collect()] == [("mondo", "MONDO:5")]
    chebi = adapters.chebi_observations(spark.createDataFrame([("CHEBI_ID\tNAME\nCHEBI:1\taspirin\nCHEBI:2\tother\n",), ("CHEBI_ID\tNAME",), (None,)], "content string"))
    assert [(r["source"], r["observation_id"]) for r in chebi.collect()] == [("chebi", "CHEBI:1")]


def test_benchmark(spark):
    rows = spark.createDataFrame([("a", "x", 0.95, 1, "MERGE", 3), ("a", "y", 0.9, 0, "MERGE", 1), ("b", "x", 0.7, 1, "REVIEW", 2), ("b", "z", 0.1, 0, "KEEP", 9)], "q string, item string, p double, y int, decision string, ms int")
    got = {r["metric"]: r["value"] for r in evaluation.benchmark(rows).collect()}
    assert (got["precision"], got["recall"], got["false_positive_rate"], got["abstention"], got["recall_at_10"], got["p50_ms"], got["p99_ms"]) == (0.5, 0.5, 0.5, 0.25, 1.0, 2.0, 9.0)
    assert evaluation.benchmark(rows.limit(0)).where("metric = 'f1'").first()["value"] == 0.0
