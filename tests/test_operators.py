import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import labels
from graphloom.operators import alignment, canonical, components, conflicts, digests, evaluation, graphs, matching, policies, projections, rdf, releases, search, skew, states


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("path", "error", "state"), [(["candidate", "verified", "promotion_review", "approved", "superseded"], None, "superseded"), (["verified"], "no_start", None), (["candidate", "approved"], "illegal_transition", None), (["candidate", "rejected", "verified"], "illegal_transition", None), (["candidate", "abstained"], None, "abstained")])
def test_replay(spark, path, error, state):
    log = spark.createDataFrame([(1, i, s, dt.datetime(2024, 1, 1, i)) for i, s in enumerate(path)], "assertion_id long, event_id long, to_state string, ts timestamp")
    r = states.resolve(log).first()
    assert (r["error"], r["state"], r["entries"]) == (error, state, len(path))


def test_repeated_events_and_appends(spark):
    log = spark.createDataFrame([(1, 5, "candidate", 1), (1, 5, "verified", 2)], "assertion_id long, event_id long, to_state string, ts long")
    assert states.resolve(log).first()["error"] == "duplicate_event"
    old = spark.createDataFrame([(1, "a", 0)], "k long, v string, n int")
    new = spark.createDataFrame([(1, "b", 1), (2, "c", 3), (2, "d", 2)], "k long, v string, n int")
    assert rows(states.append_new(old, new, ["k"], "n")) == [(2, "d", 2)]
    assert states.append_new(old.union(states.append_new(old, new, ["k"], "n")), new, ["k"], "n").count() == 0


@pytest.mark.parametrize("limit", [components.ONE_TASK, 0])
def test_components_prefer_by_rank(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "ONE_TASK", limit)
    edges = spark.createDataFrame([("a", "b"), ("b", "z"), ("c", "d"), (None, "q")], "a string, b string")
    assert rows(components.components(edges)) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("z", "a")]
    ranks = spark.createDataFrame([("z", 0), ("d", 1)], "id string, rank int")
    assert rows(components.components(edges, ranks)) == [("a", "z"), ("b", "z"), ("c", "d"), ("d", "d"), ("z", "z")]
    assert rows(components.components(edges.where("a is null"))) == []
    chain = spark.range(1, 60).selectExpr("concat('n', 1000 + id) as a", "concat('n', 1001 + id) as b")
    assert {r["root"] for r in components.components(chain).collect()} == {"n1001"}


def test_similar_sets_are_exact(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "of", *"abcdefghij"])
    make = lambda n: [(i, [word() for _ in range(rng.randrange(0, 6))]) for i in range(n)]
    a, b = make(60), make(60)
    j = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x and y else 0.0
    want = {(i, k) for i, x in a for k, y in b if j(x, y) >= 0.6}
    df = lambda x: spark.createDataFrame(x, "id long, tokens array<string>")
    assert {(r["id_a"], r["id_b"]) for r in matching.similar_sets(df(a), df(b), 0.6).collect()} == want
    assert matching.similar_sets(df(a).limit(0), df(b), 0.6).count() == 0


def test_pair_scores(spark):
    df = spark.range(1).select(matching.composite({"exact_id": F.lit(0.0), "label": F.lit(1.0), "structure": F.lit(1.0)}), matching.label_score(F.lit(False), F.lit(0.5), F.lit(True)), matching.band(F.lit(0.88)), matching.band(F.lit(0.65)), matching.band(F.lit(0.1)))
    assert tuple(df.first()) == (1.0, 0.75, "MERGE", "REVIEW", "KEEP")
    with pytest.raises(ValueError):
        matching.all_pairs(spark.range(100), spark.range(100))


def test_salted_join_gives_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "MIN_HOT", 10)
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    groups = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    assert rows(skew.salted_join(left, groups, ["k"], "n", F.col("id"))) == rows(left.join(groups, "k"))
    assert rows(skew.mark_members(left, "k", groups.where("n > 10").select("k"), "hot").where("hot").select("id")) == [(i,) for i in sorted(range(0, 300, 3), key=str)]
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 1)
    assert skew.mark_members(left, "k", groups.select("k"), "hot").where("hot").count() == 300


FACTS = "seq long, graph string, s string, p string, o string, confidence double, source string"


def test_facts_are_held_once(spark):
    df = spark.createDataFrame([(2, "b", "x", "ex:Treats", "y", 0.5, "s2"), (1, "a", "x", "treats", "y", 0.9, "s1"), (3, "a", "x", "treats", "z", None, None)], FACTS)
    got = {r["o"]: r for r in canonical.held_once(df).collect()}
    assert (got["y"]["p"], got["y"]["confidence"], got["y"]["origin"], got["y"]["graphs"], got["y"]["statements"]) == ("treats", 0.9, "s1+s2", "a+b", 2)
    assert got["z"]["id"] == "3" and got["y"]["id"].startswith("canon_")
    moved = canonical.redirect(df.where("seq = 1"), spark.createDataFrame([("x", "X")], "id string, root string")).first()
    assert (moved["s"], moved["o"], moved["redirected"]) == ("X", "y", True)


def test_conflicts_in_either_order(spark):
    df = spark.createDataFrame([(1, "a", "x", "treats", "y", 0.3, "s"), (2, "b", "x", "contraindicated_in", "y", 0.9, "s"), (3, "a", "x", "treats", "y", 0.5, "s"), (4, "a", "x", "born", "1", 0.5, "s"), (5, "a", "x", "born", "2", 0.5, "s"), (6, "a", "u", "treats", "y", 0.1, "s")], FACTS)
    rules = spark.createDataFrame([("contraindicated_in", "treats")], "x string, y string")
    assert rows(conflicts.contradictions(df, rules)) == [(2, 1)]
    assert rows(conflicts.functional_collisions(df, ["born"])) == [(5, 4)]
    got = {r["seq"]: (r["kept"], r["reason"]) for r in conflicts.fold(df, [("treats", "contraindicated_in")], ["born"], reject=True).collect()}
    assert got == {1: (False, None), 2: (True, "contradiction"), 3: (False, "repetition"), 4: (True, None), 5: (False, "collision"), 6: (True, None)}
    kept = {r["seq"] for r in conflicts.fold(df, [("treats", "contraindicated_in")], ["born"], reject=False).collect() if r["kept"]}
    assert kept == {1, 2, 3, 4, 5, 6}
    assert conflicts.fold(df.limit(0), [("a", "b")], ["c"], reject=True).count() == 0


def test_mappings_and_sources(spark):
    m = spark.createDataFrame([("knows", "meets", "equivalent", 0.5), ("Knows", "sees", "directed", 0.9)], "predicate string, target string, kind string, confidence double")
    assert alignment.directional(m).count() == 5
    facts = spark.createDataFrame([("a", "ex:knows", "b", "graph_a"), ("a", "rdf:type", "b", "graph_a")], "s string, p string, o string, graph string")
    aligned = alignment.align_predicates(facts, alignment.directional(m))
    assert sorted((r["p"], r["aligned"]) for r in aligned.collect()) == [("ex:knows", "sees"), ("rdf:type", "rdf:type")]
    a = spark.createDataFrame([("A1", "u1", "d1", 1), ("A2", "u2", "d1", 2)], "id string, uri string, digest string, seq long")
    b = spark.createDataFrame([("B1", "x", "d1", 1), ("B2", "u1", "zz", 2), ("B3", None, None, 3), ("B1", "x", "d1", 4)], "id string, uri string, digest string, seq long")
    assert rows(alignment.align_sources(a, b)) == [("A1", "B1", "digest")]


def test_quads_round_trip_and_lines(spark):
    a = spark.createDataFrame([("1", "x:1", "knows", "x:2", "approved"), ("2", "x:2", "knows", "x:3", "candidate")], "id string, s string, p string, o string, state string")
    v = spark.createDataFrame([("3", "x:1", "name", 'A "b" \\', "approved")], "id string, s string, p string, value string, state string")
    q = rdf.relationship_quads(a).union(rdf.attribute_quads(v))
    assert rows(rdf.from_quads(q)) == [("1", "relationship", "x:1", "knows", "x:2", None, "approved"), ("2", "relationship", "x:2", "knows", "x:3", None, "candidate"), ("3", "attribute", "x:1", "name", None, 'A "b" \\', "approved")]
    assert '<urn:assertion:3> <urn:assertion:value> "A \\"b\\" \\\\" <urn:graph:approved_assertion> .' in [r[0] for r in rdf.to_nquads(q).collect()]
    assert sorted(r["kind"] for r in rdf.records(q).collect()) == ["assertion", "assertion", "entity", "entity", "relation"]


def test_profiles(spark):
    r = spark.createDataFrame([("1", "relationship", "x:1", "knows", "x:2", None, "approved"), ("2", "attribute", "y:1", "name", None, "v", "approved")], "id string, kind string, subject string, predicate string, object string, value string, state string")
    p = projections.Profile
    assert [x["id"] for x in projections.project(r, p(namespaces=("x",))).collect()] == ["1"]
    assert projections.project(r, p(unsupported=("knows",), on_unsupported="skip")).count() == 1
    assert [x["value"] for x in projections.project(r, p(unsupported=("knows",), on_unsupported="flatten")).orderBy("id").collect()] == ["x:2", "v"]
    with pytest.raises(Exception, match="unsupported predicate knows"):
        projections.project(r, p(unsupported=("knows",), on_unsupported="error")).collect()
    with pytest.raises(ValueError):
        p(dropped=("a",), unsupported=("a",))
    assert [x[0] for x in projections.undeclared(r, p(dropped=("name",)), ()).collect()] == ["knows"]


def test_reconciliation_sees_every_kind_of_change(spark):
    x = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "key string, digest string")
    y = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("c", None)], "key string, digest string")
    assert rows(projections.compare(x, y, ["key"])) == [("b", "changed"), ("d", "unexpected")]
    assert rows(projections.compare(y, x, ["key"])) == [("b", "changed"), ("d", "missing")]
    assert rows(projections.bag_difference(x.union(x), x)) == [("a", "1", 1), ("b", "1", 1), ("c", None, 1)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "red red ring", ["Ring"], "red ring"), (2, "blue ring", None, "ring of blue"), (3, None, ["x"], "a red")], "doc_id long, text string, aliases array<string>, label string")
    index = search.postings(docs)
    assert [tuple(r) for r in search.search(index, "RED ring ring", 5).collect()] == [(1, 4), (2, 2)]
    assert [tuple(r) for r in search.search(index, "!!", 5).collect()] == []
    assert [r[0] for r in search.by_alias(docs, "rING").collect()] == [1]
    assert [tuple(r) for r in search.lexical(docs, "ring").collect()] == [(2, 1.0), (1, 0.7)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "key long, vector array<double>")
    assert [r[0] for r in search.more_like(v, 1, 2).collect()] == [1, 2] and search.nearest(v, v.limit(1).selectExpr("vector q"), 0).count() == 0
    assert [r[0] for r in search.semantic(v, v.where("key = 2").selectExpr("vector q")).collect()] == [2]


def test_graph_walks(spark):
    e = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("x", "p", "y")], "s string, p string, o string")
    assert rows(graphs.distances(e, "a", 5)) == [("a", 0), ("b", 1), ("c", 1)]
    assert rows(graphs.shortest_path(e, "a", "c")) == [(0, "a"), (1, "c")] and graphs.shortest_path(e, "a", "y").count() == 0
    kids = e.selectExpr("s child", "o parent")
    starts = spark.createDataFrame([("a",), ("y",)], "id string")
    assert rows(graphs.ancestors(kids, starts)) == [("a", "a"), ("a", "b"), ("a", "c")]
    assert rows(graphs.dangling(e, spark.createDataFrame([("a",), ("b",), ("c",)], "id string"))) == [("x", "p", "y", "o"), ("x", "p", "y", "s")]
    changed = graphs.diff(e, e.where("s <> 'x'").union(spark.createDataFrame([("a", "p", "n")], e.schema)))
    assert rows(changed) == [("added", "edge", "a|p|n"), ("added", "node", "n"), ("removed", "edge", "x|p|y"), ("removed", "node", "x"), ("removed", "node", "y")]


def test_policies(spark):
    df = spark.createDataFrame([(1, 5.0, "x", True, ["a"]), (2, None, None, None, [])], "id long, n double, t string, b boolean, evidence array<string>")
    value = lambda tree: [r[0] for r in df.orderBy("id").select(policies.condition(tree, df.schema, {"limit": 5.0})).collect()]
    assert value({"gte": ["n", "limit"]}) == [True, False] and value({"lte": ["b", 1]}) == [False, False] and value({"gte": ["t", 0]}) == [False, False]
    assert value({"equals": ["t", None]}) == [False, True] and value({"equals": ["no", None]}) == [False, False] and value({"exists": "t"}) == [True, False]
    assert value({"all": [{"not": {"exists": "t"}}, {"any": []}]}) == [False, False] and value({"all": []}) == [True, True]
    with pytest.raises(KeyError):
        policies.condition({"gte": ["n", "unknown"]}, df.schema, {})
    got = {r["id"]: (r["passed"], r["reasons"], r["missing_evidence"], r["review_role"]) for r in policies.decide(df, {"conditions": [("low", {"gte": ["n", 1]})], "required_evidence": ["a"], "review_routing": "r"}).collect()}
    assert got == {1: (True, "", "", None), 2: (False, "low", "a", "r")}
    gates = policies.gate(policies.validate(df, "id", [("c", "BLOCKER", F.col("n") > 1)]), ["target"])
    assert rows(gates) == [("1", "PASS", 1), ("2", "REVIEW", 1)]


def test_evaluation(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.1, 0), (1.0, 1), (None, 1)], "p double, y int")
    r = evaluation.calibration(df).first()
    assert r["n"] == 4 and r["precision"] == pytest.approx(2 / 3, abs=1e-6) and r["recall"] == 1.0 and r["brier"] == pytest.approx((0.01 + 0.64 + 0.01) / 4)
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 12)], "q long, item string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "c")], "q long, item string")
    assert rows(evaluation.recall_at(ranked, gold, [10, 20])) == [(10, 0.333333), (20, 0.666667)]
    v = spark.createDataFrame([("g", float(i)) for i in range(1, 11)], "g string, v double")
    assert rows(evaluation.nearest_rank(v, "v", [0.5, 0.95], ["g"])) == [("g", 0.5, 5.0), ("g", 0.95, 10.0)]


def test_digests_ignore_order_and_partitions(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("t"))
    first = digests.tree_digest(df, F.col("t")).first()
    assert first == digests.tree_digest(df.repartition(7).orderBy(F.desc("t")), F.col("t")).first() != digests.tree_digest(df.where("t <> '3'"), F.col("t")).first()
    text = "m\n" + "\n".join(sorted(str(i) for i in range(500)))
    want = hashlib.sha256(text.encode()).hexdigest()
    assert digests.streamed_digest(df, F.col("t"), "m") == want == digests.sorted_digest(df, F.col("t"), "m", []).first()["digest"]


def test_releases(spark):
    df = spark.createDataFrame([(1, ["a"], []), (2, [], ["e"]), (3, ["a"], ["e"]), (4, None, None)], "id long, artifacts array<string>, errors array<string>")
    assert [r["computed"] for r in releases.ingest_status(df).orderBy("id").collect()] == ["complete", "failed", "partial", "complete"]
    t = [dt.datetime(2024, 1, d) for d in range(1, 9)]
    m = spark.createDataFrame([("p1", "b", "ACTIVE", t[3], t[4], None), ("p2", "b", "retained", t[1], None, t[2]), ("p3", "b", "FAILED", t[5], None, t[6])], "projection_id string, backend string, status string, created_at timestamp, activated_at timestamp, retained_at timestamp")
    back = {r["projection_id"]: r["status"] for r in releases.rolled_back(m).collect()}
    assert back == {"p1": "retained", "p2": "active", "p3": "failed"}
    assert {r["projection_id"]: r["status"] for r in releases.rolled_back(releases.rolled_back(m)).collect()}["p1"] == "active"


def test_label_tokens(spark):
    df = spark.createDataFrame([("Ä b_c B", "b"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(labels.jaccard(labels.tokens(F.col("a")), labels.tokens(F.col("b")))).collect()] == [pytest.approx(1 / 3), 0.0]
