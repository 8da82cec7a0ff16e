import datetime as dt
import random

from graphloom.llm import survivorship as sv

SCHEMA = "record_id long, canonical_id string, label string, color string, source string, updated_at timestamp_ntz"
T = [dt.datetime(2024, 1, d) for d in range(1, 29)]


FIELDS = ["label", "color"]


def winners(spark, df, trusted=(), half_life_days=None, fields=FIELDS):
    t = spark.createDataFrame([(x,) for x in trusted], "id string")
    long = sv.unpivot(df, "canonical_id", fields, "record_id", "updated_at", "source", t)
    return sv.elect(sv.ranked(long)) if half_life_days is None else sv.elect(sv.decaying(long, T[-1], half_life_days), digits=9)


def vote(spark, rows, trusted=(), **kw):
    return {(r["group"], r["field_name"]): (r["record"], r["value"]) for r in winners(spark, spark.createDataFrame(rows, SCHEMA), trusted, **kw).collect()}


def test_trust_then_time_then_id(spark):
    rows = [(1, "c", "A", "red", "s1", T[1]), (2, "c", "B", "N/A", "s2", T[5]), (3, "c", "C", None, "s3", T[5]), (4, "d", "x", "  ", None, None), (5, "d", "y", "--", None, None)]
    got = vote(spark, rows)
    assert got["c", "label"] == (2, "B") and got["c", "color"] == (1, "red")
    assert got["d", "label"] == (4, "x") and ("d", "color") not in got
    assert vote(spark, rows, trusted=["s1"])["c", "label"][0] == 1


def test_null_time_is_earliest(spark):
    rows = [(1, "c", "A", "r", "s", None), (2, "c", "B", "g", "s", T[0])]
    assert vote(spark, rows)["c", "label"][0] == 2


def test_placeholders_never_survive(spark):
    words = ["N/A", "null", "NONE", "(none)", "to be determined", "not available", "?", "...", "#N/A", "Unknown", "TBD", "nan", "　", ""]
    got = vote(spark, [(i, "c", w, w, "s", T[2]) for i, w in enumerate(words)] + [(99, "c", "Nantes", "#888888", "s", T[0])])
    assert got["c", "label"][1] == "Nantes" and got["c", "color"][1] == "#888888"


def test_votes_add_up_by_normal_form(spark):
    rows = [(1, "c", "New", "r", "s", T[20]), (2, "c", "OLD name", "r", "s", T[15]), (3, "c", "old-name", "r", "s", T[16])]
    assert vote(spark, rows)["c", "label"][1] == "New"
    assert vote(spark, rows, half_life_days=30.0)["c", "label"][:2] == (3, "old-name")


def test_empty_repeated_and_clashing_columns(spark):
    assert vote(spark, []) == {}
    rows = [(1, "c", "A", "r", "s", T[1])] * 3 + [(2, None, "B", "g", "s", T[1])]
    assert vote(spark, rows) == {("c", "label"): (1, "A"), ("c", "color"): (1, "r")}
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as g", "2 as r", "3 as t", "4 as trusted", "5 as value", "6 as field_name", "7 as w", "8 as norm", "9 as place")
    out = winners(spark, df, fields=["label"])
    assert [tuple(r) for r in out.collect()] == [("c", "label", 1, "A")]
    assert [tuple(r) for r in sv.pivot(out, df, "canonical_id", ["label"]).collect()] == [("c", "A", 3)]


def test_pivot_gives_one_record_per_group(spark):
    df = spark.createDataFrame([(1, "c", "A", None, "s", T[1]), (2, "c", None, "red", "s", T[2]), (3, "d", None, None, "s", T[2])], SCHEMA)
    for half_life in (None, 10.0):
        won = winners(spark, df, half_life_days=half_life)
        assert sorted(tuple(r) for r in sv.pivot(won, df, "canonical_id", FIELDS).collect()) == [("c", "A", "red", 2), ("d", None, None, 1)]


def test_one_early_place_outweighs_all_later_ones(spark):
    rows = [(i, "c", "B", "r", "s", T[9]) for i in range(2, 400)] + [(1, "c", "A", "r", "s", T[9])]
    assert vote(spark, rows)["c", "label"] == (1, "A")
    rng = random.Random(5)
    rows = [(i, rng.choice("cd"), rng.choice("ABCD"), rng.choice(["r", None]), rng.choice("stu"), rng.choice([*T, None])) for i in range(600)]
    best = {}
    for r, g, label, color, source, t in rows:
        for f, v in (("label", label), ("color", color)):
            if v:
                best[g, f] = min(best.get((g, f), ((2,),)), ((source != "s", -(t or dt.datetime.min).toordinal(), r), r, v))
    assert vote(spark, rows, trusted=["s"]) == {k: v[1:] for k, v in best.items()}


def test_hot_group_sends_few_rows(spark):
    df = spark.range(5000).selectExpr("id as record_id", "'c' as canonical_id", "concat('v', id) as label", "'r' as color", "'s' as source", "timestamp_ntz'2024-01-01' as updated_at")
    out = winners(spark, df, fields=["label"])
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.first()["record"] == 0
