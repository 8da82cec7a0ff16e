"""Values that a rewriting changes are found without a shuffle of the quads it leaves alone."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.operators import rdf
from graphloom.plans import release_queries

QUADS = "graph string, s string, p string, o string"
RULES = {"a": "b", "b": "a", "c": None, "d": "e", "f": "", "n": "a"}


def rewritten():
    o = F.col("o")
    for old, new in RULES.items():
        o = F.when(F.col("o") == old, F.lit(new).cast("string")).otherwise(o)
    return F.coalesce(o, F.when(F.col("o").isNull() & (F.col("p") == "p1"), "new"))


def wanted(rows):
    sets = defaultdict(lambda: (set(), set()))
    for *key, o in rows:
        new = RULES.get(o, o) if o is not None else "new" if key[2] == "p1" else None
        for values, v in zip(sets[tuple(key)], (o, new)):
            if v is not None:
                values.add(v)
    return {key for key, (x, y) in sets.items() if x != y and None not in key}


@pytest.mark.parametrize("most", [1000, 1])
def test_sets_of_values_are_compared(spark, monkeypatch, most):
    monkeypatch.setattr(rdf, "MAX_NAMED", most)
    draw = random.Random(3)
    rows = [("g", "swap", "p", "a"), ("g", "swap", "p", "b"), ("g", "held", "p", "d"), ("g", "held", "p", "e"), ("g", "only", "p", "d"), ("g", "gone", "p", "c"), ("g", "blank", "p", "f"), ("g", "null", "p1", None), ("g", "null", "p2", None), (None, "x", "p", "a"), ("g", None, "p", "a"), ("g", "x", None, "a"), ("g", "stays", "p", "z")]
    rows += [("g", f"s{draw.randrange(60)}", f"p{draw.randrange(3)}", draw.choice([*"abcdefnz", "", None])) for _ in range(400)]
    rows += rows[::3]  # repeated rows
    got = [tuple(r) for r in rdf.transformed_by(spark.createDataFrame(rows, QUADS), rewritten()).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted(rows)
    assert {s for _, s, _ in got} & {"swap", "held", "only", "gone", "blank", "null", "stays"} == {"held", "only", "gone", "blank", "null"}


def test_two_sets_of_quads_differ_where_their_rewriting_does(spark):
    draw = random.Random(4)
    rows = [("g", f"s{draw.randrange(60)}", f"p{draw.randrange(3)}", draw.choice("abdenz")) for _ in range(300)]
    quads = spark.createDataFrame(rows, QUADS)
    got = {tuple(r) for r in rdf.transformed(quads, quads.withColumn("o", rewritten())).collect()}
    assert got == {tuple(r) for r in rdf.transformed_by(quads, rewritten()).collect()} == wanted(rows)


def test_a_rewriting_that_changes_nothing(spark):
    assert rdf.transformed_by(spark.createDataFrame([("g", "s", "p", "o"), ("g", "s", "p", None)], QUADS), F.col("o")).count() == 0
    assert rdf.transformed_by(spark.createDataFrame([], QUADS), F.lit("x")).count() == 0


def test_one_key_may_hold_most_rows(spark):
    many = spark.range(50_000).select(F.lit("g").alias("graph"), F.lit("s").alias("s"), F.lit("p").alias("p"), F.concat(F.lit("v"), "id").alias("o"))
    drop = lambda v: F.when(F.col("o") == v, "v0").otherwise(F.col("o"))
    assert [tuple(r) for r in rdf.transformed_by(many, drop("v7")).collect()] == [("g", "s", "p")]
    assert rdf.transformed_by(many, drop("v0")).count() == 0


def small_world(spark, folder, lines=3000):
    """Orders' lines, some stated twice, and records without keys."""
    tables = {
        "region": ("r_regionkey int", [(0,)]),
        "nation": ("n_nationkey int, n_regionkey int", [(1, 0), (2, None)]),
        "customer": ("c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double", [(5, 1, "AUTO", 1.5)] + [(None, 1, f"segment {i}", None) for i in range(200)]),
        "supplier": ("s_suppkey long, s_nationkey int, s_acctbal double", [(7, 1, -1.0)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderstatus string", [(i, 5 if i % 3 else None, datetime.datetime(2020, 1, 2), "F") for i in range(200)]),
        "part": ("p_partkey long, p_name string, p_size int, p_brand string", [(9, "ring", 3, "B#1"), (10, None, None, "B#2")]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long", [(i // 2 if i % 5 else None, i // 2, 7) for i in range(lines)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return tables


def test_transformed_values_shuffles_few_quads_and_equals_its_sql(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    for name in small_world(spark, tmp_path):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(con.execute(release_queries.ORACLES["transformed_values"]).fetchall())
    quads = con.execute(f"with {release_queries._QUADS} select count(*) from quads").fetchall()[0][0]
    before = shuffled(spark)
    got = sorted(tuple(r) for r in release_queries.transformed_values(spark, str(tmp_path)).collect())
    assert len(want) > 100 and got == want
    assert shuffled(spark) - before < quads / 4


def shuffled(spark):
    """Rows that the session's stages have shuffled so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))
