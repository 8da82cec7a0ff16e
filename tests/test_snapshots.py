"""Snapshots, neighbours and searches take the whole of a small world."""

import datetime
from decimal import Decimal

from graphloom.plans import fusion_queries, release_queries

TABLES = {
    "region": ("r_regionkey int", [(0,)]),
    "nation": ("n_nationkey int, n_regionkey int", [(1, 0)]),
    "customer": ("c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal decimal(15,2)", [(5, 1, "AUTO", Decimal("1.50"))]),
    "supplier": ("s_suppkey long, s_nationkey int, s_acctbal decimal(15,2)", [(7, 1, Decimal("-1.00"))]),
    "orders": ("o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string", [(8, 5, datetime.date(2020, 1, 2), "F")]),
    "part": ("p_partkey long, p_name string, p_size int, p_brand string", [(9, "ring", 3, "B#1")]),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long", [(8, 9, 7), (8, 9, 7)]),
}


def written(spark, folder):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_every_predicate_is_in_the_snapshot(spark, tmp_path):
    written(spark, tmp_path)
    got = {(r["subject"], r["predicate"], r["object"] or r["value"]) for r in release_queries.QUERIES["quads_read_back"](spark, str(tmp_path)).collect()}
    assert got == {
        ("nation:1", "partOf", "region:0"), ("customer:5", "locatedIn", "nation:1"), ("supplier:7", "locatedIn", "nation:1"), ("customer:5", "placed", "order:8"), ("order:8", "contains", "part:9"), ("supplier:7", "supplies", "part:9"),
        ("part:9", "name", "ring"), ("part:9", "size", "3"), ("part:9", "brandCode", "B#1"), ("order:8", "orderDate", "2020/01/02"), ("order:8", "status", '"F"'), ("customer:5", "segment", "AUTO"), ("customer:5", "balance", "1.50^^xsd:decimal"), ("supplier:7", "active", "no"),
    }


def test_orders_and_parts_are_neighbours(spark, tmp_path):
    written(spark, tmp_path)
    got = {r["id"]: (r["neighbours"], r["least"], r["most"]) for r in fusion_queries.QUERIES["neighbour_sets"](spark, str(tmp_path)).collect()}
    assert got["order:8"] == (2, "customer:5", "part:9") and got["part:9"] == (2, "order:8", "supplier:7")
    assert got["customer:5"] == (2, "nation:1", "order:8") and got["supplier:7"] == (2, "nation:1", "part:9")


def test_the_whole_text_is_searched(spark, tmp_path):
    rows = [("d1", "In the beginning"), ("d2", "x" * 80 + " found in the end"), ("d3", "y " * 50 + "the"), ("d4", "none"), ("d5", None)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id string, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["score"]) for r in release_queries.QUERIES["lexical_search"](spark, str(tmp_path)).collect()]
    assert got == [("d1", 1.0), ("d2", 0.7), ("d3", 0.4)]
