import datetime as dt
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.operators import orphans as op

DAY = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(400)]


def run(spark, refs, parents, **kw):
    edges = spark.createDataFrame(refs, "edge_id long, source string, at timestamp_ntz")
    nodes = spark.createDataFrame(parents, "node_key string, made timestamp_ntz, gone timestamp_ntz")
    r = op.reference_rows(edges, "edges", "source", "nodes", "edge_id", edges.source, edges["at"])
    return {(x["row_id"], x["key"]) for x in op.orphans(r, op.parent_rows(nodes, "nodes", "node_key", "made", "gone"), **kw).collect()}


def brute(refs, parents):
    strip = lambda k: None if k is None else k.strip()
    alive = lambda k, t: any(strip(n) == k and a is not None and a <= t and (z is None or z > t) for n, a, z in parents)
    return {(i, strip(k)) for i, k, t in refs if None not in (i, k, t) and not alive(strip(k), t)}


def test_times_gaps_and_white_space(spark):
    parents = [("a", DAY[10], DAY[20]), (" a", DAY[30], None), ("b", DAY[5], DAY[5]), ("c", None, None), (None, DAY[0], None), ("d", DAY[0], None), ("d", DAY[0], None)]
    refs = [(1, "a", DAY[9]), (2, "a ", DAY[10]), (3, "a", DAY[20]), (4, "　a", DAY[30]), (5, "b", DAY[5]), (6, "c", DAY[99]), (7, None, DAY[1]), (8, "d", None), (9, "", DAY[3]), (9, "", DAY[3]), (10, "nowhere", DAY[399])]
    assert run(spark, refs, parents) == brute(refs, parents) == {(1, "a"), (3, "a"), (5, "b"), (6, "c"), (9, ""), (10, "nowhere")}


def test_random_against_brute_force_in_many_ranges(spark):
    rng = random.Random(2)
    key = lambda: rng.choice(["hot", *map(str, range(40))])
    parents = [(key(), rng.choice(DAY), rng.choice([None, *DAY])) for _ in range(150)]
    refs = [(i, "hot" if i % 3 else key(), rng.choice(DAY)) for i in range(900)]
    assert run(spark, refs, parents, range_records=20) == brute(refs, parents)


def test_arrays_give_a_key_once_and_empty_tables_nothing(spark):
    rows = spark.createDataFrame([(1, ["x", " x", None, "y"], DAY[1]), (2, [], DAY[1]), (3, None, DAY[1])], "id long, keys array<string>, at timestamp_ntz")
    refs = op.reference_rows(rows, "t", "keys", "p", "id", rows["keys"], rows["at"])
    parents = op.parent_rows(spark.createDataFrame([("y", DAY[0], None)], "k string, a timestamp_ntz, z timestamp_ntz"), "p", "k", "a", "z")
    assert [(r["row_id"], r["key"], r["month"]) for r in op.orphans(refs, parents).collect()] == [(1, "x", 202401)]
    assert run(spark, [], []) == set() and run(spark, [], [("a", DAY[0], None)]) == set()


def test_columns_may_clash(spark):
    rows = spark.createDataFrame([(1, "x", DAY[1], 7)], "id long, key string, at timestamp_ntz, n int")
    refs = op.reference_rows(rows, "t", "key", "p", "id", rows["key"], rows["at"])
    parents = op.parent_rows(spark.createDataFrame([("y", DAY[0], None, 3)], "key string, first timestamp_ntz, last timestamp_ntz, parent int"), "p", "key", "first", "last")
    assert op.orphans(refs, parents).count() == 1


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 200_000)), st.sets(st.integers(0, 200_000)), st.booleans())
def test_bitmaps_are_sets(a, b, dense):
    if dense:
        a, b = a | set(range(0, 70_000, 3)), b | set(range(0, 70_000, 2))
    of = lambda s: op.Bitmap.of(np.array(sorted(s), np.int64))
    assert of(a).minus(of(b)).numbers().tolist() == sorted(a - b)
