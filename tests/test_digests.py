"""Digests of groups that fit no row."""

import hashlib

from pyspark.sql import functions as F

from graphloom.operators import digests


def test_grouped_digests_take_repeated_texts_once_in_any_partitioning(spark):
    rows = [("p", f"t{i % 5000}") for i in range(12_000)] + [("q", "ä"), ("q", "z"), ("r", "")]
    want = {}
    for p, t in sorted(set(rows), key=lambda x: (x[0], x[1].encode())):
        want.setdefault(p, []).append(t)
    want = {p: (len(x), hashlib.sha256("\n".join(["m", *x]).encode()).hexdigest()) for p, x in want.items()}
    df = spark.createDataFrame(rows, "p string, t string")
    for n in (1, 7):
        got = digests.grouped_digests(df.repartition(n), F.col("t"), "m", "p").collect()
        assert {r["p"]: (r["rows"], r["digest"]) for r in got} == want
    got = digests.sorted_digest(df.distinct(), F.col("t"), "m", ["p"]).collect()
    assert {r["p"]: (r["rows"], r["digest"]) for r in got} == want
    assert digests.grouped_digests(df.limit(0), F.col("t"), "m", "p").count() == 0
