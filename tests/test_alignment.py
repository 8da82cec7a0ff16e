"""Sources are aligned component by component, with the choices of one fold over all."""

import random

from pyspark.sql import functions as F

from graphloom.operators import alignment

SOURCES = "id string, uri string, digest string, seq long"


def folded(a, b):
    taken, out = set(), set()
    for i, uri, digest, _ in sorted(b, key=lambda r: (r[3], r[0])):
        for name, at, value in (("uri", 1, uri), ("digest", 2, digest)):
            free = next((r[0] for r in sorted(a, key=lambda r: (r[3], r[0])) if value is not None and r[at] == value and r[0] not in taken), None)
            if free is not None:
                taken.add(free)
                out.add((free, i, name))
                break
    return out


def test_components_choose_as_one_fold_would(spark):
    rng = random.Random(5)
    some = lambda letter, n: None if rng.random() < 0.2 else f"{letter}{rng.randrange(n)}"
    a, b = ([(f"{s}{i}", some("u", 60), some("d", 60), rng.randrange(30)) for i in range(80)] for s in "AB")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = alignment.align_sources(spark.createDataFrame(a, SOURCES), spark.createDataFrame(b, SOURCES)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["id_a"], r["id_b"], r["pass"]) for r in got} == folded(a, b) and len(got) == len(folded(a, b))
    lone = [(f"{i}", f"u{i}", None, i) for i in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = alignment.align_sources(spark.createDataFrame(lone, SOURCES), spark.createDataFrame(lone, SOURCES)).select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1  # independent sources are not folded in one task
