"""One group identifier for all records that pairs link, directly or through others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.canon import is_blank
from graphloom.operators.components import least_roots
from graphloom.operators.skew import partitions_for
from graphloom.scratch import drop_table, write_table

#: Edges that one union-find takes; about 150 bytes each in a Python worker.
FOREST_EDGES = 1_000_000

EDGE = T.StructType([T.StructField("v", T.StringType()), T.StructField("root", T.StringType())])


def spanning_forest(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Stars (v, root) that connect what the edges of a partition connect, root being the tree's least vertex.

    At most limit edges are held; beyond that, a forest of the edges so far takes their place, and
    if it is still too large it is sent on as it is.
    A vertex linked only to itself keeps its loop, so that no id is lost.
    """

    def forest(v: pa.ChunkedArray, root: pa.ChunkedArray) -> pa.Table:
        names = pc.unique(pa.chunked_array([*v.chunks, *root.chunks], pa.string()))
        names = names.take(pc.sort_indices(names))
        parent = least_roots(pc.index_in(v, names).to_numpy(), pc.index_in(root, names).to_numpy(), len(names))
        alone = np.bincount(parent, minlength=len(names))[parent] == 1
        child = np.flatnonzero((parent != np.arange(len(names))) | alone)
        return pa.table({"v": names.take(pa.array(child)), "root": names.take(pa.array(parent[child]))})

    held, rows = [], 0

    def shrink() -> pa.Table:
        t = pa.Table.from_batches(held).cast(pa.schema([("v", pa.string()), ("root", pa.string())]))
        return forest(t["v"], t["root"])

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= limit:
            t = shrink()
            if t.num_rows > limit // 2:
                yield from t.to_batches(max_chunksize=50_000)
                held, rows = [], 0
            else:
                held, rows = t.to_batches(), t.num_rows
    if held:
        yield from shrink().to_batches(max_chunksize=50_000)


def linked(df: DataFrame, left: str, right: str, keep: Column | None = None) -> DataFrame:
    """Edges (v, root) of the rows that link two ids: neither end null or blank."""
    a, b = F.col(f"`{left}`").cast("string"), F.col(f"`{right}`").cast("string")
    rows = df if keep is None else df.where(keep)
    return rows.where(a.isNotNull() & b.isNotNull() & ~is_blank(a) & ~is_blank(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("root"))


def groups(edges: DataFrame, limit: int = FOREST_EDGES) -> DataFrame:
    """(member, group) of each id of edges (v, root): the least id, by bytes, that links connect it with.

    Every edge partition gives a spanning forest. While the forests hold more than limit edges they
    are merged in rounds: first by vertex, where the trees that share a vertex meet, then by root,
    where a root meets its own parent. Partitions hold about limit edges each. In the second half a
    root with many vertices is spread over salts, and its parent is sent to each of them. Each round
    only lowers roots; when none changes, every tree is one component. Forests that together fit
    one partition are merged there at once.
    Repeated and reversed pairs and links of an id with itself change nothing; an id linked only to
    itself is its own group. An empty table gives an empty result.
    """
    span = lambda it: spanning_forest(it, limit)
    forest = write_table(edges.select("v", "root").mapInArrow(span, EDGE))
    n, settled = forest.count(), False
    while n > limit and not settled:
        parts = partitions_for(n, limit // 2)
        met = write_table(forest.repartition(parts, "v").mapInArrow(span, EDGE))
        drop_table(forest)
        lowered = write_table(_lower(met, parts, limit))
        drop_table(met)
        n, forest = lowered.count(), lowered
        settled = _settled(forest)
    if n <= limit:
        forest = write_table(forest.coalesce(1).mapInArrow(span, EDGE)) if n else forest
    else:
        forest = forest.distinct()  # two partitions may have linked the same two roots
    members = forest.select(F.col("v").alias("member"), F.col("root").alias("group")).where("member <> group")
    roots = forest.select("root").distinct().select(F.col("root").alias("member"), F.col("root").alias("group"))
    return members.union(roots)


def _lower(forest: DataFrame, parts: int, limit: int) -> DataFrame:
    """One step up for every vertex whose root has a parent itself; a vertex with several roots also links these."""
    heavy = forest.groupBy("root").count().where(F.col("count") > limit // 2)
    hot = heavy.collect()  # at most twice the partitions
    salts = 1 + max((r["count"] for r in hot), default=0) // max(1, limit // 2)
    parents = forest.where("v <> root").groupBy("v").agg(F.min("root").alias("up")).withColumnRenamed("v", "root")
    if not hot:
        return forest.join(parents, "root", "left").select("v", F.coalesce("up", "root").alias("root"))
    spark = forest.sparkSession
    marked = F.broadcast(spark.createDataFrame([(r["root"],) for r in hot], T.StructType([T.StructField("root", T.StringType())])).withColumn("hot", F.lit(True)))
    left = forest.join(marked, "root", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("v"), F.lit(salts))).otherwise(0).cast("int"))
    right = parents.join(marked, "root", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right.select("root", "salt", "up"), ["root", "salt"], "left").select("v", F.coalesce("up", "root").alias("root"))


def _settled(forest: DataFrame) -> bool:
    """True if each vertex has one root and no root has a parent."""
    several = forest.groupBy("v").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    above = forest.select("root").distinct().join(forest.where("v <> root").select(F.col("v").alias("root")), "root", "left_semi")
    return several.isEmpty() and above.isEmpty()
