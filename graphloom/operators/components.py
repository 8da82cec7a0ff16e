"""Connected components in joins, with a preferred representative."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import drop_table, write_table

#: Edges that one task takes at once, both directions counted.
ONE_TASK = 500_000


def least_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n numbered vertices, the least vertex that the edges (a, b) connect it with.

    Union-find in arrays: hook the larger root to the smaller one, then halve all paths, until no
    edge joins two trees.
    """
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    ids = {x: r for c, k in (("a", "rank_a"), ("b", "rank_b")) for x, r in zip(t[c].to_pylist(), t[k].to_pylist())}
    order = sorted(ids, key=lambda x: (ids[x], x))
    number = {x: i for i, x in enumerate(order)}
    ends = [np.fromiter(map(number.__getitem__, t[c].to_pylist()), np.int64, t.num_rows) for c in ("a", "b")]
    roots = least_roots(*ends, len(order))
    yield pa.RecordBatch.from_arrays([pa.array(order, t["a"].type), pa.array([order[r] for r in roots], t["a"].type)], names=["id", "root"])


def components(edges: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """(id, root) of every end of edges (a, b): the component's best vertex by rank, then by id.

    ranks (id, rank) may prefer some vertices; one without a rank comes last. Up to ONE_TASK edges are united in one task.
    Beyond that, in every round, a vertex takes the best label among its own and its
    neighbours', and then the label's own label; a round that changes nothing ends it. Each round is a
    written table, so a lost executor repeats one round at most. Null ends link nothing.
    """
    links = edges.select("a", "b").where("a is not null and b is not null")
    links = write_table(links.union(links.select(F.col("b"), F.col("a"))).distinct())
    ids = links.select(F.col("a").alias("id")).distinct()
    if ranks is None:
        labels = ids.select("id", F.struct(F.lit(0).alias("rank"), F.col("id").alias("id")).alias("label"))
    else:
        labels = ids.join(ranks.groupBy("id").agg(F.min("rank").alias("rank")), "id", "left").select("id", F.struct(F.coalesce("rank", F.lit(1 << 30)).cast("int").alias("rank"), F.col("id").alias("id")).alias("label"))
    if links.count() <= ONE_TASK:
        ranked = lambda c: labels.select(F.col("id").alias(c), F.col("label.rank").alias(f"rank_{c}"))
        whole = links.where("a <= b").join(ranked("a"), "a").join(ranked("b"), "b")
        return write_table(whole.coalesce(1).mapInArrow(_in_one_task, ids.schema.add("root", ids.schema["id"].dataType)))
    labels, changed = write_table(labels), 1
    while changed:
        heard = links.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "id", "left").select("id", "label", F.least("label", F.coalesce("heard", "label")).alias("near"))
        above = labels.select(F.col("id").alias("at"), F.col("label").alias("above"))
        jumped = near.join(above, F.col("near.id") == F.col("at"), "left").select("id", F.col("label").alias("old"), F.least("near", F.coalesce("above", "near")).alias("label"))
        rounds = write_table(jumped)
        changed = rounds.where("old <> label").limit(1).count()
        drop_table(labels)
        labels = rounds
    drop_table(links)
    return labels.select("id", F.col("label.id").alias("root"))
