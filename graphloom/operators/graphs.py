"""Differences of graphs, paths, lineage and checks of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import drop_table, write_table


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, kind, key): edges (s, p, o) added or removed, and nodes added or removed with one of these edges."""
    key = ["s", "p", "o"]
    x, y = before.select(*key).distinct(), after.select(*key).distinct()
    edges = y.join(x, key, "left_anti").withColumn("change", F.lit("added")).union(x.join(y, key, "left_anti").withColumn("change", F.lit("removed")))
    nodes = lambda e: e.select(F.explode(F.array("s", "o")).alias("n")).distinct()
    touched = edges.select("change", F.explode(F.array("s", "o")).alias("n")).distinct()
    new = touched.where("change = 'added'").join(nodes(x), "n", "left_anti")
    old = touched.where("change = 'removed'").join(nodes(y), "n", "left_anti")
    named = edges.select("change", F.lit("edge").alias("kind"), F.concat_ws("|", *key).alias("key"))
    return named.union(new.union(old.select(*new.columns)).select("change", F.lit("node"), "n"))


def distances(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(id, distance) of what is reached from start in at most depth undirected steps, each node at its least distance.

    Every step joins the newest nodes with the edges and leaves out those already reached; a step is a written table.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("s").alias("a"), F.col("o").alias("b")).union(edges.select("o", "s"))
    seen = spark.createDataFrame([(start, 0)], "id string, distance int")
    front = seen
    for step in range(1, depth + 1):
        found = both.join(front.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        front = write_table(found.select("id", F.lit(step).alias("distance")))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def shortest_path(edges: DataFrame, start: str, goal: str, depth: int = 8) -> DataFrame:
    """(hop, id): the nodes of a shortest path, the least ids where several are shortest; empty if there is none within depth, at most 8.

    The search goes back from the goal over nodes one step nearer to the start, so at most depth + 1 rows leave a step.
    """
    reached = distances(edges, start, min(depth, 8))
    near = write_table(reached)
    both = edges.select(F.col("s").alias("a"), F.col("o").alias("b")).union(edges.select("o", "s"))
    at = near.where(F.col("id") == goal).first()
    path = []
    while at is not None:
        path.append((at["distance"], at["id"]))
        if at["distance"] == 0:
            break
        back = both.where(F.col("a") == at["id"]).join(near.where(F.col("distance") == at["distance"] - 1), F.col("b") == F.col("id"))
        at = back.orderBy("id").select("id", "distance").first()
    drop_table(near)
    return edges.sparkSession.createDataFrame(path, "hop int, id string")


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id) of everything that starts (id) derive from, over edges (child, parent), directly or through others; loops end."""
    front = write_table(starts.select(F.col("id").alias("start"), F.col("id")))
    everything = None
    while True:
        found = edges.join(front, edges.child == front.id).select("start", F.col("parent").alias("id")).distinct()
        if everything is not None:
            found = found.join(everything, ["start", "id"], "left_anti")
        front = write_table(found)
        if front.isEmpty():
            break
        everything = front if everything is None else everything.union(front)
    return starts.sparkSession.createDataFrame([], "start string, id string") if everything is None else everything


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(s, p, o, end) of edges whose s or o is no node (id)."""
    out = None
    for end in ("s", "o"):
        bad = edges.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_anti").select("s", "p", "o", F.lit(end).alias("end"))
        out = bad if out is None else out.union(bad)
    return out


def three_hops(edges: DataFrame, first: str, second: str, third: str) -> DataFrame:
    """(a, b, c, d) of paths a -first- b -second- c -third- d over edges (s, p, o), each edge in either direction, each path once."""
    hop = lambda p, x, y: edges.where(F.col("p") == p).select(F.col("s").alias(x), F.col("o").alias(y)).union(edges.where(F.col("p") == p).select(F.col("o"), F.col("s"))).distinct()
    return hop(first, "a", "b").join(hop(second, "b", "c"), "b").join(hop(third, "c", "d"), "c").where("a <> c and b <> d").select("a", "b", "c", "d")


def last_targets(edges: DataFrame, predicate: str) -> DataFrame:
    """(s, o) with the last o by seq of each s, since a later statement replaces an earlier one."""
    return edges.where(F.col("p") == predicate).groupBy("s").agg(F.max_by("o", "seq").alias("o"))


def touching(edges: DataFrame, ids: list[str], limit: int = 100) -> DataFrame:
    """The first edges by seq that have one of ids at either end."""
    return edges.where(F.col("s").isin(ids) | F.col("o").isin(ids)).orderBy("seq").limit(limit)
