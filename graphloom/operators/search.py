"""Text and vector search over derived documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.functions.labels import search_terms
from graphloom.functions.vectors import cosine, dot


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, doc_id, tf)."""
    return docs.select("doc_id", F.explode(search_terms(F.col(text))).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def search(index: DataFrame, query: str, k: int) -> DataFrame:
    """The k documents with most occurrences of the query's terms, a term counting as often as the query has it; ties by doc_id."""
    terms = index.sparkSession.range(1).select(F.explode(search_terms(F.lit(query))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("times"))
    scored = index.join(F.broadcast(terms), "term").groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("times")).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def nearest(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k items (key, vector) with the largest inner product with the query's vector (one row: q); ties by key."""
    return vectors.join(F.broadcast(query)).select("key", F.round(dot(F.col("vector"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "key").limit(max(0, k))


def more_like(vectors: DataFrame, key: object, k: int) -> DataFrame:
    """The items nearest to the item with the key, which is among them."""
    return nearest(vectors, vectors.where(F.col("key") == F.lit(key)).limit(1).select(F.col("vector").alias("q")), k)


def semantic(vectors: DataFrame, query: DataFrame, k: int = 25, floor: float = 0.05) -> DataFrame:
    """The k best by cosine, and of these the ones above the floor."""
    best = vectors.join(F.broadcast(query)).select("key", F.round(cosine(F.col("vector"), F.col("q")), 4).alias("score")).orderBy(F.desc("score"), "key").limit(k)
    return best.where(F.col("score") > floor)


def by_alias(docs: DataFrame, alias: str) -> DataFrame:
    """Documents (doc_id, aliases) one of whose aliases is the given one, without case."""
    return docs.where(F.exists("aliases", lambda a: F.lower(a) == alias.lower())).select("doc_id", F.lit(1.0).alias("score"))


def lexical(docs: DataFrame, query: str, k: int = 25) -> DataFrame:
    """Documents (doc_id, label) whose label begins with the query (1.0), contains it (0.7) or one of its terms (0.4); ties by doc_id."""
    label, q = F.lower("label"), query.lower()
    term = F.arrays_overlap(search_terms(label), search_terms(F.lit(q)))
    score = F.when(label.startswith(q), 1.0).when(label.contains(q), 0.7).when(term, 0.4)
    return docs.select("doc_id", score.alias("score")).where("score is not null").orderBy(F.desc("score"), "doc_id").limit(k)


def facets(hits: DataFrame, group: str, k: int = 5) -> DataFrame:
    return hits.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).limit(k)


#: Queries of one pass, whose vectors each task holds.
QUERY_BLOCK = 4096


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int | None = None, floor: float | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, key, score): for every query (query, q) the k items (key, vector) with the largest inner product; ties by key.

    With a floor, only items that reach it count, and without k all of these.

    Queries pass in blocks of bounded size, which are broadcast; a task keeps the k best of its items for each query of
    the block, and the k best of these are found by query. Items or queries without a vector have no part in it.
    """
    spark = vectors.sparkSession
    key, out = vectors.schema["key"].dataType, None
    numbered = queries.where("q is not null").select("query", F.col("q").cast("array<double>").alias("q"))
    schema = T.StructType([T.StructField("query", queries.schema["query"].dataType), T.StructField("key", key), T.StructField("score", T.DoubleType())])
    held: list = []
    if k is None and floor is None:
        raise ValueError("k or floor must be given")
    name_type = to_arrow_type(queries.schema["query"].dataType)

    def search_block(rows: list) -> DataFrame:
        names, matrix = [r["query"] for r in rows], np.array([r["q"] for r in rows], np.float64)
        sent = spark.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                items = np.array(b["vector"].to_pylist(), np.float64)
                scores = np.round(items @ matrix.T, 6)
                ids = np.array(b["key"].to_pylist(), object)
                if k is None:
                    q, at = np.nonzero(scores.T >= floor)
                else:
                    order = np.lexsort((np.broadcast_to(np.argsort(np.argsort(ids)), scores.T.shape), -scores.T))[:, :k]
                    q, at = np.repeat(np.arange(len(names)), order.shape[1]), order.ravel()
                    kept = scores.T[q, at] >= (-np.inf if floor is None else floor)
                    q, at = q[kept], at[kept]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q], name_type), pa.array(ids[at].tolist(), b["key"].type), pa.array(scores.T[q, at])], names=["query", "key", "score"])

        return vectors.where("vector is not null").select("key", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, schema)

    for r in numbered.toLocalIterator():
        held.append(r)
        if len(held) == block:
            out = search_block(held) if out is None else out.union(search_block(held))
            held = []
    if held:
        out = search_block(held) if out is None else out.union(search_block(held))
    if out is None:
        return spark.createDataFrame([], schema)
    if k is None:
        return out
    rank = F.row_number().over(W.Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return out.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
