"""Recursive radix partitioning of byte strings, and tries that count them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: Rows that a map task holds before it emits their partial counts.
PARTIAL_ROWS = 400_000
#: Bytes by which a pass splits a prefix.
STEP = 2
#: Bytes that a record needs in a bucket's arrays besides those of its string.
RECORD_BYTES = 100

PARTIAL = T.StructType([T.StructField("k", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("first", T.LongType())])


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, n, first) of a part of the rows: what is equal within it becomes one record before anything is shuffled."""

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by("k").aggregate([("n", "sum"), ("first", "min")])
        yield from t.select(["k", "n_sum", "first_min"]).rename_columns(["k", "n", "first"]).to_batches(max_chunksize=50_000)

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= PARTIAL_ROWS:
            yield from emit(held)
            held, rows = [], 0
    if held:
        yield from emit(held)


def radix_plan(sized: DataFrame, limit: int) -> list[bytes]:
    """Lower bounds of the buckets, ascending: ranges of prefixes of k whose sizes add up to limit each at most.

    sized has k (binary, no zero bytes) and size (long). All strings start in one bucket. While a prefix holds more than
    half of limit, it is split by the next bytes, in a pass over its strings only; what all strings of the
    large prefixes have in common is passed over at once. A single string is never split.
    Next bytes are counted, and small neighbours put together, in tables. The driver gets bounds and large prefixes:
    about four for each limit of the total, which is what each task needs to find the bucket of a string.
    """
    spark = sized.sparkSession
    bounds: list[bytes] = []
    half = max(1, limit // 2)
    big, depth = [b""], 0
    while big:
        part = sized
        if depth:
            over = spark.createDataFrame([(bytearray(p),) for p in big], T.StructType([T.StructField("p", T.BinaryType())]))
            part = part.join(F.broadcast(over), F.substring("k", 1, depth) == F.col("p"), "left_semi")  # each holds more than half of limit
            ends = part.groupBy(F.substring("k", 1, depth)).agg(F.min("k").alias("a"), F.max("k").alias("b")).collect()
            depth = max(depth, min(_common(bytes(r["a"]), bytes(r["b"])) for r in ends))
        sums = part.groupBy(F.substring("k", 1, depth + STEP).alias("p")).agg(F.sum("size").alias("size"))
        large = (F.col("size") > half) & (F.length("p") == depth + STEP)
        row = W.Window.partitionBy(F.substring("p", 1, depth)).orderBy("p")  # at most 256 ** STEP rows
        run = F.floor((F.sum(F.when(large, 0).otherwise(F.col("size"))).over(row) - 1) / half)
        marked = sums.withColumns({"large": large, "run": run})
        first = F.col("large") | F.coalesce(F.lag("large").over(row) | (F.lag("run").over(row) < F.col("run")), F.lit(True))
        found = marked.withColumn("first", first).where("first").select("p", "large").collect()
        big = [bytes(r["p"]) for r in found if r["large"]]
        bounds += [bytes(r["p"]) for r in found if not r["large"]]
        depth += STEP
    return sorted(bounds)


def _common(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _fixed(strings: pa.Array, width: int) -> np.ndarray:
    """The first width bytes of each string, in numpy's order of bytes."""
    heads = pc.binary_slice(strings.cast(pa.binary()), 0, width)
    offsets = np.frombuffer(heads.buffers()[1], np.int32)[heads.offset : heads.offset + len(heads) + 1].astype(np.int64)
    data = np.frombuffer(heads.buffers()[2] or b"", np.uint8)
    at = np.arange(width)
    inside = at < np.diff(offsets)[:, None]
    out = np.zeros((len(heads), width), np.uint8)
    out[inside] = data[(offsets[:-1, None] + at)[inside]]
    return np.ascontiguousarray(out).view(f"S{width}").ravel()


def places(strings: pa.Array, bounds: list[bytes]) -> np.ndarray:
    """The number of the bucket whose range holds each string."""
    width = max(1, max(map(len, bounds)))
    return np.maximum(0, np.searchsorted(np.array(bounds, f"S{width}"), _fixed(strings, width), "right") - 1)


def assign(batches: Iterator[pa.RecordBatch], bounds: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the bucket whose range holds k."""
    for b in batches:
        at = pa.array(places(b["k"], bounds).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*b.columns, at], names=[*b.schema.names, "bucket"])


class Trie:
    """A trie over byte strings, four bytes an edge, kept level by level in arrays.

    A node is a number; an edge of a level is the pair (node, next four bytes). Each string ends in
    a node, and that node's counters add up what was put in for the string. Strings hold no zero byte.
    """

    STRIDE = 4

    def __init__(self, keys: pa.Array):
        offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
        data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
        length = np.diff(offsets)
        padded = np.concatenate([data, np.zeros(self.STRIDE, np.uint8)])
        node, live, self.nodes, depth = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1, 0
        self.end = np.zeros(len(keys), np.int64)
        while len(live):
            at, left = offsets[live] + depth, length[live] - depth
            chunk = np.zeros(len(live), np.int64)
            for i in range(self.STRIDE):
                chunk = (chunk << 8) | np.where(left > i, padded[np.minimum(at + i, len(padded) - 1)], 0)
            edges, child = np.unique((node[live] << 32) | chunk, return_inverse=True)
            node[live] = self.nodes + child
            self.nodes += len(edges)
            depth += self.STRIDE
            over = left <= self.STRIDE
            self.end[live[over]] = node[live[over]]
            live = live[~over]

    def terminals(self, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each node where strings end: a string's position, the sum of n and the least of first."""
        _, where, term = np.unique(self.end, return_index=True, return_inverse=True)
        count = np.zeros(len(where), np.int64)
        np.add.at(count, term, n)
        least = np.full(len(where), np.iinfo(np.int64).max)
        np.minimum.at(least, term, first)
        return where, count, least


def count_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, n, first) of each distinct string of a bucket, whose partial records are at most the plan's limit."""
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    keys = t["k"].combine_chunks()
    if isinstance(keys, pa.ChunkedArray):
        keys = pa.concat_arrays(keys.chunks)
    keys = keys.cast(pa.binary())
    where, count, least = Trie(keys).terminals(t["n"].to_numpy(), t["first"].to_numpy())
    out = pa.table({"k": keys.take(pa.array(where)), "n": count, "first": least})
    yield from out.to_batches(max_chunksize=50_000)


def radix_count(keyed: DataFrame, write, drop, limit: int) -> DataFrame:
    """(k, n, first) of each distinct k of keyed (k binary, n long, first long), in buckets of about limit bytes."""
    partials = write(keyed.mapInArrow(partial_counts, PARTIAL))
    bounds = radix_plan(partials.select("k", (F.length("k") + RECORD_BYTES).cast("long").alias("size")), limit)
    if not bounds:
        return partials
    placed = partials.mapInArrow(lambda it: assign(it, bounds), T.StructType([*PARTIAL.fields, T.StructField("bucket", T.IntegerType())]))
    counted = write(placed.repartitionById(len(bounds), F.col("bucket")).select("k", "n", "first").mapInArrow(count_bucket, PARTIAL))
    drop(partials)
    return counted
