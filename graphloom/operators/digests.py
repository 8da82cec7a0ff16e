"""Digests of whole tables that don't depend on the order or partitioning of their rows."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

#: Ranges that grouped_digests() works on at once; the driver holds their lines.
AHEAD = 5


def sorted_digest(rows: DataFrame, text: Column, marker: str, by: list[str]) -> DataFrame:
    """(by, rows, digest): the SHA-256 of the marker and the sorted rows' texts, a line each, for groups that fit a row."""
    texts = F.sort_array(F.collect_list(F.col("_t")))
    return rows.withColumn("_t", text).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat(F.lit(marker + "\n"), F.array_join(texts, "\n")), 256).alias("digest"))


def tree_digest(rows: DataFrame, text: Column, prefix: int = 2) -> DataFrame:
    """(rows, digest) of a table of any size: rows' digests are sorted within groups by their first digits, and the groups' digests make the whole.

    16 ** prefix groups hold equal shares of the rows, so prefix grows with the table; equal tables have equal digests.
    """
    d = rows.select(F.sha2(text, 256).alias("d"))
    groups = d.groupBy(F.substring("d", 1, prefix).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("d"))
    return groups.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "d"))), lambda x: F.concat(x["g"], x["d"])), ""), 256).alias("digest"))


def grouped_digests(rows: DataFrame, text: Column, marker: str, by: str) -> DataFrame:
    """(by, rows, digest): the digests of sorted_digest() for groups of any size, where a text repeated within a group counts once.

    Rows are put in order by ranges, so a group needn't fit a row or a task. Tasks join the sorted lines, and the driver
    takes a few ranges at a time, in order, into the digests. A null text is an error.
    """
    ordered = rows.select(by, text.alias("t")).repartitionByRange(by, "t").sortWithinPartitions(by, "t")
    lines = ordered.mapInArrow(_joined, StructType([rows.schema[by], StructField("rows", LongType()), StructField("lines", BinaryType())])).rdd
    sc, found = rows.sparkSession.sparkContext, {}
    fetch = lambda i: sc.runJob(lines, list, [i])
    with ThreadPoolExecutor(AHEAD) as pool:
        n = lines.getNumPartitions()
        waiting = deque(pool.submit(fetch, i) for i in range(min(AHEAD, n)))
        for i in range(AHEAD, n + AHEAD):
            for key, count, part in waiting.popleft().result() if waiting else ():
                total, digest = found.get(key) or (0, hashlib.sha256(marker.encode()))
                digest.update(b"\n")
                digest.update(part)
                found[key] = total + count, digest
            if i < n:
                waiting.append(pool.submit(fetch, i))
    schema = StructType([rows.schema[by], StructField("rows", LongType()), StructField("digest", StringType())])
    return rows.sparkSession.createDataFrame([(key, total, digest.hexdigest()) for key, (total, digest) in found.items()], schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(by, rows, lines) of sorted (by, t): a batch's different texts of one group, joined."""
    last = None
    for batch in batches:
        groups: dict = {}
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if row != last:
                groups.setdefault(row[0], []).append(row[1])
                last = row
        yield pa.RecordBatch.from_arrays([pa.array(groups, batch.schema.field(0).type), pa.array(map(len, groups.values()), pa.int64()), pa.array(["\n".join(x).encode() for x in groups.values()], pa.binary())], [batch.schema.field(0).name, "rows", "lines"])


def streamed_digest(rows: DataFrame, text: Column, marker: str) -> str:
    """The digest of sorted_digest() for a single group of any size: the sorted lines pass the driver one partition at a time."""
    out = hashlib.sha256(marker.encode() + b"\n")
    for i, r in enumerate(rows.select(text.alias("t")).orderBy("t").toLocalIterator()):
        out.update((b"\n" if i else b"") + r["t"].encode())
    return out.hexdigest()
