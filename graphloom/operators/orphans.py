"""References to records that do not exist, or not yet, or no longer, at the time of the reference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.canon import strip
from graphloom.functions.times import micros, month
from graphloom.operators.skew import partitions_for, salted_join
from graphloom.scratch import write_table

#: Records of the keys of one range that a Python worker takes; about 100 bytes each.
RANGE_RECORDS = 400_000

_INTERVALS = "parent string, key string, first long, last long"
_GAPS = "parent string, key string, month int, n long, after long, until long"
_LAST = np.iinfo(np.int64).max
_FIRST = np.iinfo(np.int64).min


class Bitmap:
    """A set of small integers in chunks of 65,536: sorted numbers where they are few, bits where they are many."""

    DENSE = 4096

    def __init__(self, chunks: dict[int, np.ndarray]):
        self.chunks = chunks

    @classmethod
    def of(cls, numbers: np.ndarray) -> Bitmap:
        numbers = np.unique(numbers)
        high = numbers >> 16
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        return cls({int(high[a]): cls._pack((part & 0xFFFF).astype(np.uint16)) for a, part in zip(starts, np.split(numbers, starts[1:]))} if len(numbers) else {})

    @classmethod
    def _pack(cls, low: np.ndarray) -> np.ndarray:
        if len(low) <= cls.DENSE:
            return low
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        return np.packbits(bits)

    @staticmethod
    def _low(chunk: np.ndarray) -> np.ndarray:
        return chunk if chunk.dtype == np.uint16 else np.flatnonzero(np.unpackbits(chunk)).astype(np.uint16)

    def minus(self, other: Bitmap) -> Bitmap:
        """This set AND NOT the other."""
        out = {}
        for high, mine in self.chunks.items():
            theirs = other.chunks.get(high)
            if theirs is None:
                out[high] = mine
                continue
            if mine.dtype == np.uint8 and theirs.dtype == np.uint8:
                rest = self._low(mine & ~theirs)
            else:
                rest = np.setdiff1d(self._low(mine), self._low(theirs), assume_unique=True)
            if len(rest):
                out[high] = self._pack(rest)
        return Bitmap(out)

    def numbers(self) -> np.ndarray:
        parts = [(high << 16) + self._low(self.chunks[high]).astype(np.int64) for high in sorted(self.chunks)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint ascending intervals [start, end) that cover the same times."""
    out: list[list[int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist())):
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _numbered(t: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """The keys as integers, and the dictionary that gives a key its integer."""
    name = pc.binary_join_element_wise(t["parent"], t["key"], "\x00")
    names = pc.unique(name)
    return pc.index_in(name, names).to_numpy().astype(np.int64), names


def _joined_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of a part of the rows, those of one key that touch being one."""
    schema = pa.schema([("parent", pa.string()), ("key", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
    for b in batches:
        t = pa.Table.from_batches([b]).cast(schema)
        number, _ = _numbered(t)
        several = np.bincount(number)[number] > 1
        yield from t.filter(pa.array(~several)).to_batches()
        rows = np.flatnonzero(several)
        if len(rows):
            rows = rows[np.argsort(number[rows], kind="stable")]
            first, last = t["first"].to_numpy(), t["last"].to_numpy()
            at, a, z = [], [], []
            for part in np.split(rows, np.flatnonzero(np.diff(number[rows])) + 1):
                for x, y in _merged(first[part], last[part]):
                    at.append(part[0]), a.append(x), z.append(y)
            keys = t.select(["parent", "key"]).take(pa.array(at, pa.int64()))
            yield from keys.append_column("first", pa.array(a, pa.int64())).append_column("last", pa.array(z, pa.int64())).to_batches()


def _range_gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gaps of the keys of one range: for each key and month with references, the times in which no row is in force."""
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    number, names = _numbered(t)
    month, n = t["month"].to_numpy(zero_copy_only=False), t["n"].to_numpy()
    first, last = t["first"].to_numpy(), t["last"].to_numpy()  # of references: their times; of parents: in force from, until
    is_ref = n > 0
    refs = np.flatnonzero(is_ref)
    rows = np.flatnonzero(~is_ref)
    rows = rows[np.lexsort((first[rows], number[rows]))]
    cuts = np.flatnonzero(np.diff(number[rows], prepend=-1))
    force = {int(number[part[0]]): _merged(first[part], last[part]) for part in np.split(rows, cuts[1:]) if len(part)} if len(rows) else {}

    out: dict[str, list] = {"parent": [], "key": [], "month": [], "n": [], "after": [], "until": []}
    for m in np.unique(month[refs]):
        mine = refs[month[refs] == m]
        low, high = int(first[mine].min()), int(last[mine].max())
        # a key whose row is in force from the period's first reference to its last is no orphan at any time of it
        whole = np.array([k for k in np.unique(number[mine]).tolist() if any(a <= low and high < b for a, b in force.get(k, ()))], np.int64)
        survivors = Bitmap.of(number[mine]).minus(Bitmap.of(whole)).numbers()
        count = dict(zip(number[mine].tolist(), n[mine].tolist()))
        for k in survivors.tolist():
            parent, key = names[k].as_py().split("\x00", 1)
            at = _FIRST
            for a, b in [*force.get(k, ()), (_LAST, _LAST)]:
                if at < a and not (a <= low or at > high):
                    for c, v in zip(out, (parent, key, int(m), count[k], at, a)):
                        out[c].append(v)
                at = b
    if out["key"]:
        schema = pa.schema([("parent", pa.string()), ("key", pa.string()), ("month", pa.int32()), ("n", pa.int64()), ("after", pa.int64()), ("until", pa.int64())])
        yield from pa.table(out, schema=schema).to_batches(max_chunksize=50_000)


def reference_rows(df: DataFrame, table: str, field: str, parent: str, row_id: str, key: Column, at: Column) -> DataFrame:
    """References of one field in one form: (ref_table, ref_field, parent, row_id, key, at); null keys and times are none.

    key is a string column or an array of strings, of which each element is a reference.
    """
    base = df.select(F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.lit(parent).alias("parent"), F.col(f"`{row_id}`").cast("long").alias("row_id"), key.alias("key"), at.cast("timestamp_ntz").alias("at"))
    if base.schema["key"].dataType.typeName() == "array":
        base = base.withColumn("key", F.array_distinct(F.transform("key", strip))).withColumn("key", F.explode("key"))
    else:
        base = base.withColumn("key", strip(F.col("key")))
    base = base.where("key is not null and at is not null and row_id is not null")
    return base.select("ref_table", "ref_field", "parent", "row_id", "key", micros(F.col("at")).alias("at"), month(F.col("at")).alias("month"))


def parent_rows(df: DataFrame, parent: str, key: str, start: str, end: str) -> DataFrame:
    """Rows that references may point to: (parent, key, first, last), in force from first until before last.

    A null start is never in force, a null end for ever.
    """
    since, until = micros(F.col(f"`{start}`")), micros(F.col(f"`{end}`"))
    rows = df.select(F.lit(parent).alias("parent"), strip(F.col(f"`{key}`")).alias("key"), since.alias("first"), F.coalesce(until, F.lit(_LAST)).alias("last"))
    return rows.where("key is not null and first is not null")


def orphans(refs: DataFrame, parents: DataFrame, range_records: int = RANGE_RECORDS) -> DataFrame:
    """(ref_table, ref_field, row_id, key, month) of each reference whose key has no row in force at its time.

    References are first counted by key and month, in map tasks before the shuffle, so that a key
    with a third of all references is one record a month. Keys are cut into ranges by hash. In a
    range they are encoded as integers, and each month gets a bitmap of the keys referred to and one
    of the keys in force throughout; the first AND NOT the second leaves the keys that are orphans at
    some time. These are decoded with the gaps in which no row is in force, and joined with the
    references of the key and month, hot keys salted; the time decides, exactly.
    A key is given once per row and field. Keys compare without surrounding white space. An empty
    key refers to nothing that exists unless a row has an empty key. months are yyyymm of UTC.
    """
    counted = refs.groupBy("parent", "key", "month").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    rows = parents.select("parent", "key", "first", "last").mapInArrow(_joined_intervals, _INTERVALS)
    none = [F.lit(0).alias("month"), F.lit(0).cast("long").alias("n")]
    both = write_table(counted.select("parent", "key", "month", "n", "first", "last").union(rows.select("parent", "key", *none, "first", "last")))
    ranges = partitions_for(both.count(), range_records)
    spread = both.repartition(max(ranges, both.sparkSession.sparkContext.defaultParallelism), "parent", "key")
    gaps = write_table(spread.mapInArrow(_range_gaps, _GAPS))
    found = salted_join(refs, gaps, ["parent", "key", "month"], "n", F.xxhash64("row_id", "ref_field"))
    found = found.where((F.col("at") >= F.col("after")) & (F.col("at") < F.col("until")))
    return found.select("ref_table", "ref_field", "row_id", "key", "month")
