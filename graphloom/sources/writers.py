"""Writers: sorted files, versions behind a pointer, and checks of copies."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, by: list[str], partition_by: list[str] | None = None) -> None:
    """Parquet files sorted by the columns, over as many tasks as the data needs."""
    writer = df.repartitionByRange(*[F.col(c) for c in by]).sortWithinPartitions(*by).write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files of the column line, sorted."""
    lines.select("line").repartitionByRange("line").sortWithinPartitions("line").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line, keys in order, nulls kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


class Versions:
    """Tables of one name, each version in a folder of its own; the last of numbered pointer files names the current one.

    A version is written whole before a new pointer names it, so readers see the old or the new one. A
    pointer lists the versions so far; rolling back twice comes back to where it began.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        found = self._fs.globStatus(self._path(f"{self.root}/pointers/*.json"))
        return sorted(f.getPath().getName() for f in found or [])

    def _read(self) -> list[str]:
        names = self._pointers()
        return json.loads(self.spark.read.text(f"{self.root}/pointers/{names[-1]}", wholetext=True).first()[0]) if names else []

    def _point(self, versions: list[str]) -> None:
        new = self._path(f"{self.root}/pointers/.{uuid.uuid4().hex}")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        number = int(self._pointers()[-1].split(".")[0]) + 1 if self._pointers() else 0
        if not self._fs.rename(new, self._path(f"{self.root}/pointers/{number:09d}.json")):
            raise OSError("another writer moved the pointer")

    def publish(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name}")
        self._point([*self._read(), name])
        return name

    def current(self) -> DataFrame:
        versions = self._read()
        if not versions:
            raise ValueError("nothing is published")
        return self.spark.read.parquet(f"{self.root}/{versions[-1]}")

    def rollback(self) -> str:
        versions = self._read()
        if len(versions) < 2:
            raise ValueError("there is no version before")
        versions[-1], versions[-2] = versions[-2], versions[-1]
        self._point(versions)
        return versions[-1]


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows with the same repetitions, by the number and the sum of row hashes."""
    mark = lambda df: df.select(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.sum(F.hash(*sorted(df.columns)).cast("decimal(38,0)"))).first()
    return mark(a) == mark(b)
