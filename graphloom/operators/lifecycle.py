"""A projection's life as a table of states: built, validated, active, retained, rolled back, quarantined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.scratch import write_table

#: What may follow a status of a projection.
NEXT = {None: ("building",), "building": ("candidate", "failed"), "candidate": ("validated", "quarantined"), "validated": ("active",), "active": ("retained", "destroyed"), "retained": ("active", "destroyed")}

_LOG = "seq long, projection_id string, backend string, status string, reason string"


class Projections:
    """The log of one backend's projections, kept by the driver: a few rows for each build."""

    def __init__(self, spark: SparkSession, backend: str):
        self.spark, self.backend = spark, backend
        self._rows: list[tuple] = []

    def log(self) -> DataFrame:
        return self.spark.createDataFrame(self._rows, _LOG)

    def status(self, projection: str) -> str | None:
        return next((r[3] for r in reversed(self._rows) if r[1] == projection), None)

    def active(self) -> str | None:
        names = dict.fromkeys(r[1] for r in self._rows)
        return next((n for n in names if self.status(n) == "active"), None)

    def _move(self, projection: str, status: str, reason: str | None = None) -> None:
        now = self.status(projection)
        if status not in NEXT.get(now, ()):
            raise ValueError(f"{projection} is {now}, it can't become {status}")
        self._rows.append((len(self._rows), projection, self.backend, status, reason))

    def build(self, projection: str, make: Callable[[], DataFrame]) -> DataFrame | None:
        """The projection's table, or none if making it fails; the reason is logged."""
        self._move(projection, "building")
        try:
            out = write_table(make())
        except Exception as e:
            self._move(projection, "failed", str(e).split("\n")[0][:200])
            return None
        self._move(projection, "candidate")
        return out

    def validate(self, projection: str, problems: DataFrame) -> bool:
        """Valid if there are no problems; else quarantined with their number."""
        n = problems.count()
        self._move(projection, "quarantined" if n else "validated", f"{n} problems" if n else None)
        return not n

    def activate(self, projection: str) -> None:
        if self.status(projection) not in ("validated", "retained"):
            raise ValueError(f"{projection} isn't valid")
        before = self.active()
        if before is not None:
            self._move(before, "retained")
        self._move(projection, "active")

    def rollback(self) -> str:
        """The retained projection that was active last becomes active again."""
        now = self.active()
        retained = [r[1] for r in self._rows if r[3] == "retained" and self.status(r[1]) == "retained"]
        if now is None or not retained:
            raise ValueError("there is nothing to roll back to")
        self.activate(retained[-1])
        return retained[-1]


def smoke(rows: DataFrame, columns: list[str], least: int = 1) -> DataFrame:
    """(check, ok): the columns are there, there are rows, and keys (the first column) aren't null."""
    have = all(c in rows.columns for c in columns)
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.col(columns[0]) if have else F.lit(None)).alias("keys"))
    check = lambda name, ok: F.struct(F.lit(name).alias("check"), ok.alias("ok"))
    checks = F.array(check("columns", F.lit(have)), check("rows", F.col("n") >= least), check("keys", F.col("n") == F.col("keys")))
    return counted.select(F.explode(checks).alias("x")).select("x.*")
