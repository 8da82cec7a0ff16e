"""Append-only logs of states: replay, legal transitions, and the latest entry of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: The states that may follow a state; states without an entry are final.
TRANSITIONS = {
    "candidate": ("verified", "rejected", "abstained"),
    "verified": ("promotion_review", "rejected"),
    "promotion_review": ("approved", "rejected"),
    "approved": ("superseded", "retracted"),
}


def is_allowed(before: Column, after: Column) -> Column:
    """Whether a state may follow another, a null before being the start, which only candidate follows."""
    out = F.when(before.isNull(), after == "candidate")
    for state, nexts in TRANSITIONS.items():
        out = out.when(before == state, after.isin(*nexts))
    return F.coalesce(out.otherwise(False), F.lit(False))


def replay(log: DataFrame, key: str = "assertion_id", order: tuple[str, ...] = ("ts", "event_id"), state: str = "to_state") -> DataFrame:
    """Each entry with its number, the state before it and an error where it doesn't follow from that.

    Errors are data: duplicate_event, no_start (the first entry isn't the start), illegal_transition.
    A repeated event_id within a key is an error of the later one.
    """
    by = W.Window.partitionBy(key).orderBy(*order)
    same = W.Window.partitionBy(key, order[-1]).orderBy(*order)
    out = log.withColumn("n", F.row_number().over(by)).withColumn("from_state", F.lag(state).over(by)).withColumn("_again", F.row_number().over(same) > 1)
    error = F.when(F.col("_again"), "duplicate_event").when(~is_allowed(F.col("from_state"), F.col(state)), F.when(F.col("from_state").isNull(), "no_start").otherwise("illegal_transition"))
    return out.withColumn("error", error).drop("_again")


def resolve(log: DataFrame, key: str = "assertion_id") -> DataFrame:
    """One row per key: entries, the first error and its number, and the state, which is null after an error."""
    rows = replay(log, key)
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("entries"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("n"))).alias("error"),
        F.min(F.when(F.col("error").isNotNull(), F.col("n"))).alias("error_at"),
        F.max_by("to_state", "n").alias("last"),
    ).withColumn("state", F.when(F.col("error").isNull(), F.col("last"))).drop("last")


def latest(log: DataFrame, key: str, value: str, order: list[str], name: str) -> DataFrame:
    """The value of each key's last entry; map tasks combine, so a key may have any number of entries."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(name))


def latest_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, whole."""
    return rows.withColumn("_rank", F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def append_new(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of new to append: keys that existing lacks, the first of each by order. Writing twice changes nothing."""
    fresh = new.join(existing.select(*keys).distinct(), keys, "left_anti")
    return latest_rows(fresh, keys, [F.col(order)])


def advance(log: DataFrame, wanted: DataFrame, key: str = "assertion_id") -> DataFrame:
    """wanted (key, to_state) with the key's state and whether the step is allowed from it; a key with a broken log allows none."""
    now = resolve(log, key)
    out = wanted.join(now.select(key, F.col("state").alias("from_state"), F.col("error").alias("log_error")), key, "left")
    return out.withColumn("allowed", F.col("log_error").isNull() & is_allowed(F.col("from_state"), F.col("to_state")))
