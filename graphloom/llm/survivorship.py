"""The best representative of each group of duplicate records, chosen field by field."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graphloom.functions.canon import bare, is_missing
from graphloom.operators.skew import mark_members

#: A trusted source's vote counts so many times another's.
TRUST = 3.0
#: Ranks whose votes are told apart: 2 ** -48 is far above the precision of a double's sum of such votes.
RANKS = 48


def unpivot(df: DataFrame, group: str, fields: list[str], record: str, updated: str, source: str, trusted: DataFrame) -> DataFrame:
    """(g, field_name, norm, value, r, t, trusted): a long row for each value that can survive.

    norm is a hash of the value's letters and digits, under which spellings agree. trusted says
    whether the source is among trusted (one column). Null, blank and placeholder values, and rows with a null group, have no row.
    """
    pick = lambda c: F.col(f"`{c}`")
    rows = df.select(
        pick(group).alias("g"), pick(record).cast("long").alias("r"), pick(updated).cast("timestamp_ntz").alias("t"), pick(source).alias("s"),
        F.array(*[F.struct(F.lit(f).alias("field_name"), pick(f).cast("string").alias("value")) for f in fields]).alias("cells"),
    ).where("g is not null")
    rows = mark_members(rows, "s", trusted, "trusted")
    long = rows.select("g", "r", "t", "trusted", F.explode("cells").alias("c")).select("g", "c.field_name", "c.value", "r", "t", "trusted")
    return long.where(~is_missing(F.col("value"))).withColumn("norm", F.xxhash64(bare(F.col("value"))))


def decaying(long: DataFrame, latest: dt.datetime | None, half_life_days: float, trust: float = TRUST) -> DataFrame:
    """The long rows with their vote w: trust, or 1 for other sources, halved with each half_life_days of age.

    Age counts back from latest; a null time weighs like ten half-lives.
    """
    age = (F.timestamp_diff("SECOND", F.col("t"), F.lit(latest).cast("timestamp_ntz")) / 86400.0) / half_life_days if latest else F.lit(0.0)
    return long.withColumn("w", F.when(F.col("trusted"), trust).otherwise(1.0) * F.pow(F.lit(0.5), F.coalesce(age, F.lit(10.0))))


def ranked(long: DataFrame) -> DataFrame:
    """The long rows with their vote w, which halves with each place of the order of trust, recency and id in the group and field.

    A place's vote is worth more than all later ones together, so trust outweighs any number of recent
    votes and recency any number of equal ones. Votes beyond RANKS can't change a sum, and are left out: each
    map task sends at most RANKS rows of a group and field, whatever share of all rows the group holds.
    """
    place = F.row_number().over(W.Window.partitionBy("g", "field_name").orderBy(F.desc("trusted"), F.desc_nulls_last("t"), "r", F.desc("norm")))
    return long.withColumn("place", place).where(F.col("place") <= RANKS).withColumn("w", F.pow(F.lit(0.5), F.col("place"))).drop("place")


def elect(votes: DataFrame, digits: int | None = None) -> DataFrame:
    """(group, field_name, record, value): of each group and field the normalised value with most votes.

    Votes are added up by normalised value and max_by picks the winner, at equal votes (to so many digits, as
    the order of a sum of fractions may change its last ones) that of the best record; its record and spelling are those of its best record: of a trusted source first, then the
    latest (null is earliest), then of the smallest id. Both steps combine before they shuffle.
    """
    best = F.struct("trusted", "t", (-F.col("r")).alias("neg"))
    by_value = votes.groupBy("g", "field_name", "norm").agg(F.max(best).alias("best"), F.max_by("value", F.struct(best.alias("b"), F.col("value"))).alias("value"), F.sum("w").alias("w"))
    order = F.struct((F.col("w") if digits is None else F.round("w", digits)).alias("w"), F.col("best"))
    won = by_value.groupBy("g", "field_name").agg(F.max_by("best.neg", order).alias("neg"), F.max_by("value", order).alias("value"))
    return won.select(F.col("g").alias("group"), "field_name", (-F.col("neg")).alias("record"), "value")


def pivot(winners: DataFrame, df: DataFrame, group: str, fields: list[str], what: str = "value") -> DataFrame:
    """(group, each field, records): one surviving record per group of df, with the winners' values (or what else of them) as columns again.

    A field without a winner is null; records counts the group's rows, those without values included. A null group has no record.
    """
    cells = [F.max(F.when(F.col("field_name") == f, F.col(what))).alias(f) for f in fields]
    counts = df.groupBy(F.col(f"`{group}`").alias("group")).agg(F.count(F.lit(1)).alias("records")).where("group is not null")
    return counts.join(winners.groupBy("group").agg(*cells), "group", "left").select("group", *[F.col(f"`{f}`") for f in fields], "records")
