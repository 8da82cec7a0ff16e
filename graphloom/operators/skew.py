"""Joins of rows with one record per key, where one key may hold a third of all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are salted are broadcast; at most this many can hold 1 / MAX_HOT of the rows each.
MAX_HOT = 2000
#: A key below this many rows is never worth a salt.
MIN_HOT = 100_000


def salted_join(rows: DataFrame, groups: DataFrame, on: list[str], weight: str, row_hash: Column) -> DataFrame:
    """Inner join of rows with groups (few records per key; their weight says how many rows it has).

    Keys heavier than 1 / MAX_HOT of all rows are fewer than MAX_HOT, so their list can be broadcast
    whatever the size of the data; their rows are spread over salts and their record is repeated
    once per salt. The others join as they are, in the same shuffle.
    groups is read twice, so it should be a written table. A null key joins nothing.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    hot_at = max(MIN_HOT, total // MAX_HOT)
    salts = F.least(F.lit(4096), F.ceil(F.col(weight) / hot_at).cast("int") + 1)
    hot = groups.where(F.col(weight) >= hot_at).groupBy(*on).agg(F.max(salts).alias("_salts"))
    keys = hot.collect()  # fewer than MAX_HOT
    if not keys:
        return rows.join(groups, on)
    hot = rows.sparkSession.createDataFrame(keys, hot.schema)
    left = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(row_hash, F.col("_salts"))).cast("int")).drop("_salts")
    right = groups.withColumn("_salt", F.explode(F.when(F.col(weight) >= hot_at, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "_salt"]).drop("_salt")


def spread_join(x: DataFrame, y: DataFrame, on: str, most: int = 1_000_000) -> DataFrame:
    """Inner join of rows with rows, where one key may make a large share of all pairs: no task makes many more than most of one key's pairs.

    A key is cut by the hash of x's rows into as many salts as its pairs need, and its rows of y are repeated once per salt.
    """
    count = lambda df, name: df.groupBy(on).agg(F.count(F.lit(1)).alias(name))
    pairs = F.col("_nx") * F.col("_ny")
    weights = count(x, "_nx").join(count(y, "_ny"), on).select(on, pairs.alias("_pairs"), F.least(F.col("_nx"), F.lit(4096), F.ceil(pairs / most)).cast("int").alias("_salts"))
    total = weights.agg(F.sum("_pairs")).first()[0] or 0
    n = max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, partitions_for(total, most)))
    left = x.join(weights.drop("_pairs"), on).withColumn("_salt", F.pmod(F.xxhash64(*x.columns), F.col("_salts")).cast("int")).drop("_salts")
    right = y.join(weights.drop("_pairs"), on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return left.repartition(n, on, "_salt").join(right.repartition(n, on, "_salt").hint("merge"), [on, "_salt"]).drop("_salt")


def partitions_for(rows: int, per_partition: int) -> int:
    """Partitions that hold at most per_partition rows each on average."""
    return max(1, math.ceil(rows / per_partition))


#: Distinct keys that are broadcast after they have been counted.
BROADCAST_KEYS = 200_000


def mark_members(rows: DataFrame, column: str, keys: DataFrame, mark: str, salts: int = 16) -> DataFrame:
    """rows with a boolean column mark: whether column is among keys (one column). A null is among none.

    The distinct keys are counted. Up to BROADCAST_KEYS of them are broadcast; more are repeated
    once per salt and joined with salted rows, so that one value of a third of all rows is spread.
    """
    distinct = keys.select(F.col(keys.columns[0]).alias("_key")).where("_key is not null").distinct()
    here = F.col(f"`{column}`")
    if distinct.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        joined = rows.join(F.broadcast(distinct), here == F.col("_key"), "left")
        return joined.withColumn(mark, F.col("_key").isNotNull()).drop("_key")
    spread = distinct.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = rows.withColumn("_at", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if not kind.startswith("map")]), F.lit(salts)))
    joined = left.join(spread, (here == F.col("_key")) & (F.col("_at") == F.col("_salt")), "left")
    return joined.withColumn(mark, F.col("_key").isNotNull()).drop("_key", "_at", "_salt")


#: Bits of the broadcast hashes of possible_members(), at most.
MEMBER_BITS = 1 << 26


def possible_members(rows: DataFrame, column: str, keys: DataFrame, most: int = MEMBER_BITS) -> DataFrame:
    """The rows whose column is among keys (one column), and a few others, so that fewer are shuffled. A null is among none.

    Hashes of keys are bits of words that are broadcast: 16 bits a key, so that one of 16 other rows stays, but no more than most in all, with
    which more stay. What needs the members only must join them again.
    """
    bits = max(64, min(most, 16 * keys.count()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    word = lambda c: F.shiftright(at(c), 6)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at(c), F.lit(64)).cast("int"))
    key, here = F.col("_key"), F.col(f"`{column}`")
    words = keys.select(F.col(keys.columns[0]).alias("_key")).where("_key is not null").groupBy(word(key).alias("_word")).agg(F.bit_or(bit(key)).alias("_bits"))
    found = rows.where(here.isNotNull()).join(F.broadcast(words), word(here) == F.col("_word"))
    return found.where(F.col("_bits").bitwiseAND(bit(here)) != 0).drop("_word", "_bits")
