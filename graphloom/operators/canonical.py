"""Merged entities: redirected facts, facts held once with all their provenance, and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.labels import local_name


def redirect(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """facts with s and o replaced by their root in aliases (id, root), and whether anything changed."""
    for end in ("s", "o"):
        roots = aliases.select(F.col("id").alias(end), F.col("root").alias(f"_{end}"))
        facts = facts.join(roots, end, "left")
    moved = (F.coalesce("_s", "s") != F.col("s")) | (F.coalesce("_o", "o") != F.col("o"))
    return facts.withColumns({"redirected": moved, "s": F.coalesce("_s", "s"), "o": F.coalesce("_o", "o")}).drop("_s", "_o")


def held_once(facts: DataFrame) -> DataFrame:
    """One row per fact, facts agreeing in subject, local predicate without case, and object.

    It keeps the first predicate by seq, the highest confidence, the distinct sources in order and the number of statements, and
    an id from the sources. A fact stated once keeps its own seq as its id.
    """
    key = ["s", "_p", "o"]
    grouped = facts.withColumn("_p", F.lower(local_name(F.col("p")))).groupBy(*key).agg(
        F.min_by("p", "seq").alias("p"), F.min("seq").alias("first_seq"), F.max("confidence").alias("confidence"),
        F.array_join(F.sort_array(F.collect_set("source")), "+").alias("origin"), F.array_join(F.sort_array(F.collect_set("graph")), "+").alias("graphs"), F.count(F.lit(1)).alias("statements"),
    )
    merged = F.concat(F.lit("canon_"), F.substring(F.sha2(F.concat_ws(":", "s", "p", "o", "origin"), 256), 1, 16))
    return grouped.withColumn("id", F.when(F.col("statements") > 1, merged).otherwise(F.col("first_seq").cast("string"))).drop("_p")


def clusters(aliases: DataFrame) -> DataFrame:
    """Each root with its members in order, for clusters that fit a row; members of aliases (id, root) are counted as well."""
    return aliases.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids"))


def right_wins(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The rows of b, and of a those with other keys."""
    return a.join(b.select(key).distinct(), key, "left_anti").unionByName(b)


def literal_values(facts: DataFrame) -> DataFrame:
    """Distinct values of each subject's properties with their graphs, in order of appearance: one, or a list."""
    seen = facts.groupBy("s", "p", "value", "graph").agg(F.min("seq").alias("seq"))
    return seen.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "|").alias("values"))
