"""Parsed records as statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.labels import sanitized

#: The fields that may hold a statement's parts, in the order in which they are tried.
SUBJECT_KEYS = ("subject", "source", "from", "head", "s", "@id", "id")
PREDICATE_KEYS = ("predicate", "relation", "label", "type", "p", "@type")
OBJECT_KEYS = ("object", "target", "to", "tail", "o", "name", "value")


def field(payload: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys' values that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(payload, F.lit(k))), F.lit("")) for k in keys])


def statements(records: DataFrame, graph: str) -> DataFrame:
    """(id, graph, s, p, o) of records (seq, payload map): named fields, else the columns by position.

    By position the first value is the subject, the last the object, and of three or more the second the predicate. Records
    without all three are left out; white space within a part becomes '_'. The id has the record's seq.
    """
    values = F.filter(F.map_values(F.map_filter("payload", lambda k, v: ~k.startswith("_"))), lambda v: v.isNotNull() & (F.trim(v) != ""))
    n = F.size(values)
    at = lambda i: F.trim(F.try_element_at(values, F.lit(i)))
    s = F.coalesce(field(F.col("payload"), SUBJECT_KEYS), F.when(n >= 2, at(1)))
    p = F.coalesce(field(F.col("payload"), PREDICATE_KEYS), F.when(n >= 3, at(2)))
    o = F.coalesce(field(F.col("payload"), OBJECT_KEYS), F.when(n >= 2, at(-1)))
    rows = records.where("payload is not null").select("seq", s.alias("s"), p.alias("p"), o.alias("o")).where("s is not null and p is not null and o is not null")
    return rows.select(F.concat(F.lit(f"{graph}_a_"), F.col("seq").cast("string")).alias("id"), F.lit(graph).alias("graph"), *[sanitized(F.col(c), "unknown").alias(c) for c in "spo"])
