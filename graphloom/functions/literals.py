"""Literal values of triples: which objects are literals, their type and their canonical text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.canon import let, strip
from graphloom.functions.labels import local_name

#: Predicates whose objects are literals, also as endings of longer names.
LITERAL_PREDICATES = (
    "name", "fullName", "title", "label", "description", "age", "yearsOld", "birthDate", "dateOfBirth", "foundedDate",
    "amount", "count", "value", "score", "confidence", "email", "phone", "url", "comment", "status",
    "chemicalFormula", "molecularWeight", "approvedDate", "chembl_id", "weight", "formula",
)
#: The accepted date formats, tried in this order.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d H:m:s")
#: Forms of numbers and dates.
NUMBER, DATE = r"^-?\d+(\.\d+)?$", r"^\d{4}[-/]\d{2}[-/]\d{2}(T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:?\d{2})?)?$"


def is_literal(predicate: Column, value: Column, predicates: tuple[str, ...] = LITERAL_PREDICATES) -> Column:
    """Whether a triple's object is a literal rather than an entity, from the predicate's name and the value's form."""

    def by_name(p: Column) -> Column:
        return p.endswith("id") | p.endswith("code") | p.isin("uuid", "key", "value") | reduce(lambda a, b: a | b, (p.endswith(x.lower()) for x in predicates))

    def by_form(s: Column) -> Column:
        quoted = (s.startswith('"') & s.endswith('"')) | (s.startswith("'") & s.endswith("'"))
        return s.contains("^^") | quoted | s.rlike(NUMBER) | F.lower(s).isin("true", "false", "yes", "no") | s.rlike(DATE)

    return let(F.lower(local_name(predicate)), by_name) | let(strip(value), by_form)


def literal(value: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """struct(type, lex): the value without datatype and one pair of quotes; dates of any accepted format lose their time of day.

    yes and no stay strings. A number keeps its digits but for leading zeros of integers.
    """
    s = let(strip(value), lambda x: F.when(x.contains("^^"), strip(F.split_part(x, F.lit("^^"), F.lit(1)))).otherwise(x))
    s = let(s, lambda x: F.when(x.rlike(r"""(?s)^(".*"|'.*')$""") & (F.length(x) >= 2), strip(x.substr(F.lit(2), F.length(x) - 2))).otherwise(x))

    def typed(x: Column) -> Column:
        made = lambda kind, lex: F.struct(F.lit(kind).alias("type"), lex.alias("lex"))
        day = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats])
        date = let(day, lambda t: F.when(t.isNotNull(), F.date_format(t, "yyyy-MM-dd")).otherwise(x))
        return (
            F.when(F.lower(x).isin("true", "false"), made("boolean", F.lower(x)))
            .when(x.rlike(r"^-?\d{1,18}$"), made("integer", x.try_cast("long").cast("string")))
            .when(x.rlike(r"^-?\d+\.\d+$"), made("float", x))
            .otherwise(made("string", date))
        )

    return let(s, typed)


def literal_key(kind: Column, lex: Column) -> Column:
    return F.concat_ws(":", kind, lex)


def canonical_json(fields: dict[str, Column]) -> Column:
    """A row as JSON with its keys in order and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def short_digest(prefix: str, *parts: Column, length: int = 16) -> Column:
    """prefix and the first digits of the SHA-256 of the parts joined by colons."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length))
