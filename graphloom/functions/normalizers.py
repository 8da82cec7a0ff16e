"""Normalizers of text, and chains of them with a record of each step."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = Callable[[Column], Column]


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def _title(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.title())


def white_space(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def unicode(c: Column) -> Column:
    """Composed characters (NFC), on Arrow batches."""
    return _nfc(c)


def case(mode: str) -> Step:
    """lower, upper or title case."""
    return {"lower": F.lower, "upper": F.upper, "title": _title}[mode]


def identifier(c: Column) -> Column:
    """White space and runs of '_' as one '_', none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", "_"), "_+", "_"), "^_+|_+$", "")


def literal(c: Column) -> Column:
    """The text without quotes around it, runs of white space as one space."""
    bare = F.regexp_replace(F.trim(c), r"""(?s)^(["'])(.*)\1$""", "$2")
    return F.regexp_replace(bare, r"(?U)\s+", " ")


def run(df: DataFrame, key: str, column: str, steps: list[tuple[str, Step]]) -> DataFrame:
    """(key, place, step, input, output, changed): each named step of a chain, in order; a step's input is the output of the one before. Names must be unique. A null stays null, unchanged."""
    names = [n for n, _ in steps]
    if len(set(names)) != len(names):
        raise ValueError("names of steps must be unique")
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{column}`").cast("string").alias("_v0"))
    for i, (_, step) in enumerate(steps):
        rows = rows.withColumn(f"_v{i + 1}", step(F.col(f"_v{i}")))
    made = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("step"), F.col(f"_v{i}").alias("input"), F.col(f"_v{i + 1}").alias("output"), (~F.col(f"_v{i}").eqNullSafe(F.col(f"_v{i + 1}"))).alias("changed")) for i, n in enumerate(names)]
    return rows.select(F.col("_key").alias(key), F.explode(F.array(*made)).alias("x")).select(key, "x.*")
