"""Functions whose results follow Python's own definitions; they run on Arrow batches."""

from __future__ import annotations

import difflib
import hashlib
import math
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters (Ratcliff and Obershelp); 0 for an empty or null side, 1 for equal ones."""

    def ratio(x: str, y: str) -> float:
        if not x or not y:
            return 0.0
        return 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()

    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio_from(threshold: float) -> Callable[[Column, Column], Column]:
    """matching_ratio where it reaches the threshold, else 0; pairs whose letters exclude that are not matched."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out, at, matcher = [0.0] * len(a), sorted(range(len(a)), key=lambda i: b.iat[i]), difflib.SequenceMatcher(None)
        last = None
        for i in at:
            if b.iat[i] != last:
                last = b.iat[i]
                matcher.set_seq2(last)
            matcher.set_seq1(a.iat[i])
            if matcher.quick_ratio() >= threshold and (r := matcher.ratio()) >= threshold:
                out[i] = r
        return pd.Series(out, dtype="float64")

    return ratio


def ratio_bound(a: Column, b: Column) -> Column:
    """No matching_ratio of the two can be above this."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)))


@F.pandas_udf(T.DoubleType())
def round4(x: pd.Series) -> pd.Series:
    """Rounded to four places as Python rounds the exact binary value."""
    return pd.Series([None if v is None or math.isnan(v) else round(v, 4) for v in x], dtype="float64")


@F.pandas_udf(T.StringType())
def folded(s: pd.Series) -> pd.Series:
    """Composed (NFC), white space as single blanks, case folded."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).split()).casefold())


@F.pandas_udf(T.StringType())
def composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def float_text(x: pd.Series) -> pd.Series:
    """A float as Python writes it."""
    return x.map(lambda v: None if v is None or pd.isna(v) else repr(float(v)))


def hash_embedding(dimensions: int = 64, chunks: int = 8) -> Callable[[Column], Column]:
    """A text's vector: each token adds to a few signed places that its SHA-256 gives, and the sum has length 1; zeros without tokens."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, list[tuple[int, float]]] = {}

        def places(token: str) -> list[tuple[int, float]]:
            if token not in known:
                digest = hashlib.sha256(token.encode()).digest()
                parts = [digest[4 * i : 4 * i + 4] for i in range(chunks)]
                known[token] = [(int.from_bytes(p, "big") % dimensions, 1.0 if p[3] % 2 == 0 else -1.0) for p in parts]
            return known[token]

        def one(text: str | None) -> list[float]:
            out = [0.0] * dimensions
            for token in re.findall("[a-z0-9]+", (text or "").lower()):
                for at, sign in places(token):
                    out[at] += sign
            norm = math.sqrt(sum(v * v for v in out))
            return [v / norm for v in out] if norm else out

        return texts.map(one)

    return embed
