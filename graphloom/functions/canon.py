"""Text forms under which different spellings of one value agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for both engines.
SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body uses it; else the generated code outgrows its limit."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_blank(c: Column) -> Column:
    """True where c is empty or only white space; null where c is null."""
    return c.rlike(rf"^{SPACE}*$")


def bare(c: Column) -> Column:
    """Letters, digits and marks of c, in one letter case.

    White space, punctuation, symbols and control or format characters go. The case is folded
    upwards and then downwards, so that characters with several lower forms agree.
    """
    return F.lower(F.regexp_replace(F.upper(c), r"[\p{P}\p{S}\p{Z}\p{C}]+", ""))  # lower(upper()) would be simplified to lower()


def strip(c: Column) -> Column:
    """c without surrounding white space of any kind."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


#: Words that only stand for a missing value, by their letters and digits.
PLACEHOLDERS = (
    "na", "nan", "nil", "none", "null", "tba", "tbc", "tbd", "unknown", "undefined", "unspecified", "missing",
    "notavailable", "notapplicable", "notknown", "notspecified", "tobeannounced", "tobeconfirmed", "tobedetermined",
)


def is_missing(c: Column) -> Column:
    """True where c is null, blank, without any letter or digit, or only stands for a missing value."""
    return c.isNull() | (bare(c) == "") | bare(c).isin(*PLACEHOLDERS)
