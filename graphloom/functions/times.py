"""Times without a zone, read the same in any session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a time without zone; of a time with zone, of its local reading."""
    t = c.cast("timestamp_ntz")
    of_day = F.hour(t).cast("long") * 3_600_000_000 + F.minute(t).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
    return F.unix_date(t.cast("date")).cast("long") * 86_400_000_000 + of_day


def month(c: Column) -> Column:
    """yyyymm of a time."""
    t = c.cast("timestamp_ntz")
    return (F.year(t) * 100 + F.month(t)).cast("int")
