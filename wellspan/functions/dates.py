"""Date arithmetic at day and month grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def as_date(c: Column | str) -> Column:
    """Day of a timestamp, date or ISO text; unparsable text becomes NULL instead of raising."""
    col = F.col(c) if isinstance(c, str) else c
    return F.to_date(F.try_to_timestamp(col.cast("string")))


def day_of(df: DataFrame, c: str) -> Column:
    """Day of a column of ``df``: a DATE as it is, so that a known partitioning stays known."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.DateType):
        return F.col(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    return as_date(c)


def month_start(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.trunc(col, "MM")


def month_number(c: Column | str) -> Column:
    """Running month count, so that differences are whole months."""
    col = F.col(c) if isinstance(c, str) else c
    return F.year(col) * 12 + F.month(col)


def days_in_month(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.dayofmonth(F.last_day(col))


def doy_ring(doy: Column, half: int) -> Column:
    """The days of a 366-day circle within ``half`` days of ``doy``."""
    offsets = F.sequence(F.lit(-half), F.lit(half))
    return F.transform(offsets, lambda o: F.pmod(doy + o - 1, F.lit(366)) + 1)
