"""Calendar columns of a zone-less timestamp. None depends on the session zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def date_of(time: Column) -> Column:
    return F.to_date(time)


def day_of_week(time: Column) -> Column:
    """Sunday is 0; Spark's own numbering starts at 1."""
    return F.dayofweek(time) - 1


def calendar(time: Column) -> list[Column]:
    """date, year, month, day, hour, day_of_week, quarter, as stored in staging."""
    parts = {
        "year": F.year(time),
        "month": F.month(time),
        "day": F.dayofmonth(time),
        "hour": F.hour(time),
        "day_of_week": day_of_week(time),
        "quarter": F.quarter(time),
    }
    return [date_of(time).alias("date")] + [c.cast("bigint").alias(n) for n, c in parts.items()]


def utc_wall_clock(instant: Column) -> Column:
    """A zoned instant as zone-less UTC wall clock, whatever the session zone is."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def micros(time: Column) -> Column:
    """A zone-less timestamp as microseconds since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time)


def from_micros(value: Column) -> Column:
    """The zone-less timestamp of so many microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", value, F.lit("1970-01-01").cast("timestamp_ntz"))
