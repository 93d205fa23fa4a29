"""Coverage with its gaps: the hours that a city has no row for, as intervals.

Rows become hours by a hash aggregation, and hours become one row per city and day, with the gaps inside it.
Only days are then put in order, so no task sees more of a city than its days, however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from isobar.functions.calendar import from_micros, micros
from isobar.session import settle

_HOUR = 3_600_000_000


def _time(hour: Column) -> Column:
    return from_micros(hour * _HOUR)


def _days(rows: DataFrame) -> DataFrame:
    """One row per city and day: its first and last hour, how many there are, and the gaps between them (from, hours)."""
    hour = F.floor(micros(F.col("time")) / F.lit(_HOUR).cast("decimal(20,0)")).cast("long")
    hours = rows.where(F.col("time").isNotNull()).select("city_id", hour.alias("hour")).distinct()
    days = hours.groupBy("city_id", F.floor(F.col("hour") / 24).alias("day")).agg(F.sort_array(F.collect_list("hour")).alias("hours"))
    steps = F.zip_with(
        F.slice("hours", 1, F.size("hours") - 1), F.slice("hours", 2, F.size("hours") - 1),
        lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("hours")),
    )
    return days.select(
        "city_id", "day", F.array_min("hours").alias("first"), F.array_max("hours").alias("last"), F.size("hours").alias("present"),
        F.filter(steps, lambda s: s["hours"] > 0).alias("inside"),
    )


def _gaps(days: DataFrame) -> DataFrame:
    """(city_id, start, hours) of all gaps, inside days and between them, from ``_days``."""
    before = F.lag("last").over(Window.partitionBy("city_id").orderBy("day"))
    between = days.withColumn("before", before).where(F.col("first") - F.col("before") > 1).select(
        "city_id", (F.col("before") + 1).alias("start"), (F.col("first") - F.col("before") - 1).alias("hours")
    )
    return days.select("city_id", F.inline("inside")).unionByName(between)


def missing_intervals(rows: DataFrame) -> DataFrame:
    """Per gap: city_id, its first and last missing hour, and how many hours are missing.

    A gap lies between two hours of a city that have rows. Rows without a time stand for no hour; those without
    a city for one of their own.
    """
    last = _time(F.col("start") + F.col("hours") - 1)
    gaps = _gaps(settle(_days(rows), "days"))
    return gaps.select("city_id", _time(F.col("start")).alias("first_missing"), last.alias("last_missing"), F.col("hours").alias("missing_hours"))


def coverage_of_hours(rows: DataFrame) -> DataFrame:
    """Per city: first and last hour with rows, hours present and missing between them, gaps, and the longest one."""
    days = settle(_days(rows), "days")
    span = days.groupBy("city_id").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("present").alias("present_hours")
    )
    gaps = _gaps(days).groupBy(F.col("city_id").alias("of")).agg(F.count("*").alias("gaps"), F.max("hours").alias("longest"))
    return span.join(gaps, F.col("city_id").eqNullSafe(F.col("of")), "left").select(
        "city_id", _time(F.col("first")).alias("first_hour"), _time(F.col("last")).alias("last_hour"), "present_hours",
        (F.col("last") - F.col("first") + 1 - F.col("present_hours")).alias("missing_hours"),
        F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("longest", F.lit(0)).alias("longest_gap_hours"),
    )
