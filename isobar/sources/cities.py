"""The city dimension and the requests made from it."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from isobar.schema import (
    BACKFILL_END,
    BACKFILL_START,
    CITIES,
    CITY,
    DAILY_VARIABLES,
    HOURLY_VARIABLES,
)

MODES = ("backfill", "incremental", "custom")


def cities(spark: SparkSession) -> DataFrame:
    """The dimension as a local relation: the planner knows its size, and a join with
    it moves no documents."""
    values = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, CITIES)))
    return values.select(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(values.columns, CITY.fields)])


def require_in(dimension: DataFrame, city_ids: list[str]) -> None:
    """An error that names the ids which the dimension lacks."""
    found = dimension.where(F.col("city_id").isin(city_ids)).select("city_id").distinct().collect()
    unknown = sorted(set(city_ids) - {row[0] for row in found})
    if unknown:
        raise ValueError(f"no such city: {unknown}")


def known_city_ids() -> list[str]:
    return [row[0] for row in CITIES]


def require_known(city_ids: list[str]) -> list[str]:
    """The given ids, or an error that names the unknown ones."""
    unknown = sorted(set(city_ids) - set(known_city_ids()))
    if unknown:
        raise ValueError(f"no such city: {unknown}; the dimension has {known_city_ids()}")
    return city_ids


def request_range(
    mode: str,
    as_of: date | None = None,
    start: str | None = None,
    end: str | None = None,
) -> tuple[str, str, str]:
    """(start, end, endpoint) of a mode; both dates are inclusive.

    ``as_of`` stands for today and is given by the caller, so that a rerun asks
    for the same day.
    """
    if mode == "backfill":
        return BACKFILL_START, BACKFILL_END, "archive"
    if mode == "incremental":
        if as_of is None:
            raise ValueError("an incremental request needs as_of, the day it is made")
        yesterday = (as_of - timedelta(days=1)).isoformat()
        return yesterday, yesterday, "forecast"
    if mode == "custom":
        if not start or not end:
            raise ValueError("a custom request needs its first and last day")
        return start, end, "archive"
    raise ValueError(f"no such mode: {mode}; there are {MODES}")


def request_manifest(
    dimension: DataFrame,
    mode: str,
    as_of: date | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """One request per city of ``dimension``."""
    first, last, endpoint = request_range(mode, as_of, start, end)
    return dimension.select(
        "city_id",
        "city_name",
        "latitude",
        "longitude",
        "timezone",
        F.lit(mode).alias("mode"),
        F.lit(endpoint).alias("endpoint"),
        F.lit(first).cast("date").alias("start_date"),
        F.lit(last).cast("date").alias("end_date"),
        F.lit(",".join(HOURLY_VARIABLES)).alias("hourly"),
        F.lit(",".join(DAILY_VARIABLES)).alias("daily"),
    )


def local_request_manifest(dimension: DataFrame, as_of_utc: str) -> DataFrame:
    """Incremental requests for the day before the *city's* today.

    At 02:00 UTC the previous UTC day is not over in cities west of Greenwich;
    here each city asks for the last day that has ended on its own clock.
    """
    instant = F.lit(as_of_utc).cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.col("timezone"), instant)
    day = F.date_sub(F.to_date(local), 1)
    return dimension.select(
        "city_id",
        "timezone",
        F.lit("incremental").alias("mode"),
        F.lit("forecast").alias("endpoint"),
        day.alias("start_date"),
        day.alias("end_date"),
    )
