"""Rebuild the layers from raw rows, and check them."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, StructField, StructType

from isobar.functions.lineage import batch_id_of, ingestion_timestamp
from isobar.operators.anomalies import anomalies, city_stats
from isobar.operators.daily import (
    check_variant,
    daily,
    daily_from_moments,
    daily_moments,
    merged_city_stats,
)
from isobar.operators.quality import declared_checks, filled_gaps, value_range
from isobar.operators.snapshots import latest_rows
from isobar.operators.staging import staging
from isobar.plans.tables import Layers, build_once, full_refresh, properties
from isobar.session import settle

HOURLY, DAILY = "raw.weather_hourly", "raw.weather_daily"
STAGING, STAGED_TABLE = "staging.stg_weather", "staging.weather_hourly"
MART_DAILY, MART_ANOMALIES = "mart.weather_daily", "mart.weather_anomalies"
RESULTS = "mart.dq_results"
MOMENTS, NEWEST = "state.daily_moments", "state.newest_rows"
OPTIONS = "isobar.options"


#: what ``days_of`` gives for rows of no day: nothing has changed
NO_DAYS = ()


def days_of(rows: DataFrame) -> tuple[date, ...]:
    """First and last day of the given rows, for instance those of a new batch;
    ``NO_DAYS`` if there are no rows, or none with a time."""
    first, last = rows.agg(F.to_date(F.min("time")), F.to_date(F.max("time"))).first()
    return NO_DAYS if first is None else (first, last)


def _moments(layers: Layers, stg: DataFrame, days: tuple[date, ...] | None, options: str) -> DataFrame:
    """The daily moments: of all rows, or of the given days with the stored rest.

    The condition on days becomes a range on ``time`` in the scan. Rows without
    a time belong to no day and are always taken anew. The stored moments carry
    the options they were made with; others cannot be mixed with them.
    """
    if days is None:
        return full_refresh(layers, daily_moments(stg), MOMENTS, {OPTIONS: options})
    anew = F.col("date").isNull()
    if days != NO_DAYS:
        first, last = (F.lit(day).cast("date") for day in days)
        anew = anew | F.col("date").between(first, last)
    kept = layers.table(MOMENTS).where(~anew)
    moments = daily_moments(stg.where(anew)).unionByName(kept)
    return full_refresh(layers, moments, MOMENTS, {OPTIONS: options})


def _check_days(layers: Layers, days: tuple[date, ...] | None, options: str) -> None:
    """Days can only be refreshed if all others were made with the same options."""
    if days is None:
        return
    stored = properties(layers, MOMENTS).get(OPTIONS)
    if stored != options:
        raise ValueError(f"the stored days were made with {stored}, not with {options}; refresh all days")
    if days != NO_DAYS and (len(days) != 2 or None in days):
        raise ValueError(f"days are a first and a last one, or NO_DAYS: {days}")


def _of_days(days: tuple[date, ...]) -> Column:
    """A condition on ``time``: rows of the given days, and rows of no day. Scans get it as a range."""
    of_none = F.col("time").isNull()
    if days == NO_DAYS:
        return of_none
    first, last = days
    start, end = (F.lit(d).cast("timestamp_ntz") for d in (first, last + timedelta(days=1)))
    return of_none | (F.col("time") >= start) & (F.col("time") < end)


def _newest(layers: Layers, hourly: DataFrame, days: tuple[date, ...] | None) -> DataFrame:
    """The newest row of each city and time, kept by day between refreshes.

    With ``days`` only the rows of these days are read, compared and written anew; the folders of other days stay. A
    refresh that breaks off in between is put right by the next one of the same days.
    """
    path = layers.path(NEWEST)
    chosen = hourly if days is None else hourly.where(_of_days(days))
    newest = latest_rows(chosen).withColumn("day", F.to_date("time"))
    writer = newest.write.mode("overwrite").partitionBy("day")
    # A table that is empty altogether still has its schema from the rows.
    writer.option("partitionOverwriteMode", "static" if days is None else "dynamic").parquet(path)
    schema = StructType([*hourly.schema.fields, StructField("day", DateType())])
    return layers.spark.read.schema(schema).parquet(path).select(*hourly.columns)


def refresh(
    layers: Layers,
    hourly: DataFrame,
    daily_grain: DataFrame,
    variant: str = "model",
    fill: bool = True,
    newest_only: bool = False,
    days: tuple[date, ...] | None = None,
) -> dict[str, DataFrame]:
    """Staging and marts from raw rows, all replaced. Returns the five tables.

    ``model`` keeps staging a view, so each mart reads only its own raw columns;
    ``bootstrap`` stores it as a table. The hourly rows are read twice: once for
    the daily mart, whose moments also give the city statistics, and once for
    the scores. The marts are sorted inside files, not across them: readers get
    prunable row groups, and storing them needs no further exchange.

    ``days`` says that only rows of these days, both included, or of none
    (``NO_DAYS``) have changed since the last refresh, which must have had the same
    options. The aggregates of all other days are then kept. Scores depend on the
    whole history and are always taken anew.

    ``newest_only`` keeps the newest row of each city and time, by day, and refreshes those of ``days`` alone.
    """
    check_variant(variant)
    options = f"variant={variant} fill={fill} newest_only={newest_only}"
    _check_days(layers, days, options)
    rows = _newest(layers, hourly, days) if newest_only else hourly
    stg = staging(rows, fill)
    if variant == "bootstrap":
        stg = full_refresh(layers, stg, STAGED_TABLE)
    else:
        stg.createOrReplaceTempView(f"{layers.prefix}stg_weather")

    moments = _moments(layers, stg, days, options)
    mart = daily_from_moments(moments, variant).sortWithinPartitions("date", "city_id")
    stats = settle(merged_city_stats(moments), "city-stats")
    marked = anomalies(stg, stats, variant).sortWithinPartitions("time", "city_id")
    return {
        HOURLY: hourly,
        DAILY: daily_grain,
        STAGING: stg,
        MART_DAILY: full_refresh(layers, mart, MART_DAILY),
        MART_ANOMALIES: full_refresh(layers, marked, MART_ANOMALIES),
    }


def build_legacy(layers: Layers) -> dict[str, DataFrame]:
    """Staging and marts of the older single table, each built only once."""
    stg = build_once(layers, staging(layers.table("raw.weather")), "staging.weather")
    return {
        "staging.weather": stg,
        MART_DAILY: build_once(layers, daily(stg), MART_DAILY),
        MART_ANOMALIES: build_once(
            layers, anomalies(stg, settle(city_stats(stg), "city-stats")), MART_ANOMALIES
        ),
    }


def check(
    tables: dict[str, DataFrame], limits: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """All declared checks, the gaps that staging filled, and the given ranges."""
    return declared_checks(tables, {STAGING: filled_gaps() + value_range(limits or {})})


def record(layers: Layers, results: DataFrame, run_ts: datetime) -> DataFrame:
    """Append check results to ``mart.dq_results``; failures never stop a run."""
    (
        results.withColumn("checked_at", ingestion_timestamp(run_ts))
        .withColumn("run_id", F.lit(batch_id_of(run_ts)))
        .coalesce(1)
        .write.mode("append")
        .option("path", layers.path(RESULTS))
        .saveAsTable(layers.name(RESULTS))
    )
    return layers.table(RESULTS)
