"""Per-city statistics and the z-score of every hourly row against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from isobar.functions.measures import is_anomaly, zscore
from isobar.operators.daily import check_variant
from isobar.session import settle


def city_stats(stg: DataFrame) -> DataFrame:
    """Mean and sample deviation of temperature and precipitation, per city."""
    return stg.groupBy("city_id").agg(
        F.avg("temperature_2m").alias("avg_temp"),
        F.stddev_samp("temperature_2m").alias("stddev_temp"),
        F.avg("precipitation").alias("avg_precip"),
        F.stddev_samp("precipitation").alias("stddev_precip"),
    )


def anomalies(
    stg: DataFrame, stats: DataFrame | None = None, variant: str = "model"
) -> DataFrame:
    """Hourly rows with z-scores and flags.

    ``model``: both scores; rows whose temperature score is NULL drop out, and
    with them every city of constant temperature.
    ``bootstrap``: temperature only; a constant city stays, with a NULL score
    and a false flag, and a city of one row (no deviation) drops out.

    The statistics are joined back rather than taken over a window: a window
    by city would move every row into as many tasks as there are cities.
    ``stats`` are written first (or passed in already written), so that the
    planner sees their real size before it chooses the join.
    """
    check_variant(variant)
    if stats is None:
        stats = settle(city_stats(stg), "city-stats")
    rows = stg.select("time", "city_id", "city_name", "temperature_2m", "precipitation")
    z_temp = zscore(F.col("temperature_2m"), F.col("avg_temp"), F.col("stddev_temp"))
    z_precip = zscore(F.col("precipitation"), F.col("avg_precip"), F.col("stddev_precip"))

    if variant == "bootstrap":
        known = stats.where(F.col("stddev_temp").isNotNull())
        return rows.join(known, "city_id").select(
            *rows.columns,
            z_temp.alias("temp_zscore"),
            is_anomaly(z_temp).alias("is_temp_anomaly"),
        )
    return (
        rows.join(stats, "city_id")
        .select(*rows.columns, z_temp.alias("temp_zscore"), z_precip.alias("precip_zscore"))
        .where(F.col("temp_zscore").isNotNull())
        .withColumn("is_temp_anomaly", is_anomaly(F.col("temp_zscore")))
        .withColumn("is_precip_anomaly", is_anomaly(F.col("precip_zscore")))
    )


def anomaly_counts(marked: DataFrame) -> DataFrame:
    """How many scored rows there are, and how many of them carry the flag."""
    return marked.agg(
        F.count(F.lit(1)).alias("scored_rows"),
        F.count_if("is_temp_anomaly").alias("temp_anomalies"),
    )


def in_time_order(marked: DataFrame) -> DataFrame:
    """Rows by time. The other columns break ties; they let the range partitioner
    split a moment that holds many rows, and the number of the input partition
    even copies of one row. That number is the same when a task is repeated."""
    return marked.orderBy(
        "time", "city_id", "temperature_2m", "precipitation", F.spark_partition_id()
    )
