"""Staging → one row per city and day, plus the moments that city statistics merge from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEY = ["city_id", "city_name", "date"]
VARIANTS = ("model", "bootstrap")


def check_variant(variant: str) -> None:
    if variant not in VARIANTS:
        raise ValueError(f"no such variant: {variant}; there are {VARIANTS}")


def _aggregates() -> list[Column]:
    t, p, w = "temperature_2m", "precipitation", "wind_speed_10m"
    return [
        F.min(t).alias("temp_min"),
        F.max(t).alias("temp_max"),
        F.avg(t).alias("temp_avg"),
        F.stddev_samp(t).alias("temp_stddev"),
        F.sum(p).alias("precip_total"),
        F.max(p).alias("precip_max"),
        F.count_if(F.col(p) > 0).alias("hours_with_rain"),
        F.avg(w).alias("wind_avg"),
        F.max(w).alias("wind_max"),
        F.avg("relative_humidity_2m").alias("humidity_avg"),
        F.avg("pressure_msl").alias("pressure_avg"),
        F.avg("cloud_cover").alias("cloud_cover_avg"),
        F.count(F.lit(1)).alias("total_hours"),
        F.sum("has_missing_temp").alias("missing_temp_count"),
        F.sum("has_missing_precip").alias("missing_precip_count"),
        F.max("ingestion_timestamp").alias("last_updated"),
    ]


def daily(stg: DataFrame, variant: str = "model") -> DataFrame:
    """The daily mart: 19 columns, or 18 without ``missing_precip_count`` (bootstrap).

    All aggregates combine map-side, so what is shuffled is one row per task,
    city and day, however many rows one city holds.
    """
    check_variant(variant)
    mart = stg.groupBy(*KEY).agg(*_aggregates())
    return mart if variant == "model" else mart.drop("missing_precip_count")


def in_date_order(mart: DataFrame) -> DataFrame:
    return mart.orderBy("date", "city_id")


def daily_moments(stg: DataFrame) -> DataFrame:
    """The daily mart plus the sums and moments ``merged_city_stats`` needs.

    A refresh that builds the daily mart anyway gets the city statistics from
    this small table instead of reading all hourly rows once more.
    """
    return stg.groupBy(*KEY).agg(
        *_aggregates(),
        F.count("temperature_2m").alias("temp_n"),
        F.sum("temperature_2m").alias("temp_total"),
        F.count("precipitation").alias("precip_n"),
        F.min("precipitation").alias("precip_min"),
        F.avg("precipitation").alias("precip_avg"),
        F.stddev_samp("precipitation").alias("precip_stddev"),
    )


def daily_from_moments(moments: DataFrame, variant: str = "model") -> DataFrame:
    check_variant(variant)
    hidden = ["temp_n", "temp_total", "precip_n", "precip_min", "precip_avg", "precip_stddev"]
    mart = moments.drop(*hidden)
    return mart if variant == "model" else mart.drop("missing_precip_count")


def merged_city_stats(moments: DataFrame) -> DataFrame:
    """Per-city mean and deviation, merged from daily moments.

    The spread of a city is the spread inside its days plus that of the day
    means around the city mean, summed in two steps so that large means do not
    cancel. Rounding in the day means must not turn a constant city into one
    with a tiny deviation (its z-scores would be noise instead of NULL), so
    min = max decides that case.
    """
    names = ("temp", "precip")

    def summed(name: str) -> list[Column]:
        return [
            F.sum(f"{name}_n").alias(f"n_{name}"),
            (F.sum(f"{name}_total") / F.nullif(F.sum(f"{name}_n"), F.lit(0))).alias(f"avg_{name}"),
            (F.min(f"{name}_min") == F.max(f"{name}_max")).alias(f"constant_{name}"),
        ]

    means = moments.groupBy("city_id").agg(*[c for name in names for c in summed(name)])

    def squares(name: str) -> Column:
        n, mean = F.col(f"{name}_n"), F.col(f"{name}_avg")
        within = F.coalesce((n - 1) * F.pow(f"{name}_stddev", F.lit(2.0)), F.lit(0.0))
        between = F.coalesce(n * F.pow(mean - F.col(f"avg_{name}"), F.lit(2.0)), F.lit(0.0))
        return F.sum(within + between).alias(f"squares_{name}")

    spread = (
        moments.join(means.select("city_id", "avg_temp", "avg_precip"), "city_id")
        .groupBy("city_id")
        .agg(*[squares(name) for name in names])
    )

    def stddev(name: str) -> Column:
        n = F.col(f"n_{name}")
        pooled = F.sqrt(F.col(f"squares_{name}") / F.nullif(n - 1, F.lit(0)))
        return (
            F.when(n > 1, F.when(F.col(f"constant_{name}"), F.lit(0.0)).otherwise(pooled))
            .alias(f"stddev_{name}")
        )

    return means.join(spread, "city_id").select(
        "city_id", "avg_temp", stddev("temp"), "avg_precip", stddev("precip")
    )
