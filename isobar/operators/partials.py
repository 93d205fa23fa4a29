"""Daily sums that merge: what a part of the rows says of each city and day, whatever the parts are.

``daily_moments`` can only be made from all rows of a day. Partials are closed under ``combine``, so a day
may arrive in any number of parts, late ones too, and no row is read twice for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from isobar.operators.daily import KEY
from isobar.session import settle

#: measures of which the spread is kept, and those of which it is not
SPREAD = {"temp": "temperature_2m", "precip": "precipitation"}
SUMMED = {
    "wind": "wind_speed_10m", "humidity": "relative_humidity_2m", "pressure": "pressure_msl", "cloud_cover": "cloud_cover",
}
COUNTS = ["hours_with_rain", "total_hours", "missing_temp_count", "missing_precip_count"]


def partials(stg: DataFrame) -> DataFrame:
    """One row per city and day of staged rows: numbers, sums, extremes and squares around the mean."""
    columns = []
    for name, measure in (SPREAD | SUMMED).items():
        columns += [F.count(measure).alias(f"{name}_n"), F.sum(F.col(measure).cast("double")).alias(f"{name}_total")]
    for name, measure in SPREAD.items():
        columns += [
            F.min(measure).alias(f"{name}_min"), F.max(measure).alias(f"{name}_max"),
            F.coalesce(F.var_pop(measure) * F.count(measure), F.lit(0.0)).alias(f"{name}_squares"),
        ]
    return stg.groupBy(*KEY).agg(
        *columns,
        F.max(SUMMED["wind"]).alias("wind_max"),
        F.count_if(F.col("precipitation") > 0).alias("hours_with_rain"),
        F.count(F.lit(1)).alias("total_hours"),
        F.sum("has_missing_temp").alias("missing_temp_count"),
        F.sum("has_missing_precip").alias("missing_precip_count"),
        F.max("ingestion_timestamp").alias("last_updated"),
    )


def _mean(name: str) -> Column:
    return F.col(f"{name}_total") / F.nullif(F.col(f"{name}_n"), F.lit(0))


def combine(parts: DataFrame) -> DataFrame:
    """Partials of the same city and day as one.

    The squares of the whole are those inside the parts and those of the parts' means around the mean of
    all, which is why the parts are read twice; they are small. Both readings combine map-side.
    """
    sums = [F.sum(f"{n}_{what}").alias(f"{n}_{what}") for n in SPREAD | SUMMED for what in ("n", "total")]
    extremes = [f(f"{n}_{what}").alias(f"{n}_{what}") for n in SPREAD for what, f in (("min", F.min), ("max", F.max))]
    whole = settle(
        parts.groupBy(*KEY).agg(
            *sums, *extremes, F.max("wind_max").alias("wind_max"), *[F.sum(c).alias(c) for c in COUNTS],
            F.max("last_updated").alias("last_updated"),
        ),
        "sums",
    )
    means = whole.select(*[F.col(k).alias(f"of_{k}") for k in KEY], *[_mean(n).alias(f"{n}_mean") for n in SPREAD])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in KEY])
    away = {n: F.col(f"{n}_n") * F.pow(_mean(n) - F.col(f"{n}_mean"), F.lit(2.0)) for n in SPREAD}
    squares = parts.join(means, same).groupBy(*KEY).agg(
        *[F.sum(F.col(f"{n}_squares") + F.coalesce(away[n], F.lit(0.0))).alias(f"{n}_squares") for n in SPREAD]
    )
    found = squares.select(*[F.col(k).alias(f"of_{k}") for k in KEY], *[f"{n}_squares" for n in SPREAD])
    return whole.join(found, same).select(*parts.columns)


def moments(parts: DataFrame) -> DataFrame:
    """Combined partials in the form of ``daily_moments``: the daily mart and what city statistics need."""

    def spread(name: str) -> Column:
        n = F.col(f"{name}_n")
        # Rounding in the means must not give a constant day a deviation.
        constant = F.col(f"{name}_min") == F.col(f"{name}_max")
        return F.when(n > 1, F.when(constant, F.lit(0.0)).otherwise(F.sqrt(F.col(f"{name}_squares") / (n - 1))))

    return parts.select(
        *KEY, "temp_min", "temp_max", _mean("temp").alias("temp_avg"), spread("temp").alias("temp_stddev"),
        "precip_total", "precip_max", "hours_with_rain", _mean("wind").alias("wind_avg"), "wind_max",
        _mean("humidity").alias("humidity_avg"), _mean("pressure").alias("pressure_avg"), _mean("cloud_cover").alias("cloud_cover_avg"),
        "total_hours", "missing_temp_count", "missing_precip_count", "last_updated",
        "temp_n", "temp_total", "precip_n", "precip_min", _mean("precip").alias("precip_avg"), spread("precip").alias("precip_stddev"),
    )
