"""Column expressions on measurements: fills, flags, z-scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from isobar.schema import ANOMALY_THRESHOLD, STANDARD_PRESSURE

#: what staging puts in place of a missing measurement
FILLS = {
    "temperature_2m": 0.0,
    "relative_humidity_2m": 0,
    "precipitation": 0.0,
    "wind_speed_10m": 0.0,
    "cloud_cover": 0,
    "pressure_msl": STANDARD_PRESSURE,
}


def filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(FILLS[name])).alias(name)


def missing_flag(name: str) -> Column:
    """1 where the measurement is absent, else 0; taken before any fill."""
    return F.col(name).isNull().cast("int")


def zscore(value: Column, mean: Column, stddev: Column) -> Column:
    """Distance from the mean in standard deviations; NULL if they are all zero."""
    return (value - mean) / F.nullif(stddev, F.lit(0.0))


def is_anomaly(z: Column, threshold: float = ANOMALY_THRESHOLD) -> Column:
    """Strictly beyond the threshold; a NULL score is not an anomaly."""
    return F.coalesce(F.abs(z) > threshold, F.lit(False))
