"""Canonical schemas, the city dimension and the request calendar.

Every boundary of the engine (landing, raw, staging, mart) casts to one of the
types below, so that no later step depends on what a file happened to infer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# --- Fixed values -----------------------------------------------------------
# They are part of the data contract (column names, column order, dimension
# rows, backfill range, fill values, thresholds) and must not be changed.

CITIES = [
    # city_id, name, latitude, longitude, timezone
    ("amsterdam", "Amsterdam", 52.3676, 4.9041, "Europe/Amsterdam"),
    ("new_york", "New York", 40.7128, -74.0060, "America/New_York"),
    ("london", "London", 51.5074, -0.1278, "Europe/London"),
    ("paris", "Paris", 48.8566, 2.3522, "Europe/Paris"),
    ("tokyo", "Tokyo", 35.6762, 139.6503, "Asia/Tokyo"),
]

BACKFILL_START = "2024-01-01"
BACKFILL_END = "2025-12-31"

HOURLY_VARIABLES = [
    "temperature_2m",
    "relative_humidity_2m",
    "dew_point_2m",
    "apparent_temperature",
    "precipitation",
    "rain",
    "snowfall",
    "snow_depth",
    "weather_code",
    "pressure_msl",
    "surface_pressure",
    "cloud_cover",
    "cloud_cover_low",
    "cloud_cover_mid",
    "cloud_cover_high",
    "et0_fao_evapotranspiration",
    "vapour_pressure_deficit",
    "wind_speed_10m",
    "wind_speed_100m",
    "wind_direction_10m",
    "wind_direction_100m",
    "wind_gusts_10m",
    "soil_temperature_0_to_7cm",
    "soil_temperature_7_to_28cm",
    "soil_temperature_28_to_100cm",
    "soil_temperature_100_to_255cm",
    "soil_moisture_0_to_7cm",
    "soil_moisture_7_to_28cm",
    "soil_moisture_28_to_100cm",
    "soil_moisture_100_to_255cm",
]

DAILY_VARIABLES = [
    "temperature_2m_max",
    "temperature_2m_min",
    "temperature_2m_mean",
    "apparent_temperature_max",
    "apparent_temperature_min",
    "apparent_temperature_mean",
    "sunrise",
    "sunset",
    "daylight_duration",
    "sunshine_duration",
    "precipitation_sum",
    "rain_sum",
    "snowfall_sum",
    "precipitation_hours",
    "weather_code",
    "wind_speed_10m_max",
    "wind_gusts_10m_max",
    "wind_direction_10m_dominant",
    "shortwave_radiation_sum",
    "et0_fao_evapotranspiration",
]

TEXT_VARIABLES = {"sunrise", "sunset"}
CODE_VARIABLES = {"weather_code"}

STANDARD_PRESSURE = 1013.25
ANOMALY_THRESHOLD = 3

LAYERS = ["raw", "staging", "mart"]
# --- End of fixed values ----------------------------------------------------

VARIABLES = {"hourly": HOURLY_VARIABLES, "daily": DAILY_VARIABLES}


def _variable_type(name: str):
    if name in TEXT_VARIABLES:
        return StringType()
    return IntegerType() if name in CODE_VARIABLES else DoubleType()


METADATA = StructType([
    StructField("city_id", StringType()),
    StructField("city_name", StringType()),
    StructField("latitude", DoubleType()),
    StructField("longitude", DoubleType()),
    StructField("timezone", StringType()),
    StructField("ingestion_timestamp", TimestampNTZType()),
    StructField("batch_id", StringType()),
])


def _readings(grain: str) -> StructType:
    return StructType(
        [StructField("time", TimestampNTZType())]
        + [StructField(v, _variable_type(v)) for v in VARIABLES[grain]]
    )


#: one element of a grain: time plus its variables, without the metadata
READINGS = {grain: _readings(grain) for grain in VARIABLES}

HOURLY = StructType(READINGS["hourly"].fields + METADATA.fields)
DAILY = StructType(READINGS["daily"].fields + METADATA.fields)
RAW = {"hourly": HOURLY, "daily": DAILY}

#: the older single raw table with fixed types
LEGACY = StructType([
    StructField("time", TimestampNTZType()),
    StructField("temperature_2m", DoubleType()),
    StructField("relative_humidity_2m", IntegerType()),
    StructField("precipitation", DoubleType()),
    StructField("wind_speed_10m", DoubleType()),
    StructField("cloud_cover", IntegerType()),
    StructField("pressure_msl", DoubleType()),
] + METADATA.fields)

CITY = StructType([
    StructField("city_id", StringType()),
    StructField("city_name", StringType()),
    StructField("latitude", DoubleType()),
    StructField("longitude", DoubleType()),
    StructField("timezone", StringType()),
])


def _payload_grain(grain: str) -> StructType:
    # Codes are parsed as doubles and narrowed later: "3" and "3.0" both occur.
    kinds = {v: StringType() if v in TEXT_VARIABLES else DoubleType() for v in VARIABLES[grain]}
    return StructType(
        [StructField("time", ArrayType(StringType()))]
        + [StructField(v, ArrayType(t)) for v, t in kinds.items()]
    )


PAYLOAD = StructType([
    StructField("latitude", DoubleType()),
    StructField("longitude", DoubleType()),
    StructField("elevation", DoubleType()),
    StructField("generationtime_ms", DoubleType()),
    StructField("utc_offset_seconds", IntegerType()),
    StructField("timezone", StringType()),
    StructField("timezone_abbreviation", StringType()),
    StructField("hourly_units", MapType(StringType(), StringType())),
    StructField("hourly", _payload_grain("hourly")),
    StructField("daily_units", MapType(StringType(), StringType())),
    StructField("daily", _payload_grain("daily")),
])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project ``df`` to exactly ``schema``: cast what is there, null what is not."""
    present = set(df.columns)

    def column(field: StructField) -> Column:
        source = F.col(field.name) if field.name in present else F.lit(None)
        return source.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema.fields])
