"""Weather-shaped rows derived from an event log.

Event types stand in for cities and event times for the hours. Gaps and dry
hours are put in by the event id, so that fills, flags and rain counts have
something to do. Every event becomes one row; none is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string"
)
PAYLOAD_ROWS = 1024
MEASURES = [
    "temperature_2m",
    "relative_humidity_2m",
    "precipitation",
    "wind_speed_10m",
    "cloud_cover",
    "pressure_msl",
]
DAILY_SERIES = [
    "time",
    "temperature_2m_max",
    "temperature_2m_min",
    "precipitation_sum",
    "wind_speed_10m_max",
    "sunrise",
]


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def _iso(name: str) -> Column:
    """A zone-less timestamp as ISO text, without a detour over a zone."""
    return F.translate(F.col(name).cast("string"), " ", "T")


def hourly_from_events(
    events: DataFrame, constant_city: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Raw hourly rows (the staged measures and the metadata) from events.

    ``constant_city`` is given one unchanging temperature: deviation zero.
    ``keep`` names event columns to carry along.
    """
    temperature = "if(event_id % 17 = 0, null, value)"
    if constant_city is not None:
        temperature = f"if(event_type = '{constant_city}', 20.0D, {temperature})"
    wet = "if(event_id % 3 = 0, 0.0D, value / 10)"
    return events.selectExpr(
        "ts as time",
        "event_type as city_id",
        "upper(left(event_type, 1)) || substr(event_type, 2) as city_name",
        f"{temperature} as temperature_2m",
        "if(event_id % 29 = 0, null, event_id % 101) as relative_humidity_2m",
        f"if(event_id % 23 = 0, null, {wet}) as precipitation",
        "if(event_id % 37 = 0, null, value / 5) as wind_speed_10m",
        "if(event_id % 31 = 0, null, user_id % 101) as cloud_cover",
        "if(event_id % 41 = 0, null, 1013.25D + value / 100) as pressure_msl",
        "double(length(event_type)) as latitude",
        "double(-length(event_type)) as longitude",
        "'UTC' as timezone",
        "ts + interval 1 day as ingestion_timestamp",
        "string(date(ts)) as batch_id",
        *keep,
    )


def cities_from_events(events: DataFrame) -> DataFrame:
    """The dimension that goes with the rows: one row per event type."""
    names = ["city_id", "city_name", "latitude", "longitude", "timezone"]
    return hourly_from_events(events).select(*names).distinct()


def documents_from_events(
    events: DataFrame, broken: bool = False, extra: dict[str, str] | None = None
) -> DataFrame:
    """Payload documents of one city and week each: (request columns, document).

    A document holds the events of one block of ``PAYLOAD_ROWS`` event ids, so
    its arrays stay short however many events a city and week has. ``broken``
    spoils the documents of all cities but one, each city in another way. ``extra`` are
    more hourly variables, name to expression over the event.
    """
    extra = extra or {}
    request = ["city_id", "week", "block"]
    place = ["latitude", "longitude", "timezone"]
    blocks = events.withColumn("block", F.floor(F.col("event_id") / PAYLOAD_ROWS))
    rows = (
        hourly_from_events(blocks, keep=("block", *[f"{e} as {n}" for n, e in extra.items()]))
        .withColumn("day", F.to_date("time"))
        # Rows without a time go to the documents of one week.
        .withColumn("week", F.to_date(F.date_trunc("week", F.coalesce("day", F.lit("2024-01-01").cast("date")))))
        # One exchange by document serves the days as well.
        .repartition(*request)
    )
    reading = F.struct(_iso("time").alias("time"), *MEASURES, *extra)
    days = rows.groupBy(*request, *place, "day").agg(
        F.array_sort(F.collect_list(reading)).alias("readings"),
        F.max("temperature_2m").alias("temperature_2m_max"),
        F.min("temperature_2m").alias("temperature_2m_min"),
        F.sum("precipitation").alias("precipitation_sum"),
        F.max("wind_speed_10m").alias("wind_speed_10m_max"),
    )
    summary = F.struct(
        F.col("day").cast("string").alias("time"),
        "temperature_2m_max",
        "temperature_2m_min",
        "precipitation_sum",
        "wind_speed_10m_max",
        F.concat(F.col("day").cast("string"), F.lit("T08:00")).alias("sunrise"),
    )
    grouped = days.groupBy(*request, *place).agg(
        F.flatten(F.transform(_in_day_order(F.col("readings")), lambda d: d["value"]))
        .alias("hours"),
        F.transform(_in_day_order(summary), lambda d: d["value"]).alias("days"),
    )

    def series(rows: str, name: str) -> Column:
        return F.transform(rows, lambda r: r[name])

    city = F.col("city_id")
    times, temperatures = series("hours", "time"), series("hours", "temperature_2m")
    if broken:
        marked = F.transform(times, lambda t: F.concat(F.lit("?"), t))
        times = (
            F.when(city == "signup", F.array().cast("array<string>"))
            .when(city == "purchase", marked)
            .otherwise(times)
        )
        temperatures = F.when(city == "view", F.array_append(temperatures, F.lit(0.0))).otherwise(
            temperatures
        )
    hourly = F.struct(
        times.alias("time"),
        temperatures.alias("temperature_2m"),
        *[series("hours", m).alias(m) for m in (*MEASURES, *extra) if m != "temperature_2m"],
    )
    daily = F.struct(*[series("days", name).alias(name) for name in DAILY_SERIES])
    if broken:
        daily = F.when(city != "error", daily)
    document = F.to_json(F.struct(*place, hourly.alias("hourly"), daily.alias("daily")))
    return grouped.select(
        "city_id",
        F.col("week").alias("start_date"),
        F.date_add("week", 6).alias("end_date"),
        document.alias("document"),
    )


def _in_day_order(value: Column) -> Column:
    return F.array_sort(F.collect_list(F.struct("day", value.alias("value"))))
