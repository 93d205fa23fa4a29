"""The registered queries: every operator on rows derived from the given tables.

Each takes (spark, sf_dir) and returns a DataFrame over the whole ``events``
table. Means, deviations and sums of doubles are rounded to six places, since
their last digits depend on the order of addition.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F

from isobar.operators import anomalies as scores
from isobar.operators import daily as days
from isobar.operators import gaps, profile, quality, sketches, snapshots
from isobar.operators.staging import staging
from isobar.plans import refresh as layers_plan
from isobar.plans import keys, tables
from isobar.plans.ingest import ingest
from isobar.schema import DAILY, HOURLY, conform
from isobar.session import scratch, settle
from isobar.sources import cities, events, landing, payload, raw, variables
from isobar.sources.drifted import scan_drifted
from isobar.streaming.city_state import city_state, keep_city_state
from isobar.streaming.incremental import load_new
from isobar.streaming.loads import Store, load_exactly_once, replay
from isobar.streaming.quality import Recorder, recorded_once, watched
from isobar.streaming.unique import keep_unique, too_late, unique_rows

RUN_TS = datetime(2024, 2, 1, 3, 4, 5)
CONSTANT_CITY = "error"

#: measures of the proxy rows, and the columns compared after a round trip
MEASURES = events.MEASURES
PLACE = ["city_id", "city_name", "latitude", "longitude", "timezone"]
HOURLY_COLUMNS = ["time", *MEASURES, *PLACE]
DAILY_COLUMNS = ["time", *events.DAILY_SERIES[1:], *PLACE]

DAILY_DOUBLES = [
    "temp_avg",
    "temp_stddev",
    "precip_total",
    "wind_avg",
    "humidity_avg",
    "pressure_avg",
    "cloud_cover_avg",
]
STATS = ["avg_temp", "stddev_temp", "avg_precip", "stddev_precip"]
SCORES = ["temp_zscore", "precip_zscore"]


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.round(c, 6) for c in present})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.read_events(spark, sf_dir)


def _raw(spark: SparkSession, sf_dir: str, constant_city: str | None = None) -> DataFrame:
    return events.hourly_from_events(_events(spark, sf_dir), constant_city)


def _stg(spark: SparkSession, sf_dir: str, fill: bool = True) -> DataFrame:
    return staging(_raw(spark, sf_dir), fill)


def _constant_stg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging(_raw(spark, sf_dir, CONSTANT_CITY))


# --- staging and marts -------------------------------------------------------

def stg_weather(spark, sf_dir):
    return _stg(spark, sf_dir)


def weather_daily(spark, sf_dir):
    return _rounded(days.in_date_order(days.daily(_stg(spark, sf_dir))), DAILY_DOUBLES)


def weather_daily_bootstrap(spark, sf_dir):
    mart = days.daily(_stg(spark, sf_dir), variant="bootstrap")
    return _rounded(days.in_date_order(mart), DAILY_DOUBLES)


def weather_daily_unfilled(spark, sf_dir):
    return _rounded(days.daily(_stg(spark, sf_dir, fill=False)), DAILY_DOUBLES)


def daily_preview(spark, sf_dir):
    mart = days.in_date_order(days.daily(_stg(spark, sf_dir))).limit(5)
    return _rounded(mart, DAILY_DOUBLES)


def city_stats(spark, sf_dir):
    return _rounded(scores.city_stats(_stg(spark, sf_dir)), STATS)


def city_stats_merged(spark, sf_dir):
    moments = settle(days.daily_moments(_constant_stg(spark, sf_dir)), "daily-moments")
    return _rounded(days.merged_city_stats(moments), STATS)


def weather_anomalies(spark, sf_dir):
    return _rounded(scores.anomalies(_stg(spark, sf_dir)), SCORES)


def weather_anomalies_unfilled(spark, sf_dir):
    return _rounded(scores.anomalies(_stg(spark, sf_dir, fill=False)), SCORES)


def weather_anomalies_constant(spark, sf_dir):
    return _rounded(scores.anomalies(_constant_stg(spark, sf_dir)), SCORES)


def weather_anomalies_bootstrap(spark, sf_dir):
    marked = scores.anomalies(_constant_stg(spark, sf_dir), variant="bootstrap")
    return _rounded(marked, SCORES)


def anomalies_in_time_order(spark, sf_dir):
    return _rounded(scores.in_time_order(scores.anomalies(_stg(spark, sf_dir))), SCORES)


def flagged_anomalies(spark, sf_dir):
    return _rounded(scores.anomalies(_stg(spark, sf_dir)).where("is_temp_anomaly"), SCORES)


def anomaly_counts(spark, sf_dir):
    return scores.anomaly_counts(scores.anomalies(_stg(spark, sf_dir)))


def cloud_temp_corr(spark, sf_dir):
    return _rounded(profile.cloud_temp_corr(_stg(spark, sf_dir)), ["cloud_temp_corr"])


# --- data quality ------------------------------------------------------------

def _faulty_raw(spark, sf_dir):
    """Rows with missing keys: no city on quiet views, no time on extreme values."""
    rows = _raw(spark, sf_dir)
    quiet = (F.col("city_id") == "view") & (F.col("precipitation") < 0.5)
    return rows.select(
        F.when(F.col("wind_speed_10m") > 50, F.lit(None)).otherwise(F.col("time")).alias("time"),
        F.when(quiet, F.lit(None)).otherwise(F.col("city_id")).alias("city_id"),
        F.when(F.col("cloud_cover") == 13, F.lit(None))
        .otherwise(F.col("city_name"))
        .alias("city_name"),
        *[c for c in rows.columns if c not in ("time", "city_id", "city_name")],
    )


def _daily_grain(hourly: DataFrame) -> DataFrame:
    days = hourly.groupBy("city_id", F.to_date("time").alias("day")).agg(
        F.max("temperature_2m").alias("temperature_2m_max"),
        F.min("temperature_2m").alias("temperature_2m_min"),
    )
    return days.withColumn("time", F.col("day").cast("timestamp_ntz")).drop("day")


def _lazy_tables(hourly: DataFrame) -> dict[str, DataFrame]:
    stg = staging(hourly)
    return {
        layers_plan.HOURLY: hourly,
        layers_plan.DAILY: _daily_grain(hourly),
        layers_plan.STAGING: stg,
        layers_plan.MART_DAILY: days.daily(stg),
        layers_plan.MART_ANOMALIES: scores.anomalies(stg),
    }


def _overlapping(spark, sf_dir):
    """All rows, and those of the last two days once more from a later batch."""
    rows = _raw(spark, sf_dir)
    again = rows.where(F.to_date("time") >= F.lit("2024-01-29").cast("date")).withColumns({
        "batch_id": F.lit("rerun"),
        "ingestion_timestamp": F.col("ingestion_timestamp") + F.make_dt_interval(days=F.lit(1)),
        "temperature_2m": F.col("temperature_2m") + 1,
    })
    return rows.unionByName(again)


def dq_not_null(spark, sf_dir):
    return quality.not_null_checks(_lazy_tables(_faulty_raw(spark, sf_dir)))


def dq_unique(spark, sf_dir):
    table = layers_plan.STAGING
    return quality.unique(staging(_overlapping(spark, sf_dir)), table, quality.UNIQUE[table])


def duplicate_keys(spark, sf_dir):
    return quality.duplicates(staging(_overlapping(spark, sf_dir)), snapshots.KEY)


def dq_relationships(spark, sf_dir):
    hourly = _faulty_raw(spark, sf_dir)
    stormy = hourly.where("wind_speed_10m > 69")
    stg = staging(hourly)
    return quality.union([
        quality.relationships(stg, hourly, layers_plan.STAGING, "city_id"),
        quality.relationships(stg, stormy, "staging.stg_weather_stormy", "city_id"),
    ])


def city_orphans(spark, sf_dir):
    hourly = _raw(spark, sf_dir)
    return quality.orphans(hourly, hourly.where("wind_speed_10m > 69"), "city_id")


LIMITS = {"temperature_2m": (0.5, 200.0), "precipitation": (0.0, 20.0)}


def dq_range(spark, sf_dir):
    return quality.tally(_stg(spark, sf_dir), layers_plan.STAGING, quality.value_range(LIMITS))


def layer_row_counts(spark, sf_dir):
    return quality.row_counts(_lazy_tables(_raw(spark, sf_dir)))


def coverage(spark, sf_dir):
    return quality.coverage(_stg(spark, sf_dir))


def hour_coverage(spark, sf_dir):
    return gaps.coverage_of_hours(_stg(spark, sf_dir))


def missing_intervals(spark, sf_dir):
    return gaps.missing_intervals(_stg(spark, sf_dir))


def _sketches(spark, sf_dir):
    made = sketches.daily_sketches(_stg(spark, sf_dir), ["time", "pressure_msl"], ["temperature_2m", "precipitation"])
    return settle(made, "sketches")


def distinct_sketch(spark, sf_dir):
    """Distinct times and pressures per city, and whether the estimate from daily sketches is within its error."""
    exact = _stg(spark, sf_dir).groupBy("city_id").agg(
        F.count_distinct("time").alias("times"), F.count_distinct("pressure_msl").alias("pressures")
    )
    daily, error = _sketches(spark, sf_dir), sketches.distinct_error()
    for column, name in (("time", "times"), ("pressure_msl", "pressures")):
        estimate = sketches.distinct_values(daily, column, "city_id")
        near = F.abs(F.col("distinct_values") - F.col(name)) <= F.greatest(F.lit(1.0), error * F.col(name))
        exact = exact.join(estimate, "city_id").withColumn(f"{name}_near", near).drop("distinct_values")
    return exact


def quantile_sketch(spark, sf_dir):
    """Quartiles per city from daily sketches: how many values, and whether each is at its rank within the error."""
    found = settle(sketches.quantiles(_sketches(spark, sf_dir), "temperature_2m", [0.25, 0.5, 0.75], "city_id"), "quartiles")
    rows, error = _stg(spark, sf_dir).join(found, "city_id"), sketches.RANK_ERROR

    def near(i: int, rank: float):
        below, upto = (F.count_if(test) / F.count(F.lit(1)) for test in (F.col("temperature_2m") < F.col(f"q{i}"), F.col("temperature_2m") <= F.col(f"q{i}")))
        return ((below <= rank + error) & (upto >= rank - error)).alias(f"q{i}_near")

    return rows.groupBy("city_id").agg(F.max("n").alias("n"), *[near(i, r) for i, r in enumerate((0.25, 0.5, 0.75))])


def range_from_data(spark, sf_dir):
    """Per city, values beyond limits from its quartiles: whether as many fail as fail limits from exact ranks near by."""
    daily, stg = _sketches(spark, sf_dir), _stg(spark, sf_dir)
    bounds = settle(sketches.limits(daily, "temperature_2m", 1.5, "city_id"), "limits")
    failing = sketches.outside(stg, bounds, "temperature_2m")
    error = sketches.RANK_ERROR
    low, high = "percentile(temperature_2m, {})", "percentile(temperature_2m, {})"
    exact = stg.groupBy("city_id").agg(
        F.expr(low.format(0.25 - error)).alias("a"), F.expr(low.format(0.25 + error)).alias("b"),
        F.expr(high.format(0.75 - error)).alias("c"), F.expr(high.format(0.75 + error)).alias("d"),
    ).select(
        "city_id", (F.col("b") - 1.5 * (F.col("c") - F.col("b"))).alias("tight_low"), (F.col("c") + 1.5 * (F.col("c") - F.col("b"))).alias("tight_high"),
        (F.col("a") - 1.5 * (F.col("d") - F.col("a"))).alias("wide_low"), (F.col("d") + 1.5 * (F.col("d") - F.col("a"))).alias("wide_high"),
    )
    exact = settle(exact, "exact-limits")
    t = F.col("temperature_2m")
    most = stg.join(exact, "city_id").groupBy("city_id").agg(
        F.count_if(~t.between(F.col("tight_low"), F.col("tight_high"))).alias("most"),
        F.count_if(~t.between(F.col("wide_low"), F.col("wide_high"))).alias("least"),
    )
    near = F.col("failures").between(F.col("least"), F.col("most"))
    return failing.join(most, "city_id").select("city_id", (F.col("failures") + F.col("passed")).alias("checked"), near.alias("failures_near"))


# --- requests, payloads, landing ---------------------------------------------

def _dimension(spark, sf_dir):
    return settle(events.cities_from_events(_events(spark, sf_dir)), "cities")


def _landing(spark, sf_dir, broken=False) -> str:
    """Documents of all events, landed anew for each query."""
    path = scratch(spark, "landing")
    documents = events.documents_from_events(_events(spark, sf_dir), broken)
    landing.write_landing(documents, path)
    return path


def _days(spark, sf_dir) -> dict[str, str]:
    """The first and last day of all events, as a custom request."""
    first, last = _events(spark, sf_dir).agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    return {"start": str(first), "end": str(last)}


def _judged(spark, sf_dir, broken=False):
    docs = landing.scan_landing(spark, _landing(spark, sf_dir, broken))
    return payload.judge(payload.stamped(payload.enrich(docs, _dimension(spark, sf_dir)), RUN_TS))


def request_manifest(spark, sf_dir):
    last = _events(spark, sf_dir).agg(F.to_date(F.max("ts"))).first()[0]
    dimension = _dimension(spark, sf_dir)
    return quality.union([
        cities.request_manifest(dimension, "backfill"),
        cities.request_manifest(dimension, "incremental", as_of=last),
        cities.request_manifest(dimension, "custom", start="2024-01-05", end="2024-01-09"),
    ])


def payload_validate(spark, sf_dir):
    return payload.verdicts(_judged(spark, sf_dir, broken=True))


def payload_hourly(spark, sf_dir):
    columns = [*HOURLY_COLUMNS, "ingestion_timestamp", "batch_id"]
    return payload.hourly_rows(_judged(spark, sf_dir)).select(*columns)


def payload_daily(spark, sf_dir):
    columns = [*DAILY_COLUMNS, "ingestion_timestamp", "batch_id"]
    rows = payload.daily_rows(_judged(spark, sf_dir)).select(*columns)
    return _rounded(rows, ["precipitation_sum"])


def payload_quarantine(spark, sf_dir):
    judged = _judged(spark, sf_dir, broken=True)
    return payload.hourly_rows(judged, "quarantine").select(*HOURLY_COLUMNS)


def _ingest(spark, sf_dir, root, **request):
    options = request or {"mode": "custom", **_days(spark, sf_dir)}
    options = {"run_ts": RUN_TS, **options}
    return ingest(spark, _landing(spark, sf_dir), root, _dimension(spark, sf_dir), **options)


def ingest_stats(spark, sf_dir):
    return _ingest(spark, sf_dir, scratch(spark, "raw"))


def custom_ingest(spark, sf_dir):
    root = scratch(spark, "raw")
    request = {"city_ids": ["click", "view"], "start": "2024-01-05", "end": "2024-01-09"}
    _ingest(spark, sf_dir, root, mode="custom", **request)
    return raw.scan_raw(spark, "hourly", root).select(*HOURLY_COLUMNS)


def incremental_ingest(spark, sf_dir):
    root = scratch(spark, "raw")
    last = _events(spark, sf_dir).agg(F.to_date(F.max("ts"))).first()[0]
    return _ingest(spark, sf_dir, root, mode="incremental", as_of=last)


def landing_roundtrip(spark, sf_dir):
    root = scratch(spark, "raw")
    _ingest(spark, sf_dir, root)
    return raw.scan_raw(spark, "hourly", root).select(*HOURLY_COLUMNS)


def daily_scan(spark, sf_dir):
    root = scratch(spark, "raw")
    _ingest(spark, sf_dir, root)
    rows = raw.scan_raw(spark, "daily", root).select(*DAILY_COLUMNS)
    return _rounded(rows, ["precipitation_sum"])


def _flat_files(spark, sf_dir) -> str:
    """Canonical files of two hourly batches and one daily batch in one folder."""
    path, rows = scratch(spark, "files"), _raw(spark, sf_dir)
    early = F.coalesce(F.to_date("time") <= F.lit(date(2024, 1, 15)), F.lit(False))
    hourly, daily = conform(rows, HOURLY), conform(_daily_grain(rows), DAILY)
    hourly.where(early).write.parquet(f"{path}/all_hourly_2024-01-01_2024-01-15_one.parquet")
    hourly.where(~early).write.parquet(f"{path}/all_hourly_2024-01-16_2024-12-31_two.parquet")
    daily.write.parquet(f"{path}/all_daily_2024-01-01_2024-12-31_one.parquet")
    return path


def hourly_files(spark, sf_dir):
    files = _flat_files(spark, sf_dir)
    return raw.scan_files(spark, files, "hourly").select(*HOURLY_COLUMNS)


def daily_files(spark, sf_dir):
    columns = ["time", "city_id", "temperature_2m_max", "temperature_2m_min"]
    return raw.scan_files(spark, _flat_files(spark, sf_dir), "daily").select(*columns)


def drifted_scan(spark, sf_dir):
    """Files of whole-number temperatures, files without cloud cover, and others."""
    path = scratch(spark, "drifted")
    rows = _raw(spark, sf_dir)
    click, error = (F.col("city_id").eqNullSafe(F.lit(c)) for c in ("click", "error"))
    whole = rows.where(click).withColumn("temperature_2m", F.floor("temperature_2m"))
    whole.write.parquet(path)
    rows.where(error).drop("cloud_cover").write.mode("append").parquet(path)
    rows.where(~click & ~error).write.mode("append").parquet(path)
    return scan_drifted(spark, path, HOURLY).select(*HOURLY_COLUMNS)


# --- tables ------------------------------------------------------------------

def _layers(spark) -> tables.Layers:
    prefix = f"run_{uuid.uuid4().hex[:8]}_"
    return tables.Layers(spark, scratch(spark, "layers"), prefix).create()


def _refreshed(spark, sf_dir, **options):
    layers = _layers(spark)
    root = scratch(spark, "raw")
    _ingest(spark, sf_dir, root)
    registered = tables.register_raw(layers, root)
    return layers, layers_plan.refresh(
        layers, registered[layers_plan.HOURLY], registered[layers_plan.DAILY], **options
    )


def full_refresh(spark, sf_dir):
    _, refreshed = _refreshed(spark, sf_dir)
    mart = refreshed[layers_plan.MART_DAILY].drop("last_updated")
    return _rounded(days.in_date_order(mart), DAILY_DOUBLES)


def incremental_refresh(spark, sf_dir):
    """Refresh without the last ten days, then with all rows, those days anew."""
    layers, rows = _layers(spark), _raw(spark, sf_dir)
    late = F.to_date("time") >= F.lit(date(2024, 1, 21))
    layers_plan.refresh(layers, rows.where(~late), _daily_grain(rows.where(~late)))
    days = layers_plan.days_of(rows.where(late))
    refreshed = layers_plan.refresh(layers, rows, _daily_grain(rows), days=days)
    return _rounded(refreshed[layers_plan.MART_DAILY], DAILY_DOUBLES)


def newest_refresh(spark, sf_dir):
    """Refresh all rows, then with a later batch of two days; only the newest rows of those days are looked for."""
    layers, rows = _layers(spark), _raw(spark, sf_dir)
    layers_plan.refresh(layers, rows, _daily_grain(rows), newest_only=True)
    both = _overlapping(spark, sf_dir)
    changed = layers_plan.days_of(both.where("batch_id = 'rerun'"))
    refreshed = layers_plan.refresh(layers, both, _daily_grain(both), newest_only=True, days=changed)
    return _rounded(refreshed[layers_plan.MART_ANOMALIES], SCORES)


def refresh_after_empty_batch(spark, sf_dir):
    """Refresh, then again after a batch without rows: the mart stays as it is."""
    layers, rows = _layers(spark), _raw(spark, sf_dir)
    layers_plan.refresh(layers, rows, _daily_grain(rows))
    nothing = layers_plan.days_of(rows.where("false"))
    refreshed = layers_plan.refresh(layers, rows, _daily_grain(rows), days=nothing)
    return _rounded(refreshed[layers_plan.MART_DAILY], DAILY_DOUBLES)


def streamed_refresh(spark, sf_dir):
    """Load all documents by a stream, register what it wrote, refresh."""
    path, root, state = _landing(spark, sf_dir), scratch(spark, "raw"), scratch(spark, "state")
    load_new(spark, path, root, state, _dimension(spark, sf_dir)).awaitTermination()
    layers = _layers(spark)
    registered = tables.register_raw(layers, root)
    refreshed = layers_plan.refresh(layers, registered[layers_plan.HOURLY], registered[layers_plan.DAILY])
    return _rounded(refreshed[layers_plan.MART_DAILY].drop("last_updated"), DAILY_DOUBLES)


def manifest_ingest(spark, sf_dir):
    """Another last day for each city: the day of the month is the length of its name."""
    root, dimension = scratch(spark, "raw"), _dimension(spark, sf_dir)
    day = F.date_add(F.lit(date(2024, 1, 1)), F.length("city_id"))
    manifest = dimension.select("city_id", day.alias("start_date"), day.alias("end_date"))
    return _ingest(spark, sf_dir, root, mode="custom", manifest=manifest)


def full_refresh_anomalies(spark, sf_dir):
    _, refreshed = _refreshed(spark, sf_dir)
    return _rounded(refreshed[layers_plan.MART_ANOMALIES], SCORES)


def table_listing(spark, sf_dir):
    layers, _ = _refreshed(spark, sf_dir, variant="bootstrap")
    return layers.listing()


def build_once(spark, sf_dir):
    layers, mart = _layers(spark), days.daily(_stg(spark, sf_dir))
    tables.build_once(layers, mart, layers_plan.MART_DAILY)
    built = tables.build_once(layers, mart.where("city_id = 'click'"), layers_plan.MART_DAILY)
    return _rounded(built, DAILY_DOUBLES)


def legacy_table(spark, sf_dir):
    return tables.append_legacy(_layers(spark), _raw(spark, sf_dir))


def legacy_marts(spark, sf_dir):
    layers = _layers(spark)
    tables.append_legacy(layers, _raw(spark, sf_dir))
    built = layers_plan.build_legacy(layers)
    return _rounded(built[layers_plan.MART_ANOMALIES], SCORES)


def dq_results(spark, sf_dir):
    layers, hourly = _layers(spark), _faulty_raw(spark, sf_dir)
    refreshed = layers_plan.refresh(layers, hourly, _daily_grain(hourly))
    for run in range(2):
        results = layers_plan.check(refreshed, LIMITS)
        recorded = layers_plan.record(layers, results, RUN_TS + timedelta(days=run))
    return recorded


# --- increments --------------------------------------------------------------

def incremental_load(spark, sf_dir):
    """Land two weeks, load, land the rest, load, load again with nothing new."""
    path, root, state = (scratch(spark, n) for n in ("landing", "raw", "state"))
    dimension = _dimension(spark, sf_dir)
    documents = settle(events.documents_from_events(_events(spark, sf_dir)), "documents")
    later = F.coalesce(F.col("start_date") >= F.lit(date(2024, 1, 15)), F.lit(True))
    for part in (~later, later, None):
        if part is not None:
            landing.write_landing(documents.where(part), path)
        load_new(spark, path, root, state, dimension).awaitTermination()
    return raw.scan_raw(spark, "hourly", root).select(*HOURLY_COLUMNS)


def _three_landings(spark, sf_dir, path, broken=False):
    """Land the documents of all events by week in three parts; what is yielded between runs a load."""
    documents = settle(events.documents_from_events(_events(spark, sf_dir), broken), "documents")
    start = F.coalesce("start_date", F.lit(date(2024, 1, 1)))
    first, second = start < F.lit(date(2024, 1, 15)), start >= F.lit(date(2024, 1, 22))
    for part in (first, ~first & ~second, second):
        landing.write_landing(documents.where(part), path)
        yield


def _loaded(spark, sf_dir, broken=False) -> Store:
    """All events in three loads. The second is written, and fails before it is committed; it is delivered again."""
    path, state = scratch(spark, "landing"), scratch(spark, "state")
    store, dimension = Store(spark, scratch(spark, "loads")), _dimension(spark, sf_dir)
    failed: list = []

    def fail_once(load: int) -> None:
        if load == 1 and not failed:
            failed.append(load)
            raise RuntimeError("between write and commit")

    for _ in _three_landings(spark, sf_dir, path, broken):
        for _ in range(2):
            try:
                load_exactly_once(store, path, state, dimension, on_written=fail_once).awaitTermination()
                break
            except StreamingQueryException:
                if failed != [1]:  # any other failure, or a second one
                    raise
                failed.append("seen")
    return store


def streamed_marts(spark, sf_dir):
    """The daily mart of three loads, one of which came twice; all partials have been folded."""
    store = _loaded(spark, sf_dir)
    store.fold()
    return _rounded(days.daily_from_moments(store.daily_moments()).drop("last_updated"), DAILY_DOUBLES)


def streamed_marts_stats(spark, sf_dir):
    """City statistics from the stored partials of the same loads."""
    return _rounded(days.merged_city_stats(settle(_loaded(spark, sf_dir).daily_moments(), "moments")), STATS)


def load_ledger(spark, sf_dir):
    """What each of three loads brought, some cities' documents broken."""
    return _loaded(spark, sf_dir, broken=True).ledger()


def _late_files(spark, sf_dir, path):
    """Write rows as files of hourly rows, the middle of the time first, then the first and last weeks; yield after each."""
    rows, day = conform(_constant_raw(spark, sf_dir), HOURLY), F.to_date("time")
    middle = F.coalesce(day.between(F.lit(date(2024, 1, 8)), F.lit(date(2024, 1, 20))), F.lit(False))
    early = F.coalesce(day < F.lit(date(2024, 1, 8)), F.lit(False))
    for part in (middle, early, ~middle & ~early):
        rows.where(part).write.mode("append").parquet(path)
        yield


def _constant_raw(spark, sf_dir):
    return _raw(spark, sf_dir, CONSTANT_CITY)


def streamed_city_state(spark, sf_dir):
    """Statistics and high-water mark per city kept as state over three runs, the second of which brings late rows."""
    path, root, state = (scratch(spark, n) for n in ("files", "states", "state"))
    for _ in _late_files(spark, sf_dir, path):
        rows = spark.readStream.schema(HOURLY).parquet(path)
        keep_city_state(staging(rows), root, state).awaitTermination()
    return _rounded(city_state(spark, root), STATS)


LATENESS = "10 days"


def _arrived(spark, sf_dir):
    """Folders of three arrivals, and where their unique rows are kept.

    First the middle of the time but for one city; then the later days, that city's rows, and copies of
    some days with other values; last the early days, and copies again.
    """
    path, root, state = (scratch(spark, n) for n in ("files", "unique", "state"))
    rows, day = conform(_raw(spark, sf_dir), HOURLY), F.to_date("time")
    middle, view = day.between(F.lit(date(2024, 1, 8)), F.lit(date(2024, 1, 20))), F.col("city_id") == "view"
    copies = rows.withColumn("temperature_2m", F.col("temperature_2m") + 1)
    parts = [
        rows.where(middle & ~view),
        rows.where((day > F.lit(date(2024, 1, 20))) | middle & view).unionByName(copies.where(day == F.lit(date(2024, 1, 18))).where(~view)),
        rows.where(day < F.lit(date(2024, 1, 8))).unionByName(copies.where(day.isin(date(2024, 1, 19), date(2024, 1, 25)))),
    ]
    for part in parts:
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(HOURLY).parquet(path)
        keep_unique(stream, root, state, LATENESS).awaitTermination()
    return spark.read.schema(HOURLY).parquet(path), unique_rows(spark, root, HOURLY)


def streamed_unique(spark, sf_dir):
    return _arrived(spark, sf_dir)[1].select(*HOURLY_COLUMNS)


def late_rows(spark, sf_dir):
    return too_late(*_arrived(spark, sf_dir), LATENESS).select(*HOURLY_COLUMNS)


def streamed_checks(spark, sf_dir):
    """Checks counted while faulty rows pass a stream in three runs, summed over the recorded batches."""
    layers, rows = _layers(spark), _faulty_raw(spark, sf_dir)
    path, root, state = (scratch(spark, n) for n in ("files", "raw", "state"))
    checks = quality.not_null(quality.NOT_NULL[layers_plan.HOURLY]) + quality.value_range(LIMITS)
    recorder = Recorder(layers)
    spark.streams.addListener(recorder)
    try:
        for i in range(3):
            conform(rows.where(F.pmod(F.xxhash64("wind_speed_10m", "cloud_cover"), F.lit(3)) == i), HOURLY).write.mode("append").parquet(path)
            passing = watched(spark.readStream.schema(HOURLY).parquet(path), layers_plan.HOURLY, checks)
            query = passing.writeStream.format("parquet").option("path", root).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination()
            recorder.wait(query)
    finally:
        spark.streams.removeListener(recorder)
    if recorder.errors:
        raise recorder.errors[0]
    return recorded_once(layers).groupBy("table_name", "check_name", "column_name").agg(F.sum("failures").alias("failures"))


def _replayed(spark, sf_dir) -> Store:
    """All events, two cities unknown when they are loaded; replays before and after the dimension grows, and once more.

    The first replay that takes anything fails before it is committed.
    """
    path, state = scratch(spark, "landing"), scratch(spark, "state")
    store, dimension = Store(spark, scratch(spark, "loads")), _dimension(spark, sf_dir)
    known = dimension.where("city_id NOT IN ('view', 'signup')")
    for _ in _three_landings(spark, sf_dir, path):
        load_exactly_once(store, path, state, known).awaitTermination()
    replay(store, known)

    def fail(load: int) -> None:
        raise RuntimeError("between write and commit")

    try:
        replay(store, dimension, on_written=fail)
    except RuntimeError:
        pass
    replay(store, dimension.where("city_id <> 'signup'"))
    replay(store, dimension)
    replay(store, dimension)
    return store


def replayed_rows(spark, sf_dir):
    return _replayed(spark, sf_dir).rows("hourly").select(*HOURLY_COLUMNS)


def replay_ledger(spark, sf_dir):
    return _replayed(spark, sf_dir).ledger()


def high_water_delta(spark, sf_dir):
    """Rows beyond what a first load, ending at another time per city, has taken."""
    rows = _raw(spark, sf_dir)
    cut = F.lit("2024-01-10").cast("timestamp_ntz") + F.make_dt_interval(
        days=F.length("city_id")
    )
    taken = rows.where((F.col("time") < cut) & (F.col("city_id") != "view"))
    return snapshots.newer_than(rows, snapshots.high_water(taken)).select(*HOURLY_COLUMNS)


def high_water_bounded(spark, sf_dir):
    """As before, with a mark for every city: stored marks, brought forward by a batch."""
    rows = _raw(spark, sf_dir)
    first, second = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05", "2024-01-10"))
    marks = settle(snapshots.high_water(rows.where(F.col("time") < first)), "marks")
    batch = rows.where((F.col("time") >= first) & (F.col("time") < second))
    marks = snapshots.merged_marks(marks, batch)
    return snapshots.newer_than(rows, marks, all_marked=True).select(*HOURLY_COLUMNS)


def latest_batch(spark, sf_dir):
    columns = [*HOURLY_COLUMNS, "ingestion_timestamp", "batch_id"]
    return snapshots.latest_rows(_overlapping(spark, sf_dir)).select(*columns)


def _snapshots(spark, sf_dir):
    """An old and a new snapshot; the new one corrects rows without humidity."""
    rows, day = _raw(spark, sf_dir), F.to_date("time")
    corrected = F.when(F.col("relative_humidity_2m").isNull(), F.col("temperature_2m") + 1)
    old = rows.where(day <= F.lit(date(2024, 1, 25))).withColumn("batch_id", F.lit("old"))
    new = rows.where(day >= F.lit(date(2024, 1, 5))).withColumns({
        "batch_id": F.lit("new"),
        "temperature_2m": F.coalesce(corrected, F.col("temperature_2m")),
    })
    both = old.unionByName(new)
    is_old, is_new = F.col("batch_id") == "old", F.col("batch_id") == "new"
    return snapshots.snapshot_diff(both, is_old, is_new, ["temperature_2m", "precipitation"])


def snapshot_diff(spark, sf_dir):
    return _snapshots(spark, sf_dir)


def snapshot_diff_copies(spark, sf_dir):
    """Keys with copies: a city and day each. The new snapshot corrects rows without
    humidity, and fills gaps of precipitation on even days."""
    rows = _raw(spark, sf_dir).withColumn("time", F.date_trunc("day", "time").cast("timestamp_ntz"))
    day = F.to_date("time")
    old = rows.where(day <= F.lit(date(2024, 1, 25))).withColumn("batch_id", F.lit("old"))
    dry = (F.dayofmonth("time") % 2 == 0) & F.col("precipitation").isNull()
    new = rows.where(day >= F.lit(date(2024, 1, 5))).withColumns({
        "batch_id": F.lit("new"), "precipitation": F.when(dry, 0.0).otherwise(F.col("precipitation")),
    })
    is_old, is_new = F.col("batch_id") == "old", F.col("batch_id") == "new"
    return snapshots.snapshot_diff(old.unionByName(new), is_old, is_new, ["temperature_2m", "precipitation"])


def _stored_snapshots(spark, sf_dir) -> tuple[str, str]:
    """The two snapshots of ``snapshot_diff``, stored; corrections in three days only."""
    rows, day = _raw(spark, sf_dir), F.to_date("time")
    corrected = day.isin(date(2024, 1, 9), date(2024, 1, 10), date(2024, 1, 21)) & F.col("relative_humidity_2m").isNull()
    new = rows.where(day >= F.lit(date(2024, 1, 5))).withColumn(
        "temperature_2m", F.when(corrected, F.col("temperature_2m") + 1).otherwise(F.col("temperature_2m"))
    )
    paths = scratch(spark, "old"), scratch(spark, "new")
    for path, part in zip(paths, (rows.where(day <= F.lit(date(2024, 1, 25))), new)):
        snapshots.store_snapshot(part, path, ["temperature_2m", "precipitation"])
    return paths


def snapshot_diff_stored(spark, sf_dir):
    return snapshots.stored_diff(spark, *_stored_snapshots(spark, sf_dir), ["temperature_2m", "precipitation"])


def snapshot_changed_days(spark, sf_dir):
    return snapshots.changed_days(spark, *_stored_snapshots(spark, sf_dir))


EXTRA = {"props": "from_json(props, 'k bigint')", "user_id": "user_id"}


def _extras(spark, sf_dir):
    """Documents of all events with two variables that no list names."""
    path = scratch(spark, "landing")
    landing.write_landing(events.documents_from_events(_events(spark, sf_dir), extra=EXTRA), path)
    return settle(variables.extra_variables(landing.scan_documents(spark, path)), "extras")


def landed_extras(spark, sf_dir):
    columns = {"k": ("$.props.k", "bigint"), "user_id": ("$.user_id", "bigint"), "absent": ("$.other", "double")}
    return variables.typed(_extras(spark, sf_dir), columns)


def extra_schema(spark, sf_dir):
    return variables.merged_schema(_extras(spark, sf_dir))


def _keys_by_batch(spark, sf_dir):
    """Overlapping rows in three batches, the second of which is checked twice; the duplicates that each found."""
    layers, rows = _layers(spark), staging(_overlapping(spark, sf_dir))
    rerun = F.col("batch_id") == "rerun"
    odd = F.dayofmonth("time") % 2 == 1
    batches = {"even": rows.where(~rerun & ~odd), "rerun": rows.where(rerun), "odd": rows.where(~rerun & odd)}
    found = []
    for name in ("even", "rerun", "rerun", "odd"):
        new = settle(keys.check_batch(layers, batches[name], snapshots.KEY, name, buckets=8), "new")
        found.append(new.withColumn("batch", F.lit(name)))
    return layers, quality.union([found[0], found[2], found[3]])


def duplicate_keys_by_batch(spark, sf_dir):
    layers, _ = _keys_by_batch(spark, sf_dir)
    return keys.known_keys(layers, snapshots.KEY).where("copies > 1")


def new_duplicates(spark, sf_dir):
    return _keys_by_batch(spark, sf_dir)[1].groupBy("batch").agg(F.count("*").alias("keys"))


def snapshot_diff_counts(spark, sf_dir):
    return snapshots.diff_counts(_snapshots(spark, sf_dir))


QUERIES = [
    stg_weather,
    weather_daily,
    weather_daily_bootstrap,
    weather_daily_unfilled,
    daily_preview,
    city_stats,
    city_stats_merged,
    weather_anomalies,
    weather_anomalies_unfilled,
    weather_anomalies_constant,
    weather_anomalies_bootstrap,
    anomalies_in_time_order,
    flagged_anomalies,
    anomaly_counts,
    cloud_temp_corr,
    dq_not_null,
    dq_unique,
    duplicate_keys,
    dq_relationships,
    city_orphans,
    dq_range,
    layer_row_counts,
    coverage,
    hour_coverage,
    missing_intervals,
    distinct_sketch,
    quantile_sketch,
    range_from_data,
    request_manifest,
    payload_validate,
    payload_hourly,
    payload_daily,
    payload_quarantine,
    ingest_stats,
    custom_ingest,
    incremental_ingest,
    landing_roundtrip,
    daily_scan,
    hourly_files,
    daily_files,
    drifted_scan,
    full_refresh,
    full_refresh_anomalies,
    incremental_refresh,
    newest_refresh,
    refresh_after_empty_batch,
    streamed_refresh,
    manifest_ingest,
    table_listing,
    build_once,
    legacy_table,
    legacy_marts,
    dq_results,
    incremental_load,
    streamed_marts,
    streamed_marts_stats,
    load_ledger,
    streamed_city_state,
    streamed_unique,
    late_rows,
    streamed_checks,
    replayed_rows,
    replay_ledger,
    high_water_delta,
    high_water_bounded,
    latest_batch,
    snapshot_diff,
    snapshot_diff_copies,
    snapshot_diff_counts,
    snapshot_diff_stored,
    snapshot_changed_days,
    landed_extras,
    extra_schema,
    duplicate_keys_by_batch,
    new_duplicates,
]


def queries() -> dict:
    return {query.__name__: query for query in QUERIES}
