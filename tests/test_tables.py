import os
import uuid
from datetime import UTC, date, datetime

import pytest
from fixtures import RUN_TS, document, hourly, land
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from isobar import session
from isobar.operators.snapshots import latest_rows
from isobar.operators.staging import staging
from isobar.plans import refresh as plan
from isobar.plans import tables
from isobar.plans.ingest import RefusedDocuments, ingest
from isobar.schema import DAILY, DAILY_VARIABLES, HOURLY, HOURLY_VARIABLES, LEGACY
from isobar.sources.cities import (
    cities,
    local_request_manifest,
    request_manifest,
    require_known,
)
from isobar.sources.landing import scan_landing
from isobar.sources.payload import enrich
from isobar.sources.raw import scan_raw, write_raw
from isobar.streaming.incremental import load_new, record_refused

DAY = "2026-02-08"


@pytest.fixture
def layers(spark, tmp_path):
    prefix = f"t_{uuid.uuid4().hex[:8]}_"
    return tables.Layers(spark, f"{tmp_path}/layers", prefix).create()


@pytest.fixture
def raw_root(spark, tmp_path):
    landing, root = tmp_path / "landing", f"{tmp_path}/raw"
    for city in ("paris", "tokyo"):
        land(landing, city, DAY, document(DAY, days=2), last="2026-02-09")
    ingest(spark, str(landing), root, cities(spark), "custom", RUN_TS, start=DAY, end="2026-02-09")
    return root


def readings(spark, temperatures):
    return hourly(spark, [
        {"city_id": "paris", "time": datetime(2026, 2, 8, i), "temperature_2m": t}
        for i, t in enumerate(temperatures)
    ])


@pytest.mark.parametrize("variant", ["model", "bootstrap"])
def test_refresh_and_listing(spark, layers, raw_root, variant):
    raw = tables.register_raw(layers, raw_root)
    for _ in range(2):  # a second refresh replaces, it does not add
        built = plan.refresh(layers, raw[plan.HOURLY], raw[plan.DAILY], variant)
    assert built[plan.MART_DAILY].count() == 4
    assert built[plan.MART_ANOMALIES].count() == 96
    listed = {(r.schema_name, r.table_name): r.row_count for r in layers.listing().collect()}
    expected = {
        ("raw", "weather_daily"): 4, ("raw", "weather_hourly"): 96,
        ("mart", "weather_daily"): 4, ("mart", "weather_anomalies"): 96,
    }
    if variant == "bootstrap":
        expected[("staging", "weather_hourly")] = 96
    else:
        assert spark.table(f"{layers.prefix}stg_weather").count() == 96
    assert listed == expected


def test_new_batches_show_after_registering_again(spark, layers, raw_root, tmp_path):
    assert tables.register_raw(layers, raw_root)[plan.HOURLY].count() == 96
    later = datetime(2026, 2, 9, 2)
    request = {"start": DAY, "end": DAY}
    ingest(spark, f"{tmp_path}/landing", raw_root, cities(spark), "custom", later, **request)
    raw = tables.register_raw(layers, raw_root)
    assert raw[plan.HOURLY].count() == 144
    built = plan.refresh(layers, raw[plan.HOURLY], raw[plan.DAILY], newest_only=True)
    assert built[plan.STAGING].count() == 96


def test_a_failed_refresh_keeps_the_old_table(spark, layers):
    stg = staging(readings(spark, [1.0, 2.0]))
    tables.full_refresh(layers, stg, "staging.weather_hourly")
    broken = stg.withColumn("day", F.raise_error(F.lit("broken")).cast("bigint"))
    with pytest.raises(Exception, match="broken"):
        tables.full_refresh(layers, broken, "staging.weather_hourly")
    assert layers.table("staging.weather_hourly").count() == 2


def test_a_table_may_be_rebuilt_from_itself(spark, layers):
    table = "staging.weather_hourly"
    stg = tables.full_refresh(layers, staging(readings(spark, [1.0, 2.0])), table)
    again = tables.full_refresh(layers, stg.where("temperature_2m > 1"), table)
    assert again.count() == 1


def test_a_refresh_of_some_days_takes_only_those_anew(spark, layers):
    def rows(temperature, days):
        return hourly(spark, [
            {"city_id": "paris", "time": datetime(2026, 2, day, hour),
             "temperature_2m": temperature + hour}
            for day in days for hour in (1, 2)
        ] + [{"city_id": "paris", "temperature_2m": temperature}])

    def built(raw, days=None):
        made = plan.refresh(layers, raw, raw, days=days)
        mart = {r.date: (r.temp_min, r.total_hours) for r in made[plan.MART_DAILY].collect()}
        return mart, made[plan.MART_ANOMALIES]

    built(rows(1.0, [1, 2, 3]))
    changed = rows(5.0, [1, 2, 3, 4])
    assert plan.days_of(changed) == (date(2026, 2, 1), date(2026, 2, 4))
    mart, marked = built(changed, (date(2026, 2, 3), date(2026, 2, 4)))
    assert mart == {
        None: (5.0, 1),
        date(2026, 2, 1): (2.0, 2), date(2026, 2, 2): (2.0, 2),
        date(2026, 2, 3): (6.0, 2), date(2026, 2, 4): (6.0, 2),
    }
    assert marked.count() == 9


def test_a_batch_of_no_day_keeps_the_marts(spark, layers):
    raw = readings(spark, [1.0, 2.0, 4.0])
    plan.refresh(layers, raw, raw)
    for batch in (raw.limit(0), raw.withColumn("time", F.lit(None).cast("timestamp_ntz"))):
        days = plan.days_of(batch)
        assert days == plan.NO_DAYS
        built = plan.refresh(layers, raw, raw, days=days)
        assert built[plan.MART_DAILY].count() == 1
        assert built[plan.MART_ANOMALIES].count() == 3


def test_stored_days_are_not_mixed_with_others(spark, layers):
    raw = readings(spark, [1.0, 2.0])
    with pytest.raises(ValueError, match="refresh all days"):
        plan.refresh(layers, raw, raw, days=plan.NO_DAYS)
    plan.refresh(layers, raw, raw)
    with pytest.raises(ValueError, match="fill=False"):
        plan.refresh(layers, raw, raw, fill=False, days=plan.days_of(raw))
    with pytest.raises(ValueError, match="NO_DAYS"):
        plan.refresh(layers, raw, raw, days=(date(2026, 2, 8), None))


def test_old_snapshots_go_and_the_table_stays(spark, layers):
    table = "staging.weather_hourly"
    for n in range(1, 6):
        shown = tables.full_refresh(layers, staging(readings(spark, [1.0] * n)), table)
        assert shown.count() == n
    assert len(os.listdir(layers.path(table))) == tables.KEEP
    with pytest.raises(ValueError):
        tables.expire(layers, table, keep=0)


def test_a_failure_before_the_table_moves_shows_the_old_rows(spark, layers, monkeypatch):
    table = "staging.weather_hourly"
    tables.full_refresh(layers, staging(readings(spark, [1.0, 2.0])), table)

    def fail(*_):
        raise RuntimeError("between the steps")

    monkeypatch.setattr(tables, "_point_at", fail)
    with pytest.raises(RuntimeError):
        tables.full_refresh(layers, staging(readings(spark, [1.0])), table)
    assert layers.table(table).count() == 2


def test_a_streamed_root_is_registered_with_its_rows(spark, layers, tmp_path):
    landing, root = tmp_path / "landing", f"{tmp_path}/raw"
    land(landing, "paris", DAY, document(DAY, days=2), last="2026-02-09")
    land(landing, "atlantis", DAY, document(DAY))
    load_new(spark, str(landing), root, f"{tmp_path}/state", cities(spark)).awaitTermination()
    raw = tables.register_raw(layers, root)
    assert (raw[plan.HOURLY].count(), raw[plan.DAILY].count()) == (48, 2)
    assert plan.refresh(layers, raw[plan.HOURLY], raw[plan.DAILY])[plan.MART_DAILY].count() == 2
    recorded = [(r.city_id, r.reason) for r in spark.read.parquet(f"{root}_refused").collect()]
    assert recorded == [("atlantis", "unknown_city")]


def test_a_run_knows_its_cities_and_records_refusals(spark, tmp_path):
    landing, root = tmp_path / "landing", f"{tmp_path}/raw"
    land(landing, "paris", DAY, document(DAY, days=2), last="2026-02-09")
    land(landing, "tokyo", DAY, document(DAY, days=2), last="2026-02-09")
    land(landing, "london", "__HIVE_DEFAULT_PARTITION__", document(DAY), last="2026-02-09")
    with pytest.raises(ValueError, match="atlantis"):
        ingest(spark, str(landing), root, cities(spark), "backfill", RUN_TS, city_ids=["paris", "atlantis"])
    asked = spark.createDataFrame(
        [("paris", date(2026, 2, 8), date(2026, 2, 8)), ("tokyo", date(2026, 2, 9), date(2026, 2, 9)),
         ("london", date(2026, 2, 8), date(2026, 2, 9))], "city_id string, start_date date, end_date date"
    )
    ingest(spark, str(landing), root, cities(spark), "custom", RUN_TS, manifest=asked)
    days = scan_raw(spark, "hourly", root).select("city_id", F.to_date("time").cast("string")).distinct().collect()
    assert {tuple(r) for r in days} == {("paris", "2026-02-08"), ("tokyo", "2026-02-09")}
    recorded = [(r.city_id, r.reason) for r in spark.read.parquet(f"{root}_refused").collect()]
    assert recorded == [("london", "unreadable_request")]
    with pytest.raises(RefusedDocuments):
        ingest(spark, str(landing), f"{tmp_path}/other", cities(spark), "custom", RUN_TS,
               start=DAY, end=DAY, on_refused="fail")


def test_documents_are_not_moved_to_meet_their_city(spark, tmp_path):
    land(tmp_path, "paris", DAY, document(DAY))
    joined = enrich(scan_landing(spark, str(tmp_path)), cities(spark))
    plan_text = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan_text and "BroadcastHashJoin" in plan_text


def test_scratch_is_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: str(tmp_path))
    assert session.settle(readings(spark, [1.0]), "some").count() == 1
    assert os.listdir(f"{tmp_path}/isobar")
    session.clear_scratch(spark)
    assert not os.listdir(f"{tmp_path}/isobar")


def test_newest_rows_are_refreshed_by_day(spark, layers, tmp_path):
    def rows(batch, values):
        return hourly(spark, [
            {"city_id": "paris", "time": datetime.fromisoformat(t), "temperature_2m": v, "ingestion_timestamp": datetime(2026, 3, batch)}
            for t, v in values.items()
        ])

    raw = rows(1, {"2026-02-07 01:00": 1.0, "2026-02-08 01:00": 2.0, "2026-02-08 02:00": 3.0, "2026-02-09 01:00": 4.0})
    later = rows(2, {"2026-02-08 01:00": 5.0, "2026-02-09 23:59": 6.0})
    raw.write.parquet(f"{tmp_path}/raw")
    plan.refresh(layers, spark.read.schema(HOURLY).parquet(f"{tmp_path}/raw"), raw.limit(0), newest_only=True)
    later.write.mode("append").parquet(f"{tmp_path}/raw")
    both = spark.read.schema(HOURLY).parquet(f"{tmp_path}/raw")
    days = plan.days_of(later)
    built = plan.refresh(layers, both, raw.limit(0), newest_only=True, days=days)
    mart = {str(r.date): (r.total_hours, r.temp_max) for r in built[plan.MART_DAILY].collect()}
    assert mart == {"2026-02-07": (1, 1.0), "2026-02-08": (2, 5.0), "2026-02-09": (2, 6.0)}
    assert sorted(r.temperature_2m for r in built[plan.MART_ANOMALIES].collect()) == [1.0, 3.0, 4.0, 5.0, 6.0]
    scans = latest_rows(both.where(plan._of_days(days)))._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in scans.splitlines() if "FileScan parquet" in line and "/raw" in line]
    assert len(lines) >= 2 and all("time#" in line and "GreaterThanOrEqual(time" in line for line in lines)
    # Options that differ from the stored ones are refused before anything is written.
    with pytest.raises(ValueError, match="refresh all days"):
        plan.refresh(layers, both, raw.limit(0), days=days)


def test_build_once_leaves_a_table_alone(spark, layers):
    tables.build_once(layers, readings(spark, [1.0, 2.0]), "staging.weather")
    assert tables.build_once(layers, readings(spark, [1.0]), "staging.weather").count() == 2


def test_legacy_table_has_fixed_types(spark, layers):
    assert tables.create_legacy_table(layers).count() == 0
    rows = readings(spark, [1.0]).withColumn("relative_humidity_2m", F.lit(54.6))
    legacy = tables.append_legacy(layers, rows)
    assert legacy.schema.simpleString() == LEGACY.simpleString()
    assert legacy.first().relative_humidity_2m == 55
    tables.append_legacy(layers, readings(spark, [2.0, 3.0]))
    assert layers.table("raw.weather").count() == 3
    built = plan.build_legacy(layers)
    assert built["staging.weather"].count() == built[plan.MART_ANOMALIES].count() == 3


def test_results_are_recorded_run_by_run(spark, layers, raw_root):
    raw = tables.register_raw(layers, raw_root)
    built = plan.refresh(layers, raw[plan.HOURLY], raw[plan.DAILY])
    for hour in (1, 2):
        recorded = plan.record(layers, plan.check(built), datetime(2026, 2, 9, hour))
    counts = {r.run_id: r["count"] for r in recorded.groupBy("run_id").count().collect()}
    # 18 declared checks and the two counts of filled gaps
    assert counts == {"20260209_010000": 20, "20260209_020000": 20}
    assert recorded.agg(F.sum("failures")).first()[0] == 0


def test_manifests(spark):
    def requests(*args, **kwargs):
        rows = request_manifest(cities(spark), *args, **kwargs).collect()
        assert len(rows) == 5
        assert rows[0].hourly == ",".join(HOURLY_VARIABLES)
        assert rows[0].daily == ",".join(DAILY_VARIABLES)
        return {(str(r.start_date), str(r.end_date), r.endpoint) for r in rows}

    assert requests("backfill") == {("2024-01-01", "2025-12-31", "archive")}
    assert requests("incremental", as_of=date(2026, 3, 1)) == {
        ("2026-02-28", "2026-02-28", "forecast")
    }
    assert requests("custom", start="2024-01-01", end="2024-01-31") == {
        ("2024-01-01", "2024-01-31", "archive")
    }
    for bad in ({"mode": "custom", "start": "2024-01-01"}, {"mode": "incremental"}, {"mode": "x"}):
        with pytest.raises(ValueError):
            request_manifest(cities(spark), **bad)
    assert require_known(["paris"]) == ["paris"]
    with pytest.raises(ValueError, match="atlantis"):
        require_known(["paris", "atlantis"])


def test_each_city_asks_for_its_own_last_day(spark):
    rows = local_request_manifest(cities(spark), "2026-02-09 02:00:00").collect()
    days = {r.city_id: str(r.start_date) for r in rows}
    assert days["new_york"] == "2026-02-07"  # still the 8th there
    assert days["tokyo"] == days["paris"] == "2026-02-08"


def test_incremental_load_takes_each_document_once(spark, tmp_path):
    landing, root, state = tmp_path / "landing", f"{tmp_path}/raw", f"{tmp_path}/state"

    def load():
        load_new(spark, str(landing), root, state, cities(spark), max_files=1).awaitTermination()
        return scan_raw(spark, "hourly", root)

    land(landing, "paris", DAY, document(DAY))
    land(landing, "tokyo", DAY, document(DAY, daily=None))
    assert load().count() == 24
    assert load().count() == 24  # nothing new
    land(landing, "paris", "2026-02-09", document("2026-02-09"))
    land(landing, "tokyo", DAY, document(DAY), name="b")
    rows = load()
    assert rows.count() == 72
    assert scan_raw(spark, "daily", root).count() == 3
    # Lineage is the time of landing in UTC, in the format of all batch ids.
    first = rows.where("city_id = 'paris'").orderBy("time").first()
    modified = os.path.getmtime(f"{landing}/city_id=paris/start_date={DAY}/end_date={DAY}/a.json")
    stamp = datetime.fromtimestamp(modified, UTC).replace(tzinfo=None)
    assert first.batch_id == stamp.strftime("%Y%m%d_%H%M%S")
    assert abs((first.ingestion_timestamp - stamp).total_seconds()) < 0.01
    assert os.path.isdir(f"{root}/_spark_metadata")

    def refused():
        path = f"{tmp_path}/refused"
        query = record_refused(spark, str(landing), path, f"{tmp_path}/state2", cities(spark))
        query.awaitTermination()
        return [(r.city_id, r.reason) for r in spark.read.parquet(path).collect()]

    assert refused() == refused() == [("tokyo", "missing_daily")]


def test_registering_without_daily_files(spark, layers, tmp_path):
    root = f"{tmp_path}/hourly-only"
    write_raw(readings(spark, [1.0, 2.0]).withColumn("grain", F.lit("hourly")), root)
    raw = tables.register_raw(layers, root)
    assert raw[plan.DAILY].count() == 0
    assert raw[plan.DAILY].columns == DAILY.names
    built = plan.refresh(layers, raw[plan.HOURLY], raw[plan.DAILY])
    assert built[plan.MART_DAILY].count() == 1
    checked = plan.check(built).where("check_name <> 'filled'").collect()
    assert len(checked) == 18 and {r.failures for r in checked} == {0}


def test_registering_without_hourly_files_is_an_error(spark, layers, tmp_path):
    with pytest.raises(AnalysisException):
        tables.register_raw(layers, f"{tmp_path}/nowhere")
