import copy
import json
from datetime import datetime

import pytest
from fixtures import RUN_TS, document, judged, land

from isobar.plans.ingest import ingest
from isobar.schema import DAILY, HOURLY
from isobar.sources import payload
from isobar.sources.cities import cities
from isobar.sources.raw import scan_raw

DAY = "2026-02-08"


def reasons(spark, root, form="lines"):
    rows = judged(spark, root, form).select("city_id", "reject_reason", "failure_reason").collect()
    return {r.city_id: r.reject_reason or r.failure_reason for r in rows}


def changed(grain, **arrays):
    whole = document(DAY)
    inner = copy.deepcopy(whole[grain])
    for name, values in arrays.items():
        if values is None:
            del inner[name]
        else:
            inner[name] = values
    return {**whole, grain: inner}


def test_one_city_day_has_the_recorded_shape(spark, tmp_path):
    land(tmp_path, "amsterdam", DAY, document(DAY))
    docs = judged(spark, tmp_path)
    hourly, daily = payload.hourly_rows(docs), payload.daily_rows(docs)
    assert (hourly.count(), len(hourly.columns)) == (24, 38)
    assert (daily.count(), len(daily.columns)) == (1, 28)
    assert hourly.schema.simpleString() == HOURLY.simpleString()
    assert daily.schema.simpleString() == DAILY.simpleString()


def test_values_times_and_metadata(spark, tmp_path):
    land(tmp_path, "amsterdam", DAY, document(DAY))
    row = payload.hourly_rows(judged(spark, tmp_path)).orderBy("time").collect()[13]
    assert row.time == datetime(2026, 2, 8, 13)
    assert (row.temperature_2m, row.weather_code) == (13.0, 3)
    # The place comes from the response, the names from the dimension.
    assert (row.city_id, row.city_name) == ("amsterdam", "Amsterdam")
    assert (row.latitude, row.longitude, row.timezone) == (52.37, 4.9, "Europe/Amsterdam")
    assert (row.ingestion_timestamp, row.batch_id) == (RUN_TS, "20260208_020000")
    day = payload.daily_rows(judged(spark, tmp_path)).first()
    assert (day.time, day.sunrise) == (datetime(2026, 2, 8), f"{DAY}T08:00")


def test_refused_documents(spark, tmp_path):
    land(tmp_path, "amsterdam", DAY, document(DAY, daily=None))
    land(tmp_path, "london", DAY, changed("hourly", time=[]))
    land(tmp_path, "paris", DAY, "{}")
    land(tmp_path, "tokyo", DAY, '{"latitude": 1.0, "hourly"')
    land(tmp_path, "new_york", DAY, document(DAY, hourly=None))
    land(tmp_path, "atlantis", DAY, document(DAY))
    assert reasons(spark, tmp_path) == {
        "amsterdam": "missing_daily",
        "london": "empty_hourly_time",
        "paris": "empty_document",
        "tokyo": "malformed_json",
        "new_york": "missing_hourly",
        "atlantis": "unknown_city",
    }
    assert payload.hourly_rows(judged(spark, tmp_path)).count() == 0


def test_failing_documents(spark, tmp_path):
    land(tmp_path, "amsterdam", DAY, changed("hourly", rain=[1.0, 2.0]))
    land(tmp_path, "london", DAY, changed("hourly", time=None))
    land(tmp_path, "paris", DAY, changed("hourly", time=["soon"] * 24))
    land(tmp_path, "tokyo", DAY, changed("daily", sunset=["x", "y"]))
    land(tmp_path, "new_york", DAY, document(DAY))
    assert reasons(spark, tmp_path) == {
        "amsterdam": "ragged_hourly",
        "london": "no_hourly_time",
        "paris": "bad_hourly_time",
        "tokyo": "ragged_daily",
        "new_york": None,
    }
    docs = judged(spark, tmp_path)
    assert payload.hourly_rows(docs, "quarantine").count() == 24
    with pytest.raises(Exception, match="cannot be read as rows"):
        payload.hourly_rows(docs).count()
    listed = {r.city_id: r.reason for r in payload.refused(docs).collect()}
    assert listed == {k: v for k, v in reasons(spark, tmp_path).items() if v}


def test_missing_variables_and_null_values_become_null(spark, tmp_path):
    land(tmp_path, "paris", DAY, changed("hourly", rain=None, temperature_2m=[None] * 24))
    rows = payload.hourly_rows(judged(spark, tmp_path))
    assert rows.where("rain is null and temperature_2m is null").count() == 24
    assert rows.where("precipitation is null").count() == 0


def test_null_times_are_kept_for_the_checks(spark, tmp_path):
    times = document(DAY)["hourly"]["time"]
    land(tmp_path, "paris", DAY, changed("hourly", time=[None] + times[1:]))
    root = f"{tmp_path}/raw"
    ingest(spark, str(tmp_path), root, cities(spark), "custom", RUN_TS, start=DAY, end=DAY)
    assert scan_raw(spark, "hourly", root).where("time is null").count() == 1


def test_pretty_printed_documents(spark, tmp_path):
    land(tmp_path, "paris", DAY, json.dumps(document(DAY), indent=2))
    land(tmp_path, "tokyo", DAY, json.dumps(document(DAY, daily=None), indent=2))
    assert reasons(spark, tmp_path, "documents") == {"paris": None, "tokyo": "missing_daily"}
    assert payload.hourly_rows(judged(spark, tmp_path, "documents")).count() == 24


def test_both_grains_in_one_pass_equal_the_single_ones(spark, tmp_path):
    land(tmp_path, "paris", DAY, document(DAY, days=3), last="2026-02-10")
    land(tmp_path, "tokyo", DAY, document(DAY))
    docs = judged(spark, tmp_path)
    both = payload.all_rows(docs)
    for grain, schema in (("hourly", HOURLY), ("daily", DAILY)):
        one = both.where(f"grain = '{grain}'").select(*schema.names)
        single = payload.grain_rows(docs, grain)
        assert one.exceptAll(single).count() == single.exceptAll(one).count() == 0
        assert one.count() == single.count() > 0


def test_five_cities_and_one_more_day(spark, tmp_path):
    landing, root = tmp_path / "landing", f"{tmp_path}/raw"
    for city in ("amsterdam", "new_york", "london", "paris", "tokyo"):
        land(landing, city, "2026-02-07", document("2026-02-07"))
    land(landing, "amsterdam", DAY, document(DAY))
    stats = ingest(
        spark, str(landing), root, cities(spark), "custom", RUN_TS, start="2026-02-07", end=DAY
    )
    assert scan_raw(spark, "hourly", root).count() == 144
    assert scan_raw(spark, "daily", root).count() == 6
    records = {r.city_id: r.records for r in stats.collect()}
    assert records == {"amsterdam": 48, "new_york": 24, "london": 24, "paris": 24, "tokyo": 24}


def test_a_request_takes_only_its_cities_and_days(spark, tmp_path):
    landing, root = tmp_path / "landing", f"{tmp_path}/raw"
    land(landing, "paris", "2026-02-07", document("2026-02-07", days=3), last="2026-02-09")
    land(landing, "tokyo", DAY, document(DAY))
    ingest(
        spark, str(landing), root, cities(spark), "incremental", RUN_TS,
        city_ids=["paris"], as_of=datetime(2026, 2, 9).date(),
    )
    rows = scan_raw(spark, "hourly", root)
    assert rows.count() == 24
    assert rows.selectExpr("min(to_date(time)) = date'2026-02-08'").first()[0]


def test_a_run_without_documents(spark, tmp_path):
    landing, root = tmp_path / "landing", f"{tmp_path}/raw"
    land(landing, "paris", DAY, document(DAY))
    request = {"start": "2020-01-01", "end": "2020-01-02"}
    stats = ingest(spark, str(landing), root, cities(spark), "custom", RUN_TS, **request)
    assert stats.count() == 0


def test_a_run_counts_what_it_wrote(spark, tmp_path, caplog):
    landing, root = tmp_path / "landing", f"{tmp_path}/raw"
    land(landing, "paris", DAY, document(DAY))
    land(landing, "tokyo", DAY, document(DAY, daily=None))
    caplog.set_level("INFO", logger="isobar")
    ingest(spark, str(landing), root, cities(spark), "custom", RUN_TS, start=DAY, end=DAY)
    assert "documents {'read': 2, 'refused': 1}, rows {'hourly': 24, 'daily': 1}" in caplog.text


def test_a_repeated_run_replaces_its_batch(spark, tmp_path):
    landing, root = tmp_path / "landing", f"{tmp_path}/raw"
    land(landing, "paris", DAY, document(DAY))
    request = {"start": DAY, "end": DAY}
    for repeat, run_ts, rows in (
        (False, RUN_TS, 24), (True, RUN_TS, 24), (False, RUN_TS, 48),
        (True, datetime(2026, 2, 9), 72), (True, RUN_TS, 48),
    ):
        ingest(spark, str(landing), root, cities(spark), "custom", run_ts, repeat=repeat, **request)
        assert scan_raw(spark, "hourly", root).count() == rows


def test_a_failing_run_leaves_nothing(spark, tmp_path):
    landing, root = tmp_path / "landing", f"{tmp_path}/raw"
    land(landing, "paris", DAY, document(DAY))
    land(landing, "tokyo", DAY, changed("hourly", rain=[1.0]))
    request = {"start": DAY, "end": DAY, "refused_path": f"{tmp_path}/refused"}
    with pytest.raises(Exception, match="cannot be read as rows"):
        ingest(spark, str(landing), root, cities(spark), "custom", RUN_TS, **request)
    assert scan_raw(spark, "daily", root).count() == 0
    ingest(
        spark, str(landing), root, cities(spark), "custom", RUN_TS,
        on_failure="quarantine", **request,
    )
    assert scan_raw(spark, "hourly", root).count() == 24
    refused = spark.read.parquet(f"{tmp_path}/refused").collect()
    assert [(r.city_id, r.reason) for r in refused] == [("tokyo", "ragged_hourly")]
    assert json.loads(refused[0].document) == changed("hourly", rain=[1.0]) and refused[0].file.endswith("/a.json")
