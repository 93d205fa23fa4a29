"""Streaming state, unique streamed rows, and what is checked or compared without reading the history."""

import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from fixtures import document, hourly, land
from pyspark.sql import functions as F

from isobar.operators import gaps, quality, sketches, snapshots
from isobar.operators.staging import staging
from isobar.plans import keys
from isobar.plans.tables import Layers
from isobar.schema import HOURLY
from isobar.sources import variables
from isobar.sources.landing import scan_documents
from isobar.streaming.city_state import city_state, keep_city_state
from isobar.streaming.quality import Recorder, recorded_once, watched
from isobar.streaming.unique import keep_unique, too_late, unique_rows

START = datetime(2026, 2, 1)


def rows_of(spark, cells):
    """cells: (city, hours after START or None, temperature)"""
    return hourly(spark, [
        {"city_id": c, "time": None if h is None else START + timedelta(hours=h), "temperature_2m": t, "precipitation": 0.5}
        for c, h, t in cells
    ])


@pytest.fixture
def layers(spark, tmp_path):
    made = Layers(spark, f"{tmp_path}/layers", f"t{random.randrange(10**9)}_").create()
    yield made
    for layer in ("raw", "staging", "mart", "state"):
        spark.sql(f"DROP DATABASE IF EXISTS {made.prefix}{layer} CASCADE")


@pytest.mark.parametrize("seed", [1, 2])
def test_state_of_any_split_equals_the_batch_statistics(spark, tmp_path, seed):
    rng = random.Random(seed)
    cells = [(rng.choice(["paris", "tokyo", None]), rng.choice([None, *range(200)]), rng.choice([None, rng.gauss(1e5, 3)])) for _ in range(60)]
    cells += [("still", h, 0.1) for h in range(7)] + [("one", 3, 1.0), ("none", 4, None)]
    rng.shuffle(cells)
    path = f"{tmp_path}/files"
    for i in range(2):
        rows_of(spark, cells[i::2]).write.mode("append").parquet(path)
        stream = staging(spark.readStream.schema(HOURLY).parquet(path), False)
        for _ in range(2 - i):  # a run without anything new changes nothing
            keep_city_state(stream, f"{tmp_path}/states", f"{tmp_path}/state").awaitTermination()
    found = {r.city_id: r for r in city_state(spark, f"{tmp_path}/states").collect()}
    assert set(found) == {c for c, _, _ in cells}
    for city, row in found.items():
        own = [(h, t) for c, h, t in cells if c == city]
        values, hours = [t for _, t in own if t is not None], [h for h, _ in own if h is not None]
        assert row.rows == len(own)
        assert row.high_water == (START + timedelta(hours=max(hours)) if hours else None)
        assert row.avg_temp == (pytest.approx(statistics.mean(values)) if values else None)
        assert row.stddev_temp == (pytest.approx(statistics.stdev(values), rel=1e-6, abs=0) if len(values) > 1 else None)
    assert found["still"].stddev_temp == found["still"].stddev_precip == 0.0


def test_state_of_nothing(spark, tmp_path):
    assert city_state(spark, f"{tmp_path}/states").count() == 0


def test_unique_rows_and_late_ones(spark, tmp_path):
    arrivals = [
        [("paris", 100, 1.0), ("paris", 90, 2.0), ("tokyo", 99, 3.0), ("paris", None, 4.0), ("paris", None, 4.0), (None, 50, 5.0)],
        # A copy, a new row within the lateness, one behind it, a copy behind it.
        [("paris", 100, 9.0), ("paris", 95, 6.0), ("paris", 80, 7.0), ("tokyo", 120, 8.0)],
        [("paris", 90, 9.0), ("paris", 115, 10.0), ("paris", 109, 11.0), ("paris", 200, 12.0), ("paris", 200, 12.0)],
    ]
    path, root = f"{tmp_path}/files", f"{tmp_path}/unique"
    for cells in arrivals:
        rows_of(spark, cells).write.mode("append").parquet(path)
        keep_unique(spark.readStream.schema(HOURLY).parquet(path), root, f"{tmp_path}/state", "10 hours").awaitTermination()
    taken = unique_rows(spark, root, HOURLY)
    found = sorted(r.temperature_2m for r in taken.collect())
    assert found == [1.0, 2.0, 3.0, 4.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0]
    late = too_late(spark.read.schema(HOURLY).parquet(path), taken, "10 hours")
    assert sorted(r.temperature_2m for r in late.collect()) == [7.0, 11.0]
    assert unique_rows(spark, f"{tmp_path}/nothing", HOURLY).count() == 0
    assert too_late(taken, taken.where("false"), "10 hours").count() == 0


def test_gaps(spark):
    cells = [("paris", h, 1.0) for h in (0, 0, 1, 5, 23, 24, 100, 100)] + [("tokyo", 7, 1.0), ("paris", None, 1.0), (None, 3, 1.0), (None, 30, 1.0)]
    rows = rows_of(spark, cells)
    hour = lambda h: START + timedelta(hours=h)
    assert {tuple(r) for r in gaps.missing_intervals(rows).collect()} == {
        ("paris", hour(2), hour(4), 3), ("paris", hour(6), hour(22), 17), ("paris", hour(25), hour(99), 75), (None, hour(4), hour(29), 26),
    }
    assert {tuple(r) for r in gaps.coverage_of_hours(rows).collect()} == {
        ("paris", hour(0), hour(100), 6, 95, 3, 75), ("tokyo", hour(7), hour(7), 1, 0, 0, 0), (None, hour(3), hour(30), 2, 26, 1, 26),
    }
    assert gaps.coverage_of_hours(rows.where("false")).count() == gaps.missing_intervals(rows.where("false")).count() == 0


def test_gaps_before_1970(spark):
    rows = hourly(spark, [{"city_id": "paris", "time": datetime(1969, 12, 31, h, 30)} for h in (20, 23)])
    (row,) = gaps.missing_intervals(rows).collect()
    assert tuple(row) == ("paris", datetime(1969, 12, 31, 21), datetime(1969, 12, 31, 22), 2)


def test_sketches_merge_over_days(spark):
    stg = staging(rows_of(spark, [("paris", h, float(h)) for h in range(300)] + [("tokyo", 1, None)] * 3), False)
    daily = sketches.daily_sketches(stg, ["time"], ["temperature_2m"])
    assert daily.count() == 14
    estimate = {r.city_id: r.distinct_values for r in sketches.distinct_values(daily, "time", "city_id").collect()}
    assert estimate["tokyo"] == 1 and abs(estimate["paris"] - 300) <= 300 * sketches.distinct_error()
    found = {r.city_id: r for r in sketches.quantiles(daily, "temperature_2m", [0.0, 0.5, 1.0], "city_id").collect()}
    assert (found["paris"].n, found["paris"].q0, found["paris"].q2) == (300, 0.0, 299.0) and abs(found["paris"].q1 - 149.5) < 6
    assert (found["tokyo"].n, found["tokyo"].q1) == (0, None)
    bounds = sketches.limits(daily, "temperature_2m", 0.0, "city_id")
    (row,) = sketches.outside(stg.where("city_id = 'paris'"), bounds, "temperature_2m").collect()
    assert abs(row.failures - 150) < 10 and row.failures + row.passed == 300


def test_stored_snapshots_read_only_days_that_differ(spark, tmp_path):
    cells = [(c, h, 1.0) for c in ("paris", "tokyo") for h in range(24 * 6)] + [(None, 3, 1.0), ("paris", None, 1.0)]
    other = [c for c in cells if c[1] != 30] + [("paris", 30, 2.0)] + [("rome", 50, 1.0), ("paris", None, 3.0)]
    columns = ["temperature_2m"]
    for name, rows in (("old", cells), ("new", other)):
        snapshots.store_snapshot(rows_of(spark, rows), f"{tmp_path}/{name}", columns)
    paths = f"{tmp_path}/old", f"{tmp_path}/new"
    days = {tuple(r) for r in snapshots.changed_days(spark, *paths).collect()}
    assert days == {("paris", date(2026, 2, 2)), ("tokyo", date(2026, 2, 2)), ("rome", date(2026, 2, 3)), ("paris", None)}
    diff = snapshots.stored_diff(spark, *paths, columns)
    at = lambda h: START + timedelta(hours=h)
    assert {tuple(r) for r in diff.collect()} == {
        ("paris", at(30), "changed"), ("tokyo", at(30), "removed"), ("rome", at(50), "added"), ("paris", None, "changed"),
    }
    plan = diff._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line and "2026-02-02" in line]
    assert len(filters) >= 2 and "2026-02-05" not in plan


def test_variables_beyond_the_lists(spark, tmp_path):
    extra = document("2026-02-08")
    extra["hourly"] |= {"pollen": [{"kind": "birch", "n": i} for i in range(24)], "note": ["a", 1.5, None], "flag": "no array"}
    land(tmp_path, "paris", "2026-02-08", extra)
    land(tmp_path, "tokyo", "2026-02-08", document("2026-02-08"))
    land(tmp_path, "london", "2026-02-08", '{"hourly": ')
    land(tmp_path, "amsterdam", "2026-02-08", document("2026-02-08", hourly=None))
    readings = variables.extra_variables(scan_documents(spark, str(tmp_path)))
    assert readings.count() == 24
    schema = {r.variable: (r.type, r.readings) for r in variables.merged_schema(readings).collect()}
    assert schema["pollen"] == ("OBJECT<kind: STRING, n: BIGINT>", 24) and schema["note"] == ("VARIANT", 2) and set(schema) == {"pollen", "note"}
    columns = {"n": ("$.pollen.n", "int"), "kind": ("$.pollen.kind", "string"), "note": ("$.note", "double"), "none": ("$.x.y", "int")}
    first, second, third, *_ = sorted(variables.typed(readings, columns).collect(), key=lambda r: r.time)
    assert (first.n, first.kind, first.note, first.none) == (0, "birch", None, None)
    assert (second.n, second.note, third.note) == (1, 1.5, None) and first.time == datetime(2026, 2, 8)


def test_keys_are_checked_batch_by_batch(spark, layers):
    batches = {
        "a": [("paris", 1, 1.0), ("paris", 2, 1.0), ("paris", 2, 2.0), ("paris", None, 1.0), ("paris", None, 1.0)],
        "b": [("paris", 1, 5.0), ("tokyo", 1, 1.0), ("paris", 2, 1.0)],
        "c": [("paris", 1, 5.0)],
    }
    found = {}
    for name in ("a", "b", "b", "c"):
        new = keys.check_batch(layers, rows_of(spark, batches[name]), snapshots.KEY, name, buckets=3)
        found[name] = {(r.city_id, r.time.hour, r.before, r.in_batch) for r in new.collect()}
    assert found == {"a": {("paris", 2, 0, 2)}, "b": {("paris", 1, 1, 1)}, "c": set()}
    everything = rows_of(spark, [c for cells in batches.values() for c in cells])
    known = keys.known_keys(layers, snapshots.KEY).where("copies > 1").select("city_id", "time", "copies")
    assert {tuple(r) for r in known.collect()} == {tuple(r) for r in quality.duplicates(everything, snapshots.KEY).select("city_id", "time", "copies").collect()}


def test_known_keys_are_not_moved(spark, layers):
    for name in ("a", "b"):
        new = keys.check_batch(layers, rows_of(spark, [("paris", 1, 1.0)]), snapshots.KEY, name, buckets=7)
    assert "Exchange" not in new._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in keys.known_keys(layers, snapshots.KEY)._jdf.queryExecution().executedPlan().toString()


def test_results_of_a_stream_are_recorded_by_batch(spark, layers, tmp_path):
    path, root, state = (f"{tmp_path}/{n}" for n in ("files", "raw", "state"))
    checks = quality.not_null(["time", "city_id"]) + quality.value_range({"temperature_2m": (0.0, 10.0)})
    recorder = Recorder(layers)
    spark.streams.addListener(recorder)
    try:
        for cells in ([("paris", 1, 1.0), (None, 2, 11.0)], [("paris", None, -1.0), ("paris", None, None)], []):
            if cells:
                rows_of(spark, cells).write.mode("append").parquet(path)
            passing = watched(spark.readStream.schema(HOURLY).parquet(path), "raw.weather_hourly", checks)
            query = passing.writeStream.format("parquet").option("path", root).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination()
            recorder.wait(query)
    finally:
        spark.streams.removeListener(recorder)
    assert not recorder.errors and spark.read.parquet(root).count() == 4
    batches = {}
    for r in layers.table("mart.dq_results").collect():
        batches.setdefault(r.run_id.rsplit("_", 1)[1], {})[r.check_name, r.column_name] = r.failures
    keys_ = [("not_null", "time"), ("not_null", "city_id"), ("range", "temperature_2m")]
    assert batches == {"0": dict(zip(keys_, (0, 1, 1))), "1": dict(zip(keys_, (2, 0, 1)))}
    # The same progress heard again counts once.
    again = layers.table("mart.dq_results").where("run_id LIKE '%_1'").collect()
    recorder._append([tuple(r) for r in again])
    assert recorded_once(layers).count() == 6 and layers.table("mart.dq_results").count() == 9
