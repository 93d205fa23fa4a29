import random
from datetime import datetime, timedelta

import pytest
from fixtures import hourly
from pyspark.sql import functions as F

from isobar.operators import quality, snapshots
from isobar.operators.staging import staging

START = datetime(2026, 2, 8)


def rows_of(seed, count=300):
    chance = random.Random(seed)
    return [
        {
            "city_id": chance.choice(["paris", "tokyo", None]),
            "time": chance.choice([None] + [START + timedelta(hours=h) for h in range(20)]),
            "temperature_2m": chance.choice([None, 1.0, 2.0, 3.0]),
            "precipitation": chance.choice([0.0, 0.5]),
            "ingestion_timestamp": START + timedelta(days=chance.randrange(3)),
            "batch_id": chance.choice(["a", "b"]),
        }
        for _ in range(count)
    ]


@pytest.fixture(params=["10m", "-1"])
def broadcasts(request, spark):
    """With joins as the planner likes them, and without any broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_newest_rows_by_brute_force(spark, broadcasts):
    rows = rows_of(1)
    found = snapshots.latest_rows(hourly(spark, rows)).collect()
    unkeyed = [r for r in rows if r["city_id"] is None or r["time"] is None]
    best = {}
    for r in rows:
        if r in unkeyed:
            continue
        key = (r["city_id"], r["time"])
        best[key] = max(best.get(key, ("", "")), (str(r["ingestion_timestamp"]), r["batch_id"]))
    kept = {
        (r.city_id, r.time): (str(r.ingestion_timestamp), r.batch_id)
        for r in found if r.city_id is not None and r.time is not None
    }
    assert kept == best
    assert len(found) == len(best) + len(unkeyed)


def test_the_order_of_rows_does_not_matter(spark):
    raw = hourly(spark, rows_of(2))
    one = snapshots.latest_rows(raw)
    other = snapshots.latest_rows(raw.repartition(7, "precipitation"))
    assert one.exceptAll(other).count() == other.exceptAll(one).count() == 0


def test_a_key_of_very_many_copies(spark):
    raw = hourly(spark, [{"city_id": "paris", "time": START, "temperature_2m": 1.0}])
    numbers = F.explode(F.sequence(F.lit(0), F.lit(19_999)))
    numbered = raw.withColumn("n", numbers)
    copies = numbered.withColumn("temperature_2m", F.col("n").cast("double")).drop("n")
    assert [r.temperature_2m for r in snapshots.latest_rows(copies).collect()] == [19_999.0]
    found = quality.duplicates(copies, ["city_id", "time"]).first()
    assert found.copies == 20_000


def test_rows_beyond_the_mark(spark):
    old = [{"city_id": "paris", "time": START + timedelta(hours=h)} for h in range(3)]
    more = [{"city_id": "paris", "time": START + timedelta(hours=h)} for h in range(5)]
    other = [{"city_id": "tokyo", "time": START}]
    marks = snapshots.high_water(hourly(spark, old))
    fresh = snapshots.newer_than(hourly(spark, more + other), marks)
    found = {(r.city_id, r.time.hour) for r in fresh.collect()}
    assert found == {("paris", 3), ("paris", 4), ("tokyo", 0)}


def test_marks_are_carried_forward_and_bound_the_scan(spark, tmp_path):
    def rows(city, hours):
        return [{"city_id": city, "time": START + timedelta(hours=h)} for h in hours]

    marks = snapshots.high_water(hourly(spark, rows("paris", range(3)) + rows("tokyo", range(5))))
    marks = snapshots.merged_marks(marks, hourly(spark, rows("paris", range(2, 5)) + rows("rome", [1])))
    assert {(r.city_id, r.high_water.hour) for r in marks.collect()} == {("paris", 4), ("tokyo", 4), ("rome", 1)}
    table = rows("paris", range(6)) + rows("tokyo", range(6)) + rows("rome", range(3)) + rows(None, [0])
    hourly(spark, table).write.parquet(f"{tmp_path}/rows")
    fresh = snapshots.newer_than(spark.read.parquet(f"{tmp_path}/rows"), marks, all_marked=True)
    found = {(r.city_id, r.time.hour) for r in fresh.collect()}
    assert found == {("paris", 5), ("tokyo", 5), ("rome", 2), (None, 0)}
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(time" in plan.split("PushedFilters", 1)[1]


def test_copies_are_compared_as_multisets(spark):
    def rows(batch, hour, values):
        return [{"city_id": "paris", "time": START + timedelta(hours=hour), "batch_id": batch,
                 "temperature_2m": t, "precipitation": p} for t, p in values]

    table = hourly(spark, [
        *rows("a", 0, [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]), *rows("b", 0, [(1.0, 0.0), (2.5, 0.0), (3.0, 0.0)]),
        *rows("a", 1, [(None, 0.0), (5.0, 0.0)]), *rows("b", 1, [(5.0, 0.0), (5.0, 0.0)]),
        *rows("a", 2, [(None, 5.0)]), *rows("b", 2, [(5.0, None)]),
        *rows("a", 3, [(1.0, 0.0), (None, 2.0)]), *rows("b", 3, [(None, 2.0), (1.0, 0.0)]),
    ])
    diff = snapshots.snapshot_diff(
        table, F.col("batch_id") == "a", F.col("batch_id") == "b", ["temperature_2m", "precipitation"]
    )
    assert {r.time.hour: r.status for r in diff.collect()} == {0: "changed", 1: "changed", 2: "changed"}


def test_differences_between_batches(spark):
    def row(hour, batch, temperature):
        return {"city_id": "paris", "time": START + timedelta(hours=hour), "batch_id": batch,
                "temperature_2m": temperature, "precipitation": 0.0}

    rows = hourly(spark, [
        row(0, "a", 1.0), row(0, "b", 1.0),        # the same
        row(1, "a", 1.0), row(1, "b", 2.0),        # another value
        row(2, "a", None), row(2, "b", 2.0),       # a gap filled
        row(3, "a", None), row(3, "b", None),      # still a gap
        row(4, "a", 1.0), row(5, "b", 1.0),        # gone, new
        row(6, "a", 1.0), row(6, "b", 1.0), row(6, "b", 1.0),  # a copy more
        row(7, "c", 1.0),                          # in neither snapshot
    ])
    in_old, in_new = F.col("batch_id") == "a", F.col("batch_id") == "b"
    columns = ["temperature_2m", "precipitation"]
    diff = snapshots.snapshot_diff(rows, in_old, in_new, columns)
    found = {r.time.hour: r.status for r in diff.collect()}
    assert found == {1: "changed", 2: "changed", 4: "removed", 5: "added", 6: "changed"}
    counts = {r.status: r["keys"] for r in snapshots.diff_counts(diff).collect()}
    assert counts == {"changed": 3, "removed": 1, "added": 1}


@pytest.mark.parametrize("seed", [3, 4])
def test_differences_by_brute_force(spark, seed):
    chance = random.Random(seed)

    def side():
        hours = [h for h in range(200) if chance.random() < 0.8]
        values = [None, 1.0, 2.0]
        return {h: (chance.choice(values), chance.choice(values)) for h in hours}

    sides = {"a": side(), "b": side()}
    rows = hourly(spark, [
        {"city_id": "paris", "time": START + timedelta(hours=h), "batch_id": batch,
         "temperature_2m": t, "precipitation": p}
        for batch, readings in sides.items() for h, (t, p) in readings.items()
    ])
    diff = snapshots.snapshot_diff(
        rows, F.col("batch_id") == "a", F.col("batch_id") == "b",
        ["temperature_2m", "precipitation"],
    )
    expected = {}
    for h in set(sides["a"]) | set(sides["b"]):
        old, new = sides["a"].get(h), sides["b"].get(h)
        if old != new:
            status = "added" if old is None else "removed" if new is None else "changed"
            expected[START + timedelta(hours=h)] = status
    assert {r.time: r.status for r in diff.collect()} == expected


def test_checks_find_faults_and_skip_null_keys(spark):
    raw = hourly(spark, [
        {"city_id": "paris", "time": START, "temperature_2m": 50.0},
        {"city_id": "paris", "time": START, "temperature_2m": None},
        {"city_id": None, "time": START},
        {"city_id": None, "time": START},
        {"city_id": "rome", "time": None, "city_name": None},
    ])
    stg = staging(raw)

    def failures(results):
        return {(r.check_name, r.column_name): r.failures for r in results.collect()}

    columns = ["time", "city_id", "city_name", "temperature_2m"]
    checks = quality.not_null(columns) + quality.filled_gaps()
    checks += quality.value_range({"temperature_2m": (-40.0, 45.0)})
    assert failures(quality.tally(stg, "staging.stg_weather", checks)) == {
        ("not_null", "time"): 1, ("not_null", "city_id"): 2, ("not_null", "city_name"): 1,
        ("not_null", "temperature_2m"): 0, ("filled", "temperature_2m"): 4,
        ("filled", "precipitation"): 5, ("range", "temperature_2m"): 1,
    }
    keys = ["time", "city_id"]
    assert failures(quality.unique(stg, "t", keys)) == {("unique", "time,city_id"): 1}
    known = raw.where("city_id = 'paris'")
    assert failures(quality.relationships(stg, known, "t", "city_id")) == {
        ("relationships", "city_id"): 1
    }
    assert failures(quality.relationships(stg, raw, "t", "city_id")) == {
        ("relationships", "city_id"): 0
    }


def test_checks_of_an_empty_table(spark):
    stg = staging(hourly(spark, []))
    checks = quality.not_null(["time"]) + quality.filled_gaps()
    assert {r.failures for r in quality.tally(stg, "t", checks).collect()} == {0}
    assert quality.unique(stg, "t", ["time", "city_id"]).first().failures == 0
