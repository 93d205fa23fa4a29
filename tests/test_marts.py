import statistics
from datetime import datetime, timedelta

import pytest
from fixtures import hourly
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isobar.functions.measures import is_anomaly
from isobar.operators import anomalies as scores
from isobar.operators.daily import daily, daily_from_moments, daily_moments, merged_city_stats
from isobar.operators.staging import staging

START = datetime(2026, 2, 1)  # a Sunday


def series(city, temperatures, precipitation=None, start=START, step=1):
    wet = precipitation or [float(i % 3) for i in range(len(temperatures))]
    return [
        {"city_id": city, "time": start + timedelta(hours=i * step),
         "temperature_2m": t, "precipitation": p}
        for i, (t, p) in enumerate(zip(temperatures, wet))
    ]


def test_sunday_is_day_zero(spark):
    row = staging(hourly(spark, series("paris", [1.0]))).first()
    assert row.day_of_week == 0
    assert (row.year, row.month, row.day, row.hour, row.quarter) == (2026, 2, 1, 0, 1)


def test_fills_and_flags(spark):
    raw = hourly(spark, [{"city_id": "paris", "time": START}])
    row = staging(raw).first()
    assert (row.temperature_2m, row.precipitation, row.pressure_msl) == (0.0, 0.0, 1013.25)
    assert (row.relative_humidity_2m, row.cloud_cover, row.wind_speed_10m) == (0, 0, 0.0)
    assert (row.has_missing_temp, row.has_missing_precip) == (1, 1)
    unfilled = staging(raw, fill=False).first()
    assert unfilled.temperature_2m is None and unfilled.has_missing_temp == 1


def test_times_in_the_gap_of_summer_time_keep_their_hour(spark):
    row = staging(hourly(spark, series("paris", [1.0], start=datetime(2024, 3, 10, 2, 30)))).first()
    assert (row.time, row.hour) == (datetime(2024, 3, 10, 2, 30), 2)


def test_one_row_has_no_deviation_and_a_null_city_keeps_its_day(spark):
    rows = series("paris", [4.0]) + series(None, [1.0, 2.0])
    mart = {r.city_id: r for r in daily(staging(hourly(spark, rows))).collect()}
    assert mart["paris"].temp_stddev is None
    assert mart[None].total_hours == 2


def test_variants_differ_on_constant_and_single_row_cities(spark):
    rows = (
        series("flat", [20.0] * 5)
        + series("single", [3.0])
        + series("varied", [1.0, 2.0, 6.0])
        + series(None, [1.0, 9.0])
    )
    stg = staging(hourly(spark, rows))
    model = scores.anomalies(stg).collect()
    assert {r.city_id for r in model} == {"varied"}
    bootstrap = scores.anomalies(stg, variant="bootstrap").collect()
    assert {r.city_id for r in bootstrap} == {"varied", "flat"}
    assert all(
        r.temp_zscore is None and r.is_temp_anomaly is False
        for r in bootstrap if r.city_id == "flat"
    )
    with pytest.raises(ValueError):
        scores.anomalies(stg, variant="other")


def test_constant_precipitation_gives_a_null_score_and_no_flag(spark):
    stg = staging(hourly(spark, series("paris", [1.0, 2.0, 4.0], [0.5, 0.5, 0.5])))
    rows = scores.anomalies(stg).collect()
    assert len(rows) == 3
    assert all(r.precip_zscore is None and r.is_precip_anomaly is False for r in rows)


def test_threshold_is_strict(spark):
    values = spark.createDataFrame([(3.0,), (-3.0,), (3.0001,), (-3.0001,), (None,)], "z double")
    flags = [r[0] for r in values.select(is_anomaly(F.col("z"))).collect()]
    assert flags == [False, False, True, True, False]


def test_one_extreme_value_is_flagged(spark):
    stg = staging(hourly(spark, series("paris", [10.0 + i % 2 for i in range(40)] + [90.0])))
    flagged = scores.anomalies(stg).where("is_temp_anomaly").collect()
    assert [r.temperature_2m for r in flagged] == [90.0]
    counts = scores.anomaly_counts(scores.anomalies(stg)).first()
    assert (counts.scored_rows, counts.temp_anomalies) == (41, 1)


def test_copies_of_one_row_are_sorted_by_several_tasks(spark):
    row = series("paris", [1.0, 2.0])[0]
    copies = hourly(spark, [row]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4000))))
    marked = copies.repartition(8, "n").select(
        "time", "city_id", "temperature_2m", "precipitation"
    )
    spread = scores.in_time_order(marked).select(F.spark_partition_id().alias("task"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = [r["count"] for r in spread.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(counts) == 4000 and len(counts) > 1


def test_merged_statistics_of_a_constant_that_is_not_a_binary_fraction(spark):
    # Day means of 0.1 differ in their last digit with the number of hours.
    rows = series("flat", [0.1] * 79) + series("single", [0.1]) + series("two", [0.1, 0.3])
    stats = {r.city_id: r for r in merged_city_stats(daily_moments(
        staging(hourly(spark, rows)))).collect()}
    assert stats["flat"].stddev_temp == 0.0
    assert stats["single"].stddev_temp is None
    assert stats["two"].stddev_temp == pytest.approx(statistics.stdev([0.1, 0.3]))


def test_moments_hold_the_daily_mart(spark):
    stg = staging(hourly(spark, series("paris", [float(i) for i in range(60)])))
    for variant in ("model", "bootstrap"):
        one = daily_from_moments(daily_moments(stg), variant)
        assert one.columns == daily(stg, variant).columns
        assert one.exceptAll(daily(stg, variant)).count() == 0


measurement = st.one_of(st.none(), st.floats(-60, 60).map(lambda x: round(x, 1)))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), measurement, measurement),
                min_size=1, max_size=60))
def test_daily_invariants_and_statistics_by_brute_force(spark, readings):
    rows = [
        {"city_id": city, "time": START + timedelta(hours=i), "temperature_2m": t,
         "precipitation": p}
        for i, (city, t, p) in enumerate(readings)
    ]
    stg = staging(hourly(spark, rows))
    mart = daily(stg).collect()
    assert sum(r.total_hours for r in mart) == len(rows)
    for r in mart:
        assert r.hours_with_rain <= r.total_hours
        assert r.temp_min - 1e-9 <= r.temp_avg <= r.temp_max + 1e-9
    direct = {r.city_id: r for r in scores.city_stats(stg).collect()}
    merged = {r.city_id: r for r in merged_city_stats(daily_moments(stg)).collect()}
    for city in direct:
        temperatures = [t or 0.0 for c, t, _ in readings if c == city]
        for stats in (direct[city], merged[city]):
            assert stats.avg_temp == pytest.approx(statistics.fmean(temperatures), abs=1e-9)
            if len(temperatures) == 1:
                assert stats.stddev_temp is None
            else:
                expected = statistics.stdev(temperatures)
                assert stats.stddev_temp == pytest.approx(expected, abs=1e-7)
