from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from fixtures import hourly
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from isobar.schema import DAILY, HOURLY
from isobar.sources.drifted import scan_drifted
from isobar.sources.raw import scan_files, scan_raw, write_raw

TIMES = [datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 3, 30)]


def foreign(path, temperature, kind, unit="ns", extra=None, **options):
    columns = {
        "time": pa.array(TIMES, pa.timestamp(unit)),
        "temperature_2m": pa.array(temperature, kind),
        "city_id": pa.array([path.stem] * 2),
        **(extra or {}),
    }
    pq.write_table(pa.table(columns), path, **options)


def test_drifting_types_keep_their_values(spark, tmp_path):
    foreign(tmp_path / "whole.parquet", [1, 2], pa.int64())
    foreign(tmp_path / "fraction.parquet", [1.5, None], pa.float64())
    foreign(tmp_path / "absent.parquet", [None, None], pa.null())
    foreign(tmp_path / "micro.parquet", [7.0, 8.0], pa.float64(), unit="us",
            extra={"weather_code": pa.array([3.0, None]), "surprise": pa.array(["x", "y"])})
    rows = scan_drifted(spark, str(tmp_path), HOURLY)
    assert rows.schema.simpleString() == HOURLY.simpleString()
    found = {(r.city_id, r.time): (r.temperature_2m, r.weather_code) for r in rows.collect()}
    first, second = TIMES
    assert found == {
        ("whole", first): (1.0, None), ("whole", second): (2.0, None),
        ("fraction", first): (1.5, None), ("fraction", second): (None, None),
        ("absent", first): (None, None), ("absent", second): (None, None),
        ("micro", first): (7.0, 3), ("micro", second): (8.0, None),
    }


def test_values_that_a_cast_would_change_are_errors(spark, tmp_path):
    for name, values in (("half", [3.7, 1.0]), ("huge", [5e9, 1.0])):
        foreign(tmp_path / f"{name}.parquet", [1.0, 2.0], pa.float64(), extra={"weather_code": pa.array(values)})
        rows = scan_drifted(spark, f"{tmp_path}/{name}.parquet", HOURLY)
        with pytest.raises(Exception, match=f"weather_code cannot hold .*{name}.parquet"):
            rows.collect()
    pq.write_table(pa.table({"time": pa.array([1], pa.timestamp("ns"))}), tmp_path / "fine.parquet")
    with pytest.raises(Exception, match="time cannot hold 1 of"):
        scan_drifted(spark, f"{tmp_path}/fine.parquet", HOURLY).collect()


def test_other_variables_are_kept_and_columns_pruned(spark, tmp_path):
    foreign(tmp_path / "a.parquet", [1.0, 2.0], pa.float64(), extra={"surprise": pa.array(["x", None])})
    foreign(tmp_path / "b.parquet", [1, 2], pa.int64(), extra={"zoned": pa.array(TIMES, pa.timestamp("us", "UTC"))})
    rows = scan_drifted(spark, str(tmp_path), HOURLY, others=True)
    kept = {(r.city_id, (r.others or {}).get("surprise")) for r in rows.collect()}
    assert kept == {("a", "x"), ("a", None), ("b", None)}
    narrow = scan_drifted(spark, str(tmp_path), HOURLY).select("city_id")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in plan.replace("ReadSchema", "\nReadSchema").splitlines() if line.startswith("ReadSchema")]
    assert len(schemas) == 2 and all("city_id" in s and "temperature_2m" not in s for s in schemas)


def test_each_row_group_is_read_once(spark, tmp_path):
    count = 10_000
    pq.write_table(
        pa.table({"temperature_2m": pa.array(range(count), pa.int64())}),
        tmp_path / "large.parquet", row_group_size=700,
    )
    rows = scan_drifted(spark, str(tmp_path), HOURLY)
    found = rows.agg(F.count("*"), F.sum("temperature_2m"), F.count_distinct("temperature_2m"))
    assert tuple(found.first()) == (count, count * (count - 1) / 2, count)


def test_files_of_a_grain_by_name(spark, tmp_path):
    day = "2026-02-08_2026-02-08_20260208_020000"
    foreign(tmp_path / f"paris_hourly_{day}.parquet", [1.0, 2.0], pa.float64(), unit="us")
    foreign(tmp_path / f"tokyo_hourly_{day}.parquet", [3.0, 4.0], pa.float64(), unit="us")
    rows = scan_files(spark, str(tmp_path), "hourly")
    assert rows.count() == 4 and rows.columns == HOURLY.names
    assert scan_files(spark, str(tmp_path), "daily").count() == 0


def test_daily_files_are_optional_and_hourly_ones_are_not(spark, tmp_path):
    missing = f"{tmp_path}/nowhere"
    daily = scan_raw(spark, "daily", missing)
    assert daily.count() == 0 and daily.schema.simpleString() == DAILY.simpleString()
    with pytest.raises(AnalysisException):
        scan_raw(spark, "hourly", missing)


def batch(spark, batch_id, temperature):
    rows = hourly(spark, [
        {"city_id": c, "time": TIMES[0], "temperature_2m": temperature, "batch_id": batch_id}
        for c in ("paris", "tokyo")
    ])
    return rows.withColumn("grain", F.lit("hourly"))


def test_batches_add_up_or_replace_themselves(spark, tmp_path):
    root = f"{tmp_path}/raw"
    write_raw(batch(spark, "2026-02-08", 1.0), root)
    write_raw(batch(spark, "2026-02-09", 2.0), root)
    # A batch id that looks like a date stays text, and overlapping batches stay.
    rows = scan_raw(spark, "hourly", root)
    assert rows.schema["batch_id"].dataType.simpleString() == "string"
    assert rows.count() == 4
    write_raw(batch(spark, "2026-02-09", 3.0), root)
    assert scan_raw(spark, "hourly", root).count() == 6
    write_raw(batch(spark, "2026-02-09", 9.0), root, replace_batches=True)
    found = scan_raw(spark, "hourly", root).groupBy("batch_id").agg(F.max("temperature_2m"))
    assert {tuple(r) for r in found.collect()} == {("2026-02-08", 1.0), ("2026-02-09", 9.0)}


def test_several_roots(spark, tmp_path):
    write_raw(batch(spark, "a", 1.0), f"{tmp_path}/one")
    write_raw(batch(spark, "b", 1.0), f"{tmp_path}/two")
    assert scan_raw(spark, "hourly", f"{tmp_path}/one", f"{tmp_path}/two").count() == 4


def test_drifted_files_in_a_store_that_only_spark_reads(spark, tmp_path):
    """The scan goes through a view of a folder, whose scheme no other reader knows."""
    pa_table = pa.table({
        "time": pa.array([datetime(2026, 2, 8, 1)], pa.timestamp("ns")), "city_id": ["paris"], "temperature_2m": pa.array([3], pa.int64()),
    })
    pq.write_table(pa_table, f"{tmp_path}/a.parquet")
    pq.write_table(pa_table.set_column(2, "temperature_2m", pa.array([1.5])), f"{tmp_path}/b.parquet")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.drifted.link./in", f"file://{tmp_path}")
    rows = scan_drifted(spark, "viewfs://drifted/in", HOURLY).select("time", "city_id", "temperature_2m")
    assert sorted(map(tuple, rows.collect())) == [(datetime(2026, 2, 8, 1), "paris", 1.5), (datetime(2026, 2, 8, 1), "paris", 3.0)]
    assert spark.conf.get("spark.sql.legacy.parquet.nanosAsLong") == "false"
