"""Loads: each document once, whatever breaks off in between."""

import json
import os
from datetime import datetime

import pytest
from fixtures import document, hourly, land
from pyspark.errors import StreamingQueryException

from isobar.operators import daily as days
from isobar.operators.partials import combine, moments, partials
from isobar.operators.staging import staging
from isobar.sources.cities import cities
from isobar.streaming.loads import Store, load_exactly_once, replay

DAY = "2026-02-08"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/loads")


def load(spark, store, tmp_path, dimension=None, **options):
    known = cities(spark) if dimension is None else dimension
    load_exactly_once(store, f"{tmp_path}/landing", f"{tmp_path}/state", known, **options).awaitTermination()


def ledger(store):
    return sorted(tuple(r) for r in store.ledger().select("load", "documents", "refused", "hourly", "daily").collect())


def test_an_empty_store(store):
    assert store.rows("hourly").count() == store.refused().count() == store.pending().count() == 0
    store.fold()
    assert store.daily_moments().count() == 0


def test_rows_and_refusals_of_one_pass(spark, store, tmp_path):
    land(tmp_path / "landing", "paris", DAY, document(DAY, days=2), last="2026-02-09")
    land(tmp_path / "landing", "tokyo", DAY, document(DAY, daily=None))
    land(tmp_path / "landing", "atlantis", DAY, document(DAY))
    land(tmp_path / "landing", "london", DAY, '{"broken": ')
    load(spark, store, tmp_path)
    assert ledger(store) == [(0, 4, 3, 48, 2)]
    refused = {r.city_id: r for r in store.refused().collect()}
    assert {c: r.reason for c, r in refused.items()} == {"tokyo": "missing_daily", "atlantis": "unknown_city", "london": "malformed_json"}
    assert refused["london"].document == '{"broken": ' and json.loads(refused["atlantis"].document) == document(DAY)
    assert refused["tokyo"].file.endswith("city_id=tokyo/start_date=2026-02-08/end_date=2026-02-08/a.json")
    load(spark, store, tmp_path)
    assert ledger(store) == [(0, 4, 3, 48, 2)]


@pytest.mark.parametrize("form", ["lines", "documents"])
def test_a_load_without_rows(spark, store, tmp_path, form):
    land(tmp_path / "landing", "tokyo", DAY, json.dumps(document(DAY, hourly=None), indent=2 if form == "documents" else None) + "\n\n")
    load(spark, store, tmp_path, form=form)
    assert ledger(store) == [(0, 1, 1, 0, 0)]
    assert store.rows("hourly").count() == store.daily_moments().count() == 0


@pytest.mark.parametrize("moment", ["before the rows", "after the rows"])
def test_a_load_that_broke_off_is_not_seen_and_comes_again(spark, store, tmp_path, monkeypatch, moment):
    land(tmp_path / "landing", "paris", DAY, document(DAY))
    load(spark, store, tmp_path)
    land(tmp_path / "landing", "paris", "2026-02-09", document("2026-02-09"))

    def fail(*_):
        raise RuntimeError(moment)

    with monkeypatch.context() as patch:
        if moment == "before the rows":
            patch.setattr("isobar.streaming.loads._written", fail)
        with pytest.raises(StreamingQueryException):
            load(spark, store, tmp_path, on_written=fail)
    assert store.rows("hourly").count() == 24 and store.daily_moments().count() == 1
    if moment == "after the rows":
        assert os.path.isdir(store.folder("rows", 1))
    load(spark, store, tmp_path)
    assert ledger(store) == [(0, 1, 0, 24, 1), (1, 1, 0, 24, 1)]
    assert store.rows("hourly").count() == 48 and store.daily_moments().count() == 2


def test_a_failing_document_stops_the_run_and_leaves_nothing(spark, store, tmp_path):
    land(tmp_path / "landing", "paris", DAY, document(DAY))
    ragged = document(DAY)
    ragged["hourly"]["rain"] = [1.0]
    land(tmp_path / "landing", "tokyo", DAY, ragged)
    with pytest.raises(StreamingQueryException, match="cannot be read as rows"):
        load(spark, store, tmp_path, on_failure="fail")
    assert ledger(store) == [] and store.rows("hourly").count() == 0
    load(spark, store, tmp_path)
    assert ledger(store) == [(0, 2, 1, 24, 1)]


def test_folds_may_be_repeated_and_mixed_with_loads(spark, store, tmp_path):
    expected = 0
    for i in range(4):
        land(tmp_path / "landing", "paris", DAY, document(DAY), name=f"file{i}")
        load(spark, store, tmp_path)
        expected += 24
        (row,) = store.daily_moments().collect()
        assert row.total_hours == row.temp_n == expected and row.temp_avg == pytest.approx(11.5)
        if i % 2:
            store.fold()
            store.fold()
    folded = spark.read.parquet(store.folder("folded", 3))
    assert folded.count() == 1 and folded.first().total_hours == 96


def test_replays_take_each_document_once(spark, store, tmp_path):
    known = cities(spark).where("city_id = 'paris'")
    twice = json.dumps(document(DAY)) + "\n" + json.dumps(document(DAY))
    land(tmp_path / "landing", "paris", DAY, document(DAY))
    land(tmp_path / "landing", "tokyo", DAY, twice)
    land(tmp_path / "landing", "london", DAY, document(DAY, daily=None))
    load(spark, store, tmp_path, known)
    assert ledger(store) == [(0, 4, 3, 24, 1)] and replay(store, known) == 0

    def fail(*_):
        raise RuntimeError("between write and commit")

    with pytest.raises(RuntimeError):
        replay(store, cities(spark), on_written=fail)
    assert store.rows("hourly").count() == 24 and store.pending().count() == 3
    assert replay(store, cities(spark)) == 2
    assert replay(store, cities(spark)) == 0
    assert ledger(store) == [(-1, 2, 0, 48, 2), (0, 4, 3, 24, 1)]
    # The reason is the one of the load: london was not known either.
    assert [(r.city_id, r.reason) for r in store.pending().collect()] == [("london", "unknown_city")]
    # A city refused later than the replay is taken by the next one.
    land(tmp_path / "landing", "amsterdam", DAY, document(DAY))
    load(spark, store, tmp_path, known)
    assert replay(store, cities(spark)) == 1
    assert store.rows("hourly").count() == 96 and store.daily_moments().agg({"total_hours": "sum"}).first()[0] == 96
    replayed = store.rows("hourly").where("city_id = 'tokyo'").select("batch_id").distinct().count()
    assert replayed == 1  # lineage is the time of landing, as in a load


def test_partials_of_any_parts_equal_the_moments_of_all_rows(spark):
    times = [f"2026-02-0{d} {h:02}:00:00" for d in (7, 8) for h in range(24)]
    values = [(None if i % 7 == 0 else 1e6 + i / 3, 0.1 if i < 24 else i / 7) for i in range(48)]
    rows = [
        {"time": None if i == 5 else t, "city_id": None if i % 11 == 0 else "paris", "temperature_2m": x, "precipitation": p, "wind_speed_10m": 1.0}
        for i, (t, (x, p)) in enumerate(zip(times, values))
    ]
    frame = hourly(spark, [r | {"time": r["time"] and datetime.fromisoformat(r["time"])} for r in rows])
    for fill in (True, False):
        stg = staging(frame, fill)
        whole = days.daily_moments(stg)
        for n in (1, 3):
            parts = None
            for i in range(n):
                one = partials(stg.where(f"pmod(xxhash64(time, temperature_2m, precipitation), {n}) = {i}"))
                parts = one if parts is None else parts.unionByName(one)
            made = moments(combine(parts))
            assert sorted(made.columns) == sorted(whole.columns)
            key = lambda r: (str(r.city_id), str(r.date))
            for a, b in zip(sorted(made.collect(), key=key), sorted(whole.collect(), key=key), strict=True):
                for name in whole.columns:
                    assert a[name] == (pytest.approx(b[name], abs=1e-7) if isinstance(b[name], float) else b[name]), name
