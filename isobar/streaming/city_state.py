"""City statistics as streaming state: count, mean, squares around the mean and the newest time.

A row updates the state of its city when it arrives, late or not: moments merge in any order. A city is spread
over ``SLICES`` states by a hash of time, so that one which sends most rows is no single task; the slices
are merged when the statistics are read. What a micro-batch has changed is written to a folder named by its
number, which a repeated micro-batch overwrites.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from isobar.functions.calendar import from_micros, micros

# Python workers get the processor by value and need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICES = 16
MEASURES = {"temp": "temperature_2m", "precip": "precipitation"}

_MOMENTS = ", ".join(f"{m}_n long, {m}_mean double, {m}_squares double, {m}_low double, {m}_high double" for m in MEASURES)
_STATE = f"rows long, high_water long, {_MOMENTS}"
CHANGED = f"city_id string, slice int, {_STATE}"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _joined(a: tuple, b: tuple) -> tuple:
    """The moments (n, mean, squares, low, high) of both sets of values."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, away = a[0] + b[0], b[1] - a[1]
    return n, a[1] + away * b[0] / n, a[2] + b[2] + away * away * a[0] * b[0] / n, min(a[3], b[3]), max(a[4], b[4])


def _of(values: pd.Series) -> tuple:
    values = values.dropna()
    if values.empty:
        return 0, 0.0, 0.0, 0.0, 0.0
    mean = float(values.mean())
    return len(values), mean, float(((values - mean) ** 2).sum()), float(values.min()), float(values.max())


class CityMoments(StatefulProcessor):
    """Merges the rows of a micro-batch into the state of their city and slice."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("moments", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._state.get()
        count, mark, *flat = held if held is not None else (0, None, *[0, 0.0, 0.0, 0.0, 0.0] * len(MEASURES))
        moments = [tuple(flat[i : i + 5]) for i in range(0, len(flat), 5)]
        for part in rows:
            count += len(part)
            times = part["time"].dropna()
            if not times.empty:
                newest = int(times.max())
                mark = newest if mark is None else max(mark, newest)
            moments = [_joined(old, _of(part[m])) for old, m in zip(moments, MEASURES)]
        values = (count, mark, *[v for m in moments for v in m])
        self._state.update(values)
        yield pd.DataFrame([(*key, *values)], columns=[c.split()[0] for c in CHANGED.split(", ")]).astype({"high_water": "Int64"})

    def close(self) -> None:
        pass


def keep_city_state(stg: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Start a run that brings the state up to date with the staged rows of a stream, then ends.

    The state lies in ``checkpoint`` and survives runs; what each micro-batch changed lies under ``root``.
    """
    spark = stg.sparkSession
    rows = stg.select(
        "city_id", F.pmod(F.xxhash64("time"), F.lit(SLICES)).cast("int").alias("slice"), micros(F.col("time")).alias("time"),
        *[F.col(c).alias(m) for m, c in MEASURES.items()],
    )
    changed = rows.groupBy("city_id", "slice").transformWithStateInPandas(
        statefulProcessor=CityMoments(), outputStructType=CHANGED, outputMode="Update", timeMode="None"
    )

    def write(batch: DataFrame, load: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root.rstrip('/')}/load={load}")

    # State of this kind needs this store; a query keeps the setting it was started with.
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return (
            changed.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def city_state(spark: SparkSession, root: str) -> DataFrame:
    """Per city: rows, high_water, avg_temp, stddev_temp, avg_precip, stddev_precip, of all rows so far."""
    try:
        written = spark.read.schema(f"{CHANGED}, load long").parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        written = spark.createDataFrame([], f"{CHANGED}, load long")
    names = [c.split()[0] for c in _STATE.split(", ")]
    newest = written.groupBy("city_id", "slice").agg(F.max_by(F.struct(*names), "load").alias("state")).select("city_id", "state.*")
    parts = newest.groupBy("city_id").agg(F.collect_list(F.struct(*names)).alias("slices"))  # at most SLICES

    def total(name: str) -> Column:
        return F.aggregate("slices", F.lit(0).cast("long"), lambda sum_, s: sum_ + s[name])

    def mean(m: str) -> Column:
        weighed = F.aggregate("slices", F.lit(0.0), lambda sum_, s: sum_ + s[f"{m}_n"] * s[f"{m}_mean"])
        return weighed / F.nullif(total(f"{m}_n"), F.lit(0))

    def spread(m: str) -> Column:
        around = F.aggregate("slices", F.lit(0.0), lambda sum_, s: sum_ + s[f"{m}_squares"] + s[f"{m}_n"] * F.pow(s[f"{m}_mean"] - F.col(f"avg_{m}"), F.lit(2.0)))
        held = F.filter("slices", lambda s: s[f"{m}_n"] > 0)
        constant = F.array_min(F.transform(held, lambda s: s[f"{m}_low"])) == F.array_max(F.transform(held, lambda s: s[f"{m}_high"]))
        n = total(f"{m}_n")
        return F.when(n > 1, F.when(constant, F.lit(0.0)).otherwise(F.sqrt(around / (n - 1)))).alias(f"stddev_{m}")

    newest_time = F.array_max(F.transform("slices", lambda s: s["high_water"]))
    return parts.withColumns({f"avg_{m}": mean(m) for m in MEASURES}).select(
        "city_id", total("rows").alias("rows"),
        from_micros(newest_time).alias("high_water"),
        "avg_temp", spread("temp"), "avg_precip", spread("precip"),
    )
