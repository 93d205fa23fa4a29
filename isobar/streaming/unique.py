"""Overlapping streamed batches without copies: one row per city and time, and what came too late.

A key is remembered until the watermark has passed it: the newest time of earlier micro-batches less the
lateness. A row at or below the watermark is not taken, be it a copy or new; new ones are recorded. So the state holds
the keys of the lateness and no more, and no two rows of a key are ever taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from isobar.functions.calendar import micros
from isobar.operators.snapshots import KEY

_EVENT = "_event_time"


def _keyed() -> Column:
    return reduce(Column.__and__, [F.col(k).isNotNull() for k in KEY])


def keep_unique(rows: DataFrame, root: str, checkpoint: str, lateness: str) -> StreamingQuery:
    """Start a run that writes new keys of the stream ``rows`` under ``root``, then ends.

    Of copies the first to arrive is taken. Rows without a full key cannot be copies of one another; all are
    taken. Each micro-batch has a folder that its repetition overwrites.
    """
    # Watermarks are kept on instants; as instants of UTC the zone-less times keep their order and distances.
    event = F.timestamp_micros(micros(F.col("time")))
    unique = (
        rows.where(_keyed()).withColumn(_EVENT, event).withWatermark(_EVENT, lateness)
        .dropDuplicatesWithinWatermark(KEY).drop(_EVENT)
    )
    taken = unique.unionByName(rows.where(~_keyed()))

    def write(batch: DataFrame, load: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root.rstrip('/')}/load={load}")

    return (
        taken.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def unique_rows(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The rows that ``keep_unique`` has taken so far."""
    try:
        return spark.read.schema(StructType([*schema.fields, StructField("load", LongType())])).parquet(root).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def too_late(arrived: DataFrame, taken: DataFrame, lateness: str) -> DataFrame:
    """Rows of ``arrived``, all that has come, whose key was not taken: they were new and came too late.

    No row newer than the newest one less the lateness can be late, which bounds the scan of both sides.
    """
    newest = taken.agg(F.max("time")).first()[0]
    if newest is None:
        return arrived.where("false")
    bound = F.col("time") <= F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {lateness}")
    known = taken.where(bound).select(*KEY)
    return arrived.where(bound & _keyed()).join(known, KEY, "left_anti").select(*arrived.columns)
