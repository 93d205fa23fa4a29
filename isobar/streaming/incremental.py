"""Incremental load: each run takes the landed files that no run has taken yet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from isobar.functions.calendar import utc_wall_clock
from isobar.sources.landing import stream_landing
from isobar.sources.payload import all_rows, enrich, judge, refused


def stamped_by_landing(docs: DataFrame) -> DataFrame:
    """Lineage from the time a document landed. Unlike the clock of the run it
    is the same when a micro-batch is repeated after a failure."""
    landed = utc_wall_clock(F.col("landed_at"))
    digits = F.translate(F.substring(landed.cast("string"), 1, 19), "-: ", "")
    batch = F.concat_ws("_", F.substring(digits, 1, 8), F.substring(digits, 9, 6))
    return docs.withColumn("ingestion_timestamp", landed).withColumn("batch_id", batch)


def _judged(
    spark: SparkSession, landing: str, dimension: DataFrame, form: str, max_files: int | None
) -> DataFrame:
    docs = stream_landing(spark, landing, form, max_files)
    return judge(stamped_by_landing(enrich(docs, dimension)))


def _append(df: DataFrame, path: str, checkpoint: str, *partitions: str) -> StreamingQuery:
    """The checkpoint records which files were taken and the sink's log which
    were written, so each document counts exactly once even if a run is killed."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*partitions)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


@dataclass(frozen=True)
class Load:
    """A running load: the rows, and the record of the documents that gave none."""

    rows: StreamingQuery
    refused: StreamingQuery

    def awaitTermination(self) -> None:  # noqa: N802, as of the queries in it
        self.rows.awaitTermination()
        self.refused.awaitTermination()


def load_new(
    spark: SparkSession,
    landing: str,
    raw_root: str,
    checkpoint: str,
    dimension: DataFrame,
    form: str = "lines",
    on_failure: str = "quarantine",
    max_files: int | None = None,
) -> Load:
    """Start a run that loads what has landed since the last one, then ends.

    Refused documents are recorded by the same run, beside the raw root; a run that
    cannot do that fails.

    ``raw_root`` belongs to this stream alone. Its directories go by grain only:
    batch ids, one per second of landing, stay a column. ``max_files`` bounds a
    micro-batch when a long history is loaded at once.
    """
    judged = _judged(spark, landing, dimension, form, max_files)
    root, state = raw_root.rstrip("/"), checkpoint.rstrip("/")
    refusals = record_refused(spark, landing, f"{root}_refused", f"{state}_refused", dimension, form, max_files)
    return Load(_append(all_rows(judged, on_failure), raw_root, checkpoint, "grain"), refusals)


def record_refused(
    spark: SparkSession,
    landing: str,
    path: str,
    checkpoint: str,
    dimension: DataFrame,
    form: str = "lines",
    max_files: int | None = None,
) -> StreamingQuery:
    """The counterpart of ``load_new``: the documents that gave no rows, and why."""
    judged = _judged(spark, landing, dimension, form, max_files)
    return _append(refused(judged), path, checkpoint, "reason")
