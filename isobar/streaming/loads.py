"""Loads: every micro-batch of landed documents taken exactly once, with all that follows from it.

One pass over a micro-batch parses and judges each document and writes, in one job, its hourly and daily rows,
or the refused document itself with its reason. From the rows come the load's daily partials. Last, one row in
the ledger says that the load is complete. Everything lies in folders named by the number of the load,
which a repeated delivery overwrites, and readers take the loads of the ledger alone. So a load that broke off
anywhere is not seen, and one that was written but not committed by the stream replaces itself.

Refused documents can be replayed when the reason is gone, for instance when the dimension has grown. A replay
is a load as well, with a number below zero: it brings the rows of the documents it could take, and a mark for
each of them, by which the next replay leaves them out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from isobar.operators.partials import combine, moments, partials
from isobar.operators.staging import staging
from isobar.schema import RAW
from isobar.session import settle
from isobar.sources.landing import parse_again, stream_documents
from isobar.sources.payload import enrich, judge, rows_and_refusals
from isobar.streaming.incremental import stamped_by_landing

LEDGER = "load long, documents long, refused long, hourly long, daily long"
REFUSED = (
    "city_id string, start_date date, end_date date, landed_at timestamp, batch_id string, reason string, file string, document string"
)
KINDS = ("hourly", "daily", "refused", "taken")


def mark() -> Column:
    """What a document is known by: its file and text. Equal documents of one file go together."""
    return F.sha2(F.concat_ws("\n", "file", "document"), 256)


@dataclass(frozen=True)
class Store:
    """The folders of one stream of loads under ``root``."""

    spark: SparkSession
    root: str

    def folder(self, kind: str, load: int | None = None) -> str:
        base = f"{self.root.rstrip('/')}/{kind}"
        return base if load is None else f"{base}/load={load}"

    def put(self, df: DataFrame, kind: str, load: int, *partitions: str) -> None:
        """Write a load's part, or write it again."""
        df.write.mode("overwrite").partitionBy(*partitions).parquet(self.folder(kind, load))

    def _read(self, kind: str, schema: str | StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", self.folder(kind)).parquet(self.folder(kind))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """One row per complete load: documents, refused ones, hourly and daily rows."""
        return self._read("ledger", LEDGER)

    def _committed(self, kind: str, schema: StructType) -> DataFrame:
        return self._read(kind, _and(schema, load="long")).join(self.ledger().select("load"), "load", "left_semi")

    def rows(self, grain: str) -> DataFrame:
        """All rows of a grain that complete loads have brought."""
        schema = _and(RAW[grain], kind="string")
        return self._committed("rows", schema).where(F.col("kind") == grain).select(*RAW[grain].names, "load")

    def _kind(self, kind: str, columns: str) -> DataFrame:
        schema = StructType.fromDDL(columns)
        return self._committed("rows", _and(schema, kind="string")).where(F.col("kind") == kind).select(*schema.names, "load")

    def refused(self) -> DataFrame:
        """All documents that complete loads have refused, with reason, file and text."""
        return self._kind("refused", REFUSED)

    def pending(self) -> DataFrame:
        """The refused documents that no replay has taken."""
        taken = self._kind("taken", "document string").select(F.col("document").alias("mark")).distinct()
        return self.refused().withColumn("mark", mark()).join(taken, "mark", "left_anti").drop("mark")

    def partials(self, only: DataFrame | None = None) -> DataFrame:
        """The daily partials of all complete loads: the last fold, and the loads that it has not.

        ``only`` (load) names loads among which are all of the last fold; others are left out.
        """
        last = self._read("folds", "load long").agg(F.max("load")).first()[0]
        schema = _partial_schema(self.spark)
        loads = self._committed("partials", schema)
        if only is not None:
            loads = loads.join(only, "load", "left_semi")
        if last is None:
            return loads.drop("load")
        has = self.spark.read.parquet(self.folder("folds", last)).select(F.col("of").alias("load"))
        folded = self.spark.read.schema(schema).parquet(self.folder("folded", last))
        return folded.unionByName(loads.join(has, "load", "left_anti").drop("load"))

    def fold(self) -> None:
        """Combine the partials of all complete loads, so that the next reader has one part for each day."""
        # A load that is committed meanwhile waits for the next fold.
        has = settle(self.ledger().select("load"), "folded")
        folds = self._read("folds", "load long").agg(F.coalesce(F.max("load") + 1, F.lit(0))).first()[0]
        self.put(combine(self.partials(has)), "folded", folds)
        self.put(has.withColumnRenamed("load", "of"), "folds", folds)

    def daily_moments(self) -> DataFrame:
        """The daily mart of all complete loads with what city statistics need; no row is read."""
        return moments(combine(self.partials()))


def _and(schema: StructType, **columns: str) -> StructType:
    """The schema with more columns, name=type."""
    return StructType([*schema.fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in columns.items())).fields])


def _partial_schema(spark: SparkSession) -> StructType:
    """The columns of partials, by the function that makes them."""
    return partials(staging(spark.createDataFrame([], RAW["hourly"]))).schema


def take(
    store: Store, documents: DataFrame, load: int, dimension: DataFrame, on_failure: str = "quarantine",
    on_written: Callable[[int], None] | None = None,
) -> None:
    """Write everything that ``documents`` (of ``stream_documents``) bring, as load number ``load``.

    ``on_written`` is called when all is written and nothing committed, for tests of that moment.
    """
    judged = judge(stamped_by_landing(enrich(documents, dimension)))
    read = Observation("read")
    counted = judged.observe(read, F.count(F.lit(1)).alias("documents"))
    made = _written(store, rows_and_refusals(counted, on_failure), load)
    _commit(store, load, read.get | made, on_written)


def _written(store: Store, every: DataFrame, load: int) -> dict[str, int]:
    """Write a load's rows in one job and then their partials; how many rows there are of each kind."""
    made = Observation("made")
    counted = every.observe(made, *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    store.put(counted.sortWithinPartitions("kind", "city_id", "time"), "rows", load, "kind")
    schema = _and(RAW["hourly"], kind="string")
    # Without any row there is no file.
    hourly = store.spark.createDataFrame([], schema) if not sum(made.get.values()) else (
        store.spark.read.schema(schema).parquet(store.folder("rows", load)).where("kind = 'hourly'")
    )
    store.put(partials(staging(hourly.select(*RAW["hourly"].names))), "partials", load)
    return made.get


def _commit(store: Store, load: int, counts: dict[str, int], on_written: Callable[[int], None] | None) -> None:
    if on_written is not None:
        on_written(load)
    line = store.spark.range(1).select(*[F.lit(counts[c]).cast("long").alias(c) for c in ("documents", "refused", "hourly", "daily")])
    store.put(line, "ledger", load)


def replay(store: Store, dimension: DataFrame, on_written: Callable[[int], None] | None = None) -> int:
    """Take the pending documents that can be taken now, each once; returns how many.

    A replay that broke off has the same number as the next one, which overwrites it.
    """
    judged = judge(stamped_by_landing(enrich(parse_again(store.pending().drop("reason", "load", "batch_id")), dimension)))
    good = judged.where(F.coalesce("reject_reason", "failure_reason").isNull())
    load = -1 - store.ledger().where("load < 0").count()
    # The store's own rows are read, and another folder of them written.
    made = _written(store, rows_and_refusals(good, marks=mark()), load)
    if made["taken"]:
        _commit(store, load, made | {"documents": made["taken"]}, on_written)
    return made["taken"]


def load_exactly_once(
    store: Store, landing: str, checkpoint: str, dimension: DataFrame, form: str = "lines", on_failure: str = "quarantine",
    max_files: int | None = None, on_written: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Start a run that loads into ``store`` what has landed since the last one, then ends.

    ``store`` and ``checkpoint`` belong together: the numbers of the loads are those of the checkpoint's batches.
    """
    documents = stream_documents(store.spark, landing, form, max_files)
    return (
        documents.writeStream.foreachBatch(lambda batch, load: take(store, batch, load, dimension, on_failure, on_written))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
