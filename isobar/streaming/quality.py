"""Results of checks for streams: counted while the rows pass, recorded batch by batch.

``watched`` puts the counts of the checks on a stream, which costs no pass of its own. A listener hears them with the
progress of every micro-batch and appends one row per check to ``mart.dq_results``, under the stream's id and
batch. A batch whose progress comes twice, as after a restart, has the same id: ``recorded_once`` counts it once.
"""

from __future__ import annotations

import threading
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import (
    QueryIdleEvent,
    QueryProgressEvent,
    QueryStartedEvent,
    QueryTerminatedEvent,
)

from isobar.operators.quality import Check
from isobar.plans.refresh import RESULTS
from isobar.plans.tables import Layers

_PREFIX = "dq "


def watched(rows: DataFrame, table: str, checks: list[Check]) -> DataFrame:
    """The stream ``rows`` of ``table`` with its checks counted on the way; rows and columns are as before.

    Checks must be plain aggregates over rows, as those of ``not_null`` and ``value_range`` are.
    """
    counts = [c.failures.cast("bigint").alias(f"{c.name} {c.column}") for c in checks]
    return rows.observe(_PREFIX + table, F.count(F.lit(1)).alias("rows"), *counts)


class Recorder(StreamingQueryListener):
    """Appends the results of every micro-batch that has rows to ``mart.dq_results``.

    Register it with ``spark.streams.addListener``. Failures to write are kept in ``errors`` and never stop a
    stream. ``wait`` returns when the last batch of a query has been heard.
    """

    def __init__(self, layers: Layers):
        self._layers, self._heard, self._ended = layers, threading.Condition(), set()
        self.errors: list[Exception] = []

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        progress = event.progress
        run = f"{progress.id}_{progress.batchId}"
        # The time that the batch was triggered, in UTC as all lineage.
        at = datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00")).astimezone(UTC).replace(tzinfo=None)
        lines = []
        for name, row in progress.observedMetrics.items():
            counts = row.asDict()
            if name.startswith(_PREFIX) and counts.pop("rows"):
                lines += [(name.removeprefix(_PREFIX), *key.split(" ", 1), n, at, run) for key, n in counts.items()]
        try:
            if lines:
                self._append(lines)
        except Exception as error:  # noqa: BLE001 - results never stop a stream
            self.errors.append(error)

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        with self._heard:
            self._ended.add(str(event.runId))
            self._heard.notify_all()

    def _append(self, lines: list[tuple]) -> None:
        layers = self._layers
        schema = "table_name string, check_name string, column_name string, failures long, checked_at timestamp_ntz, run_id string"
        results = layers.spark.createDataFrame(lines, schema).coalesce(1)
        results.write.mode("append").option("path", layers.path(RESULTS)).saveAsTable(layers.name(RESULTS))

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until the end of a query that has ended was heard, which comes behind all its batches."""
        until = time.monotonic() + seconds
        with self._heard:
            while str(query.runId) not in self._ended:
                if not self._heard.wait(max(0.0, until - time.monotonic())):
                    raise TimeoutError(f"no end of {query.runId} within {seconds} s")


def recorded_once(layers: Layers) -> DataFrame:
    """``mart.dq_results`` with each batch's result of a check once, the last one recorded."""
    keys = ["table_name", "check_name", "column_name", "run_id"]
    last = layers.table(RESULTS).groupBy(*keys).agg(F.max(F.struct("checked_at", "failures")).alias("last"))
    return last.select(*keys, "last.checked_at", "last.failures")
