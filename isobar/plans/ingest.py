"""One ingest run: landed documents of a request → raw rows."""

from __future__ import annotations

import logging
from datetime import date, datetime

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from isobar.functions.lineage import batch_id_of
from isobar.session import settle
from isobar.sources.cities import request_range, require_in
from isobar.sources.landing import requested, scan_documents, scan_landing
from isobar.sources.payload import (
    all_rows,
    enrich,
    ingest_stats,
    judge,
    refused,
    stamped,
    within,
    within_requests,
)
from isobar.sources.raw import scan_raw, write_raw

log = logging.getLogger(__name__)


class RefusedDocuments(RuntimeError):
    """A run whose refused documents, recorded by then, are to count as its failure."""


def ingest(
    spark: SparkSession,
    landing: str,
    raw_root: str,
    dimension: DataFrame,
    mode: str,
    run_ts: datetime,
    city_ids: list[str] | None = None,
    as_of: date | None = None,
    start: str | None = None,
    end: str | None = None,
    form: str = "lines",
    on_failure: str = "fail",
    refused_path: str | None = None,
    repeat: bool = False,
    manifest: DataFrame | None = None,
    on_refused: str = "record",
) -> DataFrame:
    """Land the requested days of the given cities and return the run's statistics.

    ``city_ids`` that the dimension lacks are an error. A ``manifest`` (city_id,
    start_date, end_date), for instance of ``local_request_manifest``, takes the place
    of mode and cities: each city's rows of its own days are landed.

    Both grains are written by one job, so a run that fails leaves nothing
    behind. Refused documents give no rows; ``on_failure`` says whether a
    document that cannot become rows stops the run or is refused as well. Refused
    documents are always recorded with reasons, files and texts, in ``refused_path`` or beside
    the raw root; only a run that has some reads documents again for that.
    With ``on_refused="fail"`` such a run then fails.

    ``repeat`` says that a run with this ``run_ts`` may have been here before, and
    replaces its batch; otherwise rows are added.

    Documents, rows, and rows of days that were not asked for are counted while
    they are written. The statistics per city are read back from the new batch, two
    narrow columns of one directory.
    """
    if on_refused not in ("record", "fail"):
        raise ValueError(f"no such policy: {on_refused}; there are record and fail")
    if city_ids is not None:
        require_in(dimension, city_ids)
    if manifest is None:
        first, last, _ = request_range(mode, as_of, start, end)
    else:
        manifest = settle(manifest.select("city_id", "start_date", "end_date"), "manifest")
        asked = [row.city_id for row in manifest.select("city_id").distinct().collect()]
        require_in(dimension, asked)
        city_ids = asked if city_ids is None else [c for c in asked if c in city_ids]
        first, last = manifest.agg(
            F.min("start_date").cast("string"), F.max("end_date").cast("string")
        ).first()
        if first is None:
            raise ValueError("a manifest without requests")
    docs = requested(scan_landing(spark, landing, form), first, last, city_ids)
    judged = judge(stamped(enrich(docs, dimension), run_ts))
    documents, made, rows = (Observation(n) for n in ("documents", "made", "rows"))
    counted = judged.observe(
        documents,
        F.count(F.lit(1)).alias("read"),
        F.count_if(F.coalesce("reject_reason", "failure_reason").isNotNull()).alias("refused"),
    )
    every = all_rows(counted, on_failure).observe(made, F.count(F.lit(1)).alias("rows"))
    chosen = within(every, first, last)
    if manifest is not None:
        chosen = within_requests(chosen, manifest)
    landed = chosen.observe(
        rows,
        F.count_if(F.col("grain") == "hourly").alias("hourly"),
        F.count_if(F.col("grain") == "daily").alias("daily"),
    )
    write_raw(landed, raw_root, replace_batches=repeat)
    others = made.get["rows"] - sum(rows.get.values())
    log.info("batch %s, %s to %s: documents %s, rows %s, rows of other days %s", batch_id_of(run_ts),
             first, last, documents.get, rows.get, others)
    if documents.get["refused"]:
        path = refused_path or f"{raw_root.rstrip('/')}_refused"
        # Read once more as text, so that the record can be taken again from itself.
        kept = requested(scan_documents(spark, landing, form), first, last, city_ids)
        again = judge(stamped(enrich(kept, dimension), run_ts))
        refused(again).write.mode("append").partitionBy("batch_id").parquet(path)
        log.warning("batch %s: %s documents refused, see %s", batch_id_of(run_ts), documents.get["refused"], path)
        if on_refused == "fail":
            raise RefusedDocuments(f"{documents.get['refused']} documents refused, see {path}")
    written = scan_raw(spark, "hourly", raw_root)
    return ingest_stats(written.where(F.col("batch_id") == batch_id_of(run_ts)))
