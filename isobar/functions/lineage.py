"""Batch lineage: one ingestion timestamp and one batch id for a whole run."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

BATCH_FORMAT = "%Y%m%d_%H%M%S"


def batch_id_of(run_ts: datetime) -> str:
    return run_ts.strftime(BATCH_FORMAT)


def ingestion_timestamp(run_ts: datetime) -> Column:
    """The run's naive timestamp as a literal: the same on every task and retry."""
    return F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz")
