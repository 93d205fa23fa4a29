"""Raw hourly rows → staging rows: calendar, fills, missing flags. A narrow projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from isobar.functions.calendar import calendar
from isobar.functions.measures import FILLS, filled, missing_flag

CARRIED = [
    "city_id",
    "city_name",
    "latitude",
    "longitude",
    "timezone",
    "ingestion_timestamp",
    "batch_id",
]


def staging(raw: DataFrame, fill: bool = True) -> DataFrame:
    """The 23 staging columns.

    ``fill=True`` puts the fixed fill values in place of missing measurements,
    which is the defined output. ``fill=False`` keeps them NULL, so that means
    and deviations downstream are not pulled towards the fill value.
    """
    measures = [filled(m) if fill else F.col(m) for m in FILLS]
    return raw.select(
        "time",
        *calendar(F.col("time")),
        *measures,
        *CARRIED,
        missing_flag("temperature_2m").alias("has_missing_temp"),
        missing_flag("precipitation").alias("has_missing_precip"),
    )
