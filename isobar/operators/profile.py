"""Relations between measures, per city."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def cloud_temp_corr(stg: DataFrame) -> DataFrame:
    """Correlation of cloud cover with temperature."""
    return stg.groupBy("city_id").agg(
        F.corr("cloud_cover", "temperature_2m").alias("cloud_temp_corr"),
        F.count(F.lit(1)).alias("rows"),
    )
