"""Uniqueness checked batch by batch against a table of known keys.

The table is bucketed by the key, so what it holds is never moved: a batch's keys are dealt to the buckets and
meet theirs there. Each batch is stored under its name; one that comes again counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from isobar.plans.tables import Layers

KEYS = "state.known_keys"


def known_keys(layers: Layers, keys: list[str]) -> DataFrame:
    """(keys, copies) of all stored batches; a batch stored twice counts once."""
    stored = layers.table(KEYS).groupBy(*keys, "batch").agg(F.max("copies").alias("copies"))
    return stored.groupBy(*keys).agg(F.sum("copies").alias("copies"))


def check_batch(layers: Layers, rows: DataFrame, keys: list[str], batch: str, buckets: int = 200) -> DataFrame:
    """Keys of the batch that are duplicates with it and were none before: keys, copies before, copies in the batch.

    The batch's keys are stored first, and the history is what other batches have brought. Keys with a NULL part
    are not compared. ``buckets`` counts when the table is made, by the first batch.
    """
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    own = rows.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    own = own.withColumn("batch", F.lit(batch))
    name, path = layers.name(KEYS), layers.path(KEYS)
    writer = own.write.mode("append").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path).saveAsTable(name)
    stored = layers.table(KEYS)
    mine = stored.where(F.col("batch") == batch).groupBy(*keys).agg(F.max("copies").alias("in_batch"))
    others = stored.where(F.col("batch") != batch).groupBy(*keys, "batch").agg(F.max("copies").alias("copies"))
    others = others.groupBy(*keys).agg(F.sum("copies").alias("copies"))
    before = F.coalesce("copies", F.lit(0))
    return mine.join(others.hint("merge"), keys, "left").select(*keys, before.alias("before"), "in_batch").where(
        (F.col("before") <= 1) & (F.col("before") + F.col("in_batch") > 1)
    )
