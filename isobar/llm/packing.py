"""Sharding by vector bin packing.

Groups of equal texts are vectors of bytes, tokens and rows. Each goes to the shard
where the dot product of its vector with what is left of the shard's capacity is
highest, in descending order of size. Dimensions are measured in shards, so that the
capacity is 1 in each.

Groups beyond ``1 / FINE`` of a shard in any dimension are packed one by one, and so
are the pieces of a group that is larger than a shard. There are few of these,
whatever the number of rows: a total of ``shards`` has room for ``3 * FINE * shards``
at most. Smaller groups are packed in ``CELLS`` cells by a hash of their text, of which
the sizes fall off, so that the last ones even out the shards. So the driver packs a
bounded list of sums, and rows follow their cells by a join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from isobar.session import settle

SHARDS = 16
FINE = 64
CELLS = 16_384
#: What evenness in bytes, tokens and rows is worth.
WORTH = (1.0, 0.1, 0.1)
_DIMENSIONS = ["bytes", "tokens", "rows"]
_PLACED = StructType([
    StructField("cell", StringType()), StructField("shard", IntegerType()), StructField("first_slot", LongType()),
])


def size(text: Column) -> Column:
    """Bytes of the text in UTF-8 (null: none), and one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _sums() -> list[Column]:
    return [F.sum(d).cast("long").alias(d) for d in _DIMENSIONS]


def place(units: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector; ``units`` (n, 3) in descending order of importance.

    The highest dot product with the residual capacity wins, on ties the lowest
    shard. A residual may become negative; a vector then goes where it does least harm.
    """
    residual = np.ones((shards, units.shape[1])) * np.maximum(units.sum(axis=0) / shards, 1e-300)
    weight = np.array(WORTH) / residual[0] ** 2
    out = np.empty(len(units), np.int64)
    for i, unit in enumerate(units):
        out[i] = shard = int(np.argmax(residual @ (unit * weight)))
        residual[shard] -= unit
    return out


def _packed(spark: SparkSession, cells: DataFrame, shards: int) -> DataFrame:
    """(cell, shard, first_slot): cells of one unit (whole group, or single cell) stay together."""
    rows = cells.collect()
    units: dict[str, list] = {}
    for row in rows:
        units.setdefault(row["unit"], []).append(row)
    vectors = {u: np.array([[c[d] for d in _DIMENSIONS] for c in own], float).sum(axis=0) for u, own in units.items()}
    total = np.maximum(sum(vectors.values()), 1) if vectors else None
    order = sorted(units, key=lambda u: (-float(np.max(vectors[u] / total)), u))
    chosen = place(np.array([vectors[u] for u in order]), shards) if order else []
    slots, out = [0] * shards, []
    for unit, shard in zip(order, map(int, chosen)):
        for cell in sorted(units[unit], key=lambda c: c["cell"]):
            out.append((cell["cell"], shard, slots[shard]))
            slots[shard] += cell["rows"]
    return spark.createDataFrame(out, _PLACED)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: the shards' sums of ``size`` are nearly equal, tokens and rows
    as far as that allows. A group of equal texts (null is as empty) stays in one shard
    unless it is larger than one. ``slot`` counts the rows of a shard from 0, without
    gaps. Rows of equal id and text may trade places. ``grown_shard`` is null. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = settle(
        docs.select(
            "doc_id", size(F.col("text")).alias("bytes"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
            F.lit(1).cast("long").alias("rows"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"),
        ),
        "texts",
    )
    total = rows.agg(*_sums()).first()
    capacity = {d: max(1, total[d] or 0) / shards for d in _DIMENSIONS}
    groups = rows.groupBy("key").agg(*_sums())
    share = F.greatest(*(F.col(d) / F.lit(capacity[d]) for d in _DIMENSIONS))
    # At most 3 * FINE * shards rows: only so many groups can be as large.
    large = groups.withColumn("share", share).where(F.col("share") >= 1 / FINE).select(
        "key", F.ceil(F.col("share") * FINE).cast("int").alias("pieces"), (F.col("share") > 1).alias("divided")
    )
    large = settle(large, "large")
    # Half the hash range is halved again and again: cells of many sizes.
    number = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(1 << 48)
    step = F.floor(CELLS * number * number).cast("string")
    piece = F.concat_ws("/", "key", F.pmod(F.xxhash64("doc_id", "key"), F.col("pieces")).cast("string"))
    celled = rows.join(large.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left").withColumn(
        "cell", F.when(F.col("k").isNull(), step).otherwise(piece)
    ).withColumn("unit", F.when(F.col("divided") | F.col("k").isNull(), F.col("cell")).otherwise(F.col("key")))
    celled = settle(celled.select("doc_id", "bytes", "tokens", "rows", "text_crc32", "key", "cell", "unit"), "cells")
    placed = settle(_packed(spark, celled.groupBy("unit", "cell").agg(*_sums()), shards), "placed")
    in_cell = Window.partitionBy("cell").orderBy("key", "doc_id")
    return celled.withColumn("at", F.row_number().over(in_cell) - 1).join(placed, "cell").select(
        "doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first_slot") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
