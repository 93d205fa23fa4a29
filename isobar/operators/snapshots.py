"""Overlapping batches: newest rows, high-water marks, differences between runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from isobar.session import settle

KEY = ["city_id", "time"]
RECENCY = ["ingestion_timestamp", "batch_id"]


def _newest(rows: DataFrame) -> DataFrame:
    """The newest row of each key: a maximum over structs instead of a window.

    Copies combine map-side, so a key of many copies needs no task of its own.
    Equal recency is decided by the remaining columns, and the outcome does not
    depend on the order of rows.
    """
    rest = [c for c in rows.columns if c not in KEY + RECENCY]
    newest = rows.groupBy(*KEY).agg(F.max(F.struct(*RECENCY, *rest)).alias("row"))
    return newest.select(*KEY, "row.*").select(*rows.columns)


def latest_rows(raw: DataFrame) -> DataFrame:
    """One row per city and time: the one ingested last.

    Keys that have copies, with their latest time of ingestion, are found first by
    a hash aggregation of three columns. One left join with them, planned by their
    size, lets rows without copies and the latest copies pass; only the latter are
    then chosen among. Rows without a full key cannot be copies of one another
    and stay.
    """
    stamp = RECENCY[0]
    keyed = reduce(Column.__and__, [F.col(k).isNotNull() for k in KEY])
    copies = raw.where(keyed).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("copies"), F.max(stamp).alias("latest")
    )
    copied = settle(copies.where("copies > 1"), "copied-keys")
    marked = raw.join(copied, KEY, "left")
    single = marked.where("copies IS NULL").select(*raw.columns)
    late = marked.where(F.col("copies").isNotNull() & F.col(stamp).eqNullSafe(F.col("latest")))
    return single.unionByName(_newest(late.select(*raw.columns)))


def high_water(raw: DataFrame) -> DataFrame:
    """Per city the last time that has been ingested."""
    return raw.groupBy("city_id").agg(F.max("time").alias("high_water"))


def merged_marks(marks: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored marks brought forward by the rows of a new batch: the history is not read."""
    return marks.unionByName(high_water(batch)).groupBy("city_id").agg(
        F.max("high_water").alias("high_water")
    )


def newer_than(rows: DataFrame, marks: DataFrame, all_marked: bool = False) -> DataFrame:
    """Rows beyond their city's mark; all rows of a city without one.

    ``marks`` are written first, so that the planner knows their size: broadcast
    while small, a shuffled join with skew handling beyond that. ``all_marked`` says
    that every city in ``rows`` has a mark: the least one then bounds ``time`` in the
    scan. Rows without a city have no mark and stay.
    """
    known = settle(marks, "high-water")
    if all_marked:
        least, without = known.agg(F.min("high_water"), F.count_if(F.col("high_water").isNull())).first()
        if least is not None and not without:
            rows = rows.where((F.col("time") > F.lit(least).cast("timestamp_ntz")) | F.col("city_id").isNull())
    fresh = F.col("high_water").isNull() | (F.col("time") > F.col("high_water"))
    return rows.join(known, "city_id", "left").where(fresh).select(*rows.columns)


def snapshot_diff(
    rows: DataFrame, in_old: Column, in_new: Column, columns: list[str]
) -> DataFrame:
    """Keys that were added, removed or changed between two snapshots of a table.

    Both snapshots come from one scan and meet in one aggregation instead of an
    outer join: only keys and a digest of the compared columns are shuffled, and
    copies of a key combine before. Per key and side, the number of rows and the sums
    of both halves of a 64-bit hash of the compared columns, gaps included, are
    compared: they do not depend on the order of copies, and differ if the copies do.
    """
    digest = F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])
    halves = {"low": digest.bitwiseAND(F.lit(0xFFFFFFFF)), "high": F.shiftrightunsigned(digest, 32)}
    sides = {"old": in_old, "new": in_new}
    met = rows.where(in_old | in_new).groupBy(*KEY).agg(
        *[F.count_if(side).alias(f"{name}_rows") for name, side in sides.items()],
        *[
            F.sum(F.when(side, half)).alias(f"{name}_{part}")
            for name, side in sides.items() for part, half in halves.items()
        ],
    )
    same = reduce(
        Column.__and__,
        [F.col(f"old_{part}").eqNullSafe(F.col(f"new_{part}")) for part in ("rows", *halves)],
    )
    status = (
        F.when(F.col("old_rows") == 0, "added")
        .when(F.col("new_rows") == 0, "removed")
        .when(~same, "changed")
    )
    return met.select(*KEY, status.alias("status")).where(F.col("status").isNotNull())


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("city_id", "status").agg(F.count(F.lit(1)).alias("keys"))


# --- stored snapshots -----------------------------------------------------------

def _halves(columns: list[str]) -> dict[str, Column]:
    digest = F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])
    return {"low": digest.bitwiseAND(F.lit(0xFFFFFFFF)), "high": F.shiftrightunsigned(digest, 32)}


def store_snapshot(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Write a snapshot by day, and beside it one digest per city and day over the keys and ``columns``.

    A digest is the number of rows and the sums of both halves of their hashes, whatever their order. Rows
    without a time lie in the folder of no day.
    """
    dated = rows.withColumn("day", F.to_date("time"))
    dated.write.partitionBy("day").parquet(f"{path}/rows")
    halves = _halves([*KEY, *columns])
    digests = dated.groupBy("city_id", "day").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(h).alias(n) for n, h in halves.items()])
    digests.write.parquet(f"{path}/digests")


def changed_days(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(city_id, day) whose digests differ between two stored snapshots, or that only one has. No rows are read."""
    sides = [
        spark.read.parquet(f"{path}/digests").withColumn("old", F.lit(int(path == old))) for path in dict.fromkeys((old, new))
    ]
    marked = reduce(DataFrame.unionByName, sides)
    return marked.groupBy("city_id", "day").agg(
        F.count_distinct("rows", "low", "high").alias("kinds"), F.count(F.lit(1)).alias("sides")
    ).where("kinds > 1 OR sides < 2").select("city_id", "day")


def stored_diff(spark: SparkSession, old: str, new: str, columns: list[str]) -> DataFrame:
    """``snapshot_diff`` of two stored snapshots, reading only the days that differ.

    The days go into the scans as a condition on folders; there are at most as many as the snapshots have.
    Within such a day, cities that have not changed are left out.
    """
    changed = settle(changed_days(spark, old, new), "changed-days")
    days = [row.day for row in changed.select("day").distinct().collect()]
    dated = F.col("day").isin([d for d in days if d is not None])
    chosen = (dated | F.col("day").isNull()) if None in days else dated

    def side(path: str, name: str) -> DataFrame:
        rows = spark.read.parquet(f"{path}/rows").where(chosen)
        return rows.select(*KEY, "day", *columns, F.lit(name).alias("side"))

    both = side(old, "old").unionByName(side(new, "new")).alias("r")
    met = both.join(
        changed.alias("c"), F.col("r.city_id").eqNullSafe(F.col("c.city_id")) & F.col("r.day").eqNullSafe(F.col("c.day")), "left_semi"
    )
    return snapshot_diff(met, F.col("side") == "old", F.col("side") == "new", columns)
