"""Data-quality checks. Each yields (table_name, check_name, column_name, failures)."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from isobar.session import settle

# --- Fixed values: the declared not-null columns of each table ---------------
NOT_NULL = {
    "raw.weather_hourly": ["time", "city_id", "city_name"],
    "raw.weather_daily": ["time", "city_id"],
    "staging.stg_weather": ["time", "date", "city_id", "temperature_2m", "precipitation"],
    "mart.weather_daily": ["city_id", "date", "total_hours"],
    "mart.weather_anomalies": ["time", "city_id", "is_temp_anomaly"],
}
UNIQUE = {"staging.stg_weather": ["time", "city_id"]}
# relationships: (child table, key) → parent table
RELATIONSHIPS = {("staging.stg_weather", "city_id"): "raw.weather_hourly"}
# --- End of fixed values ----------------------------------------------------


class Check(NamedTuple):
    """A rule that one pass over a table can count: how many rows break it."""

    name: str
    column: str
    failures: Column


def not_null(columns: list[str]) -> list[Check]:
    return [Check("not_null", c, F.count_if(F.col(c).isNull())) for c in columns]


def filled_gaps() -> list[Check]:
    """Missing measurements by the flags of staging. Once filled they are not
    NULL any more, so ``not_null`` cannot see them."""
    flags = {"temperature_2m": "has_missing_temp", "precipitation": "has_missing_precip"}
    return [Check("filled", c, F.coalesce(F.sum(f), F.lit(0))) for c, f in flags.items()]


def value_range(limits: dict[str, tuple[float, float]]) -> list[Check]:
    """Values outside the caller's limits, both ends allowed; NULLs do not count."""
    return [
        Check("range", c, F.count_if(~F.col(c).between(low, high)))
        for c, (low, high) in limits.items()
    ]


def tally(df: DataFrame, table: str, checks: list[Check]) -> DataFrame:
    """All ``checks`` in one pass: one row per task is shuffled, and the counts
    of the single row that results are turned into one row per check."""
    counted = df.agg(
        F.array(*[
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(check.name).alias("check_name"),
                F.lit(check.column).alias("column_name"),
                check.failures.cast("bigint").alias("failures"),
            )
            for check in checks
        ]).alias("results")
    )
    return counted.select(F.inline("results"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with the number of rows. Keys with a NULL
    part are not compared. Copies combine map-side, so a key of many copies
    arrives as one row per task."""
    present = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    counted = df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return counted.where("copies > 1")


def unique(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """How many keys occur more than once."""
    return tally(duplicates(df, keys), table, [Check("unique", ",".join(keys), F.count(F.lit(1)))])


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Key values of ``child`` that ``parent`` lacks, with the number of rows.

    Both sides are reduced to their distinct keys before they meet, so no row
    of either table is moved, and a key held by many rows counts as one. It is
    an outer join on purpose: an anti join would be pushed below the count, and
    the rows themselves would be joined.
    """
    held = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    known = parent.where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(True).alias("known"))
    return held.join(known, key, "left").where(F.col("known").isNull()).select(key, "rows")


def relationships(child: DataFrame, parent: DataFrame, table: str, key: str) -> DataFrame:
    """How many rows of ``child`` have a key that ``parent`` lacks."""
    failures = F.coalesce(F.sum("rows"), F.lit(0))
    return tally(orphans(child, parent, key), table, [Check("relationships", key, failures)])


def union(results: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


def not_null_checks(
    tables: dict[str, DataFrame], more: dict[str, list[Check]] | None = None
) -> DataFrame:
    """The declared not-null checks of the given tables, one pass over each.
    ``more`` checks of a table go with the same pass."""
    extra = more or {}
    return union([
        tally(df, name, not_null(NOT_NULL[name]) + extra.get(name, []))
        for name, df in tables.items()
    ])


def _reduced(df: DataFrame, checks: list[Check], key: str, keys: list[str] | None) -> DataFrame:
    """One row per value of ``key``: its rows, the failures of each check (f0, f1, …) and,
    with ``keys``, how many of these occur more than once. One scan of the table."""
    counts = [c.failures.cast("bigint").alias(f"f{i}") for i, c in enumerate(checks)]
    if keys is None:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("bigint").alias("copies"), *counts)
    present = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    single = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *counts)
    return single.groupBy(key).agg(
        F.sum("rows").alias("rows"), F.count_if(present & (F.col("rows") > 1)).alias("copies"),
        *[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(checks))],
    )


def declared_checks(
    tables: dict[str, DataFrame], more: dict[str, list[Check]] | None = None
) -> DataFrame:
    """All declared checks: 16 not-null, one unique, one relationships.

    Each table is read once. Tables that a relationship or a unique key speaks of are
    reduced to one small row per value of the relationship's key, from which all
    their results follow; those rows are written, as several results need them.
    """
    extra = more or {}
    results, small = [], {}
    key_of = {t: key for (child, key), parent in RELATIONSHIPS.items() for t in (child, parent)}
    for name, df in tables.items():
        checks = not_null(NOT_NULL[name]) + extra.get(name, [])
        if name not in key_of:
            results.append(tally(df, name, checks))
            continue
        keys = UNIQUE.get(name)
        small[name] = settle(_reduced(df, checks, key_of[name], keys), "checked")

        def total(column: str) -> Column:
            return F.coalesce(F.sum(column), F.lit(0))

        again = [Check(c.name, c.column, total(f"f{i}")) for i, c in enumerate(checks)]
        if keys is not None:
            again.append(Check("unique", ",".join(keys), total("copies")))
        results.append(tally(small[name], name, again))
    for (child, key), parent in RELATIONSHIPS.items():
        held = small[child].where(F.col(key).isNotNull()).select(key, "rows")
        known = small[parent].where(F.col(key).isNotNull()).select(key, F.lit(True).alias("known"))
        missing = held.join(known, key, "left").where(F.col("known").isNull())
        results.append(tally(missing, child, [Check("relationships", key, F.coalesce(F.sum("rows"), F.lit(0)))]))
    return union(results)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, by layer and name."""

    def counted(name: str, df: DataFrame) -> DataFrame:
        layer, table = name.split(".")
        return df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(layer).alias("schema_name"), F.lit(table).alias("table_name"), "row_count"
        )

    return union([counted(n, df) for n, df in tables.items()]).orderBy("schema_name", "table_name")


def coverage(stg: DataFrame) -> DataFrame:
    """First and last day, and how many cities there are."""
    return stg.agg(
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.count_distinct("city_id").alias("city_count"),
    )
