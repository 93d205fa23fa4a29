"""Daily sketches that merge: distinct counts and quantiles of any range of days without reading its rows again.

A sketch has a bounded size whatever it has seen, so a hot city is one small row per task and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from isobar.operators.quality import Check

#: log2 of the number of registers of a distinct count; its standard error is about 1 / sqrt(2 ** REGISTERS)
REGISTERS = 12
#: size parameter of a quantile sketch; ``RANK_ERROR`` is a bound of its rank error that holds with 99 % confidence
SIZE, RANK_ERROR = 400, 0.01


def distinct_error() -> float:
    """Three standard errors of a merged distinct count, relative."""
    return 3 * 1.04 / (1 << REGISTERS) ** 0.5


def daily_sketches(stg: DataFrame, counted: list[str], measured: list[str]) -> DataFrame:
    """Per city and day a sketch of the distinct values of each ``counted`` column (``<name>_distinct``) and of the
    distribution of each ``measured`` one (``<name>_quantiles``). Missing values are in neither."""
    return stg.groupBy("city_id", "date").agg(
        *[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(REGISTERS)).alias(f"{c}_distinct") for c in counted],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(SIZE)).alias(f"{c}_quantiles") for c in measured],
    )


def distinct_values(sketches: DataFrame, column: str, *by: str) -> DataFrame:
    """About how many distinct values a column has, of all days in ``sketches``, in all or by columns of it."""
    united = F.hll_sketch_estimate(F.hll_union_agg(f"{column}_distinct"))
    return sketches.groupBy(*by).agg(united.alias("distinct_values"))


def quantiles(sketches: DataFrame, column: str, ranks: list[float], *by: str) -> DataFrame:
    """The values of a column at the given ranks, ``q0``, ``q1``, …, and of how many values (``n``)."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double(f"{column}_quantiles").alias("merged"))
    n = F.kll_sketch_get_n_double("merged")
    return merged.select(
        *by, n.alias("n"),
        *[F.when(n > 0, F.kll_sketch_get_quantile_double("merged", F.lit(r))).alias(f"q{i}") for i, r in enumerate(ranks)],
    )


def limits(sketches: DataFrame, column: str, reach: float = 1.5, *by: str) -> DataFrame:
    """Limits from the data: the quartiles of a column, moved apart by ``reach`` times their distance."""
    found = quantiles(sketches, column, [0.25, 0.75], *by)
    spread = F.col("q1") - F.col("q0")
    return found.select(*by, (F.col("q0") - reach * spread).alias("low"), (F.col("q1") + reach * spread).alias("high"))


def outside(rows: DataFrame, bounds: DataFrame, column: str) -> DataFrame:
    """Per city how many values of a column are outside the city's limits, and inside; both ends are allowed.

    ``bounds`` has one small row per city and should be written, so that the planner knows its size. Cities
    without limits have no result.
    """
    inside: Column = F.col(column).between(F.col("low"), F.col("high"))
    checks = [Check("range", column, F.count_if(~inside)), Check("inside", column, F.count_if(inside))]
    named = {"range": "failures", "inside": "passed"}
    return rows.join(bounds, "city_id").groupBy("city_id").agg(*[c.failures.alias(named[c.name]) for c in checks])
