"""Variables of landed documents that the canonical lists do not name, kept as variants.

They need no schema and no change of code when they appear: each reading carries them in a map of name to
variant, their merged types are found from the data, and they are returned as columns of such a type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from isobar.schema import VARIABLES


def extra_variables(docs: DataFrame, grain: str = "hourly") -> DataFrame:
    """Per reading of ``docs`` (of ``scan_documents``) that has some: city_id, time, others (name to variant).

    Only documents whose grain has times are looked at, as others give no readings. A variable that is shorter than ``time`` is null at its
    end, a null value or a variable that is no array is left out.
    """
    known = F.array(*[F.lit(v) for v in ("time", *VARIABLES[grain])])
    parsed = F.from_json("document", f"{grain} map<string, variant>")[grain]
    kept = F.map_filter(parsed, lambda name, _: ~F.array_contains(known, name))
    arrays = F.transform_values(kept, lambda _, v: F.try_variant_get(v, "$", "array<variant>"))
    times = F.try_variant_get(parsed["time"], "$", "array<string>")
    found = docs.select("city_id", times.alias("times"), F.map_filter(arrays, lambda _, v: v.isNotNull()).alias("arrays"))
    found = found.where("size(times) > 0 AND size(arrays) > 0")

    def at(i: Column) -> Column:
        entries = F.transform(F.map_entries("arrays"), lambda e: F.struct(e["key"].alias("key"), F.get(e["value"], i).alias("value")))
        present = F.filter(entries, lambda e: e["value"].isNotNull() & ~F.is_variant_null(e["value"]))
        return F.map_from_entries(present)

    readings = F.transform("times", lambda t, i: F.struct(t.try_cast("timestamp_ntz").alias("time"), at(i).alias("others")))
    return found.select("city_id", F.inline(readings)).where("size(others) > 0")


def merged_schema(readings: DataFrame) -> DataFrame:
    """Per extra variable: the type that holds all its values, and how many there are."""
    values = readings.select(F.explode("others").alias("variable", "value"))
    return values.groupBy("variable").agg(F.schema_of_variant_agg("value").alias("type"), F.count("*").alias("readings"))


def typed(readings: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Extra variables as columns: name to (path in the reading, such as ``$.props.k``, and type).

    The first step of a path is the variable. What cannot be cast is NULL.
    """

    def value(path: str, kind: str) -> Column:
        variable, _, rest = path.removeprefix("$.").partition(".")
        return F.try_variant_get(F.col("others")[variable], f"$.{rest}" if rest else "$", kind)

    return readings.select("city_id", "time", *[value(p, t).alias(n) for n, (p, t) in columns.items()])
