"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from isobar.session import settle


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge from its larger to its smaller end, once."""
    return edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).where("u <> v").distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of a node to its least neighbour: the larger ones, or all others and itself.

    Least neighbours are aggregated map-side and joined back, so a node with
    very many neighbours is never gathered in one task.
    """
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
    if large:
        return _directed(joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return _directed(
        joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    )


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v): the least node that it reaches.

    Rows with a null end and edges from a node to itself count for nothing; nodes
    that have no other edge are absent. Each step is a written table in the shared
    folder; the driver sees two numbers of it.
    """
    now = settle(_directed(edges.where("u IS NOT NULL AND v IS NOT NULL")), "edges")
    state = _state(now)
    while state[0]:
        now = settle(_star(_star(now, True), False), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
