"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is its share, by weight, of ``share`` times all words; it stops at
``most`` times the source's own words, and what is above goes to the others by weight
until none is above. The ratio of target to words is the number of copies of a
document. Its whole part is certain: every document is taken that often. For the
rest, documents are ranked by u / (1 - u), their random odds, divided by p / (1 - p),
the odds of their inclusion, and taken in that order until the words of the source
are used up. The document at which they would be exceeded is left out; in its place the
largest one that still fits is taken, ``FILLERS`` times.

Only sums by source and by bucket of rank are gathered, and ``FILLERS`` documents of each
size that still fits. A source that holds most rows is spread over ``BUCKETS`` buckets,
of which one has to be put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from isobar.session import settle

WEIGHTS = (5, 2, 1)
BUCKETS = 4096
#: Documents of a source that may take the place of the one that did not fit.
FILLERS = 4
SEED = 20


def words(text: Column) -> Column:
    """Number of runs of characters that are not spaces (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number strictly between 0 and 1 that depends on the key (null: '') and the seed alone."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size), one per source.

    Sources by code point, null last, weigh ``weights`` in turn. In ascending order
    of limit by weight, the sources that stop at their limits come first; the rest
    share by weight what these leave. One row per source goes through one task.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn % len(weights) + 1))
    limit = most * F.col("source_size")
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    level = (F.col("budget") - F.col("stopped")) / F.col("weights_left")
    return (
        weighed.withColumn("budget", share * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("stopped", F.coalesce(F.sum(limit).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("limit", limit).withColumn("level", level)
        # The first source below its limit sets the level of all after it.
        .withColumn("open", F.first(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level")), ignorenulls=True)
                    .over(by_limit.rowsBetween(Window.unboundedPreceding, 0)))
        .select("source", "source_size", F.coalesce(F.least("limit", F.col("open") * F.col("weight")), F.col("limit")).alias("target"))
    )


def expected_copies(by_level: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """(source, level, source_size, target, expected) from (source, level, words) and ``targets``.

    In descending order of level, those come first whose documents stop at ``most`` copies; the rest go by level
    and share what these leave of the target. One small row per source and level.
    """
    met = by_level.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    down = Window.partitionBy("source").orderBy(F.desc("level"))
    stopped = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weighed = F.sum(F.col("level") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    share = (F.col("target") - most * stopped) / F.nullif(weighed, F.lit(0.0))
    shared = met.withColumn("share", share)
    level = F.first(F.when(F.col("share") * F.col("level") <= most, F.col("share")), ignorenulls=True).over(
        down.rowsBetween(Window.unboundedPreceding, 0)
    )
    expected = F.when((F.col("source_size") == 0) | (F.col("level") == 0), 0.0).otherwise(
        F.coalesce(F.least(F.lit(most), level * F.col("level")), F.lit(most))
    )
    return shared.select("source", "level", "source_size", "target", expected.alias("expected"))


def _fillers(free: DataFrame, left: DataFrame) -> DataFrame:
    """(row) of the rows of ``free`` that fill what is ``left`` of the words of their source ``s``, ``FILLERS`` of a source.

    The largest one that fits is taken again and again, of equal sizes the first by rank. What did not fit once does not
    fit later, so one pass through the sizes in descending order takes the same. ``FILLERS`` rows of each size that
    is not above what is left are gathered by source.
    """
    size_rank = Window.partitionBy("source", "size").orderBy(F.desc("o"), F.desc("d"), F.desc("row"))
    fitting = (
        free.join(left, F.col("source").eqNullSafe(F.col("s"))).where(F.col("size") <= F.col("left"))
        .select("source", "left", "size", (-F.col("odds")).alias("o"), (-F.col("doc_id")).alias("d"), "row")
        .withColumn("nth", F.row_number().over(size_rank)).where(F.col("nth") <= FILLERS)
    )
    by_source = fitting.groupBy("source").agg(
        F.first("left").alias("left"), F.sort_array(F.collect_list(F.struct("size", "o", "d", "row")), asc=False).alias("down")
    )
    taken = F.aggregate(
        "down",
        F.struct(F.col("left").alias("left"), F.array().cast("array<long>").alias("rows")),
        lambda so_far, one: F.when(
            (F.size(so_far["rows"]) < FILLERS) & (one["size"] <= so_far["left"]),
            F.struct(
                (so_far["left"] - one["size"]).alias("left"), F.concat(so_far["rows"], F.array(one["row"])).alias("rows")
            ),
        ).otherwise(so_far),
        lambda so_far: so_far["rows"],
    )
    return by_source.select(F.explode(taken).alias("row"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = SEED,
    weight: Column | None = None,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    ``copies`` is how often the mix takes the document, ``taken`` the words of all
    copies. ``weight`` (default: 1 for all; null: 0), of a few different values, makes the
    expected copies of documents unequal inside their source: they go by weight, and
    stop at ``most``, of which the others take what is left, so the target is met. A null text has no words, is never ranked before others
    and takes the certain copies; null sources are one source. Repeated rows of one id
    have the same random number and stand side by side. Other columns are ignored.
    """
    level = F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = settle(
        docs.select("doc_id", "source", words(F.col("text")).alias("size"), level.alias("level"), uniform(F.col("doc_id"), seed).alias("u"))
        .withColumn("row", F.monotonically_increasing_id()),
        "sizes",
    )
    by_level = settle(rows.groupBy("source", "level").agg(F.sum("size").alias("words")), "levels")
    by_source = by_level.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = settle(expected_copies(by_level, targets(by_source, weights, share, most), most), "targets")

    plan_key = plan.withColumnRenamed("source", "s").withColumnRenamed("level", "l")
    ranked = (
        rows.join(plan_key, F.col("source").eqNullSafe(F.col("s")) & (F.col("level") == F.col("l")), "left").drop("s", "l", "level")
        .withColumn("certain", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("certain"))
        .withColumn("odds", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
        # A bucket is a range of odds, so buckets are in the order of the rank.
        .withColumn("bucket", F.floor(F.col("odds") / (1 + F.col("odds")) * BUCKETS).cast("int"))
    )
    ranked = settle(ranked, "ranked")
    of_bucket = (
        ranked.groupBy("source", "bucket").agg(
            F.sum(F.when(F.col("p") > 0, F.col("size")).otherwise(0)).alias("words"),
            F.sum(F.col("certain") * F.col("size")).alias("certain_words"),
            F.first("target").alias("target"),
        )
    )
    whole = Window.partitionBy("source")
    upto = whole.orderBy(F.col("bucket").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = F.col("target") - F.sum("certain_words").over(whole)
    of_bucket = settle(
        of_bucket.withColumn("rest", rest).withColumn("after", F.sum("words").over(upto))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "rest", (F.col("after") - F.col("words")).alias("before"), "after"),
        "buckets",
    )
    placed = ranked.join(of_bucket, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left")
    # Only in the bucket where the words run out does the order of single documents matter.
    crossing = (F.col("before") < F.col("rest")) & (F.col("after") > F.col("rest"))
    order = Window.partitionBy("source", "bucket", crossing).orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.where(crossing).withColumn("reached", F.col("before") + F.sum("size").over(order))
    sure = placed.where(~crossing | crossing.isNull()).withColumn("reached", F.col("after"))
    columns = ["row", "doc_id", "source", "size", "source_size", "target", "certain", "odds", "rest", "reached"]
    drawn = settle(edge.select(*columns).unionByName(sure.select(*columns)).withColumn(
        "drawn", F.coalesce((F.col("reached") <= F.col("rest")) & F.col("odds").isNotNull(), F.lit(False))
    ), "drawn")
    left = settle(
        drawn.groupBy("source").agg(
            F.first("rest", ignorenulls=True).alias("rest"), F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0)).alias("used")
        ).select(F.col("source").alias("s"), (F.col("rest") - F.col("used")).alias("left")), "left",
    )
    fillers = settle(_fillers(drawn.where("NOT drawn AND odds IS NOT NULL AND size > 0"), left), "fillers")
    filled = drawn.join(fillers.withColumn("fills", F.lit(True)), "row", "left")
    copies = (F.col("certain") + (F.col("drawn") | F.coalesce("fills", F.lit(False))).cast("long")).alias("copies")
    return filled.select("doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))
