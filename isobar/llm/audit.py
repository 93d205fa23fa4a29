"""Interaction audit of quality filters: what each removes, in every order of applying them.

Five filters are taken: A few words, B few distinct words, C many capitals, D a stray mark,
E text that a smaller doc_id has as well. A row's failures are bits of one number. Those of A to
D come from its own text. E is an existential self-join: a left-semi join on hash, exact text and
smaller doc_id. The rows it marks and the other failures are put together by union, and counted
by part and combination of bits: 32 numbers a part, from which all orders follow.

Only rows whose hash occurs more than once carry their texts to that join, and those that share a bit with such a
hash in a broadcast bitmap of fixed size. The other side has each such text once, with its least doc_id, and once more for every ``HOT`` rows that share
it: its rows are dealt over that many keys.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from isobar.session import settle

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
STRAY = r"[#$%&*|]"
#: Rows of one text that share a task.
HOT = 20_000
#: Bitmaps of 4 KB, which are all that is broadcast.
BITMAPS, _BITS = 2048, 32768

_E = 1 << FILTERS.index("E")
_ORDERS = list(permutations(range(len(FILTERS))))


def own_failures(text: Column) -> Column:
    """The bits of A to D of a text (null: empty)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))

    def bits(words: Column) -> Column:
        tests = [
            F.size(words) < LEAST_WORDS,
            100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_PERCENT * F.size(words).cast("long"),
            100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"),
            text.rlike(STRAY),
        ]
        return sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests[1:], 1)), F.when(tests[0], 1).otherwise(0))

    # As a lambda's variable the array of words is made once, not once for each test.
    return F.element_at(F.transform(F.array(words), bits), 1)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("hash"))


def _place(hashed: Column) -> tuple[Column, Column]:
    """The bitmap and the bit in it that a hash has."""
    place = F.pmod(F.xxhash64(hashed), F.lit(BITMAPS * _BITS))
    return F.floor(place / _BITS), place % _BITS


def _might_be_in(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The ``rows`` whose hash is among ``hashes``, and few others; no row is moved for it."""
    bitmap, bit = _place(F.col("hash"))
    bitmaps = hashes.groupBy(bitmap.alias("bitmap")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    met = rows.withColumn("bitmap", bitmap).join(F.broadcast(bitmaps), "bitmap")
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, 1)), 16, 10).cast("long")
    return met.where(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("long")) != 0).select(rows.columns)


def repeated(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(doc_id, part, hash) of each row of ``docs`` whose text a row of a smaller doc_id has.

    ``hashes`` has the hash of each row's text, as ``_texts`` makes it.
    """
    shared = hashes.groupBy("hash").agg(F.count("*").alias("rows"), F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
    shared = settle(shared.where("a < z").select("hash", F.ceil(F.col("rows") / HOT).cast("int").alias("salts")), "shared")
    held = _might_be_in(_texts(docs).where("doc_id IS NOT NULL"), shared).join(shared, "hash")
    least = (
        held.groupBy("hash", "salts", "text").agg(F.min("doc_id").alias("least"))
        .select("hash", "text", "least", F.explode(F.sequence(F.lit(1), "salts")).alias("salt"))
    )
    dealt = held.withColumn("salt", (F.pmod(F.xxhash64("doc_id"), F.col("salts")) + 1).cast("int"))
    one, other = dealt.alias("one"), least.alias("other")
    same = (
        (F.col("one.hash") == F.col("other.hash")) & (F.col("one.salt") == F.col("other.salt"))
        & (F.col("one.text") == F.col("other.text")) & (F.col("other.least") < F.col("one.doc_id"))
    )
    return one.join(other, same, "left_semi").select("doc_id", "part", "hash")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and combination of failures (``mask``): rows (n), those labelled good and toxic."""
    rows = settle(_texts(docs).select("doc_id", "part", "hash", own_failures(F.col("text")).alias("bits")), "failures")
    marks = repeated(docs, rows).select("doc_id", "part", "hash", F.lit(0).alias("bits"), F.lit(_E).alias("mark"), F.lit(0).alias("n"))
    own = rows.withColumns({"mark": F.lit(0), "n": F.lit(1)})
    # Rows of one doc_id, part and text fail alike.
    failed = own.unionByName(marks).groupBy("doc_id", "part", "hash").agg(
        (F.max("bits") + F.max("mark")).alias("mask"), F.sum("n").alias("n")
    ).select("doc_id", "part", "mask", "n")
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # A null id has no label and would only meet others of its kind in one task.
    found = failed.where("doc_id IS NOT NULL").join(marked, "doc_id", "left").unionByName(
        failed.where("doc_id IS NULL"), allowMissingColumns=True
    )
    return found.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.col("n") * F.col("good")), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.col("n") * F.col("toxic")), F.lit(0)).alias("toxic"),
    )


def _steps() -> Column:
    """All orders and their steps: the order, the step, the filter's bit, the bits of those before."""
    steps = [
        {"filter_order": "".join(FILTERS[x] for x in order), "step": at + 1, "bit": 1 << i, "before": sum(1 << x for x in order[:at])}
        for order in _ORDERS for at, i in enumerate(order)
    ]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` has doc_id, text and lang; ``labels`` doc_id, quality and toxic. A null text is an empty one,
    a null lang the part of the empty string. Every row counts, repeated ones as often as they come; equal rows
    of one doc_id are no reason for E, and a row without an id neither fails E nor makes others fail it. Of
    several labels of a doc_id the largest counts; documents without one lose none. An empty table has no
    parts. Other columns are ignored.
    """
    cells = combinations(docs, labels).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")
    )
    # At most 32 cells a part; every part meets every step without a join.
    steps = cells.select("part", "cells", F.inline(_steps()))
    bit, before = F.col("bit"), F.col("before")

    def total(name: str, chosen) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(chosen(c["mask"]), c[name]).otherwise(0))

    def here(mask: Column) -> Column:
        return (mask.bitwiseAND(bit) != 0) & (mask.bitwiseAND(before) == 0)

    # A document's removal falls to each of the filters it fails in an equal share of the orders.
    shares = F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(
        c["mask"].bitwiseAND(bit) != 0, (c["n"] * len(_ORDERS) / F.bit_count(c["mask"])).cast("long")
    ).otherwise(0))
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        shares.alias("shapley"),
    )
