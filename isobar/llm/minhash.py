"""Near-duplicates by b-bit MinHash.

``ROWS * BANDS`` minima per document make band keys; the lowest ``BITS`` bits of
each minimum are packed into longs, from which pairs that meet in a band get a
collision-corrected estimate of their similarity. Pairs with a high enough
estimate are confirmed on the full sets of shingles.

A pair of similarity 0.75 meets in no band with a probability of
(1 - 0.75**4)**32 = 6e-6, and the estimate misses it with about the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from isobar.llm import words as W
from isobar.llm.components import components
from isobar.session import settle

WIDTH = 5
ROWS, BANDS, BITS = 4, 32, 4
#: Minima and bits of the longer signatures of documents whose band keys stay in doubt.
FINE_MINIMA, FINE_BITS = 1024, 2
#: Standard deviations that an estimate may fall below the threshold.
DEVIATIONS = 4.5

_MINIMA = ROWS * BANDS
_SIGNED = "doc_id long, n_shingles long, low long, high long, bands array<long>, bits array<long>"


def _minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The least value of each non-empty set under each of ``n`` hash functions, mixed."""
    factors = W.mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    minima = np.empty((len(sets), n), np.uint64)
    block = np.empty((256, n), np.uint64)
    for i, values in enumerate(sets):
        least = minima[i]
        least[:] = np.uint64(2**64 - 1)
        for at in range(0, len(values), 256):
            part = values[at : at + 256]
            np.multiply(part[:, None], factors, out=block[: len(part)])
            np.minimum(least, block[: len(part)].min(axis=0), out=least)
    return W.mix(minima)


def _packed(minima: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits of each minimum, one bit plane after another."""
    planes = [
        np.packbits(((minima >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64)
        for bit in range(bits)
    ]
    return np.concatenate(planes, axis=1)


def _signature(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed bits of each non-empty set."""
    minima = _minima(sets, _MINIMA)
    order = W.mix(np.arange(100, 100 + ROWS, dtype=np.uint64)) | np.uint64(1)
    bands = (minima.reshape(-1, BANDS, ROWS) * order).sum(axis=2, dtype=np.uint64)
    bands = W.mix(bands + W.mix(np.arange(BANDS, dtype=np.uint64)))
    return bands, _packed(minima, BITS)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = W.flat(batch.column("text"))
    for low, high in W.groups(offsets):
        at = offsets[low : high + 1]
        values, first = W.hashes(data[at[0] : at[-1]], at - at[0])
        yield low, high, [W.shingles(values[a:b], width) for a, b in zip(first, first[1:])]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(values.astype(np.uint64).view(np.int64)))


def _sign(width: int):
    def run(batches):
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for low, high, sets in _sets(batch, width):
                full = [s for s in sets if len(s)]
                bands, bits = _signature(full) if full else ([], [])
                where = iter(range(len(full)))
                rows = [next(where) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(low, high - low),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                    pa.array(np.array([W.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                    _lists([none if r is None else bands[r] for r in rows]),
                    _lists([none if r is None else bits[r] for r in rows]),
                ], ["doc_id", "n_shingles", "low", "high", "bands", "bits"])
    return run


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Size and digest of each document's set of shingles, its band keys and packed bits.

    A null or empty text, or one of spaces only, has no shingles and no bands.
    """
    return docs.select("doc_id", "text").mapInArrow(_sign(width), _SIGNED)


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, shingles): the full sorted set of each document."""
    def run(batches):
        for batch in batches:
            for low, high, sets in _sets(batch, width):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), _lists(sets)], ["doc_id", "shingles"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def _fine(batches):
    for batch in batches:
        column = batch.column("shingles")
        values = column.flatten().to_numpy().view(np.uint64)
        ends = np.cumsum(pc.list_value_length(column).to_numpy())
        sets = np.split(values, ends[:-1])
        for low in range(0, len(sets), 512):
            bits = _packed(_minima(sets[low : low + 512], FINE_MINIMA), FINE_BITS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, 512), _lists(list(bits))], ["doc_id", "fine"])


def estimate(a: Column, b: Column, minima: int = _MINIMA, bits: int = BITS) -> Column:
    """Similarity of two packed signatures by bit counts, corrected for chance collisions."""
    longs = minima // 64
    differing = F.lit(0)
    for word in range(longs):
        differs = F.lit(0).cast("long")
        for plane in range(bits):
            at = plane * longs + word
            differs = differs.bitwiseOR(a[at].bitwiseXOR(b[at]))
        differing = differing + F.bit_count(differs)
    chance = 2.0**-bits
    return (1 - differing / F.lit(float(minima)) - chance) / (1 - chance)


def least_estimate(threshold: float, minima: int = _MINIMA, bits: int = BITS) -> float:
    """What the estimate of a pair at the threshold reaches, but for ``DEVIATIONS``."""
    chance = 2.0**-bits
    agree = threshold + (1 - threshold) * chance
    return threshold - DEVIATIONS * (agree * (1 - agree) / minima) ** 0.5 / (1 - chance)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """Of pairs (u, v), those whose full sets are similar enough."""
    a = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    joined = pairs.join(a, "u").join(b, "v").select("u", "v", both.alias("both"), (F.size("a") + F.size("b")).alias("total"))
    return settle(joined.where(100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).select("u", "v"), label)


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents with 100 * intersection >= ``percent`` * union of their sets of
    ``width``-word shingles are linked; component_id is the least id reachable.
    Documents without words are linked with nothing. A row whose doc_id is null
    takes no part: its component_id is null, and it is kept. Rows that share a
    doc_id are one node. Other columns are ignored.

    Documents with equal sets become one class first, named by its least id.
    Then every band key links its classes to its least class, and those links
    that the full sets confirm give components. Only keys that still hold several
    components are looked at again, each class outside the least class's
    component against every class of another component, by a longer signature: with
    that no link between components is left out, and a group of copies costs one
    comparison per copy.
    """
    signed = settle(signatures(docs, width), "signatures")
    keyed = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    digest = ["low", "high", "n_shingles"]
    classes = keyed.groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    member_of = settle(keyed.select("doc_id", *digest).join(classes, digest).select("doc_id", "rep"), "classes")
    chosen = keyed.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *digest], "left_semi")

    keys = chosen.select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last")
    members = settle(keys.join(shared.drop("last"), "key"), "buckets")
    involved = members.select("doc_id").distinct()
    bits = settle(chosen.join(involved, "doc_id", "left_semi").select("doc_id", "bits"), "bits")
    sets = settle(shingle_sets(docs.join(involved, "doc_id", "left_semi"), width), "sets")
    least = least_estimate(percent / 100)

    stars = members.where("doc_id <> hub").select(F.col("hub").alias("u"), F.col("doc_id").alias("v")).distinct()
    hinted = (
        stars.join(bits.select(F.col("doc_id").alias("u"), F.col("bits").alias("a")), "u")
        .join(bits.select(F.col("doc_id").alias("v"), F.col("bits").alias("b")), "v")
        .where(estimate(F.col("a"), F.col("b")) >= least).select("u", "v")
    )
    links = _confirmed(hinted, sets, percent, "links")
    # Links of documents with equal digests join classes that share an id.
    same = member_of.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = components(links)

    placed = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")
    )
    open_keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    hubs = found.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    left = settle(
        placed.join(open_keys.select("key"), "key", "left_semi").join(hubs, "hub", "left")
        .withColumn("settled", F.coalesce("hub_component", "hub") == F.col("component")).drop("hub_component"), "open",
    )
    doubted = left.select("doc_id").distinct()
    fine = settle(sets.join(doubted, "doc_id", "left_semi").mapInArrow(_fine, "doc_id long, fine array<long>"), "fine")
    known = fine.join(chosen.select("doc_id", "bands", "n_shingles"), "doc_id")
    left = left.join(known, "doc_id")
    one, other = left.where("NOT settled").alias("one"), left.alias("other")
    least = least_estimate(percent / 100, FINE_MINIMA, FINE_BITS)
    rest = one.join(
        other,
        (F.col("one.key") == F.col("other.key"))
        & (F.col("one.component") != F.col("other.component"))
        & (F.col("other.doc_id") != F.col("other.hub"))
        & (F.col("other.settled") | (F.col("one.doc_id") < F.col("other.doc_id")))
        & (100 * F.least("one.n_shingles", "other.n_shingles") >= percent * F.greatest("one.n_shingles", "other.n_shingles"))
        & (estimate(F.col("one.fine"), F.col("other.fine"), FINE_MINIMA, FINE_BITS) >= least)
        # A pair that shares several bands counts in the first of them.
        & (F.array_position(F.zip_with("one.bands", "other.bands", lambda x, y: x == y), True) == F.col("one.band") + 1),
    ).select(F.col("one.doc_id").alias("u"), F.col("other.doc_id").alias("v"))
    links = links.unionByName(_confirmed(rest, sets, percent, "links")).unionByName(same)
    found = settle(components(links), "components")
    return (
        signed.select("doc_id", "n_shingles")
        .join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
