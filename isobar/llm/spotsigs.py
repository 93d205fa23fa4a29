"""SpotSigs fingerprints of documents, in DataFrame functions only.

A spot is a stretch of text behind a common word, the anchor. Its signature is the
hash of the chain of the ``CHAIN`` content words that follow, anchors left out. A
document's set of signatures is its fingerprint; documents are alike as the Jaccard
similarity of their sets. The start of a text is an anchor too, and so that texts without common words,
such as lists, have spots as well, one of ``SPREAD`` content words begins a spot, by a hash of the
word. All texts are read by these rules, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from isobar.session import settle

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is that for with it are was be this on "
    "der die und das von den ist mit im zu ein des "
    "le la les de et un une est en du que pour "
    "el los las y se por con para del una"
).split()
CHAIN = 2
SPREAD = 8


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The distinct signatures of a text (array<int>); empty if it has no words."""
    all_words = words(text)
    begins = lambda w: F.crc32(w.cast("binary")) % SPREAD == 0
    marked = F.array_join(F.transform(
        all_words, lambda w: F.when(w.isin(ANCHORS), "\n").when(begins(w), F.concat(F.lit("\n"), w)).otherwise(w)
    ), " ")
    # Anchors in a row are one.
    spots = F.filter(F.transform(F.split(marked, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    # A text of common words only has no content word, and is taken by its words.
    pieces = F.when(F.size(spots) > 0, spots).otherwise(all_words)
    return F.transform(F.array(pieces), lambda p: F.array_distinct(F.transform(p, lambda s, i: F.hash(
        F.substring_index(F.concat_ws(" ", s, *(F.get(p, i + k) for k in range(1, chain))), " ", chain)
    ))))[0]


def fingerprint(spots: Column) -> Column:
    """A set of signatures as text: base64 of its sorted 32-bit values."""
    return F.base64(F.unhex(F.array_join(F.transform(F.array_sort(spots), lambda s: F.lpad(F.hex(s.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; two empty sets are alike.

    Sets whose sizes alone keep them below ``least`` are not compared, and have 0.
    """
    na, nb = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    pruned = (na == 0) | (nb == 0) | (F.least(na, nb) < least * F.greatest(na, nb))
    return F.when((na == 0) & (nb == 0), 1.0).when(pruned, 0.0).otherwise(both / (na + nb - both))


def _keys() -> list[Column]:
    """Two hashes that tell a row (doc_id, text) from all others, and are never null."""
    return [F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("k1"), F.xxhash64("text").alias("k2")]


def _circle(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n, copies, p1, p2, take) of each different row (doc_id, text).

    Rows stand in a circle by doc_id and k2; p1 and p2 are the keys of the one before,
    ``take`` how many of this row's first code points it asks for. Row numbers come from
    range partitions: the number in the partition, and the rows of the partitions
    before, of which there is one sum each.
    """
    length = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n")
    narrow = docs.select("doc_id", *_keys(), length).groupBy("doc_id", "k1", "k2", "n").agg(F.count("*").alias("copies"))
    ranged = narrow.repartitionByRange("doc_id", "k2").sortWithinPartitions("doc_id", "k2")
    numbered = ranged.withColumn("number", F.monotonically_increasing_id()).withColumns({
        "part": F.shiftright("number", 33), "at": F.col("number").bitwiseAND(F.lit((1 << 33) - 1)),
    })
    numbered = settle(numbered, "numbered")
    parts = numbered.groupBy("part").agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = settle(parts.select(
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), F.sum("rows").over(Window.partitionBy()).alias("total")
    ), "parts")
    ranked = numbered.join(parts, "part").select(
        "doc_id", "k1", "k2", "n", "copies", (F.col("base") + F.col("at")).alias("rank"), "total"
    )
    previous = ranked.select(
        F.pmod(F.col("rank") + 1, F.col("total")).alias("rank"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.floor(F.col("n") / 4).cast("int").alias("take"),
    )
    return settle(ranked.join(previous, "rank").drop("rank", "total"), "circle")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 4) code points replaced
    by the first as many (or all) of the next document: that of the next doc_id, after
    the last the first; null ids come first, and rows that share a doc_id in the order
    of a hash of their texts. Equal rows are one document, and each has its result. A
    null text is empty; a text without words has an empty fingerprint. Other columns
    are ignored.

    Texts are shuffled once, to meet their place in the circle; what the row before
    needs of them goes on from there: at most a quarter of its length, and the set.
    """
    circle = _circle(docs)
    # Both uses of the rows have these columns, so they share one exchange.
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *_keys())
    placed = rows.join(circle, ["k1", "k2"])
    heads = placed.select("p1", "p2", F.substring("text", F.lit(1), F.col("take")).alias("head"), signatures(F.col("text")).alias("next_spots"))
    if not circle.where("copies > 1").isEmpty():
        heads = heads.dropDuplicates(["p1", "p2"])
    own = placed.select("doc_id", "text", "k1", "k2", "n")
    joined = own.join(heads, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")))
    kept = (F.col("n") - F.floor(F.col("n") / 4)).cast("int")
    edited = joined.select(
        "doc_id", "n", "next_spots", signatures(F.col("text")).alias("spots"),
        F.concat(F.substring("text", F.lit(1), kept), F.col("head")).alias("edited"),
    )
    both = edited.select(
        "doc_id", "n", "next_spots", "spots", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("edited")).alias("edited_spots")
    )
    return both.select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256", fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def near_classes(docs: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id) and pairs (a, b, similarity) of classes of at least ``threshold``, a < b.

    Documents with equal sets are one class, named by its least doc_id; rows without
    words, text or id are in none. A class is compared with classes that share one of
    its rarest signatures, as many as a pair of the threshold cannot all differ in, and
    whose set lengths fall in the same or the next partition: a partition spans a
    factor of ``1 / threshold``, and lengths further apart cannot be similar enough.
    """
    sets = docs.where("doc_id IS NOT NULL").select("doc_id", F.array_sort(signatures(F.col("text"))).alias("spots")).where("size(spots) > 0")
    keyed = settle(sets.withColumn("key", F.sha2(F.array_join("spots", ","), 256)), "spots")
    named = keyed.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    members = keyed.select("doc_id", "key").join(named, "key").select("doc_id", "class_id")
    reps = settle(keyed.join(named, (keyed["key"] == named["key"]) & (F.col("doc_id") == F.col("class_id")), "left_semi").dropDuplicates(["key"]), "classes")
    single = reps.select("doc_id", F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    often = single.groupBy("spot").agg(F.count("*").alias("often"))
    n = F.col("n")
    prefix = n - F.ceil(n * threshold) + 1
    # Rarest first; a text's own signatures are gathered, of which there are at most as many as words.
    rare = single.join(often, "spot").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "spot"))).alias("s"))
    cells = rare.select(
        "doc_id", "n", F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / threshold))).alias("part"),
        F.explode(F.slice("s", F.lit(1), prefix.cast("int"))["spot"]).alias("spot"),
    )
    cells = settle(cells, "cells")
    left = cells.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "spot", F.explode(F.array(F.col("part") - 1, "part", F.col("part") + 1)).alias("part"))
    right = cells.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "spot", "part")
    pairs = left.join(right, ["spot", "part"]).where(
        (F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    ).select("a", "b").distinct()
    value = reps.select(F.col("doc_id").alias("a"), F.col("spots").alias("x")), reps.select(F.col("doc_id").alias("b"), F.col("spots").alias("y"))
    compared = pairs.join(value[0], "a").join(value[1], "b").select("a", "b", likeness(F.col("x"), F.col("y"), threshold).alias("similarity"))
    return members, compared.where(F.col("similarity") >= threshold)
