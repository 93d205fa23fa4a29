"""Language-model scores by a hashed maximum-entropy model.

The probability of a word is that of its class, given what stands before it,
times that of the word in its class. Classes: the end of a text, each of the
``SINGLES`` most frequent words, and ``TAILS`` groups of the other words by a hash
of their last two bytes. The class is a softmax over weights of hashed features:
the class before, the two classes before (n-grams), the class two before, the last
frequent word further back, and that one with the class before (skips). Inside a
group the softmax has a bias only, whose maximum is the smoothed relative count.

A context is (class before, class two before, last frequent word), so the whole
corpus reduces to counts of (context, class): at most ``CELLS`` rows, whatever its
size. Training reads them in parts; every part gives the gradient and its
curvature, which are summed by blocks of weight rows in Spark. The driver gets one table a step.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from isobar.llm import words as W
from isobar.session import settle

SINGLES, TAILS = 31, 32
CLASSES = 1 + SINGLES + TAILS
CONTEXTS = CLASSES * CLASSES * (SINGLES + 1)
CELLS = CONTEXTS * CLASSES
#: Rows of the weight table that features are hashed to.
FEATURES = 1 << 13
#: Most frequent words whose counts every task holds; other words are joined with theirs.
FREQUENT = 1 << 16
#: Parts of a training step, steps, and the blocks of weight rows that its gradients are summed by.
PARTS, STEPS, BLOCKS = 8, 10, 16
RIDGE = 1.0

_SLOTS = 1 << 21
_BUFFER = 1 << 22


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 7, is 2 (null id: never)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _tail_class(tails: np.ndarray) -> np.ndarray:
    table = (W.mix(np.arange(65536, dtype=np.uint64) + np.uint64(7)) % np.uint64(TAILS)).astype(np.int32)
    return table[tails] + np.int32(1 + SINGLES)


def _words(batch: pa.RecordBatch):
    data, offsets = W.flat(batch.column("text"))
    for low, high in W.groups(offsets):
        at = offsets[low : high + 1]
        yield low, high, *W.tailed(data[at[0] : at[-1]], at - at[0])


def _count_words(batches):
    buffer, held = [], 0

    def flush():
        values = np.concatenate(buffer)
        value, at, count = np.unique(values["word"], return_index=True, return_counts=True)
        for low in range(0, len(value), 100_000):
            cut = slice(low, low + 100_000)
            yield pa.RecordBatch.from_arrays([
                pa.array(value[cut].view(np.int64)), pa.array(values["group"][at[cut]]), pa.array(count[cut]),
            ], ["word", "group", "count"])

    for batch in batches:
        for _, _, value, _, tails in _words(batch):
            both = np.empty(len(value), [("word", np.uint64), ("group", np.int32)])
            both["word"], both["group"] = value, _tail_class(tails)
            buffer.append(both)
            held += len(both)
            if held >= _BUFFER:
                yield from flush()
                buffer, held = [], 0
    if held:
        yield from flush()


class Lexicon:
    """The most frequent words: a direct table from hash to rank, and their counts.

    Where two words want one slot the more frequent one has it; the other is
    treated like a rare word.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        slots = (words & np.uint64(_SLOTS - 1)).astype(np.int64)
        self.words, self.counts = words, counts
        self.table = np.full(_SLOTS, -1, np.int32)
        self.table[slots[::-1]] = np.arange(len(words), dtype=np.int32)[::-1]

    def held(self) -> np.ndarray:
        return self.words[self.rank(self.words) >= 0]

    def rank(self, values: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(values), -1, np.int32)
        rank = self.table[(values & np.uint64(_SLOTS - 1)).astype(np.int64)]
        return np.where(self.words[rank] == values, rank, np.int32(-1))


def _contexts(rank: np.ndarray, tails: np.ndarray, first: np.ndarray):
    """Class and context of all tokens of some texts, each with its end; where the words and ends are."""
    texts = len(first) - 1
    sizes = np.diff(first)
    text_of = np.repeat(np.arange(texts), sizes)
    at = np.arange(len(rank)) + text_of
    ends = first[1:] + np.arange(texts)
    classes = np.zeros(len(rank) + texts, np.int32)
    single = (rank >= 0) & (rank < SINGLES)
    classes[at] = np.where(single, rank + 1, _tail_class(tails))
    begins = first[:-1] + np.arange(texts)
    begin_of = np.repeat(begins, sizes + 1)
    place = np.arange(len(classes))

    def before(steps, values):
        shifted = np.zeros(len(values), values.dtype)
        shifted[steps:] = values[:-steps]
        return np.where(place - steps >= begin_of, shifted, 0)

    frequent = (classes >= 1) & (classes <= SINGLES)
    last = np.maximum.accumulate(np.where(frequent, place, -1))
    last = before(3, last + 1) - 1
    skip = np.where(last >= begin_of, classes[np.maximum(last, 0)], 0)
    context = (before(1, classes) * CLASSES + before(2, classes)) * (SINGLES + 1) + skip
    return classes, context.astype(np.int64), at, ends


def _count_cells(lexicon):
    def run(batches):
        counts = np.zeros(CELLS, np.int32)
        for batch in batches:
            for _, _, value, first, tails in _words(batch):
                classes, context, _, _ = _contexts(lexicon.value.rank(value), tails, first)
                cell, count = np.unique(context * CLASSES + classes, return_counts=True)
                counts[cell] += count.astype(np.int32)
        cells = np.flatnonzero(counts)
        for low in range(0, len(cells), 100_000):
            cut = cells[low : low + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cut // CLASSES), pa.array((cut % CLASSES).astype(np.int32)), pa.array(counts[cut].astype(np.int64))],
                ["context", "class", "count"],
            )
    return run


def _features(context: np.ndarray) -> np.ndarray:
    """The rows of the weight table that are active in each context; row 0 is the bias."""
    skip = context % (SINGLES + 1)
    two = context // (SINGLES + 1) % CLASSES
    one = context // (SINGLES + 1) // CLASSES
    parts = [one, one * CLASSES + two, two, skip, one * (SINGLES + 1) + skip]
    hashed = [
        (W.mix((p + (i << 32)).astype(np.uint64)) % np.uint64(FEATURES - 1)).astype(np.int64) + 1
        for i, p in enumerate(parts)
    ]
    return np.stack([np.zeros(len(context), np.int64), *hashed], axis=1)


def _log_softmax(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    features = _features(context)
    scores = weights[features[:, 0]].copy()
    for j in range(1, features.shape[1]):
        scores += weights[features[:, j]]
    scores -= scores.max(axis=1, keepdims=True)
    scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
    return scores


def _gradient(weights):
    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        context, cls, count = (table.column(c).to_numpy() for c in ("context", "class", "count"))
        seen, which = np.unique(context, return_inverse=True)
        gradient = np.zeros((FEATURES, CLASSES))
        curvature = np.zeros((FEATURES, CLASSES))
        observed = np.zeros((len(seen), CLASSES))
        np.add.at(observed, (which, cls), count)
        for low in range(0, len(seen), 8192):
            own = observed[low : low + 8192]
            p = np.exp(_log_softmax(weights.value, seen[low : low + 8192]))
            expected = p * own.sum(axis=1, keepdims=True)
            features = _features(seen[low : low + 8192])
            for j in range(features.shape[1]):
                order = np.argsort(features[:, j], kind="stable")
                rows, begin = np.unique(features[order, j], return_index=True)
                gradient[rows] += np.add.reduceat((own - expected)[order], begin, axis=0)
                curvature[rows] += np.add.reduceat(np.maximum(expected, own)[order], begin, axis=0)
        for block in range(BLOCKS):
            yield _block(block, *(t[_rows(block)].astype(np.float32) for t in (gradient, curvature)))
    return run


_BLOCK = "block int, gradient binary, curvature binary"


def _rows(block: int) -> slice:
    size = FEATURES // BLOCKS
    return slice(block * size, (block + 1) * size)


def _block(block: int, gradient: np.ndarray, curvature: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([gradient.tobytes()]), pa.array([curvature.tobytes()])], ["block", "gradient", "curvature"]
    )


def _sum_blocks(batches):
    """Gradients and curvatures of a block of weight rows, summed over the parts."""
    sums = {}
    for batch in batches:
        for block, *both in zip(*(batch.column(i).to_pylist() for i in range(3))):
            tables = [np.frombuffer(t, np.float32).reshape(-1, CLASSES) for t in both]
            sums[block] = [a + b for a, b in zip(sums[block], tables)] if block in sums else tables
    for block, (gradient, curvature) in sums.items():
        yield _block(block, gradient, curvature)


def _trained(cells: DataFrame) -> np.ndarray:
    """Weights after ``STEPS`` updates; each is one pass over the counts, in at most ``PARTS`` parts."""
    context = cells.sparkSession.sparkContext
    prior = np.ones(CLASSES)
    for row in cells.groupBy("class").agg(F.sum("count").alias("n")).collect():
        prior[row["class"]] += row["n"]
    weights = np.zeros((FEATURES, CLASSES), np.float32)
    weights[0] = np.log(prior / prior.sum())
    active = _features(np.zeros(1, np.int64)).shape[1]
    parts = cells.coalesce(PARTS)
    for _ in range(STEPS):
        shared = context.broadcast(weights)
        gradient = np.zeros((FEATURES, CLASSES))
        curvature = np.zeros((FEATURES, CLASSES))
        for row in parts.mapInArrow(_gradient(shared), _BLOCK).repartition(BLOCKS, "block").mapInArrow(_sum_blocks, _BLOCK).collect():
            gradient[_rows(row.block)] += np.frombuffer(row.gradient, np.float32).reshape(-1, CLASSES)
            curvature[_rows(row.block)] += np.frombuffer(row.curvature, np.float32).reshape(-1, CLASSES)
        # Features overlap, so each takes its share of the step that its own curvature allows.
        step = (gradient - RIDGE * weights) / (active / 2 * curvature + RIDGE)
        weights = (weights + np.clip(step, -1, 1)).astype(np.float32)
        shared.destroy()
    return weights


_tables: dict[str, np.ndarray] = {}


def _table(model) -> np.ndarray:
    """log10 of each class's probability in each context, kept for the next task of this worker."""
    key = model.value["key"]
    if key not in _tables:
        _tables.clear()
        table = np.empty((CONTEXTS, CLASSES), np.float32)
        for low in range(0, CONTEXTS, 8192):
            context = np.arange(low, min(CONTEXTS, low + 8192))
            table[low : low + 8192] = _log_softmax(model.value["weights"], context) / np.log(10)
        _tables[key] = table
    return _tables[key]


def _score(lexicon, model):
    def run(batches):
        table, inner = _table(model), model.value["inner"]
        logs = np.log10(lexicon.value.counts + 1.0)
        end_log = model.value["end_log"]
        for batch in batches:
            for low, high, value, first, tails in _words(batch):
                rank = lexicon.value.rank(value)
                classes, context, at, ends = _contexts(rank, tails, first)
                known = rank >= 0
                log = np.where(known, logs[np.maximum(rank, 0)] if len(logs) else 0.0, 0.0)
                base = np.zeros(len(classes))
                base[at] = log
                base[ends] = end_log
                own = table[context, classes].astype(np.float64)
                grouped = classes[at] > SINGLES
                own[at] += np.where(grouped, log, 0.0) - inner[classes[at]]
                begins = first[:-1] + np.arange(high - low)
                rare = ~known
                sizes = np.concatenate(([0], np.cumsum(rare)))[first]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(low, high - low),
                    pa.array(np.diff(first) + 1),
                    pa.array(np.add.reduceat(base, begins)),
                    pa.array(np.add.reduceat(own, begins)),
                    pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(value[rare].view(np.int64))),
                ], ["doc_id", "n_tokens", "base", "own", "rare"])
    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on all rows that are not held out. Null and empty texts have one
    token, their end. Words that training has not seen share one place in their
    group. Without any training rows every probability inside a group is that of
    an unseen word. Repeated rows are trained on and scored as often as they come;
    other columns are ignored.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    docs = docs.select("doc_id", "text")
    train = docs.where(~held_out(F.col("doc_id")))
    vocabulary = settle(
        train.mapInArrow(_count_words, "word long, group int, count long")
        .groupBy("word").agg(F.first("group").alias("group"), F.sum("count").alias("count")),
        "vocabulary",
    )
    texts = train.count()
    size, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    size, total = size + (texts > 0), total + texts
    top = vocabulary.orderBy(F.desc("count"), "word").limit(FREQUENT).toPandas()
    lexicon = Lexicon(top["word"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64))
    shared = context.broadcast(lexicon)
    cells = settle(
        train.mapInArrow(_count_cells(shared), "context long, class int, count long")
        .groupBy("context", "class").agg(F.sum("count").alias("count")),
        "cells",
    )
    # A word that lost its slot is rare to every task, and belongs to its group.
    own = lexicon.words[:SINGLES]
    singles = [int(w) for w in own[lexicon.rank(own) >= 0].view(np.int64)]
    inner = np.zeros(CLASSES)
    groups = vocabulary.where(~F.col("word").isin(singles)).groupBy("group").agg(F.sum("count").alias("n"), F.count("*").alias("v"))
    for row in groups.collect():
        inner[row["group"]] = np.log10(row["n"] + row["v"] + 1)
    model = context.broadcast({
        "key": uuid.uuid4().hex, "weights": _trained(cells), "inner": inner, "end_log": np.log10(texts + 1.0),
    })
    scored = settle(
        docs.mapInArrow(_score(shared, model), "doc_id long, n_tokens long, base double, own double, rare array<long>")
        .withColumn("row", F.monotonically_increasing_id()),
        "scored",
    )
    model.destroy()
    shared.destroy()
    # The slots are the same here as in the tasks, so a rare word is never among those that tasks hold.
    rare = scored.select("row", F.explode("rare").alias("word")).join(vocabulary.select("word", "count"), "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("count", F.lit(0)) + F.lit(1.0))).alias("log"),
        F.count(F.when(F.col("count").isNull(), 1)).alias("unknown"),
    )
    log = F.coalesce("log", F.lit(0.0))
    unseen_end = 0 if texts else 1
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_tokens") - F.coalesce("unknown", F.lit(0)) - unseen_end).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * float(np.log10(total + size + 1))).alias("base_score"),
        (F.col("own") + log).alias("score"),
    )
