"""Language of texts by a linear-chain conditional random field over their words.

Every word has a label. Its score for a label comes from hashed features: prefixes and suffixes,
n-grams of bytes, and lexicons (whether nearly all training documents that hold the word are of one language); the
score of two neighbouring words from learned transitions. Forward-backward gives the probability of each
label of each word, in texts that switch between languages too. A document's language has the largest
share of its words' probability.

The chain runs over whole texts. All texts of a batch are one chain in which a first word's transition
forgets what stood before. It is cut into blocks; products of transition and emission matrices over each
block come from all blocks at once, what enters a block from one walk over the products, and the rest again from
all blocks at once. That is exact for any length.
"""

from __future__ import annotations

import pickle
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from isobar.llm import words as W

#: Documents that the fit looks at, and runs of words taken from each, evenly spread over its text.
DOCUMENTS, RUNS, RUN = 4000, 6, 8
#: Runs of different documents in one training sequence, in which languages switch.
SWITCHES = 6
FEATURES = 1 << 17
STEPS, RATE, RIDGE = 60, 0.2, 1e-4
#: A word is in a language's lexicon if it stands in so many documents of the sample, this share of them of the language.
LEAST, SHARE = 3, 0.8
UNKNOWN = "und"
BLOCK = 64
#: Words whose scores a worker remembers.
WORDS = 1_000_000

_PREFIXES, _SUFFIXES, _GRAMS = (1, 2, 3), (1, 2, 3, 4), (1, 2, 3, 4)
_ORDER = W.mix(np.arange(301, 301 + 16, dtype=np.uint64)) | np.uint64(1)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2 (null id: never)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# --- features -----------------------------------------------------------------

class Words(NamedTuple):
    """Different words: their hashes, their bytes one after another, and where each begins (one more at the end)."""

    hash: np.ndarray
    data: np.ndarray
    first: np.ndarray


def _split(data: np.ndarray, offsets: np.ndarray):
    """The different words of some rows, the word at each place, and each row's first place (one more at the end)."""
    starts, ends, values, first = W.spans(data, offsets, W.PUNCTUATION_TABLE)
    seen, where, which = np.unique(values, return_index=True, return_inverse=True)
    sizes = ends[where] - starts[where]
    at = np.repeat(starts[where] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    folded = data[at]
    folded = np.where((folded >= 65) & (folded <= 90), folded + 32, folded).astype(np.uint8)
    return Words(seen, folded, np.concatenate(([0], np.cumsum(sizes)))), which, first


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, and the word that each belongs to."""
    n = len(words.hash)
    # A zero byte stands before and behind each word.
    sizes = np.diff(words.first) + 2
    first = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint64)
    data[np.arange(len(words.data)) + np.repeat(2 * np.arange(n) + 1, sizes - 2)] = words.data.astype(np.uint64) + np.uint64(1)
    of = np.repeat(np.arange(n), sizes)
    parts, owners = [], []

    def add(kind: int, at: np.ndarray, size: int) -> None:
        key = np.full(len(at), kind, np.uint64)
        for i in range(size):
            key += data[at + i] * _ORDER[i]
        parts.append((W.mix(key * _ORDER[15]) % np.uint64(FEATURES)).astype(np.int64))
        owners.append(of[at])

    for size in _GRAMS:
        at = np.arange(len(data) - size + 1) if len(data) >= size else np.zeros(0, np.int64)
        add(size, at[of[at] == of[at + size - 1]] if len(at) else at, size)
    for size in _PREFIXES:
        add(100 + size, (first + 1)[sizes - 2 >= size], size)
    for size in _SUFFIXES:
        add(200 + size, (first + sizes - 1 - size)[sizes - 2 >= size], size)
    return np.concatenate(parts), np.concatenate(owners)


# --- the chain ----------------------------------------------------------------

def posteriors(scores: np.ndarray, fresh: np.ndarray, start: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Probabilities of all labels at each place of a chain, and with ``pairs`` summed ones of neighbours and of starts.

    ``scores``: log potentials (places, labels); ``fresh``: places whose label follows from ``start`` and not from the one
    before; ``start``, ``moves``: log potentials. The first place is fresh.
    """
    n, labels = scores.shape
    blocks = -(-n // BLOCK)
    emitted = np.zeros((blocks * BLOCK, labels))
    emitted[:n] = scores - scores.max(axis=1, keepdims=True)
    emitted = np.exp(emitted).reshape(blocks, BLOCK, labels)
    new = np.ones(blocks * BLOCK, bool)
    new[:n] = fresh
    new = new.reshape(blocks, BLOCK)
    begin, move = np.exp(start - start.max()), np.exp(moves - moves.max())

    def step(now: np.ndarray, t: int) -> np.ndarray:
        """Rows of masses (…, labels) carried to place ``t`` of their blocks, scaled to a sum of one."""
        again = new[:, t].reshape(-1, *[1] * (now.ndim - 1))
        carried = np.where(again, now.sum(axis=-1, keepdims=True) * begin, now @ move)
        return carried * emitted[:, t].reshape(blocks, *[1] * (now.ndim - 2), labels)

    product = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
    for t in range(BLOCK):
        product = step(product, t)
        product /= product.sum(axis=(1, 2), keepdims=True)
    entering, leaving = np.empty((blocks, labels)), np.empty((blocks, labels))
    now = np.full(labels, 1 / labels)
    for i in range(blocks):
        entering[i] = now
        now = now @ product[i]
        now /= now.sum()
    now = np.full(labels, 1 / labels)
    for i in range(blocks - 1, -1, -1):
        leaving[i] = now
        now = product[i] @ now
        now /= now.sum()
    forward = np.empty((blocks, BLOCK, labels))
    now = entering
    for t in range(BLOCK):
        now = step(now, t)
        now = now / now.sum(axis=1, keepdims=True)
        forward[:, t] = now
    behind = np.empty((blocks, BLOCK, labels))
    now = leaving
    for t in range(BLOCK - 1, -1, -1):
        behind[:, t] = now
        weighed = emitted[:, t] * now
        now = np.where(new[:, t, None], (weighed @ begin)[:, None], weighed @ move.T)
        now = now / now.sum(axis=1, keepdims=True)
    both = forward * behind
    both = (both / both.sum(axis=2, keepdims=True)).reshape(-1, labels)[:n]
    if not pairs:
        return both
    before = forward.reshape(-1, labels)[: n - 1]
    after = (emitted * behind).reshape(-1, labels)[1:n]
    joint = before[:, :, None] * move * after[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return both, joint[~fresh[1:]].sum(axis=0), both[fresh].sum(axis=0)


# --- training -----------------------------------------------------------------

def train(runs: list[tuple[int, str]], labels: list[str]) -> dict:
    """Weights, transitions and lexicons from runs of words of documents (label, words), one document's runs together.

    The lexicons come from the words of all runs, but what a word's own run says of it is left out when the
    weights are learned, so that they are not trusted more than they will deserve.
    """
    count = len(labels)
    data, offsets = W.flat(pa.array([text for _, text in runs], pa.string()))
    words, which, first = _split(data, offsets)
    gold = np.repeat(np.array([label for label, _ in runs], np.int64), np.diff(first))
    run = np.repeat(np.arange(len(runs)), np.diff(first))
    once = np.unique(np.stack([which, run]), axis=1) if len(which) else np.zeros((2, 0), np.int64)
    held = np.zeros((len(words.hash), count))
    np.add.at(held, (once[0], np.array([label for label, _ in runs], np.int64)[once[1]]), 1)
    lexicon = _in_lexicon(held)
    # Held by its own run only, a word would look as if no lexicon knew it: seen from its run, it is one document less.
    less = held[which].copy()
    less[np.arange(len(which)), gold] -= 1
    seen_as = _in_lexicon(less)

    # Runs of different documents one after another: the language switches between them.
    order = np.random.default_rng(12).permutation(len(runs))
    sizes = np.diff(first)[order]
    at = np.repeat(first[:-1][order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    fresh = np.zeros(len(at), bool)
    begins = np.cumsum(sizes) - sizes
    fresh[begins[::SWITCHES][begins[::SWITCHES] < len(at)]] = True
    if len(fresh):
        fresh[0] = True
    gold, which, seen_as = gold[at], which[at], seen_as[at]

    feature, owner = _features(words)
    by_word = np.argsort(owner, kind="stable")
    feature, owner = feature[by_word], owner[by_word]
    word_first = np.searchsorted(owner, np.arange(len(words.hash)))
    by_feature = np.argsort(feature, kind="stable")
    used, feature_first = np.unique(feature[by_feature], return_index=True)
    places = np.argsort(which, kind="stable")
    place_first = np.searchsorted(which[places], np.arange(len(words.hash)))

    sizes = {"weights": (FEATURES, count), "lexicon": (count + 1, count), "start": (count,), "moves": (count, count)}
    model = {name: np.zeros(shape) for name, shape in sizes.items()}
    squares = {name: np.full(shape, 1e-8) for name, shape in sizes.items()}
    if len(at) and count > 1:
        target = np.zeros((len(at), count))
        target[np.arange(len(at)), gold] = 1
        moved = np.zeros((count, count))
        np.add.at(moved, (gold[:-1][~fresh[1:]], gold[1:][~fresh[1:]]), 1)
        for _ in range(STEPS):
            own = np.add.reduceat(model["weights"][feature], word_first, axis=0)
            scores = own[which] + model["lexicon"][seen_as]
            both, joint, began = posteriors(scores, fresh, model["start"], model["moves"], pairs=True)
            missing = target - both
            on_word = np.add.reduceat(missing[places], place_first, axis=0)
            gradient = {"weights": np.zeros((FEATURES, count)), "lexicon": np.zeros((count + 1, count)),
                        "start": target[fresh].sum(axis=0) - began, "moves": moved - joint}
            gradient["weights"][used] = np.add.reduceat(on_word[owner][by_feature], feature_first, axis=0)
            np.add.at(gradient["lexicon"], seen_as, missing)
            for name, value in gradient.items():
                value = value / len(at) - RIDGE * model[name]
                squares[name] += value * value
                model[name] += RATE * value / np.sqrt(squares[name])
    known = lexicon < count
    return model | {
        "key": uuid.uuid4().hex, "labels": labels, "weights": model["weights"].astype(np.float32),
        "words": words.hash[known], "of": lexicon[known],
    }


def _in_lexicon(held: np.ndarray) -> np.ndarray:
    """Per row of documents by label, the label of its lexicon; the number of labels for none."""
    total, most = held.sum(axis=1), held.max(axis=1, initial=0)
    return np.where((total >= LEAST) & (most >= SHARE * total), held.argmax(axis=1) if held.shape[1] else 0, held.shape[1])


def fit(docs: DataFrame) -> dict:
    """A model from a bounded sample of the rows of ``docs`` (doc_id, text, lang) that are not held out and have a lang.

    Looked at are the ``DOCUMENTS`` rows with the least hashes of id and text, and of each ``RUNS`` runs of
    ``RUN`` words, evenly spread. All languages of the table are labels. The sample is fitted in one task, so the
    driver holds the model alone.
    """
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))).where("lang IS NOT NULL")
    labels = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    keyed = rows.where("text IS NOT NULL").select("text", "lang", F.xxhash64("doc_id", "text").alias("order"))
    bound = keyed.select("order").orderBy("order").limit(DOCUMENTS).agg(F.max("order")).first()[0]
    if bound is None:
        return train([], labels)
    chosen = keyed.where(F.col("order") <= bound).repartition(1)

    def run(batches):
        sample = []
        for batch in batches:
            for r in batch.to_pylist():
                sample.append((r["order"], r["lang"], _runs(r["text"])))
        sample = sorted(sample)[:DOCUMENTS]
        model = train([(labels.index(lang), own) for _, lang, runs in sample for own in runs], labels)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return pickle.loads(chosen.mapInArrow(run, "model binary").first()["model"])


def _runs(text: str) -> list[str]:
    """``RUNS`` runs of ``RUN`` pieces between spaces, evenly spread over the text; all of a short text."""
    pieces = text.split()
    n = len(pieces) // RUN
    if n <= RUNS:
        return [" ".join(pieces[i : i + RUN]) for i in range(0, len(pieces), RUN)]
    return [" ".join(pieces[i * n // RUNS * RUN : (i * n // RUNS + 1) * RUN]) for i in range(RUNS)]


# --- prediction ---------------------------------------------------------------

class Labeller:
    """Scores of the words that a worker has met, by hash."""

    def __init__(self, model: dict):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.hash, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(self.model["labels"])), np.float32)

    def _scored(self, words: Words) -> np.ndarray:
        feature, owner = _features(words)
        order = np.argsort(owner, kind="stable")
        own = np.add.reduceat(self.model["weights"][feature[order]], np.searchsorted(owner[order], np.arange(len(words.hash))), axis=0)
        known, count = self.model["words"], len(self.model["labels"])
        at = np.minimum(np.searchsorted(known, words.hash), max(0, len(known) - 1))
        entry = np.where(known[at] == words.hash, self.model["of"][at], count) if len(known) else np.full(len(words.hash), count)
        return (own + self.model["lexicon"][entry]).astype(np.float32)

    def label(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all labels of each word of some rows, and each row's first word (one more at the end)."""
        words, which, first = _split(data, offsets)
        if not len(words.hash):
            return np.zeros((0, len(self.model["labels"]))), first
        if len(self.hash) > WORDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.hash, words.hash), max(0, len(self.hash) - 1))
        new = np.flatnonzero(self.hash[at] != words.hash) if len(self.hash) else np.arange(len(words.hash))
        if len(new):
            sizes = np.diff(words.first)[new]
            pick = np.repeat(words.first[new] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            scored = self._scored(Words(words.hash[new], words.data[pick], np.concatenate(([0], np.cumsum(sizes)))))
            at = np.searchsorted(self.hash, words.hash[new])
            self.hash, self.scores = np.insert(self.hash, at, words.hash[new]), np.insert(self.scores, at, scored, axis=0)
        scores = self.scores[np.searchsorted(self.hash, words.hash)][which]
        fresh = np.zeros(len(which), bool)
        fresh[first[:-1][np.diff(first) > 0]] = True
        return posteriors(scores.astype(np.float64), fresh, self.model["start"], self.model["moves"]), first


_labellers: dict[str, Labeller] = {}


def _labeller(model: dict) -> Labeller:
    """Kept for the next task of this worker."""
    if model["key"] not in _labellers:
        _labellers.clear()
        _labellers[model["key"]] = Labeller(model)
    return _labellers[model["key"]]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def word_labels(text: str, model: dict) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of one text, in order."""
    data, offsets = W.flat(pa.array([text]))
    probable, _ = _labeller(model).label(data, offsets)
    starts, ends, _, _ = W.spans(data, offsets, W.PUNCTUATION_TABLE)
    raw = data.tobytes()
    return [
        (raw[a:b].decode(), model["labels"][int(p.argmax())], float(p.max())) for a, b, p in zip(starts.tolist(), ends.tolist(), probable)
    ]


def _predict(shared):
    def run(batches):
        model = shared.value
        labeller, labels = _labeller(model), np.array(model["labels"], object)
        for batch in batches:
            data, offsets = W.flat(batch.column("text"))
            for low, high in W.groups(offsets):
                at = offsets[low : high + 1]
                part = data[at[0] : at[-1]]
                probable, first = labeller.label(part, at - at[0])
                sums = np.concatenate([np.zeros((1, len(labels))), np.cumsum(probable, axis=0)])
                sums = sums[first[1:]] - sums[first[:-1]]
                total = np.diff(first)
                letters = np.concatenate(([0], np.cumsum((part | 0x20) - 97 < 26)))
                worded = np.diff(letters[at - at[0]]) > 0
                for i in np.flatnonzero(~worded):
                    worded[i] = has_letter(batch.column("text")[low + int(i)].as_py())
                found = worded & (total > 0)
                best = sums.argmax(axis=1)
                share = np.clip(sums[np.arange(high - low), best] / np.maximum(total, 1), 0, 1)
                chosen = np.where(found, labels[best], UNKNOWN)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(low, high - low), pa.array(chosen.tolist(), pa.string()),
                    pa.array(np.where(found, share, 0.0)),
                ], ["doc_id", "lang_pred", "score"])
    return run


def languages(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score (the language's share of its words).

    Null texts and those without a letter are ``und`` with a score of 0, and so are all texts if no row that is not held out
    has a lang. Rows without an id are learned from. Repeated rows are predicted alike; other columns are ignored.
    """
    model = fit(docs)
    if not model["labels"]:
        unknown = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)}
        return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out")).withColumns(unknown)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = docs.select("doc_id", "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
