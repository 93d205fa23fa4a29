"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages, passages into blocks of about three quarters of ``RANK``. For
each block the matrix of TF-IDF weights by hashed terms has a randomised singular
value decomposition: a random projection, refined by power iterations, whose products
with the matrix are summed over its rows by Spark. What the right singular vectors
span is the latent space. Document frequencies come from all documents.

A document's passages are windows of words. Each passage of the benchmark is looked for
in windows of the least of ``WIDTHS`` that it fits in, a quarter of that apart. A term
outside the benchmark adds nothing to a window's image in the latent space, only to its
length. What the terms of a window give to its product with an item, repeats in full,
bounds the cosine: only windows above that bound are projected. Those whose cosine is
high enough are candidates, confirmed word by word: the longest common subsequence of
item and document must hold enough of the item, or less of it together with its answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from isobar.llm import words as W
from isobar.session import settle

TERMS = 1 << 18
RANK, OVERSAMPLING, ITERATIONS = 256, 16, 2
#: Words of windows, and in how many steps the next one is reached.
WIDTHS, STEPS = (8, 16, 32, 64), 4
#: Least cosine of a candidate. A window that holds the share s of a passage, all words weighing the same, has
#: s * sqrt(passage / width), which is 0.35 for the least share ``WITH_ANSWER`` and the shortest passage of a width.
COSINE = 0.25
#: Terms in more than this share of all documents, and in more than so many of them, weigh nothing, but for passages
#: that have fewer than ``SPARED`` others.
COMMON, OFTEN, SPARED = 0.05, 100, 4
#: Least share of an item in the common subsequence, alone and together with its answer.
ALONE, WITH_ANSWER = 0.75, 0.5
#: Without an answer of its own, an item's answer is this share of it, at its end.
TAIL = 0.25
#: Words of an item in one passage, and blocks that are compared in one reading of the documents.
PASSAGE, BLOCKS = 64, 16
#: Parts of a block whose products the driver sums, each (terms of the block) x (rank) numbers.
PARTS = 6
#: Items of fewer words are too short to tell.
LEAST_WORDS = 6


def _terms(batch: pa.RecordBatch, column: str = "text"):
    data, offsets = W.flat(batch.column(column))
    for low, high in W.groups(offsets):
        at = offsets[low : high + 1]
        yield low, high, *W.hashes(data[at[0] : at[-1]], at - at[0], W.PUNCTUATION_TABLE)


def _frequencies(batches):
    """How many texts hold each hashed term."""
    counts = np.zeros(TERMS, np.int64)
    for batch in batches:
        for _, _, value, first in _terms(batch):
            term = (value % np.uint64(TERMS)).astype(np.int64)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            both = np.unique(row * TERMS + term)
            counts += np.bincount(both % TERMS, minlength=TERMS)
    found = np.flatnonzero(counts)
    for low in range(0, len(found), 100_000):
        cut = found[low : low + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(cut), pa.array(counts[cut])], ["term", "n"])


def inverse_frequencies(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """log((texts + 1) / (texts with the term + 1)) + 1 of every hashed term, from all rows of ``docs``; which are common."""
    counts = docs.select("text").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # as rows, the counts of all terms would take a multiple of the driver's memory
    n = np.zeros(TERMS)
    n[found.column("term").to_numpy()] = found.column("n").to_numpy()
    texts = docs.count()
    return (np.log((texts + 1) / (n + 1)) + 1).astype(np.float32), n > max(OFTEN, COMMON * texts)


def _passages(batches):
    for batch in batches:
        rows = []
        for low, high, value, first in _terms(batch):
            for i in range(high - low):
                own = value[first[i] : first[i + 1]].view(np.int64)
                item = batch.column("item_id")[low + i].as_py()
                # Of about equal length: one of them holds at least the share that the whole item has in common.
                for part in np.array_split(own, max(1, -(-len(own) // PASSAGE))):
                    rows.append((item, own.tolist(), part.tolist()))
        items, whole, part = zip(*rows) if rows else ([], [], [])
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(whole, lists), pa.array(part, lists)], ["item_id", "words", "passage"])


def _matrix(passages, vocabulary: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of unit length; a term that comes n times weighs sqrt(n) of its idf."""
    out = np.zeros((len(passages), len(vocabulary)), np.float32)
    for i, passage in enumerate(passages):
        term = (np.asarray(passage, np.int64).view(np.uint64) % np.uint64(TERMS)).astype(np.int64)
        own, count = np.unique(term, return_counts=True)
        out[i, np.searchsorted(vocabulary, own)] = np.sqrt(count) * idf[own]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _spared(common):
    """The terms of passages that common terms make up but for a few."""
    def run(batches):
        for batch in batches:
            terms = set()
            for passage in batch.column("passage").to_pylist():
                own = np.unique((np.asarray(passage, np.int64).view(np.uint64) % np.uint64(TERMS)).astype(np.int64))
                if (~common.value[own]).sum() < SPARED:
                    terms.update(own.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(terms), pa.int64())], ["term"])
    return run


def _product(vocabulary, idf, basis):
    """The sum of a^T (a Q) over the rows a of a part of the matrix."""
    def run(batches):
        total = np.zeros(basis.value.shape, np.float64)
        for batch in batches:
            rows = _matrix(batch.column("passage").to_pylist(), vocabulary.value, idf.value)
            total += rows.T @ (rows @ basis.value)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()])], ["part"])
    return run


def _latent(block: DataFrame, vocabulary: np.ndarray, idf, rank: int) -> np.ndarray:
    """Orthonormal right singular vectors (terms, rank) of a block, by randomised iteration.

    Every product with the matrix is a Spark job over its rows; the driver sums one
    small matrix per part and makes it orthonormal.
    """
    context = block.sparkSession.sparkContext
    width = min(rank + OVERSAMPLING, len(vocabulary))
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((len(vocabulary), width)))[0]
    shared_terms = context.broadcast(vocabulary)
    for _ in range(ITERATIONS + 1):
        shared = context.broadcast(basis.astype(np.float32))
        total = np.zeros(basis.shape)
        parts = block.select("passage").coalesce(PARTS).mapInArrow(_product(shared_terms, idf, shared), "part binary")
        for part in parts.toArrow().column("part"):
            total += np.frombuffer(part.as_buffer(), np.float32).reshape(basis.shape)
        basis, values, _ = np.linalg.svd(total, full_matrices=False)
        shared.destroy()
    shared_terms.destroy()
    return basis[:, : min(rank, int((values > values[0] * 1e-6).sum()))].astype(np.float32)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of ``a`` a longest common subsequence with ``b`` takes."""
    n, m = len(a), len(b)
    length = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        # Along a row the best so far can only grow, so its running maximum is the recurrence.
        take = np.where(b == a[i], length[i + 1, 1:] + 1, 0)
        length[i, :-1] = np.maximum.accumulate(np.maximum(take, length[i + 1, :-1])[::-1])[::-1]
    taken, i, j = np.zeros(n, bool), 0, 0
    while i < n and j < m:
        if a[i] == b[j] and length[i, j] == length[i + 1, j + 1] + 1:
            taken[i] = True
            i, j = i + 1, j + 1
        elif length[i + 1, j] >= length[i, j + 1]:
            i += 1
        else:
            j += 1
    return taken


def _found(batch: pa.RecordBatch, model: dict, squared: np.ndarray) -> list[tuple]:
    """(row, item, cosine, share of it in common, share of its answer) of the items that the rows of a batch hold."""
    found = []
    for low, _, value, first in _terms(batch):
        term = (value % np.uint64(TERMS)).astype(np.int64)
        weight = squared[term]
        for block in model["blocks"]:
            for (doc, item), windows in _candidates(weight, block["row"][term], first, block).items():
                best = _confirmed(value[first[doc] : first[doc + 1]], windows, first[doc], *block["words"][item])
                if best:
                    whole, tail, cosine = best
                    found.append((low + doc, item, cosine, whole, tail))
    return found


def _confirmed(text: np.ndarray, windows: list[tuple], origin: int, words: np.ndarray, answer: int) -> tuple | None:
    """(share in common, share of the answer, cosine) where the windows (first word, width, cosine) confirm an item best.

    It is looked for in a window and as many words on either side as item and window have.
    """
    spans = sorted(
        (max(0, begin - origin - width - len(words)), min(len(text), begin - origin + 2 * width + len(words)), cosine)
        for begin, width, cosine in windows
    )
    best, done = None, 0
    while done < len(spans):
        # Overlapping spans: words that all of them together lack are lacking in each.
        last, end = done + 1, spans[done][1]
        while last < len(spans) and spans[last][0] < end:
            end = max(end, spans[last][1])
            last += 1
        if np.isin(words, text[spans[done][0] : end]).mean() >= WITH_ANSWER:
            for low, high, cosine in sorted(spans[done:last], key=lambda span: -span[2]):
                most = float(np.isin(words, text[low:high]).mean())
                if most < WITH_ANSWER or (best and (most, 1.0) <= best[:2]):
                    continue
                taken = _common(words, text[low:high])
                whole, tail = float(taken.mean()), float(taken[answer:].mean())
                if whole >= ALONE or (whole >= WITH_ANSWER and tail >= WITH_ANSWER):
                    best = max(best or (0.0, 0.0, 0.0), (whole, tail, cosine))
        done = last
    return best


def _candidates(weight: np.ndarray, row: np.ndarray, first: np.ndarray, block: dict) -> dict:
    """(text, item) → (first word, width, cosine) of all windows of at least ``COSINE``, for some texts.

    ``weight`` and ``row`` of each word; ``first``: where the texts begin.
    """
    n = np.diff(first)
    text_of = np.repeat(np.arange(len(n)), n)
    every = np.concatenate(([0.0], np.cumsum(weight, dtype=np.float64)))
    found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for width, items, gains in block["widths"]:
        step = width // STEPS
        count = np.where(n > 0, -(-np.maximum(1, n - width + step) // step), 0)
        text = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        starts = first[text] + nth * step
        ends = np.minimum(starts + width, first[text + 1])
        # Squared lengths are sums over words, as a term's weight is the root of its number.
        squares = np.maximum(every[ends] - every[starts], 1e-9)
        # A step of words has a place, a text so many more that no window reaches the next text.
        places = -(-n // step) + STEPS - 1
        base = np.cumsum(places) - places
        window = base[text] + nth
        ahead = np.maximum(gains, 0)
        telling = np.flatnonzero((row >= 0) & ahead.any(axis=1)[row])
        place = base[text_of[telling]] + (telling - first[text_of[telling]]) // step
        least = (COSINE * 0.9999 * np.sqrt(squares)).astype(np.float32)[:, None]
        for low in range(0, int(places.sum()), 4096):
            words = telling[(cut := slice(*np.searchsorted(place, (low, low + 4096 + STEPS - 1))))]
            some = slice(*np.searchsorted(window, (low, low + 4096)))
            if not len(words) or some.start == some.stop:
                continue
            held, begin = np.unique(place[cut] - low, return_index=True)
            sums = np.zeros((4096 + STEPS - 1, len(items)), np.float32)
            sums[held] = np.add.reduceat(ahead[row[words]], begin, axis=0)
            total = sums[:4096].copy()
            for i in range(1, STEPS):
                total += sums[i : i + 4096]
            hopeful = some.start + np.flatnonzero((total[window[some] - low] >= least[some]).any(axis=1))
            for k, j, cosine in _cosines(hopeful, starts, ends, row, squares, gains):
                found.setdefault((int(text[k]), int(items[j])), []).append((int(starts[k]), width, cosine))
    return found


def _cosines(some: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, squares: np.ndarray, gains: np.ndarray):
    """(window, passage, cosine) of at least ``COSINE`` of some windows."""
    if not len(some):
        return
    terms = len(gains)
    size = ends[some] - starts[some]
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[some], size)
    own = row[place]
    key, times = np.unique((np.repeat(np.arange(len(some)), size) * terms + own)[own >= 0], return_counts=True)
    which, begin = np.unique(key // terms, return_index=True)
    cosines = np.add.reduceat(gains[key % terms] * np.sqrt(times).astype(np.float32)[:, None], begin, axis=0)
    cosines /= np.sqrt(squares[some[which]])[:, None]
    for k, j in zip(*(x.tolist() for x in np.nonzero(cosines >= COSINE))):
        yield int(some[which[k]]), j, float(cosines[k, j])


def _matches(model):
    def run(batches):
        squared = model.value["idf"] ** 2
        for batch in batches:
            found = _found(batch, model.value, squared)
            rows, items, cosines, shares, answers = zip(*found) if found else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(cosines, pa.float64()),
                pa.array(shares, pa.float64()), pa.array(answers, pa.float64()),
            ], ["doc_id", "item_id", "cosine", "common", "answer"])
    return run


def _clean(model):
    def run(batches):
        squared = model.value["idf"] ** 2
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[hit[0] for hit in _found(batch, model.value, squared)]] = False
            yield batch.filter(pa.array(keep))
    return run


def _models(docs: DataFrame, benchmark: DataFrame, rank: int):
    """Broadcast models of ``BLOCKS`` blocks each."""
    spark = docs.sparkSession
    idf, common = inverse_frequencies(docs)
    items = benchmark.where("item_id IS NOT NULL").select("item_id", "text").dropDuplicates(["item_id"])
    passages = items.mapInArrow(_passages, "item_id long, words array<long>, passage array<long>").where(F.size("words") >= LEAST_WORDS)
    # Three quarters of the rank on average, so that a block's passages hardly ever outnumber it.
    passages = settle(passages, "passages")
    n = -(-passages.count() // (RANK * 3 // 4))
    shared_common = spark.sparkContext.broadcast(common)
    spared = passages.select("passage").mapInArrow(_spared(shared_common), "term long").distinct()
    common[spared.toArrow().column("term").to_numpy()] = False  # at most TERMS
    shared_common.destroy()
    idf[common] = 0
    shared_idf = spark.sparkContext.broadcast(idf)
    blocks = [passages.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(n)) == i) for i in range(n)]
    for low in range(0, n, BLOCKS):
        model = {"idf": idf, "blocks": [_block(b, idf, shared_idf, rank) for b in blocks[low : low + BLOCKS]]}
        W.give_back()
        yield spark.sparkContext.broadcast(model)
    shared_idf.destroy()


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """Pairs (doc_id, item_id, cosine, common, answer) of documents and the benchmark items that they hold.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. ``common`` is the share
    of the item's words in the longest common subsequence, ``answer`` that of its last
    words. Null and empty texts hold nothing; items without an id or with fewer than
    ``LEAST_WORDS`` words are not looked for. Each pair comes once, also if documents
    are repeated; rows with a null doc_id count as one document. Of items that share
    an id one is taken. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    schema = "doc_id long, item_id long, cosine double, common double, answer double"
    found = docs.limit(0).mapInArrow(lambda batches: (), schema)
    for model in _models(docs, benchmark, rank):
        found = found.unionByName(docs.mapInArrow(_matches(model), schema))
    # An item of several passages can be found in several blocks.
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "common", "answer")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item; see ``contaminated``."""
    for model in _models(docs, benchmark, rank):
        docs = docs.mapInArrow(_clean(model), docs.schema)
    return docs


def _block(block: DataFrame, idf: np.ndarray, shared_idf, rank: int) -> dict:
    """The terms of a block, what they add in its latent space to the passages of each width, and the words of its items."""
    rows = sorted(block.collect(), key=lambda r: (r["item_id"], r["passage"]))  # about three quarters of RANK
    if not rows:
        return {"row": np.full(TERMS, -1, np.int32), "widths": [], "words": {}}
    passages = [r["passage"] for r in rows]
    terms = [(np.array(p, np.int64).view(np.uint64) % np.uint64(TERMS)).astype(np.int64) for p in passages]
    vocabulary = np.unique(np.concatenate(terms))
    basis = _latent(block, vocabulary, shared_idf, rank)
    images = _matrix(passages, vocabulary, idf) @ basis
    row = np.full(TERMS, -1, np.int32)
    row[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
    words = {}
    for r in rows:
        own = np.array(r["words"], np.int64).view(np.uint64)
        words[r["item_id"]] = own, min(len(own) - 1, int(len(own) * (1 - TAIL)))
    images /= np.maximum(np.linalg.norm(images, axis=1, keepdims=True), 1e-12)
    # What one occurrence of a term adds to the product of a window's image with that of each passage.
    gains = (basis * idf[vocabulary][:, None]) @ images.T
    item, widths = np.array([r["item_id"] for r in rows]), []
    fit = np.searchsorted(WIDTHS, [len(p) for p in passages])
    for i in np.unique(fit):
        own = gains[:, fit == i]
        widths.append((WIDTHS[i], item[fit == i], np.where(np.abs(own) < 1e-5, 0, own).astype(np.float32)))
    return {"row": row, "widths": widths, "words": words}
