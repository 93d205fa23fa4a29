"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on toxic and on ordinary text. Documents are
cut into windows of about ``WINDOW`` bytes, and each window is compressed twice: with
the ordinary dictionary, and with the toxic one standing before it. Its distance is
the number of bytes that the toxic dictionary saves. Samples of the toxic dictionary
are the stretches of toxic windows whose byte runs are much more frequent in toxic
than in ordinary windows, so what both have in common cannot blur the distance.

A window without any of the telling runs in the toxic dictionary is at distance 0 and is
not compressed: there the dictionary could only save what both kinds have in common. Thresholds are calibrated: from its windows' distances a
document has a score by a logistic curve, fitted on labelled documents that the
dictionaries have not seen.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from isobar.llm import words as W
from isobar.session import settle

WINDOW = 40
RUN = 6
#: Labelled documents of each kind, and windows of each, that the fit looks at.
TOXIC, ORDINARY, WINDOWS = 4000, 8000, 128
#: Bytes of the dictionaries and of the text that the ordinary one is trained on.
TOXIC_BYTES, ORDINARY_BYTES, TRAINED_BYTES = 8192, 16384, 4_000_000
#: Log ratio of a run's frequencies from which it counts as toxic; one of so many toxic windows must hold it,
#: and between the two numbers of them at least.
RATIO, ONE_OF, LEAST = 2.5, 1000, (5, 12)
#: Share of the sample that the dictionaries are trained on; the rest calibrates.
TRAINED = 0.7
LEVEL = 10
THRESHOLD = 0.3

_BUCKETS = 1 << 24
_SPACE = re.compile(r"\s+")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never used: crc32 of the id as text, modulo 4, is 2 (null id: never)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _cut(text: str | None) -> tuple[bytes, list[int]]:
    """The text in lower case with white space as single spaces, and where its windows begin (and the last one ends)."""
    data = f" {_SPACE.sub(' ', (text or '').lower()).strip()} ".encode()
    cuts, end = [0], len(data) - 1
    while cuts[-1] < end:
        stop = data.find(b" ", cuts[-1] + WINDOW)
        cuts.append(end if stop < 0 else stop)
    return data, cuts


def windows(text: str | None) -> list[bytes]:
    """Pieces of the text of about ``WINDOW`` bytes, cut at spaces; each begins and ends with one."""
    data, cuts = _cut(text)
    return [data[a : b + 1] for a, b in zip(cuts, cuts[1:]) if b - a > 1]


def _runs(data: bytes | np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``RUN`` bytes."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(a) < RUN:
        return np.zeros(0, np.int64)
    h = np.zeros(len(a) - RUN + 1, np.uint64)
    for i in range(RUN):
        h = h * np.uint64(257) + a[i : len(h) + i]
    return (W.mix(h) % np.uint64(_BUCKETS)).astype(np.int64)


def _frequency(sample: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs, and in how many of the windows each stands."""
    parts = [np.zeros(0, np.int64)]
    for low in range(0, len(sample), 512):
        part = sample[low : low + 512]
        runs = [_runs(w) for w in part]
        row = np.repeat(np.arange(len(part)), [len(r) for r in runs])
        parts.append(np.unique(row * _BUCKETS + np.concatenate(runs)) % _BUCKETS)
    return np.unique(np.concatenate(parts), return_counts=True)


def _stretches(sample: list[bytes], telling: np.ndarray) -> list[bytes]:
    """What telling runs cover, joined where they overlap."""
    out = []
    for window in sample:
        hot = telling[_runs(window)]
        if not hot.any():
            continue
        covered = np.zeros(len(window) + 2, np.int8)
        for i in range(RUN):
            covered[1 + i : 1 + i + len(hot)] |= hot
        edges = np.flatnonzero(np.diff(covered))
        out += [window[a:b] for a, b in zip(edges[::2], edges[1::2])]
    return out


def _trained(sample: list[bytes], size: int) -> bytes:
    """A dictionary of the samples by the library's training; of few samples a smaller one, or all of them."""
    size = min(size, sum(map(len, sample)) // 3)
    if size >= 512 and len(sample) >= 16:
        try:
            return zstandard.train_dictionary(size, sample, k=32, d=6, steps=1).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(dict.fromkeys(sample))[-max(size, 4096) :]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=2 * WINDOW, dict_size=len(content),
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    if not content:
        return zstandard.ZstdCompressor(compression_params=parameters)
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=parameters)


class Distance:
    """Bytes that the toxic dictionary saves in a window."""

    def __init__(self, toxic: bytes, ordinary: bytes, telling: np.ndarray):
        self.with_toxic, self.alone = _compressor(toxic + ordinary), _compressor(ordinary)
        self.telling = np.zeros(_BUCKETS, bool)
        self.telling[telling] = True

    def features(self, text: str | None) -> np.ndarray:
        """Largest and mean saving, share of windows with one, their sum by the root of the number of windows, its log."""
        data, cuts = _cut(text)
        if len(cuts) < 2 or len(data) < RUN:
            return np.zeros(5)
        saved = np.zeros(len(cuts) - 1)
        # A run belongs to the window that it begins in; windows overlap in a space only.
        hot = np.flatnonzero(self.telling[_runs(data)])
        for i in np.unique(np.searchsorted(cuts, hot, "right") - 1):
            window = data[cuts[i] : cuts[i + 1] + 1]
            saved[i] = len(self.alone.compress(window)) - len(self.with_toxic.compress(window))
        return np.array([
            saved.max(), saved.mean(), (saved > 1).mean(), saved.sum() / np.sqrt(len(saved)), np.log(len(saved)),
        ])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (bias first) of a logistic regression by Newton steps, and the scale of the features."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
    return w, mean, scale


def _curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logistic curve of labelled documents, moved to the ``share`` of toxic ones among all, which the sample need not keep."""
    if len(set(y.tolist())) < 2:
        # Nothing to calibrate with: the share of toxic documents, whatever the text.
        bias = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return np.array([bias, 0, 0, 0, 0, 0]), np.zeros(5), np.ones(5)
    weights, mean, scale = _logistic(x, y)
    weights[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return weights, mean, scale


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(label, learns, windows) of the documents that the fit looks at, and the share of toxic labels."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    counts = {row["label"]: row["n"] for row in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = marked.withColumn("order", F.xxhash64("doc_id"))
    chosen = None
    for label, most in ((1, TOXIC), (0, ORDINARY)):
        some = order.where(F.col("label") == label).orderBy("order", "doc_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    learns = F.pmod(F.xxhash64("doc_id", F.lit("learns")), F.lit(1000)) < int(1000 * TRAINED)

    def cut(batches):
        for batch in batches:
            own = [windows(t) for t in batch.column("text").to_pylist()]
            own = [w if len(w) <= WINDOWS else [w[i * len(w) // WINDOWS] for i in range(WINDOWS)] for w in own]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("order", "label", "learns")), pa.array(own, pa.list_(pa.binary()))],
                ["order", "label", "learns", "windows"],
            )
        W.give_back()

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("order", "label", learns.alias("learns"), "text")
    sample = settle(rows.mapInArrow(cut, "order long, label int, learns boolean, windows array<binary>"), "sample")
    total = max(1, sum(counts.values()))
    return sample, min(max(counts.get(1, 0) / total, 1e-3), 1 - 1e-3)


def _counted(distinct: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(run, n): in how many windows each run stands, of all runs or those in ``only`` (sorted)."""
    shared = distinct.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        for batch in batches:
            runs, n = _frequency(batch.column("window").to_pylist())
            if shared.value is not None:
                held = np.isin(runs, shared.value)
                runs, n = runs[held], n[held]
            yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(n)], ["run", "n"])
        W.give_back()

    return distinct.select("window").mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """A model from a bounded sample of the labelled rows of ``docs`` (doc_id, text) that are not held out.

    ``labels`` has doc_id and toxic (1 or 0; null: no label; the largest of several
    counts). The ``TOXIC`` and ``ORDINARY`` documents of each kind with the least hashes
    of their ids are looked at, and of each ``WINDOWS`` windows, evenly spread; no other
    column is. Runs are counted and documents compared in Spark; the driver trains the
    dictionaries, on text of bounded size, and fits the curve.
    """
    context = docs.sparkSession.sparkContext
    sample, share = _sample(docs, labels)
    learnt = sample.where("learns").select("label", F.explode("windows").alias("window")).distinct()
    learnt = settle(learnt.withColumn("order", F.xxhash64("window")), "windows")
    sizes = {row["label"]: row["n"] for row in learnt.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_plain = sizes.get(1, 0), sizes.get(0, 0)
    toxic, plain = learnt.where("label = 1"), learnt.where("label = 0")

    least = int(np.clip(n_toxic // ONE_OF, *LEAST))
    often = _counted(toxic).where(F.col("n") >= least).toArrow().sort_by("run")
    runs, n = often.column("run").to_numpy(), often.column("n").to_numpy()
    there = _counted(plain, runs).toArrow()
    also = np.zeros(len(runs))
    also[np.searchsorted(runs, there.column("run").to_numpy())] = there.column("n").to_numpy()
    ratio = np.log((n + 0.1) / max(1, n_toxic)) - np.log((also + 0.5) / max(1, n_plain))
    shared = context.broadcast(runs[ratio > RATIO])

    def stretches(batches):
        telling = np.zeros(_BUCKETS, bool)
        telling[shared.value] = True
        for batch in batches:
            for order, window in zip(batch.column("order").to_pylist(), batch.column("window").to_pylist()):
                found = _stretches([window], telling)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([order]), pa.array([found], pa.list_(pa.binary()))], ["order", "parts"])
        W.give_back()

    hot = toxic.select("order", "window").mapInArrow(stretches, "order long, parts array<binary>").toArrow()
    samples = [p for _, parts in sorted(zip(hot.column("order").to_pylist(), hot.column("parts").to_pylist())) for p in parts]
    content = _trained(samples, TOXIC_BYTES)
    # About as many ordinary windows as make up the bytes to train on, by their hash.
    kept = int(min(1.0, TRAINED_BYTES / WINDOW / max(1, n_plain)) * 1_000_000)
    some = plain.where(F.pmod("order", F.lit(1_000_000)) < kept).select("order", "window").toArrow().sort_by([("order", "ascending")])
    model = {"toxic": content, "ordinary": _trained(some.column("window").to_pylist(), ORDINARY_BYTES)}
    known = np.unique(_runs(content))
    model["telling"] = known[np.isin(known, shared.value)]
    del hot, samples, some, often, there, runs, n, also, ratio
    W.give_back()
    trained = context.broadcast(model)

    def measured(batches):
        distance = Distance(*(trained.value[k] for k in ("toxic", "ordinary", "telling")))
        for batch in batches:
            # For calibration a text counts as far as its sampled windows.
            texts = [b" ".join(own).decode(errors="ignore") for own in batch.column("windows").to_pylist()]
            x = np.array([distance.features(t) for t in texts]).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["order", "label", "x"]
            )

    found = sample.where("NOT learns").select("order", "label", "windows").mapInArrow(measured, "order long, label int, x array<double>")
    found = found.toArrow().sort_by([("order", "ascending"), ("label", "ascending")])
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, 5)
    shared.destroy()
    trained.destroy()
    return model | {"curve": _curve(x, found.column("label").to_numpy().astype(float), share)}


def _scores(model: dict):
    """What scores an Arrow column of texts by a broadcast model."""
    distance = Distance(*(model[k] for k in ("toxic", "ordinary", "telling")))
    weights, mean, scale = model["curve"]

    def of(texts: pa.Array) -> np.ndarray:
        z = np.array([weights[0] + ((distance.features(t.as_py()) - mean) / scale) @ weights[1:] for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return of


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, score, from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = _scores(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(of(batch.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score stays below ``THRESHOLD``; see ``toxicity``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        of = _scores(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(of(batch.column("text")) < THRESHOLD))
        W.give_back()

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 from ``THRESHOLD``).

    Null and empty texts have no window and the score of no saving. Without labels of
    both kinds every score is the share of toxic labels. Repeated rows have equal
    scores; other columns are ignored.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
