"""Token ids in binary files of patched frame-of-reference blocks.

A file holds records, each followed by one line feed:

* blocks of ``BLOCK`` ids (the last may be shorter): little-endian header ``count
  u32, least id u32, width u8, exceptions u32``; the ids less the least one, packed
  at ``width`` bits in groups of 32 values to ``width`` 32-bit words, of which only
  the low ``width`` bits stay for ids that need more; then the exceptions: their
  positions (u32) and what is missing above ``width`` bits (u32);
* the index: ``documents u32, blocks u32``; the file offset of each block (u64); a
  byte per document (1: it has an id), its id (i64) and its number of ids (u32);
* the trailer, 16 bytes: file offset of the index (u64), the magic ``PFORIDS1``.

The width is that of the ``PERCENTILE``-th percentile of a block. Files are ordered
by their part number, documents inside by id. Spark's own writer commits them, so a
task that is lost and run again leaves one copy.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from isobar.llm import words as W
from isobar.session import scratch, settle

BLOCK, PERCENTILE = 1 << 14, 95
MAGIC = b"PFORIDS1"
_HEAD, _INDEX, _TRAILER = struct.Struct("<IIBI"), struct.Struct("<II"), struct.Struct("<Q8s")
#: Words whose ids a worker remembers, about 50 bytes each.
WORDS = 3_000_000
#: White space that separates words; any other is left to the tokenizer.
BREAKS = np.zeros(256, bool)
BREAKS[list(b" \t\n\r")] = True


def _pack(values: np.ndarray, width: int) -> bytes:
    """Groups of 32 values, each of ``width`` bits, as ``width`` words."""
    lanes = np.zeros((-(-len(values) // 32), 32), np.uint64)
    lanes.ravel()[: len(values)] = values
    out = np.zeros((len(lanes), width + 1), np.uint64)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        shifted = lanes[:, i] << np.uint64(shift)
        out[:, word] |= shifted & np.uint64(0xFFFFFFFF)
        out[:, word + 1] |= shifted >> np.uint64(32)
    return out[:, :width].astype("<u4").tobytes()


def _unpack(data: bytes, count: int, width: int) -> np.ndarray:
    groups = -(-count // 32)
    words = np.zeros((groups, width + 1), np.uint64)
    words[:, :width] = np.frombuffer(data, "<u4", groups * width).reshape(groups, width)
    out = np.empty((groups, 32), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        both = words[:, word] | (words[:, word + 1] << np.uint64(32))
        out[:, i] = (both >> np.uint64(shift)) & mask
    return out.ravel()[:count]


def encode_block(ids: np.ndarray) -> bytes:
    """One block of up to ``BLOCK`` ids (unsigned 32-bit), at least one."""
    least = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(least)
    width = max(1, int(np.percentile(rest, PERCENTILE, method="lower")).bit_length())
    high = (rest.astype(np.uint64) >> np.uint64(width)).astype("<u4")
    where = np.flatnonzero(high).astype("<u4")
    low = rest.astype(np.uint64) & np.uint64((1 << width) - 1)
    return b"".join([
        _HEAD.pack(len(ids), least, width, len(where)), _pack(low, width), where.tobytes(), high[where].tobytes(),
    ])


def decode_block(data: bytes | memoryview, at: int = 0) -> np.ndarray:
    count, least, width, exceptions = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    size = -(-count // 32) * width * 4
    rest = _unpack(data[at : at + size], count, width).astype(np.uint64)
    at += size
    where = np.frombuffer(data, "<u4", exceptions, at)
    rest[where] |= np.frombuffer(data, "<u4", exceptions, at + 4 * exceptions).astype(np.uint64) << np.uint64(width)
    return (rest + np.uint64(least)).astype(np.uint32)


class _Known:
    """The ids of the words that a worker has met, by the hash of the word, in flat arrays."""

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab()
        #: which ids end a word
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, "<u4")
        self.used = 0
        self.parts: dict[str, np.ndarray] = {}

    def _learn(self, parts: list[str]) -> None:
        """Put the ids of each part in ``parts``, in few calls.

        Parts of letters only are one word each to the tokenizer. They are handed over
        in one string with spaces between, and the ids that end a word tell them apart.
        All other parts go alone.
        """
        letters = [p for p in parts if p.isalpha() and (p.isascii() or max(p) <= "\xff")]
        for low in range(0, len(letters), 2000):
            some = letters[low : low + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                begin = 0
                for part, end in zip(some, ends.tolist()):
                    self.parts[part] = ids[begin:end]
                    begin = end
        rest = [p for p in parts if p not in self.parts]
        for part, one in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.parts[part] = np.array(one.ids, "<u4")

    def add(self, hashes: np.ndarray, words: list[str]) -> None:
        """Learn new words; ``hashes`` ascend."""
        cut = [_cut(w) for w in words]
        self._learn(list({p for pair in cut for p in pair}))
        pieces = [self.parts[p] for pair in cut for p in pair]
        self.parts.clear()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)).reshape(-1, 2).sum(axis=1)
        new = np.concatenate(pieces) if pieces else np.zeros(0, "<u4")
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), "<u4")])
        self.ids[self.used : self.used + len(new)] = new
        begin = self.used + np.cumsum(sizes) - sizes
        self.used += len(new)
        at = np.searchsorted(self.hash, hashes)
        self.hash = np.insert(self.hash, at, hashes)
        self.begin = np.insert(self.begin, at, begin)
        self.size = np.insert(self.size, at, sizes)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, ``end`` behind each, and how many each row has.

        The tokenizer's model never sees across white space, so a text's ids are those
        of its words, and each new word goes through the tokenizer once.
        """
        if len(self.hash) > WORDS:
            self.forget()
        starts, ends, values, first = W.spans(data, offsets, BREAKS, fold=False)
        seen, where, which = np.unique(values, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, seen), max(0, len(self.hash) - 1))
        new = np.flatnonzero(self.hash[at] != seen) if len(self.hash) else np.arange(len(seen))
        if len(new):
            raw = data.tobytes()
            spots = where[new]
            self.add(seen[new], [raw[a:b].decode() for a, b in zip(starts[spots].tolist(), ends[spots].tolist())])
        at = np.searchsorted(self.hash, seen)
        size = self.size[at][which]
        before = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(self.begin[at][which] - before[:-1], size) + np.arange(before[-1])]
        row_ends = before[first[1:]]
        counts = np.diff(np.concatenate(([0], row_ends))) + 1
        return np.insert(ids, row_ends, end).astype("<u4"), counts


_known: dict[int, _Known] = {}


def _encoder(spec: str) -> _Known:
    """Kept for the next task of this worker."""
    key = zlib.crc32(spec.encode())
    if key not in _known:
        _known.clear()
        _known[key] = _Known(spec)
    return _known[key]


def _cut(word: str) -> tuple[str, str]:
    """A word of Latin-1 letters with marks behind it, as lower-case letters and marks; others whole.

    The tokenizer lower-cases letters and separates them from marks itself, so the
    ids are the same, and fewer different parts have to go through it.
    """
    core = word.rstrip(".,;:!?|*%$#&")
    if core.isalpha() and (core.isascii() or max(core) <= "\xff"):
        return core.lower(), word[len(core) :]
    return word, ""


def _index(offset: int, starts: list[int], ids: list[int | None], counts: np.ndarray) -> bytes:
    """The index record and the trailer, of a file whose blocks end at ``offset``."""
    return b"".join([
        _INDEX.pack(len(ids), len(starts)), np.array(starts, "<u8").tobytes(),
        bytes(i is not None for i in ids), np.array([i or 0 for i in ids], "<i8").tobytes(),
        counts.astype("<u4").tobytes(), b"\n", _TRAILER.pack(offset, MAGIC),
    ])


def _records(spec, end: int):
    def run(batches):
        pending, held, offset = [], 0, 0
        starts, ids, counts = [], [], []

        def out(record: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["value"])

        def blocks(everything: bool) -> Iterator[bytes]:
            nonlocal pending, held, offset
            whole = np.concatenate(pending) if pending else np.zeros(0, "<u4")
            stop = len(whole) if everything else len(whole) // BLOCK * BLOCK
            for low in range(0, stop, BLOCK):
                record = encode_block(whole[low : min(stop, low + BLOCK)])
                starts.append(offset)
                offset += len(record) + 1
                yield record
            pending, held = [whole[stop:].copy()], len(whole) - stop

        known = _encoder(spec.value)
        for batch in batches:
            data, offsets = W.flat(batch.column("text"))
            ids.extend(batch.column("doc_id").to_pylist())
            for low, high in W.groups(offsets):
                at = offsets[low : high + 1]
                some, sizes = known.encode(data[at[0] : at[-1]], at - at[0], end)
                pending.append(some)
                held += len(some)
                counts.append(sizes)
                if held >= 8 * BLOCK:
                    yield from map(out, blocks(False))
        if not ids:
            return
        yield from map(out, blocks(True))
        yield out(_index(offset, starts, ids, np.concatenate(counts)))
        W.give_back()
    return run


def write_token_files(docs: DataFrame, path: str, spec: str, end: int = 1) -> None:
    """Encode each row of ``docs`` (doc_id, text), append ``end``, and write files under ``path``.

    ``spec`` is the tokenizer's JSON. Rows go in ascending doc_id order, null ids
    first; rows of equal ids in the order of a hash of their texts. A null text is
    empty, and has the end alone. An empty table makes no file with content. Other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    records = ordered.select("doc_id", "text").mapInArrow(_records(shared, end), "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)


def _documents(batches):
    _known.clear()  # reading needs the memory, not the words
    W.give_back()
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            data = memoryview(content.as_buffer())
            index, magic = _TRAILER.unpack_from(data, len(data) - _TRAILER.size - 1)
            if magic != MAGIC:
                raise ValueError(f"{path} is not a token file")
            n, blocks = _INDEX.unpack_from(data, index)
            at = index + _INDEX.size
            starts = np.frombuffer(data, "<u8", blocks, at)
            at += 8 * blocks
            given = np.frombuffer(data, np.uint8, n, at)
            ids = np.frombuffer(data, "<i8", n, at + n)
            counts = np.frombuffer(data, "<u4", n, at + 9 * n).astype(np.int64)
            begins = np.cumsum(counts) - counts
            sums, buffer, block = np.empty(n, np.int64), np.zeros(0, np.uint32), 0
            for i, count in enumerate(counts.tolist()):
                parts, have = [buffer], len(buffer)
                while have < count:
                    parts.append(decode_block(data, int(starts[block])))
                    have += len(parts[-1])
                    block += 1
                buffer = np.concatenate(parts) if len(parts) > 1 else buffer
                sums[i] = zlib.crc32(buffer[:count].astype("<u4").tobytes())
                buffer = buffer[count:]
            yield pa.RecordBatch.from_arrays([
                pa.array([path] * n), pa.array(ids, mask=given == 0), pa.array(begins), pa.array(counts), pa.array(sums),
            ], ["path", "doc_id", "begin", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, over all files. Each file
    is one task's output and read in one task, block by block.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    found = settle(
        files.select("path", "content").mapInArrow(
            _documents, "path string, doc_id long, begin long, n_tokens long, ids_crc32 long"
        ).withColumn("part", F.regexp_extract("path", r"part-(\d+)", 1).cast("int")).drop("path"),
        "read",
    )
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = found.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    files = settle(files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    return found.join(files, "part").select(
        "doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, spec: str, end: int = 1) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and return what reading them gives."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, path, spec, end)
    return read_token_files(docs.sparkSession, path)
