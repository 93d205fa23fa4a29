"""Alignment of two tokenizers by an associative monoid of fragments.

A byte-level tokenizer (A) and a sentence-piece tokenizer (B) cut one byte string, a space and the text.
Where tokens of both end, a group of both ends. A fragment is what a byte range holds: the tokens that end
in it, up to the first common end (open prefix), its closed groups, and the tokens behind the last common
end (open suffix). Joining two fragments closes one group, of the left one's suffix and the right one's
prefix; a range without a common end stays open as a whole. This is associative, so the fragments of a
very long document are made by many tasks, one for each ``CHUNK`` bytes, and joined as a tree of ``FAN``
at a time. All other documents are one fragment.

Neither tokenizer merges across certain places: before a space or line feed behind something solid, and
behind a single line feed. The text between two of them is a unit; its tokens do not depend on what
stands around it, so a worker tokenizes each unit once and remembers its groups.

A pair of ids counts in how many documents it is linked. The counts of the ``FREQUENT`` most
frequent pairs are broadcast; links of other pairs are joined with theirs.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from isobar.llm import words as W
from isobar.session import settle

#: Bytes of a fragment's range; fragments joined at once.
CHUNK, FAN = 1 << 15, 8
#: Most frequent pairs, whose counts every task holds (13 bytes each).
FREQUENT = 1 << 18
#: Bytes of the units that a worker remembers, about 190 each; units tokenized in one string, and scored at once.
HELD, JOINED, _SCORED = 120_000_000, 4096, 1 << 15
#: Bytes of text handled at once, and ids of pairs that are counted before they are handed on.
_GROUP, _BUFFER = 1 << 20, 8_000_000
#: Links of a group from which its ids are counted before they are paired.
_MANY = 4096


def _at(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes of all items of runs that begin at ``begin`` and have ``size`` items."""
    total = np.cumsum(size)
    return np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)


class _Runs:
    """Byte strings or arrays one after another."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size
        self.begin = np.cumsum(size) - size

    def gather(self, which: np.ndarray) -> np.ndarray:
        return self.flat[_at(self.begin[which], self.size[which])]


class _Column:
    """An array that grows at its end; what is not used yet takes no memory."""

    def __init__(self, dtype, *width: int):
        self.room, self.n = np.empty((0, *width), dtype), 0

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.room):
            room = np.empty((max(end, len(self.room) * 3 // 2), *self.room.shape[1:]), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : end] = values
        self.n = end

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]

    def __getitem__(self, which):
        return self.values[which]

    @property
    def bytes(self) -> int:
        return self.values.nbytes


class _Kept:
    """Runs that grow at their end; ``more``: further values, one for each item."""

    def __init__(self, *dtypes):
        self.begin, self.size = _Column(np.int64), _Column(np.int32)
        self.flat, *self.more = self.columns = [_Column(d) for d in dtypes]

    def add(self, size: np.ndarray, *values: np.ndarray) -> None:
        self.begin.add(self.flat.n + np.cumsum(size) - size)
        self.size.add(size)
        for column, own in zip(self.columns, values):
            column.add(own)

    def gather(self, which: np.ndarray) -> list[np.ndarray]:
        at = _at(self.begin[which], self.size[which])
        return [column[at] for column in self.columns]

    @property
    def bytes(self) -> int:
        return sum(c.bytes for c in (self.begin, self.size, *self.columns))


def _strings(items: list[bytes]) -> _Runs:
    return _Runs(np.frombuffer(b"".join(items), np.uint8), np.fromiter(map(len, items), np.int64, len(items)))


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Tokens(NamedTuple):
    """Ids, and the byte offsets that they end at."""

    ids: np.ndarray
    ends: np.ndarray


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a: str, b: bytes):
        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        vocabulary, byte = self.a.get_vocab(), _byte_of()
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            bytes_a[i] = bytes(byte.get(c, 0) for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or len(self.b.encode("\n")) != 2:
            raise ValueError("pieces of the second tokenizer reach across spaces or lines")
        if max(len(bytes_a), len(pieces)) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.bytes = _strings(bytes_a), _strings([_piece_bytes(p) for p in pieces])
        self.digits = _strings([b"%d" % i for i in range(max(len(bytes_a), len(pieces)))])

    def encode(self, text: str) -> tuple[Tokens, Tokens] | None:
        """Tokens of a unit, or of several, by both tokenizers; None if their bytes are not the text's."""
        ids = [
            np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64),
            # A line feed in front keeps the leading space away; its two tokens are taken off.
            np.array(self.b.encode("\n" + text, num_threads=1)[2:], np.int64),
        ]
        data = np.frombuffer(text.encode(), np.uint8)
        for own, known in zip(ids, self.bytes):
            if not np.array_equal(known.gather(own), data):
                return None
        return tuple(Tokens(own, np.cumsum(known.size[own])) for own, known in zip(ids, self.bytes))


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin, of rows that each begin with a space; every row begins one.

    Bytes that may end a space beyond ASCII do not count as solid, so such places begin no unit.
    """
    solid = data > 0x20
    if (data >= 0x80).any():
        before = np.concatenate(([0], data[:-1]))
        two = np.concatenate(([0, 0], data[:-2]))[: len(data)]
        wide = (two >= 0xE1) & (two <= 0xE3) & ((before == 0x9A) | (before == 0x80) | (before == 0x81))
        solid &= ~(wide | (before == 0xC2) & ((data == 0x85) | (data == 0xA0)))
    feed = data == 0x0A
    start = np.zeros(len(data) + 1, bool)
    start[1:-1] = ((data[1:] == 0x20) | feed[1:]) & solid[:-1]
    letter = (data > 0x20) & (data < 0x80) | (data >= 0xC3) & (data <= 0xDF)
    start[2:-1] |= feed[1:-1] & letter[2:] & solid[:-2]
    start[offsets[:-1]] = True
    return np.flatnonzero(start[:-1])


def _ends_solid(unit: bytes) -> bool:
    """Whether a space behind the unit would begin another one."""
    if unit[-1] < 0x80:
        return unit[-1] > 0x20
    wide = len(unit) > 2 and 0xE1 <= unit[-3] <= 0xE3 and unit[-2] in b"\x9a\x80\x81"
    return not (wide or unit[-2] == 0xC2 and unit[-1] in b"\x85\xa0")


class Groups(NamedTuple):
    """Per unit: whether its bytes agree, counts, the text of its groups, its pairs of ids and how often each is linked."""

    good: np.ndarray
    n: np.ndarray
    text: _Runs
    pairs: _Runs
    weights: np.ndarray


def _joined(many: list[Groups]) -> Groups:
    text = _Runs(np.concatenate([g.text.flat for g in many]), np.concatenate([g.text.size for g in many]))
    pairs = _Runs(np.concatenate([g.pairs.flat for g in many]), np.concatenate([g.pairs.size for g in many]))
    return Groups(*(np.concatenate([getattr(g, name) for g in many]) for name in ("good", "n")), text, pairs,
                  np.concatenate([g.weights for g in many]))


_NOTHING = Groups(np.zeros(0, bool), np.zeros((0, 4), np.int64), _Runs(np.zeros(0, np.uint8), np.zeros(0, np.int64)),
                  _Runs(np.zeros(0, np.uint32), np.zeros(0, np.int64)), np.zeros(0, np.int64))


def _linked(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, unit: np.ndarray):
    """Unit, pair of ids and number of links of all groups; first: where each group's tokens begin, and the end."""
    n_a, n_b = np.diff(first_a), np.diff(first_b)
    few = n_a * n_b <= _MANY
    sizes = np.where(few, n_a, 0)
    tokens = _at(first_a[:-1], sizes)
    group = np.repeat(np.arange(len(n_a)), sizes)
    partners = _at(first_b[:-1][group], n_b[group])
    one = np.repeat(a[tokens] << 16, n_b[group]) | b[partners]
    keys = [np.repeat(unit[group], n_b[group]) << 32 | one]
    weights = [np.ones(len(one), np.int64)]
    for i in np.flatnonzero(~few).tolist():
        x, of_x = np.unique(a[first_a[i] : first_a[i + 1]], return_counts=True)
        y, of_y = np.unique(b[first_b[i] : first_b[i + 1]], return_counts=True)
        keys.append((unit[i] << 32 | x[:, None] << 16 | y).ravel())
        weights.append((of_x[:, None] * of_y).ravel())
    return _summed(np.concatenate(keys), np.concatenate(weights))


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else np.zeros(0, np.int64)


def closed_groups(tools: Tokenizers, a: Tokens, b: Tokens, ends: np.ndarray, common: np.ndarray) -> Groups:
    """The groups of consecutive units that end at ``ends``, all of them in ``common``; offsets where both tokens end."""
    group_a, group_b = np.searchsorted(common, a.ends), np.searchsorted(common, b.ends)
    unit = np.searchsorted(ends, common)
    first_a, first_b = (np.searchsorted(g, np.arange(len(common) + 1)) for g in (group_a, group_b))
    n_a, n_b = np.diff(first_a), np.diff(first_b)

    def per_unit(values: np.ndarray) -> np.ndarray:
        return np.bincount(unit, values, len(ends)).astype(np.int64)

    # Ids in the order of groups, A before B; behind the last id of a side stands another mark.
    order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
    ids = np.concatenate([a.ids, b.ids])[order]
    sizes = tools.digits.size[ids] + 1
    text = np.full(sizes.sum(), ord(","), np.uint8)
    behind = np.cumsum(sizes)
    text[_at(behind - sizes, sizes - 1)] = tools.digits.gather(ids)
    closing = np.cumsum(n_a + n_b)
    text[behind[closing - n_b - 1] - 1] = ord("|")
    text[behind[closing - 1] - 1] = ord(";")
    lengths = np.diff(np.concatenate(([0], behind[closing - 1])))

    keys, weights = _linked(a.ids, b.ids, first_a, first_b, unit)
    return Groups(
        np.ones(len(ends), bool),
        np.stack([per_unit(x) for x in (n_a, n_b, np.ones(len(common)), n_a * n_b)], axis=1),
        _Runs(text, per_unit(lengths)),
        _Runs((keys & 0xFFFFFFFF).astype(np.uint32), np.bincount(keys >> 32, minlength=len(ends))), weights,
    )


def _learned(tools: Tokenizers, units: list[bytes], barrier: bytes) -> Groups:
    """Groups of units, tokenized as one string with ``barrier`` between them, which is a unit itself or empty."""
    if not units:
        return _NOTHING
    texts = [u + barrier for u in units] if barrier else units
    found = tools.encode(b"".join(texts).decode())
    if found is not None:
        a, b = found
        common = np.intersect1d(a.ends, b.ends, assume_unique=True)
        sizes = np.fromiter((n for u in units for n in ((len(u), len(barrier)) if barrier else (len(u),))), np.int64)
        ends = np.cumsum(sizes)
        if np.isin(ends, common).all():
            made = closed_groups(tools, a, b, ends, common)
            return _chosen(made, np.arange(0, len(ends), 2)) if barrier else made
    if len(units) > 1:
        # Some unit's bytes differ: find it.
        half = len(units) // 2
        return _joined([_learned(tools, units[:half], barrier), _learned(tools, units[half:], barrier)])
    return _joined([Groups(np.zeros(1, bool), np.zeros((1, 4), np.int64), _Runs(_NOTHING.text.flat, np.zeros(1, np.int64)),
                           _Runs(_NOTHING.pairs.flat, np.zeros(1, np.int64)), _NOTHING.weights)])


def _chosen(groups: Groups, which: np.ndarray) -> Groups:
    return Groups(
        groups.good[which], groups.n[which], _Runs(groups.text.gather(which), groups.text.size[which]),
        _Runs(groups.pairs.gather(which), groups.pairs.size[which]),
        groups.weights[_at(groups.pairs.begin[which], groups.pairs.size[which])],
    )


class Known:
    """The groups of the units that a worker has met, by the hash of the unit."""

    def __init__(self, a: str, b: bytes):
        self.tools = Tokenizers(a, b)
        self.forget()

    def forget(self) -> None:
        # No unit of a row under ``CHUNK`` bytes has 2**31 links.
        self.hash, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.good, self.n, self.text, self.pairs = _Column(bool), _Column(np.int32, 4), _Kept(np.uint8), _Kept(np.uint32, np.int32)
        self._unscored(None)

    def _unscored(self, key: str | None) -> None:
        #: of the table of counts: its key, and per unit links of the best count, the sum of counts, pairs not in it
        self.scored_by, self.scores, self.rare = key, _Column(np.int64, 2), _Kept(np.uint32, np.int32)

    @property
    def bytes(self) -> int:
        kept = self.good, self.n, self.text, self.pairs, self.scores, self.rare
        return self.hash.nbytes + self.slot.nbytes + sum(c.bytes for c in kept)

    def _learn(self, units: list[bytes]) -> Groups:
        kinds = {"spaced": [], "bare": [], "alone": []}
        for i, unit in enumerate(units):
            kinds["alone" if not _ends_solid(unit) else "spaced" if unit[0] in b" \n" else "bare"].append(i)
        parts, order = [], []
        for kind, barrier, most in (("spaced", b"", JOINED), ("bare", b"\n", JOINED), ("alone", b"", 1)):
            for low in range(0, len(kinds[kind]), most):
                some = kinds[kind][low : low + most]
                parts.append(_learned(self.tools, [units[i] for i in some], barrier))
                order += some
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return _chosen(_joined(parts), back)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the units of rows that each begin with a space, and each row's first unit (one more at the end)."""
        if self.bytes > HELD:
            self.forget()
        starts = unit_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        values = W.hash_runs(data, starts, ends, fold=False)
        seen, where, which = np.unique(values, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, seen), max(0, len(self.hash) - 1))
        new = np.flatnonzero(self.hash[at] != seen) if len(self.hash) else np.arange(len(seen))
        if len(new):
            raw = data.tobytes()
            spots = where[new]
            learned = self._learn([raw[a:b] for a, b in zip(starts[spots].tolist(), ends[spots].tolist())])
            slots = self.good.n + np.arange(len(new))
            self.good.add(learned.good)
            self.n.add(learned.n)
            self.text.add(learned.text.size, learned.text.flat)
            self.pairs.add(learned.pairs.size, learned.pairs.flat, learned.weights)
            at = np.searchsorted(self.hash, seen[new])
            self.hash, self.slot = np.insert(self.hash, at, seen[new]), np.insert(self.slot, at, slots)
        slots = self.slot[np.searchsorted(self.hash, seen)][which]
        return slots, np.searchsorted(starts, offsets)

    def score(self, table: dict) -> None:
        """Bring the scores of all units up to date with the table of counts."""
        if self.scored_by != table["key"]:
            self._unscored(table["key"])
        while self.scores.n < self.good.n:
            new = np.arange(self.scores.n, min(self.scores.n + _SCORED, self.good.n))
            codes, weights = (v.astype(np.int64) for v in self.pairs.gather(new))
            scores, missing = counted(table, codes, weights)
            unit = np.repeat(np.arange(len(new)), self.pairs.size[new])
            sums = [np.zeros(len(new), np.int64) for _ in scores]
            for total, own in zip(sums, scores):
                np.add.at(total, unit, own)
            self.scores.add(np.stack(sums, axis=1))
            self.rare.add(np.bincount(unit[missing], minlength=len(new)), codes[missing], weights[missing])


def counted(table: dict, codes: np.ndarray, weights: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """For pairs linked ``weights`` times: links of the best count and sums of counts, both 0 where the table lacks
    the pair; and where it does."""
    known = table["codes"]
    at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
    missing = known[at] != codes if len(known) else np.ones(len(codes), bool)
    if not len(known):
        return (np.zeros(len(codes), np.int64),) * 2, missing
    kept = np.where(missing, 0, weights)
    return (kept * table["best"][at], kept * table["counts"][at]), missing


_known: dict[int, Known] = {}


def _worker(spec) -> Known:
    """Kept for the next task of this worker."""
    key = zlib.crc32(spec.value["b"], zlib.crc32(spec.value["a"].encode()))
    if key not in _known:
        _known.clear()
        _known[key] = Known(spec.value["a"], spec.value["b"])
    return _known[key]


def _spaced(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows with the bytes of a space and the text for each, and their offsets."""
    data, offsets = W.flat(batch.column("text"))
    for low, high in W.groups(offsets, _GROUP):
        at = offsets[low : high + 1] - offsets[low]
        yield low, high, np.insert(data[offsets[low] : offsets[high]], at[:-1], 0x20), at + np.arange(len(at))


def _documents(known: Known, data: np.ndarray, offsets: np.ndarray):
    """Slots of the units of each document, the documents they are in, and which documents have tokens."""
    slots, first = known.units(data, offsets)
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))
    good = np.logical_and.reduceat(known.good[slots], first[:-1]) & (np.diff(offsets) > 1)
    return slots, first, document, good


def _count_pairs(spec):
    """Ids of pairs, and in how many of the documents of a batch each is linked."""
    def run(batches):
        known, buffer, held = _worker(spec), [], 0

        def flush():
            code, count = np.unique(np.concatenate(buffer), return_counts=True)
            for low in range(0, len(code), 100_000):
                cut = slice(low, low + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(code[cut].astype(np.int64)), pa.array(count[cut])], ["code", "docs"])

        for batch in batches:
            for _, _, data, offsets in _spaced(batch):
                slots, _, document, good = _documents(known, data, offsets)
                both = np.unique((document << 32 | slots)[good[document]])
                own = both & 0xFFFFFFFF
                keys = np.repeat(both >> 32 << 32, known.pairs.size[own]) | known.pairs.gather(own)[0]
                buffer.append((np.unique(keys) & 0xFFFFFFFF).astype(np.uint32))
                held += len(buffer[-1])
                if held >= _BUFFER:
                    yield from flush()
                    buffer, held = [], 0
        if held:
            yield from flush()
        W.give_back()
    return run


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values.astype(np.int64)))


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_ROWS = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + (
    ", n_best long, count_sum long, groups_sha256 string, codes array<long>, weights array<long>"
)
_NAMES = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256", "codes", "weights"]


def _digest(spec, table):
    """The result of each document but for its rare pairs, which are listed with their links."""
    def run(batches):
        known = _worker(spec)
        for batch in batches:
            for low, high, data, offsets in _spaced(batch):
                slots, first, document, good = _documents(known, data, offsets)
                known.score(table.value)
                begins = first[:-1]
                n = np.add.reduceat(known.n[slots], begins, axis=0, dtype=np.int64) * good[:, None]
                scores = np.add.reduceat(known.scores[slots], begins, axis=0) * good[:, None]
                text = known.text.gather(slots)[0]
                ends = np.cumsum(np.add.reduceat(known.text.size[slots], begins, dtype=np.int64))
                raw = memoryview(text.tobytes())
                hashes = [
                    hashlib.sha256(raw[a : b - 1]).hexdigest() if ok else ""
                    for a, b, ok in zip([0, *ends[:-1].tolist()], ends.tolist(), good.tolist())
                ]
                keep = good[document] & (known.rare.size[slots] > 0)
                own = slots[keep]
                codes, weights = known.rare.gather(own)
                keys, weights = _summed(np.repeat(document[keep] << 32, known.rare.size[own]) | codes, weights.astype(np.int64))
                sizes = np.bincount(keys >> 32, minlength=high - low)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(low, high - low), *(pa.array(n[:, i]) for i in range(4)),
                    pa.array(scores[:, 0]), pa.array(scores[:, 1]), pa.array(hashes),
                    _lists(keys & 0xFFFFFFFF, sizes), _lists(weights, sizes),
                ], _NAMES)
        W.give_back()
    return run


# --- fragments ----------------------------------------------------------------

class Fragment(NamedTuple):
    """What a byte range holds. Without a common end (``closed`` is false) all its tokens are in the prefix."""

    good: bool
    closed: bool
    prefix: tuple[list[int], list[int]]
    suffix: tuple[list[int], list[int]]
    n: list[int]
    groups: bytes
    codes: np.ndarray
    weights: np.ndarray


_EMPTY = np.zeros(0, np.int64)
NEUTRAL = Fragment(True, False, ([], []), ([], []), [0, 0, 0, 0], b"", _EMPTY, _EMPTY)


def _closing(a: list[int], b: list[int]) -> tuple[list[int], bytes, np.ndarray, np.ndarray]:
    """Counts, text, pairs and links of one group."""
    if not a and not b:
        return [0, 0, 0, 0], b"", _EMPTY, _EMPTY
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    keys, weights = _linked(x, y, np.array([0, len(x)]), np.array([0, len(y)]), np.zeros(1, np.int64))
    text = ",".join(map(str, a)) + "|" + ",".join(map(str, b)) + ";"
    return [len(a), len(b), 1, len(a) * len(b)], text.encode(), keys, weights


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of both ranges, ``y`` behind ``x``. ``NEUTRAL`` is its neutral element."""
    good = x.good and y.good
    if not y.closed:
        side = "suffix" if x.closed else "prefix"
        mine = getattr(x, side)
        return x._replace(good=good, **{side: (mine[0] + y.prefix[0], mine[1] + y.prefix[1])})
    mine = x.suffix if x.closed else x.prefix
    met = mine[0] + y.prefix[0], mine[1] + y.prefix[1]
    if not x.closed:
        return y._replace(good=good, prefix=met)
    n, text, codes, weights = _closing(*met)
    codes, weights = _summed(np.concatenate([x.codes, codes, y.codes]), np.concatenate([x.weights, weights, y.weights]))
    return Fragment(good, True, x.prefix, y.suffix, [sum(v) for v in zip(x.n, n, y.n)], x.groups + text + y.groups, codes, weights)


def whole(x: Fragment) -> Fragment:
    """A document's fragment with its prefix closed, as a document begins where groups may; good if nothing stays open."""
    n, text, codes, weights = _closing(*x.prefix) if x.closed else ([0, 0, 0, 0], b"", _EMPTY, _EMPTY)
    codes, weights = _summed(np.concatenate([codes, x.codes]), np.concatenate([weights, x.weights]))
    good = x.good and x.closed and not any(x.suffix)
    return Fragment(good, x.closed, ([], []), x.suffix, [sum(v) for v in zip(n, x.n)], text + x.groups, codes, weights)


def _part(tools: Tokenizers, unit: bytes, low: int, high: int) -> Fragment:
    """The fragment of the bytes behind ``low`` up to ``high`` of a unit."""
    found = tools.encode(unit.decode())
    if found is None:
        return NEUTRAL._replace(good=False)
    common = np.intersect1d(found[0].ends, found[1].ends, assume_unique=True)
    common = common[(common > low) & (common <= high)]
    a, b = (Tokens(t.ids[(t.ends > low) & (t.ends <= high)], t.ends[(t.ends > low) & (t.ends <= high)]) for t in found)
    if not len(common):
        return NEUTRAL._replace(prefix=(a.ids.tolist(), b.ids.tolist()))
    left = [t.ids[t.ends <= common[0]].tolist() for t in (a, b)]
    right = [t.ids[t.ends > common[-1]].tolist() for t in (a, b)]
    n, text, codes, weights = [0, 0, 0, 0], b"", _EMPTY, _EMPTY
    if len(common) > 1:
        inside = [(t.ends > common[0]) & (t.ends <= common[-1]) for t in (a, b)]
        made = closed_groups(tools, *(Tokens(t.ids[i], t.ends[i]) for t, i in zip((a, b), inside)), common[-1:], common[1:])
        n, text = made.n[0].tolist(), made.text.flat.tobytes()
        codes, weights = made.pairs.flat.astype(np.int64), made.weights
    return Fragment(True, True, tuple(left), tuple(right), n, text, codes, weights)


def fragment(known: Known, data: bytes, low: int, high: int, first: bool) -> Fragment:
    """The fragment of the bytes from ``low`` to ``high`` of whole units; ``first``: they begin a row, with a space."""
    # Behind a row's space and something solid, units are told apart as in the row.
    lead = b"" if first else b" x"
    starts = unit_starts(np.frombuffer(lead + data, np.uint8), np.array([0, len(lead) + len(data)])) - len(lead)
    starts = np.union1d(starts[starts > 0], [0])
    ends = np.append(starts[1:], len(data))
    out, inner = NEUTRAL, []
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b <= low or a >= high:
            continue
        if low <= a and b <= high:
            inner.append(data[a:b])
            continue
        out = compose(out, _closed(known, inner)) if inner else out
        inner = []
        out = compose(out, _part(known.tools, data[a:b], max(0, low - a), min(b, high) - a))
    return compose(out, _closed(known, inner)) if inner else out


def _closed(known: Known, units: list[bytes]) -> Fragment:
    """The fragment of whole units, each of which ends a group: its first group is its prefix."""
    distinct = list(dict.fromkeys(units))
    made = known._learn(distinct)
    place = {u: i for i, u in enumerate(distinct)}
    which = np.fromiter((place[u] for u in units), np.int64, len(units))
    if not made.good[which].all():
        return NEUTRAL._replace(good=False)
    text = made.text.gather(which).tobytes()
    head, rest = text.split(b";", 1)
    prefix = tuple([int(i) for i in side.split(b",")] for side in head.split(b"|"))
    codes, weights = _summed(made.pairs.gather(which).astype(np.int64), made.weights[_at(made.pairs.begin[which], made.pairs.size[which])])
    _, _, own, links = _closing(*prefix)
    weights = weights.copy()
    weights[np.searchsorted(codes, own)] -= links
    n = made.n[which].sum(axis=0) - [len(prefix[0]), len(prefix[1]), 1, len(prefix[0]) * len(prefix[1])]
    return Fragment(True, True, prefix, ([], []), n.tolist(), rest, codes[weights > 0], weights[weights > 0])


def _cut(batches):
    """Rows of byte ranges, each with the whole units that it touches."""
    for batch in batches:
        for i, text in enumerate(batch.column("text").to_pylist()):
            data = b" " + text.encode()
            starts = np.append(unit_starts(np.frombuffer(data, np.uint8), np.array([0, len(data)])), len(data))
            # A unit longer than a range is not divided.
            bounds = [0]
            for p in range(CHUNK, len(data), CHUNK):
                at = int(np.searchsorted(starts, p, "right"))
                if starts[at] - starts[at - 1] <= CHUNK:
                    bounds.append(p)
            bounds.append(len(data))
            rows = []
            for low, high in zip(bounds, bounds[1:]):
                left = int(starts[np.searchsorted(starts, low, "right") - 1])
                right = int(starts[np.searchsorted(starts, high)])
                rows.append((data[left:right], low - left, high - left, left == 0))
            n = len(rows)
            for k in range(0, n, 16):
                some = rows[k : k + 16]
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("row")[i].as_py()] * len(some), pa.int64()),
                    pa.array([batch.column("doc_id")[i].as_py()] * len(some), pa.int64()),
                    pa.array(range(k, k + len(some)), pa.int64()), pa.array([n] * len(some), pa.int64()),
                    pa.array([r[0] for r in some], pa.binary()), pa.array([r[1] for r in some], pa.int64()),
                    pa.array([r[2] for r in some], pa.int64()), pa.array([r[3] for r in some], pa.bool_()),
                ], ["row", "doc_id", "k", "ranges", "units", "low", "high", "first"])


_FRAGMENT = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("good", pa.bool_()), ("closed", pa.bool_()),
    *((name, pa.list_(pa.int64())) for name in ("prefix_a", "prefix_b", "suffix_a", "suffix_b", "n")),
    ("groups", pa.binary()), ("codes", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())),
])
_FRAGMENT_DDL = (
    "row long, doc_id long, k long, good boolean, closed boolean, prefix_a array<long>, prefix_b array<long>, "
    "suffix_a array<long>, suffix_b array<long>, n array<long>, groups binary, codes array<long>, weights array<long>"
)


def _as_row(row: int, doc_id: int | None, k: int, f: Fragment) -> dict:
    return {
        "row": row, "doc_id": doc_id, "k": k, "good": bool(f.good), "closed": bool(f.closed), "prefix_a": f.prefix[0], "prefix_b": f.prefix[1],
        "suffix_a": f.suffix[0], "suffix_b": f.suffix[1], "n": [int(v) for v in f.n], "groups": f.groups,
        "codes": f.codes.tolist(), "weights": f.weights.tolist(),
    }


def _from_row(r: dict) -> Fragment:
    return Fragment(
        r["good"], r["closed"], (r["prefix_a"], r["prefix_b"]), (r["suffix_a"], r["suffix_b"]), r["n"], r["groups"],
        np.array(r["codes"], np.int64), np.array(r["weights"], np.int64),
    )


def _fragments(spec):
    def run(batches):
        known = _worker(spec)
        for batch in batches:
            for r in batch.to_pylist():
                made = fragment(known, r["units"], r["low"], r["high"], r["first"])
                yield pa.RecordBatch.from_pylist([_as_row(r["row"], r["doc_id"], r["k"], made)], _FRAGMENT)
        W.give_back()
    return run


def _compose(table: pa.Table) -> pa.Table:
    """Up to ``FAN`` neighbouring fragments of a document as one."""
    rows = table.sort_by("k").to_pylist()
    out = NEUTRAL
    for r in rows:
        out = compose(out, _from_row(r))
    return pa.Table.from_pylist([_as_row(rows[0]["row"], rows[0]["doc_id"], rows[0]["k"] // FAN, out)], _FRAGMENT)


def long_fragments(docs: DataFrame, spec) -> DataFrame:
    """One fragment for each row of ``docs``, of long texts: made range by range, joined as a tree."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    ranges = settle(rows.mapInArrow(
        _cut, "row long, doc_id long, k long, ranges long, units binary, low long, high long, first boolean"
    ), "ranges")
    most = ranges.agg(F.max("ranges")).first()[0] or 0
    now = settle(ranges.repartition("row", "k").drop("ranges").mapInArrow(_fragments(spec), _FRAGMENT_DDL), "fragments")
    while most > 1:
        most = -(-most // FAN)
        up = now.withColumn("up", (F.col("k") / FAN).cast("long"))
        now = settle(up.groupBy("row", "up").applyInArrow(_compose, _FRAGMENT_DDL), "fragments")
    return now


def _digest_long(table):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                f = whole(_from_row(r))
                (best, sums), missing = counted(table.value, f.codes, f.weights)
                n = f.n if f.good else [0, 0, 0, 0]
                missing &= f.good
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["doc_id"]], pa.int64()), *(pa.array([int(v)], pa.int64()) for v in n),
                    pa.array([int(best.sum()) * f.good], pa.int64()), pa.array([int(sums.sum()) * f.good], pa.int64()),
                    pa.array([hashlib.sha256(f.groups[:-1]).hexdigest() if f.good else ""]),
                    _lists(f.codes[missing], np.array([missing.sum()])), _lists(f.weights[missing], np.array([missing.sum()])),
                ], _NAMES)
    return run


def _long_codes(batches):
    for batch in batches:
        for r in batch.to_pylist():
            f = whole(_from_row(r))
            if f.good:
                yield pa.RecordBatch.from_arrays([pa.array(f.codes), pa.array(np.ones(len(f.codes), np.int64))], ["code", "docs"])


def frequent(pairs: DataFrame) -> dict:
    """The most frequent pairs, at most ``FREQUENT`` of them: all whose counts reach a step of a geometric scale."""
    step = F.floor(8 * F.log2("docs")).cast("int")
    steps = pairs.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    least, held = None, 0
    for row in steps:
        held += row["n"]
        if held > FREQUENT:
            break
        least = row["step"]
    top = pairs.where(step >= least if least is not None else F.lit(False)).toArrow().sort_by("code")
    return {
        "codes": top.column("code").to_numpy(), "counts": top.column("docs").to_numpy(),
        "best": np.array(top.column("best").to_pylist(), bool),
    }


def align(docs: DataFrame, a: str, b: bytes) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` is the JSON of a byte-level tokenizer, ``b`` the model of a sentence-piece one. A null or empty text,
    and one whose tokens' bytes are not those of a space and the text, has no tokens: zeros and ''. Rows are
    counted as documents of their own, also those that share a doc_id or a text, or have no id. An empty table gives no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    spec = context.broadcast({"a": a, "b": b})
    docs = docs.select("doc_id", "text")
    is_long = F.coalesce(F.octet_length("text") >= CHUNK, F.lit(False))
    short = docs.where(~is_long)
    fragments = long_fragments(docs.where(is_long), spec)
    counts = short.mapInArrow(_count_pairs(spec), "code long, docs long").unionByName(
        fragments.mapInArrow(_long_codes, "code long, docs long")
    )
    pairs = settle(counts.groupBy("code").agg(F.sum("docs").alias("docs")), "pairs")
    best = settle(pairs.groupBy(F.shiftright("code", 16).alias("a")).agg(F.max("docs").alias("most")), "best")
    pairs = settle(
        pairs.join(best, F.shiftright("code", 16) == F.col("a")).select("code", "docs", (F.col("docs") == F.col("most")).alias("best")), "pairs"
    )
    table = context.broadcast({"key": uuid.uuid4().hex, **frequent(pairs)})
    found = settle(
        short.mapInArrow(_digest(spec, table), _ROWS).unionByName(fragments.mapInArrow(_digest_long(table), _ROWS))
        .withColumn("row", F.monotonically_increasing_id()), "aligned",
    )
    rare = found.select("row", F.explode(F.arrays_zip("codes", "weights")).alias("link")).select(
        "row", F.col("link.codes").alias("code"), F.col("link.weights").alias("links")
    )
    sums = rare.join(pairs, "code").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("docs")).alias("more_sum")
    )
    return found.join(sums, "row", "left").select(
        "doc_id", *_COUNTS, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
