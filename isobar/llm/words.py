"""Words of whole texts as 64-bit hashes, in numpy over Arrow buffers.

A word is a run of bytes that are not in ``SPACES`` (space, tab to carriage
return); A-Z count as a-z. Texts are cut into pieces at spaces before they are
hashed, so memory does not follow the length of a text.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes hashed at once, if no word is longer.
PIECE = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table(spaces: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(spaces)] = True
    return table


SPACE_TABLE = _table(SPACES)
#: Everything in ASCII that is neither letter nor digit, for matching across punctuation.
PUNCTUATION_TABLE = _table(bytes(b for b in range(128) if not chr(b).isalnum()))

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the offsets of its rows."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: a worker lives on for other tasks, with what its allocators keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def groups(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, one row at least."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


#: A value for each byte and an odd factor for each place in a word: pseudo-random, so that no word is another's
#: by the rule that made them, as in a polynomial modulo 2**64, where words of repeating structure collide.
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _CODES[_LOWER]
_FACTORS = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _hashed(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of runs of ``sizes`` bytes that stand one after another, given by the values of their bytes."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(codes), dtype=np.int32 if len(codes) < 1 << 31 else np.int64)
    place -= np.repeat(first.astype(place.dtype), sizes)
    if sizes.max() <= 1 << 16:
        codes *= _FACTORS.take(place)
    else:
        codes *= _FACTORS.take(place & 0xFFFF)
        codes *= np.where(place < 1 << 16, np.uint64(1), _FACTORS.take(place >> 16 ^ 0xAAAA, mode="wrap"))
    return mix(np.add.reduceat(codes, first) + sizes.astype(np.uint64))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of the given runs of bytes, which are not empty and do not overlap."""
    sizes = ends - starts
    at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return _hashed((_FOLDED if fold else _CODES).take(data[at]), sizes)


def _piece(
    data: np.ndarray, space: np.ndarray, first: np.ndarray, fold: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in one piece; first: bytes that begin a row."""
    start = ~space
    end = start.copy()
    start[1:] &= space[:-1] | first[1:]
    end[:-1] &= space[1:] | first[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    # Every byte that is no space is in one word.
    return starts, ends, _hashed((_FOLDED if fold else _CODES).take(data[~space]), ends - starts)


def spans(
    data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray = SPACE_TABLE, fold: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word, and for each row the index of its first word (one more at the end).

    Without ``fold`` A-Z and a-z differ.
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    parts, low = [], 0
    while low < n:
        high = min(n, low + PIECE)
        # A piece ends before a space or a row's first byte, wherever the next one is.
        while high < n:
            found = np.flatnonzero(spaces[data[high : high + PIECE]] | first[high : min(n, high + PIECE)])
            if len(found):
                high += int(found[0])
                break
            high = min(n, high + PIECE)
        part = data[low:high]
        starts, ends, values = _piece(part, spaces[part], first[low:high], fold)
        parts.append((starts + low, ends + low, values))
        low = high
    if not parts:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    starts, ends, values = (np.concatenate(p) for p in zip(*parts))
    return starts, ends, values, np.searchsorted(starts, offsets).astype(np.int64)


def hashes(
    data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray = SPACE_TABLE
) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and for each row the index of its first word (one more at the end)."""
    _, _, values, first = spans(data, offsets, spaces)
    return values, first


def tailed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``hashes`` returns, and the last two bytes of each word."""
    starts, ends, values, first = spans(data, offsets)
    tails = _LOWER[data[ends - 1]].astype(np.uint16)
    tails |= np.where(ends - starts > 1, _LOWER[data[ends - 2]], np.uint8(0)).astype(np.uint16) << np.uint16(8)
    return values, first, tails


_ORDER = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(width, n)
    runs = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        runs += words[i : n - width + 1 + i] * _ORDER[i]
    return np.unique(mix(runs))
