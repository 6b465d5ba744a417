"""Words of whole Arrow text columns as 64-bit hashes, without a Python loop over words.

A word is a run of bytes other than space and the controls 9 to 13; UTF-8 never uses
those bytes inside a longer character, so bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The bytes of an eight-byte piece that belong to a range with so many left.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)

#: Bytes that are worked on at once; a longer document is worked on alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``b`` on as one number; zeros follow its end."""
    padded = np.zeros(len(b) + 8, np.uint8)
    padded[: len(b)] = b
    return np.ndarray(len(b) + 1, "<u8", padded, strides=(1,))


def _later(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Eight-byte pieces after the first of ranges over eight bytes: (which ranges, where each one's pieces begin, number of each piece, its place)."""
    long = np.flatnonzero(ends - starts > 8)
    n = (ends[long] - starts[long] - 1) // 8
    begin = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(long)), n)
    k = np.arange(len(owner)) - begin[owner] + 1
    return long, begin, k, starts[long][owner] + 8 * k


def hash_ranges(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each range.

    Eight-byte pieces go through a mixer that is keyed by their number and the seed, so no
    algebraic relation between pieces cancels; hashes of two seeds are independent.
    """
    eight = _eights(b)
    size = ends - starts
    key = mix(np.array([seed], _U) * _U(0x9E3779B97F4A7C15) + _U(0xD1B54A32D192ED03))
    h = mix((eight[starts] & _MASK[np.minimum(size, 8)]) ^ key)
    long, begin, k, at = _later(starts, ends)
    if len(long):
        piece = eight[at] & _MASK[np.minimum(np.repeat(ends[long], np.diff([*begin, len(at)])) - at, 8)]
        h[long] += np.add.reduceat(mix(piece ^ mix(key + k.astype(_U))), begin)
    return mix(h + size.astype(_U) * _U(0xD6E8FEB86659FD93) + key)


def same_ranges(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether the bytes of each range equal those of the range beside it."""
    eight = _eights(b)
    size = ends - starts
    same = (size == other_ends - others) & ((eight[starts] ^ eight[others]) & _MASK[np.minimum(size, 8)] == 0)
    which = np.flatnonzero(same)
    long, begin, k, at = _later(starts[which], ends[which])
    if len(long):
        owner = np.repeat(which[long], np.diff([*begin, len(at)]))
        differs = (eight[at] ^ eight[others[owner] + 8 * k]) & _MASK[np.minimum(ends[owner] - at, 8)] != 0
        same[owner[differs]] = False
    return same


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1 + column.offset)
    offsets = offsets[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents with about ``limit`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """Words of some documents: byte ranges in ``data`` (lower-cased if asked for), hashes, and where each document's begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of each document, and one past the last

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of documents that lie one after another in ``data``; ``lower`` folds A to Z."""
    b = data[offsets[0] : offsets[-1]]
    if lower:
        b = _LOWER[b]
    offsets = offsets - offsets[0]
    n = len(b)
    inside = np.zeros(n + 2, bool)
    np.logical_not(_GAP[b], out=inside[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return Words(b, starts, ends, hash_ranges(b, starts, ends), np.searchsorted(starts, offsets))


def grams(w: Words, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of every run of k words inside one document.

    Another seed hashes the words anew from their bytes, so two seeds' hashes are independent.
    """
    n = len(w.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    own = w.hashes if not seed else hash_ranges(w.data, w.starts, w.ends, seed)
    odd = mix(np.arange(seed * 1000 + 1, seed * 1000 + k + 1, dtype=_U)) | _U(1)
    h = np.zeros(n, _U)
    for i in range(k):
        h += own[i : n + i] * odd[i]
    doc = w.doc
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(h[at] + _U(k)), at


#: Numbers that are counted together.
TALLY = 1 << 22


def tally(parts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct values, how often) of about TALLY values at a time, so that few repeats leave a task."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= TALLY:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, n = [], 0
    if n:
        yield np.unique(np.concatenate(held), return_counts=True)
