"""Vectorised word and n-gram hashing over Arrow text columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. These bytes never occur inside a
UTF-8 sequence, so words can be cut on the encoded text of a whole batch at once. A word's hash sums
mixed values of its blocks of eight bytes, each with the block's place in the word; sequences of words
are hashed from word hashes in the same way. (Powers of a base modulo 2**64 would not do: with any odd
base, and so with any number of seeds, some pairs of long texts of two letters collide.)
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)))


_GOLD = U(0x9E3779B97F4A7C15)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of consecutive stretches of so many values; an empty one sums to 0."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    end = np.cumsum(sizes)
    return total[end] - total[end - sizes]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one stretch after the other."""
    end = np.cumsum(sizes)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - sizes, sizes)


class Hasher:
    """Hashes of words and of word sequences; two seeds give independent hashes."""

    def __init__(self, seed: int = 1):
        self.block, self.word, self.length, self.run = stream(seed, 4)

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each pair."""
        sizes = end - start
        blocks = (sizes + 7) >> 3
        place = _within(blocks)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        value = words[np.repeat(start, blocks) + 8 * place].astype(U)
        left = np.repeat(sizes, blocks) - 8 * place
        value &= np.where(left < 8, (U(1) << (U(8) * (left.astype(U) & U(7)))) - U(1), ~U(0))
        return mix(_sums(mix(value ^ mix(place.astype(U) * _GOLD + self.block)), blocks) + mix(sizes.astype(U) + self.length))

    def sequences(self, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words[start:end] for each pair; the length is part of it."""
        sizes = end - start
        place = _within(sizes)
        value = words[np.repeat(start, sizes) + place]
        return mix(_sums(mix(value ^ mix(place.astype(U) * _GOLD + self.word)), sizes) + mix(sizes.astype(U) + self.length))

    def runs(self, words: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        """Hash of words[start : start + n] for each start; not that of :meth:`sequences`."""
        out = np.full(len(start), self.run, U)
        for j in range(n):
            out ^= words[start + j]
            out *= U(0xC4CEB9FE1A85EC53)
            out ^= out >> U(29)
        return mix(out)


@dataclass
class Words:
    """The words of a few documents: byte spans in ``data``, and ``first[i]:first[i + 1]`` of document i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a whole string column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row is a range of its own and is never cut."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def slices(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column as :func:`chunks` makes them, without a copy of its bytes."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    yield from chunks(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), size)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the rows between ``offsets`` (which start at 0) of ``data``."""
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, start, end, np.searchsorted(start, offsets, "left"))


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (word number) and document of every run of n words of one document."""
    counts = np.diff(words.first)
    many = np.maximum(counts - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), many)
    before = np.concatenate([[0], np.cumsum(many)])
    return np.arange(before[-1]) - before[doc] + words.first[doc], doc


def few_arenas() -> None:
    """Let a library's threads share the system's memory pools, as each would keep what it has freed."""
    try:
        ctypes.CDLL(None).mallopt(-8, 2)
    except (OSError, AttributeError):  # not glibc
        pass


def released(batches: Callable) -> Callable:
    """A batch function that gives freed memory back to the system when its task ends.

    Python workers outlive tasks; without this, what one operator's arrays took stays with the worker
    while the next operator runs.
    """

    @functools.wraps(batches)
    def run(*args):
        try:
            yield from batches(*args)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return run
