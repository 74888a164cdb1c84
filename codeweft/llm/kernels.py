"""Vectorised text kernels that run inside Spark tasks, one Arrow batch at a time.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D`` (the class is ASCII only, so byte and
code point views agree).  All kernels take whole texts; a batch is walked in slices of about
``SLICE_BYTES`` and at most ``SLICE_TEXTS`` texts, so that memory does not follow the batch, and one text is
never cut.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
SLICE_TEXTS = 2048

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_libc = ctypes.CDLL(ctypes.util.find_library("c"))


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def released(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``task``, trimmed at its end, as Spark uses a worker for many tasks."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        trim()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Hash bits as doubles in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


#: Bytes of a range up to which it is hashed with others, eight bytes at a time.
SHORT_RANGE = 64
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class RangeHash:
    """64-bit hashes of any ranges of one sequence of symbols.

    A state is mixed with every eight bytes of a range in turn, for all short ranges at once; the few long ones go
    through XXH3, one by one.  ``seed`` gives another hash of the same ranges.
    """

    def __init__(self, symbols: np.ndarray, seed: int = 0):
        self._size, self._seed = symbols.itemsize, seed
        self._bytes = np.concatenate([np.ascontiguousarray(symbols).view(np.uint8), np.zeros(8, np.uint8)])
        self._eights = np.ndarray(len(self._bytes) - 7, "<u8", self._bytes, strides=(1,))  # those that begin at each byte

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        at, left = start.astype(np.int64) * self._size, (end - start).astype(np.int64) * self._size
        out = mix64(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (self._seed + 1) & 2**64 - 1))
        for k in np.flatnonzero(left > SHORT_RANGE).tolist():
            out[k] ^= np.uint64(xxhash.xxh3_64_intdigest(self._bytes[at[k] : at[k] + left[k]], self._seed))
        todo = np.flatnonzero((left > 0) & (left <= SHORT_RANGE))
        at, left = at[todo], left[todo]
        while len(todo):
            out[todo] = mix64((out[todo] ^ (self._eights[at] & _FIRST_BYTES[np.minimum(left, 8)])) + np.uint64(0x632BE59BD9B4E019))
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        return out


@dataclass
class Slice:
    """Some whole texts of a batch as bytes; ``offsets[i]:offsets[i + 1]`` is text i."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of the maximal runs of ``inside`` that stay in one text."""
        return runs(inside, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~_SPACE[self.data])


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] |= inside[inner]
    finish[inner - 1] |= inside[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def slices(texts: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES, count: int = SLICE_TEXTS) -> Iterator[Slice]:
    """The texts of an Arrow column in order; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, first + count, len(texts))
        yield Slice(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def word_hashes(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, start and end of every word."""
    starts, ends, owner = part.words()
    return RangeHash(part.data)(starts, ends), owner, starts, ends


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows of ``width`` words that lie in one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = mix64(out + hashes[at + k] + np.uint64(0x632BE59BD9B4E019))
    return at, out


def per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums by text."""
    if weights is None:
        return np.bincount(owner, minlength=n).astype(np.int64)
    return np.bincount(owner, weights=weights, minlength=n).astype(np.float64)  # of nothing it gives integers


_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letter:
        _letter.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letter[0]


def code_points(part: Slice, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points and the texts' offsets in them."""
    raw = part.data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True)]
    if lower:
        texts = [t.lower() for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32), offsets
