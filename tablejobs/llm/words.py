"""Words, word hashes and runs of words, taken from Arrow text columns in NumPy.

A word is a longest run of characters other than space and U+0009..U+000D.
Null texts count as empty. Everything here works on one Arrow batch in slices
of a few hundred kilobytes, so that memory does not follow the batch's size;
one text is never split, so a slice is as large as its longest text at least.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 * 1024

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (one to one)."""
    x = x ^ (x >> _SHIFT)
    x = x * _M1
    x = x ^ (x >> _SHIFT)
    x = x * _M2
    return x ^ (x >> _SHIFT)


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII and Latin-1 letters in lower case and all other
    ASCII as spaces."""
    out = _FOLD[data]
    accent = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[1:][accent] += 0x20
    return out


def release_memory() -> None:
    """Give what this process has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.pythonapi, "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def released(work: Callable) -> Callable:
    """``work`` for mapInArrow; memory it has freed goes back when its task
    ends, as Spark keeps idle workers and their number is not the job's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release_memory()
    return run


@dataclass
class Words:
    """The words of texts ``lo`` .. ``hi`` - 1 of a batch.

    ``first[i]`` is the place of text ``lo + i``'s first word in ``hashes``;
    ``first`` has one more entry than there are texts. ``starts`` and ``ends``
    are byte places in ``data``.
    """

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def place(self) -> np.ndarray:
        """Each word's place within its own text."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)

    def left(self) -> np.ndarray:
        """How many words from each word on, itself included, its text has."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes, or of its first ``most``."""
        global _POWERS
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        lengths = self.ends - self.starts
        if most is not None:
            lengths = np.minimum(lengths, most)
        if (longest := int(lengths.max())) > len(_POWERS):
            _POWERS = _powers(longest)
        begins = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(begins, lengths)
        if most is None:
            data = self.data[~_SEPARATOR[self.data]]
        else:
            data = self.data[place + np.repeat(self.starts, lengths)]
        return mix(np.add.reduceat(_BYTE_VALUE[data] * _POWERS[place], begins))


def slices(texts: pa.Array, folded: bool = False, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a text column, some texts at a time; ``folded`` ones are of
    letters only, in lower case."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        chunk = data[offsets[lo]:offsets[hi]]
        chunk = fold(chunk) if folded else chunk
        bounds = offsets[lo:hi + 1] - offsets[lo]
        inside = ~_SEPARATOR[chunk]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cuts = bounds[:-1]
        cuts = cuts[cuts < len(chunk)]
        begin[cuts] = inside[cuts]  # a text's end ends its last word as well
        cuts = cuts[cuts > 0]
        end[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        yield Words(lo, hi, chunk, starts, ends, np.searchsorted(starts, bounds))
        lo = hi


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each ``length`` consecutive values (len - length + 1 of them),
    joined from runs of powers of two; runs over a text's end are the caller's
    to leave out."""
    if len(hashes) < length:
        return np.zeros(0, dtype=np.uint64)
    out, have, part, size = None, 0, hashes, 1
    while True:
        if length & size:
            if out is None:
                out, have = part, size
            else:
                n = len(hashes) - have - size + 1
                out = mix(out[:n] + _STEP) * _M1 + part[have:have + n]
                have += size
        size *= 2
        if size > length:
            return mix(out)
        half = size // 2
        n = len(hashes) - size + 1
        part = mix(part[:n] + _STEP) * _M2 + part[half:half + n]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
