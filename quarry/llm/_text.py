"""Words and their hashes, for whole batches of texts at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Work is done on the UTF-8
bytes of an Arrow string column with numpy, chunk by chunk; a chunk holds about
CHUNK_BYTES, or one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from quarry.llm._common import CHUNK_BYTES, U64, mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = U64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CASED = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0xA0761D6478BD642F))
_FOLDED = _CASED.copy()
_FOLDED[0x41:0x5B] = _CASED[0x61:0x7B]


@dataclass
class Words:
    """The words of some texts: byte ranges, 64-bit hashes, and where each text's words begin."""

    first: int  # the row of the batch that the first text is
    data: np.ndarray  # the texts' bytes
    text_off: np.ndarray  # by text, into data; one more than texts
    starts: np.ndarray
    ends: np.ndarray
    off: np.ndarray  # by text, into starts; one more than texts
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def raw(self, i: int) -> list[bytes]:
        """The words of text i."""
        return bytes(self.data[self.text_off[i] : self.text_off[i + 1]]).split()


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. n-1, mod 2 ** 64."""
    with np.errstate(over="ignore"):
        out = np.ones(max(n, 1), dtype=np.uint64)
        out[1:] = U64(base)
        return np.cumprod(out)


class Splitter:
    """Cuts the texts of Arrow batches into words; keeps its power tables between batches."""

    def __init__(self, fold: bool = False, chunk_bytes: int = CHUNK_BYTES):
        self.values = _FOLDED if fold else _CASED
        self.chunk_bytes = chunk_bytes
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, self.chunk_bytes)
            self.up, self.down = _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))

    def chunks(self, texts: pa.Array) -> Iterator[Words]:
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + self.chunk_bytes, "right")) - 1)
            hi = min(hi, len(texts))
            yield self._words(lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            lo = hi

    def _words(self, first: int, data: np.ndarray, off: np.ndarray) -> Words:
        n = len(data)
        self._tables(n + 1)
        inside = np.ones(n + 2, dtype=bool)
        inside[0] = inside[-1] = False
        np.logical_not(_SPACE[data], out=inside[1:-1])
        begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        border = off[1:-1]
        joined = border[inside[border] & inside[border + 1]]  # words that touch over a text's border
        begins[joined] = ends[joined] = True
        starts, ends = np.flatnonzero(begins), np.flatnonzero(ends)
        total = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.values[data] * self.up[:n], out=total[1:])
            hashes = (total[ends] - total[starts]) * self.down[starts]
            hashes = mix64(hashes + (ends - starts).astype(np.uint64) * _STEP)
        return Words(first, data, off, starts, ends, np.searchsorted(starts, off), hashes)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words; as many as words, less k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = hashes[:n].copy()
        for j in range(1, k):
            h = h * _STEP + hashes[j : j + n]
        return mix64(h)


def distinct_shingles(words: Words, i: int, all_grams: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of text i's k-word shingles; all its words if they are fewer."""
    a, b = int(words.off[i]), int(words.off[i + 1])
    if b - a >= k:
        h = np.sort(all_grams[a : b - k + 1])
        return h[np.concatenate(([True], h[1:] != h[:-1]))]
    return whole(words.hashes[a:b])


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash for a sequence shorter than a shingle, told apart from any shingle; none for no words."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = U64(len(hashes)) * U64(0x2545F4914F6CDD1D)
        for x in hashes:
            h = h * _STEP + x
        return mix64(np.array([h], dtype=np.uint64))
