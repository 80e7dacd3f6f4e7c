"""A compressed FM-index over word sequences: Burrows-Wheeler transform, wavelet matrix, sampled suffix positions.

Everything is vectorised over patterns. Bits of the wavelet matrix are packed, with a running
count for each 64 of them; of the suffix order, which is only there while the index is built,
every RATE-th position of the text is kept, and the others are found by walking to the left.
"""

from __future__ import annotations

import numpy as np

#: One position in so many is kept.
RATE = 4


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words)))).astype(np.int32)
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int32)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for d in range(self.depth - 1, -1, -1):
            bit = (symbols >> d & 1).astype(bool)
            self.levels.append((Bits(bit), len(symbols) - int(bit.sum())))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        self.begin = np.zeros(0, dtype=np.int64)
        self.begin = self.rank(np.arange(sigma), np.zeros(sigma, dtype=np.int64), whole=False)  # where a symbol's run begins at the bottom

    def rank(self, symbol: np.ndarray, i: np.ndarray, whole: bool = True) -> np.ndarray:
        """How often symbol stands before i, for arrays of both."""
        i = i.astype(np.int64)
        for level, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - level) & 1).astype(bool)
            ones = bits.rank(i)
            i = np.where(one, zeros + ones, i - ones)
        return i - self.begin[symbol] if whole else i

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and how often each stands before."""
        i, symbol = i.astype(np.int64), np.zeros(len(i), dtype=np.int64)
        for bits, zeros in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            symbol = symbol << 1 | one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.begin[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes in order, by prefix doubling: each round sorts only those that others still equal so far."""
    n = len(text)
    word = np.concatenate((np.unique(text, return_inverse=True)[1] + 1, np.zeros(2, np.int64)))
    base = int(word.max(initial=0)) + 1
    key, h = (word[:n], 1) if base**3 >= 2**62 else ((word[:n] * base + word[1 : n + 1]) * base + word[2 : n + 2], 3)
    order, live = np.argsort(key, kind="stable"), np.arange(n)
    key, pos = key[order], order
    rank = np.zeros(n, dtype=np.int64)  # the first row of a suffix's group
    while True:
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        rank[pos] = live[np.repeat(first, size)]
        live = live[np.repeat(size > 1, size)]
        if not len(live):
            return order
        pos = order[live]
        after = np.zeros(len(pos), dtype=np.int64)
        more = pos + h < n
        after[more] = rank[pos[more] + h] + 1
        key = rank[pos] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        key, pos = key[by], pos[by]
        order[live] = pos
        h *= 2


class FMIndex:
    """Over a text of symbols 0 .. sigma - 1, in which 0 ends a segment and no pattern holds it."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.n = len(text)
        order = suffix_order(text)
        self.tree = WaveletMatrix(text[order - 1], sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        kept = (order % RATE == 0) | (text[order - 1] == 0)  # a walk ends where its segment begins
        self.kept, self.places = Bits(kept), order[kept].astype(np.int32)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The positions in the text of the suffixes in these rows."""
        out, steps, live = np.zeros(len(row), dtype=np.int64), 0, np.arange(len(row))
        while len(live):
            here = self.kept.get(row)
            out[live[here]] = self.places[self.kept.rank(row[here])] + steps
            live, row = live[~here], row[~here]
            symbol, before = self.tree.at(row)
            row, steps = self.first[symbol] + before, steps + 1
        return out

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with symbol put before; equal questions are asked once."""
        key = lo * (self.n + 1) + hi
        order = np.lexsort((symbol, key))
        k, s = key[order], symbol[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])))
        one, back = order[new], np.cumsum(new) - 1
        s, n = symbol[one], len(one)
        both = self.tree.rank(np.concatenate((s, s)), np.concatenate((lo[one], hi[one])))
        out_lo, out_hi = np.empty_like(lo), np.empty_like(hi)
        out_lo[order], out_hi[order] = (self.first[s] + both[:n])[back], (self.first[s] + both[n:])[back]
        return out_lo, out_hi

    def statistics(self, text: np.ndarray, at: np.ndarray, length) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of the patterns text[a : a + length] of a text that this indexes, and those above the threshold.

        The statistic of a pattern is the length of its longest suffix that occurs twice or more: backward search
        extends it to the left, over all patterns at once, until it occurs once only. Patterns whose statistic is
        their length are reported with their interval (index into at, lo, hi). length is a number, or one for each.
        """
        length = np.broadcast_to(length, len(at))
        symbol = text[at + length - 1]
        lo, hi, live = self.first[symbol], self.first[symbol + 1], np.arange(len(at))
        matched = np.zeros(len(at), dtype=np.int64)
        found = []
        step = 1
        while len(live):
            keep = hi - lo > 1
            matched[live[keep]] = step
            done = keep & (length[live] == step)
            found.append((live[done], lo[done], hi[done]))
            keep &= length[live] > step
            live, lo, hi = live[keep], lo[keep], hi[keep]
            step += 1
            if len(live):
                lo, hi = self.step(text[at[live] + length[live] - step], lo, hi)
        live, lo, hi = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(live)
        return matched, (live[order], lo[order], hi[order])

    def earliest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first position in the text of each interval's suffixes."""
        if not len(lo):
            return np.zeros(0, dtype=np.int64)
        one, back = np.unique(lo * (self.n + 1) + hi, return_inverse=True)
        lo, size = one // (self.n + 1), one % (self.n + 1) - one // (self.n + 1)
        begin = np.cumsum(size) - size
        return np.minimum.reduceat(self.locate(np.arange(int(size.sum())) - np.repeat(begin - lo, size)), begin)[back]
