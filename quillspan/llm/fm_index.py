"""An FM-index over one shard of symbols, in numpy.

Suffix order by prefix doubling in which each round sorts only the suffixes
still tied (Larsson & Sadakane), the Burrows-Wheeler transform in a wavelet
matrix with popcount ranks, backward search of many patterns in lockstep, and
location by walking back to sampled suffix positions.
"""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the suffixes of ``s`` (symbols 0 .. 2**bits - 2) in order; a suffix that ends sorts before its extensions."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    span = 62 // bits
    key = np.zeros(n, np.uint64)
    for i in range(span):
        key <<= np.uint64(bits)
        if i < n:
            key[: n - i] |= s[i:].astype(np.uint64) + np.uint64(1)
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
    size = np.diff(np.r_[head, n])
    rank = np.empty(n + 1, np.int32)  # half the memory traffic; a shard has far fewer than 2**31 symbols
    rank[order] = np.repeat(head.astype(np.int32) + 1, size)
    rank[n] = 0
    tied = order[np.repeat(size > 1, size)].astype(np.int32)
    h = span
    while len(tied):
        first = rank[tied]
        second = rank[np.minimum(tied + h, n)]
        pair = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        at = np.argsort(pair)
        tied, pair, first = tied[at], pair[at], first[at]
        m = len(tied)
        # A group keeps its first rank; those of equal pairs in it share the rank of the first of them.
        within = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        size = np.diff(np.r_[within, m])
        head = first[within]
        fresh = np.r_[True, head[1:] != head[:-1]]
        begin = np.maximum.accumulate(np.where(fresh, within, 0))
        rank[tied] = np.repeat((head + within - begin).astype(np.int32), size)
        tied = tied[np.repeat(size > 1, size)]
        h *= 2
    order = np.empty(n, np.int32)
    order[rank[:n] - 1] = np.arange(n, dtype=np.int32)
    return order


class _Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros((len(bits) >> 6) + 1, np.uint64)
        raw = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(raw)] = raw
        self.words = words
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)].astype(np.int32)

    def ones(self, pos: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = pos >> 6
        mask = (np.uint64(1) << (pos & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def at(self, pos: np.ndarray) -> np.ndarray:
        return (self.words[pos >> 6] >> (pos & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    """Counts and locates patterns in ``s``, an array of symbols below 2**bits - 1."""

    def __init__(self, s: np.ndarray, bits: int = 6, sample: int = 32):
        self.n, self.bits = len(s), bits
        order = suffix_order(s, bits)
        # Row 0 is the empty suffix; its preceding symbol is the last one.
        order = np.r_[np.int32(self.n), order]
        text = np.r_[s, np.uint8(0)]
        bwt = text[order - 1]
        self.end = int(np.flatnonzero(order == 0)[0])  # the row of the whole text has no preceding symbol
        marked = order % sample == 0
        self.marked, self.samples = _Bits(marked), order[marked]
        count = np.bincount(s, minlength=1 << bits)
        self.first = np.r_[0, np.cumsum(count)] + 1
        self.levels, self.zeros = [], []
        seq = bwt.copy()
        seq[self.end] = 0  # left out of the ranks of 0 in occ()
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1 == 1
            self.levels.append(_Bits(bit))
            self.zeros.append(int((~bit).sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.start = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _down(self, c: np.ndarray, pos: np.ndarray) -> np.ndarray:
        for i, b in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.levels[i].ones(pos)
            pos = np.where((c >> b) & 1 == 1, self.zeros[i] + ones, pos - ones)
        return pos

    def occ(self, c: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """How often symbol c precedes a row before ``pos``."""
        return self._down(c, pos) - self.start[c] - ((c == 0) & (pos > self.end))

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that start with each pattern; the patterns stand one after the other."""
        last = np.cumsum(length) - 1
        lo, hi = np.zeros(len(length), np.int64), np.full(len(length), self.n + 1, np.int64)
        live = np.arange(len(length))
        for step in range(int(length.max(initial=0))):
            live = live[(length[live] > step) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[last[live] - step].astype(np.int64)
            base = self.first[c]
            lo[live] = base + self.occ(c, lo[live])
            hi[live] = base + self.occ(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.full(len(rows), -1, np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = rows[live]
            done = self.marked.at(r)
            out[live[done]] = self.samples[self.marked.ones(r[done])] + steps[live[done]]
            live = live[~done]
            r = rows[live]
            pos, c = r, np.zeros(len(r), np.int64)
            for i in range(self.bits):
                bit = self.levels[i].at(pos)
                ones = self.levels[i].ones(pos)
                pos = np.where(bit, self.zeros[i] + ones, pos - ones)
                c = c * 2 + bit
            rows[live] = self.first[c] + pos - self.start[c] - ((c == 0) & (r > self.end))
            steps[live] += 1
        return out
