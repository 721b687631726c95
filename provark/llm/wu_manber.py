"""Wu-Manber search of many test strings in many texts, on NumPy arrays.

A scan holds one cursor a stretch of text and moves all of them at once: the block under a cursor says how far no string
can end (shift table); where it says 0, the strings with that block at the end of their first `reach` bytes (suffix
bucket) are compared byte by byte."""

from __future__ import annotations

import numpy as np

#: Strings of very different lengths have tables of their own, or the shortest would make every shift small.
CLASSES = (1, 8, 21)
_STRETCH = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place of data, which is padded for it, as little-endian numbers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


class Tables:
    """Shift table and suffix buckets of the strings data[starts[k] : starts[k] + sizes[k]], of similar lengths."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray):
        self.reach = int(sizes.min())
        self.block = min(8, max(1, self.reach // 2))
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        blocks = _eights(data)
        steps = self.reach - self.block
        bits = min(22, max(10, int(len(starts) * (steps + 1) * 4).bit_length()))
        self.fold = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, steps + 1, np.int32)
        for step in range(steps + 1):  # the later block, the smaller shift
            self.shift[self.slot(blocks[starts + step] & self.mask)] = steps - step
        last = blocks[starts + steps] & self.mask
        order = np.argsort(last, kind="stable")
        self.data, self.starts, self.sizes, self.numbers = data, starts[order], sizes[order], numbers[order]
        self.suffixes, first = np.unique(last[order], return_index=True)
        self.first = np.append(first, len(order))

    def slot(self, block: np.ndarray) -> np.ndarray:
        return ((block * _ODD) >> self.fold).astype(np.int64)

    def stops(self, blocks: np.ndarray, n: int) -> np.ndarray:
        """The places of text, of n bytes, where a string may start: all others are skipped."""
        last = n - self.reach
        if last < 0:
            return np.zeros(0, np.int64)
        at = np.arange(0, last + 1, _STRETCH, dtype=np.int64)
        until = np.minimum(at + _STRETCH, last + 1)
        ahead, found = self.reach - self.block, []
        while len(at):
            shift = self.shift[self.slot(blocks[at + ahead] & self.mask)]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            on = at < until
            at, until = at[on], until[on]
        return np.sort(np.concatenate(found))

    def search(self, text: np.ndarray, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Start and string number of every occurrence in text; at most about `most` comparisons are held at once."""
        blocks, own = _eights(text), _eights(self.data)
        at = self.stops(blocks, len(text))
        block = blocks[at + self.reach - self.block] & self.mask
        bucket = np.minimum(np.searchsorted(self.suffixes, block), len(self.suffixes) - 1)
        true = self.suffixes[bucket] == block
        at, bucket = at[true], bucket[true]
        sizes = self.first[bucket + 1] - self.first[bucket]
        total = np.cumsum(sizes)
        starts, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        low = 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right")))
            size, part = sizes[low:high], slice(low, high)
            which = np.repeat(self.first[bucket[part]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            hit = self._equal(blocks, own, np.repeat(at[part], size), which, len(text))
            starts.append(hit[0])
            numbers.append(self.numbers[hit[1]])
            low = high
        return np.concatenate(starts), np.concatenate(numbers)

    def _equal(self, blocks: np.ndarray, own: np.ndarray, at: np.ndarray, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        fits = at + self.sizes[which] <= n
        at, which = at[fits], which[fits]
        done, done_which, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while len(at):
            left = np.minimum(self.sizes[which] - step, 8)
            keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - left)).astype(np.uint64)
            same = (blocks[at + step] ^ own[self.starts[which] + step]) & keep == 0
            over = self.sizes[which] - step <= 8
            done.append(at[same & over])
            done_which.append(which[same & over])
            at, which, step = at[same & ~over], which[same & ~over], step + 8
        return np.concatenate(done), np.concatenate(done_which)


def tables(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[Tables]:
    """The strings by length class; string k has the number k. Empty strings are found nowhere."""
    kind = np.searchsorted(CLASSES, sizes, "right")
    picks = [np.flatnonzero(kind == k) for k in range(1, len(CLASSES) + 1)]
    return [Tables(data, starts[p], sizes[p], p) for p in picks if len(p)]
