"""Hashed words and packed sorted numbers, for operators that move n-grams between tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from . import common

#: Odd multipliers that hold the places of words in an n-gram apart (from the digits of the golden ratio).
PLACES = np.array([0x9E3779B97F4A7C15, 0xF39CC0605CEDC835, 0x1082276BF3A27251, 0xF86C6A11D0C18E95], np.uint64)
REMEMBER = 300_000


class Words:
    """64-bit hashes of lower-cased words. A clash of two among a hundred million words has a chance under 1 in 3000."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _new(self, word: bytes) -> int:
        if len(self.known) > REMEMBER:
            self.known.clear()
        h = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def hashes(self, text: bytes) -> list[int]:
        get, new = self.known.get, self._new
        return [get(w) or new(w) for w in text.translate(common.LOWER).split()]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (the public-domain splitmix64 step)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class EliasFano:
    """A sorted run of unsigned numbers: low parts in whole bytes, high parts as a bit vector in unary.

    `data` may be any buffer, such as a memory map. The bit of number i stands at high(i) + i, so the
    numbers with a given high part lie between two unset bits, where a successor is looked for.
    """

    def __init__(self, data):
        head = np.frombuffer(data, "<u8", 3)
        self.n, self.width, bits = int(head[0]), int(head[1]), int(head[2])
        self.low = np.frombuffer(data, np.uint8, self.n * self.width, 24).reshape(self.n, self.width)
        self.high = np.frombuffer(data, np.uint8, -(-bits // 8), 24 + self.n * self.width)
        self.bits = bits
        self._marks: np.ndarray | None = None

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = 0
        while n and (top >> (8 * width)) > n:  # so that the unary part has at most 2 bits a number
            width += 1
        high = (values >> np.uint64(8 * width)).astype(np.int64) if width < 8 else np.zeros(n, np.int64)
        bits = int(high[-1]) + n + 1 if n else 1
        unary = np.zeros(bits, np.uint8)
        unary[high + np.arange(n)] = 1
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        return np.array([n, width, bits], "<u8").tobytes() + low.tobytes() + np.packbits(unary, bitorder="little").tobytes()

    def ones(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.high, count=self.bits, bitorder="little"))

    def lows(self, at=slice(None)) -> np.ndarray:
        part = self.low[at]
        wide = np.zeros((len(part), 8), np.uint8)
        wide[:, : self.width] = part
        return wide.view("<u8").ravel()

    def values(self) -> np.ndarray:
        high = (self.ones() - np.arange(self.n)).astype(np.uint64)
        return (high << np.uint64(8 * self.width) if self.width < 8 else high) | self.lows()

    def get(self, at: np.ndarray) -> np.ndarray:
        """Numbers at the given places."""
        if self._marks is None:
            self._marks = self.ones()
        high = (self._marks[at] - at).astype(np.uint64)
        return (high << np.uint64(8 * self.width) if self.width < 8 else high) | self.lows(at)

    def successors(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each value, the first place in first..last-1 whose number isn't smaller, else last. Bisects all at once."""
        lo, hi = first.astype(np.int64).copy(), last.astype(np.int64).copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.get(mid) < values[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo
