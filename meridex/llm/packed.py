"""Compact integer sequences: variable-length bytes for shuffles and Elias-Fano levels for tries."""

from __future__ import annotations

import numpy as np


def pack_values(d: np.ndarray) -> bytes:
    """uint64 values of seven bits a byte each."""
    if not len(d):
        return b""
    most = int(d.max())
    if most < 128:
        return d.astype(np.uint8).tobytes()
    size = np.ones(len(d), np.int64)
    for k in range(7, most.bit_length(), 7):
        size += d >= np.uint64(1) << np.uint64(k)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]), np.uint8)
    at, rest = end - size, d
    while len(at):
        more = rest >= np.uint64(128)
        out[at] = (rest & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        at, rest = at[more] + 1, rest[more] >> np.uint64(7)
    return out.tobytes()


def unpack_values(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(data < 128)
    if len(last) == len(data):
        return data.astype(np.uint64)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    parts = (data & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, first)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as differences."""
    d = values.copy()
    d[1:] -= values[:-1]
    return pack_values(d)


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_values(raw), dtype=np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending. (`np.unique` hashes all values before it sorts, which takes several times as long.)"""
    held = np.sort(values)
    return held[np.append(True, held[1:] != held[:-1])] if len(held) else held


class Distinct:
    """The distinct values of many lots; those that wait are merged once they are as many as those held, so it is
    a few sorts of all values in the end, however many lots there are."""

    def __init__(self) -> None:
        self.held, self.lots, self.waiting = np.zeros(0, np.uint64), [], 0

    def add(self, values: np.ndarray) -> None:
        self.lots.append(distinct(values))
        self.waiting += len(self.lots[-1])
        if self.waiting > max(len(self.held), 1 << 18):
            self.all()

    def all(self) -> np.ndarray:
        self.held, self.lots, self.waiting = distinct(np.concatenate([self.held, *self.lots])), [], 0
        return self.held


_EACH, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_PAIRS, _FOURS, _BYTES = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
#: For each byte and r: the place of its bit number r that is set.
_PLACE = np.array([[*(k for k in range(8) if i >> k & 1), *([8] * (8 - bin(i).count("1")))] for i in range(256)], np.uint8)


#: Values whose lower bits are cut at once; a multiple of eight, so each lot fills whole bytes.
_STEP = 1 << 15


class EliasFano:
    """A monotone sequence: `low` bits of each value in a row, the rest as gaps of a bit array (about 2 + low bits each).

    Values are read and searched where they are, through counts of the bits before each 64 of them; nothing is decoded.
    """

    def __init__(self, number: int, low: int, lower: np.ndarray, upper: np.ndarray):
        self.number, self.low, self.lower, self.upper = number, low, lower, upper
        self.words = np.asarray(upper).view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = [np.concatenate([[0], np.cumsum(x)]) for x in (64 - ones, ones)]
        self.lanes = np.ndarray((len(lower) - 7,), "<u8", lower, strides=(1,))
        self.zeros = 64 * len(self.words) - number

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        low = min(max(0, (int(values[-1]) // n).bit_length() - 1), 56) if n else 0
        high = (values >> np.uint64(low)).astype(np.int64)
        size = int(high[-1]) + n + 1 if n else 1
        bits = np.zeros(size + -size % 64, np.uint8)
        bits[high + np.arange(n)] = 1
        data = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
        each = (np.unpackbits(data[k : k + _STEP], axis=1, count=low, bitorder="little") for k in range(0, n if low else 0, _STEP))
        lower = np.concatenate([*(np.packbits(x, bitorder="little") for x in each), np.zeros(8, np.uint8)])
        return cls(n, low, lower, np.packbits(bits, bitorder="little"))

    def _select(self, bit: int, i: np.ndarray) -> np.ndarray:
        """Where in the upper bits the i-th of this value stands, counted from 0."""
        word = np.searchsorted(self.before[bit], i, "right") - 1
        left = (i - self.before[bit][word]).astype(np.uint64)
        bits = self.words[word] if bit else ~self.words[word]
        sums = bits - ((bits >> np.uint64(1)) & _PAIRS)
        sums = (sums & _FOURS) + ((sums >> np.uint64(2)) & _FOURS)
        sums = ((sums + (sums >> np.uint64(4))) & _BYTES) * _EACH  # in each byte: the bits up to its end
        skip = np.bitwise_count(((left * _EACH | _HIGH) - sums) & _HIGH).astype(np.uint64) << np.uint64(3)  # whole bytes before it, in bits
        left -= ((sums << np.uint64(8)) >> skip) & np.uint64(255)
        return 64 * word + skip.astype(np.int64) + _PLACE[((bits >> skip) & np.uint64(255)).astype(np.uint8), left.astype(np.uint8)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low
        return (self.lanes[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values of these numbers."""
        return ((self._select(1, i) - i).astype(np.uint64) << np.uint64(self.low)) | self._low(i)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the first entry that is not less than each value (or the length), and whether it is equal.

        Entries of the same upper part lie between two zeros of the upper bits; among them the lower bits decide.
        """
        high, rest = (values >> np.uint64(self.low)).astype(np.int64), values & np.uint64((1 << self.low) - 1)
        inside = high < self.zeros
        h = np.where(inside, high, self.zeros - 1)
        lo = np.where(h > 0, self._select(0, np.maximum(h - 1, 0)) - h + 1, 0)
        hi = np.where(inside, self._select(0, h) - h, self.number)
        lo = np.where(inside, lo, self.number)
        end = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < rest[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        equal = lo < end
        equal[equal] = self._low(lo[equal]) == rest[equal]
        return lo, equal

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.number, self.low, len(self.lower), len(self.upper)], "<i8").view(np.uint8), self.lower, self.upper]

    @classmethod
    def read(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """From a memory map: (sequence, where it ends)."""
        n, low, a, b = np.frombuffer(data[at : at + 32].tobytes(), "<i8").tolist()
        at += 32
        return cls(n, low, data[at : at + a], data[at + a : at + a + b]), at + a + b
