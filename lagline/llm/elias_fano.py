"""Elias-Fano coded monotone sequences over numpy arrays, which may be memory-mapped.

A value's low bits are packed at fixed width; its high part is a bit vector with a
one per value and a zero per step of the high part. Lookups are vectorised: a
successor search selects the zeros around a query's high part, and bisects the low
bits between them.
"""

from __future__ import annotations

import json

import numpy as np

_ONE = np.uint64(1)


def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing uint64 sequence with values below universe."""
    n = len(values)
    width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
    width = min(width, 56)
    high = (values >> np.uint64(width)).astype(np.int64)
    size = n + ((universe - 1) >> width if universe > 0 else 0) + 2
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    zeros = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))))
    low = np.zeros(-(-(n * width) // 8) + 8, np.uint8)
    step = 1 << 18  # values at a time; a multiple of 8, so that each begins a byte
    for a in range(0, n if width else 0, step):
        part = values[a : a + step]
        plane = np.empty((len(part), width), np.uint8)
        for b in range(width):
            plane[:, b] = (part >> np.uint64(b)) & _ONE
        packed = np.packbits(plane.ravel(), bitorder="little")
        low[a * width // 8 : a * width // 8 + len(packed)] = packed
    return {"low": low, "high": words, "zeros": zeros.astype(np.uint32 if zeros[-1] < 1 << 32 else np.uint64), "shape": np.array([n, width, universe], np.uint64)}


_L, _H = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_M1, _M2, _M4 = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
#: Position of the k-th set bit of a byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for b in range(256) for k in range(8)], np.uint8)


def _select(word: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Position of the left-th set bit (from 0) of each word: bytes' running counts, side by side in a word, then a table."""
    one, left = np.uint64(1), left.astype(np.uint64)
    s = word - ((word >> one) & _M1)
    s = (s & _M2) + ((s >> np.uint64(2)) & _M2)
    s = ((s + (s >> np.uint64(4))) & _M4) * _L  # byte i: bits set in bytes 0 to i
    full = (((left * _L) | _H) - s) & _H  # bytes that end before the bit
    place = np.minimum(np.bitwise_count(full).astype(np.uint64) << np.uint64(3), np.uint64(56))
    rank = left - (((s << np.uint64(8)) >> place) & np.uint64(0xFF))
    byte = (word >> place) & np.uint64(0xFF)
    return place.astype(np.int64) + _IN_BYTE[((byte << np.uint64(3)) | (rank & np.uint64(7))).astype(np.int64)]


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self._ones: np.ndarray | None = None
        self.n, self.width, self.universe = (int(x) for x in arrays["shape"])
        self.high, self.zeros = arrays["high"], arrays["zeros"]
        raw = arrays["low"]
        # Each 8 bytes from any byte on, as one number.
        self.low = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        return (self.low[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero (from 0)."""
        w = np.searchsorted(self.zeros, k, "right") - 1
        return w * 64 + _select(~self.high[w], k - self.zeros[w].astype(np.int64))

    def successor(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each x: the first index (within [begin, end)) of a value >= x, and whether it equals x."""
        x = x.astype(np.uint64)
        beyond = x >= np.uint64(self.universe)
        x = np.minimum(x, np.uint64(max(self.universe - 1, 0)))
        h = (x >> np.uint64(self.width)).astype(np.int64)
        hi = self._select0(h) - h
        lo = np.where(h > 0, self._select0(np.maximum(h - 1, 0)) + 1 - h, 0)
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
            hi = np.maximum(hi, lo)
        want, top = x & np.uint64((1 << self.width) - 1), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        found = lo < top
        found[found] = self._low(lo[found]) == want[found]
        return np.where(beyond, self.n, lo), found & ~beyond

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at indices i: the high part is the position of the i-th one, less i."""
        if self._ones is None:
            self._ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros.astype(np.int64)
        w = np.searchsorted(self._ones, i, "right") - 1
        high = w * 64 + _select(self.high[w], i - self._ones[w]) - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | self._low(i)


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one block of bytes, each at a multiple of 8."""
    head, body, at = {}, [], 0
    for name, x in arrays.items():
        data = np.ascontiguousarray(x).tobytes()
        head[name] = (x.dtype.str, at, len(x))
        data += b"\0" * (-len(data) % 8)
        body.append(data)
        at += len(data)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return b"".join([len(text).to_bytes(8, "little"), text, *body])


def load(block: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a block: views, nothing is copied."""
    size = int.from_bytes(block[:8].tobytes(), "little")
    head = json.loads(block[8 : 8 + size].tobytes())
    out = {}
    for name, (kind, at, n) in head.items():
        kind = np.dtype(kind)
        begin = 8 + size + at
        out[name] = np.frombuffer(block[begin : begin + n * kind.itemsize], dtype=kind)
    return out


def part(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {k.removeprefix(prefix): v for k, v in arrays.items() if k.startswith(prefix)}
