"""Vectorised text primitives on Arrow buffers.

All of them work on the UTF-8 bytes of a whole batch, a slice of documents at a
time, so that the temporary arrays stay small whatever the batch holds.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: What stands for a null id inside packed arrays; nulls sort before every id.
NULL_ID = np.iinfo(np.int64).min
_M64 = (1 << 64) - 1


def splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M64
    return x ^ (x >> 31)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_KEYS = np.array([splitmix(i + 1) for i in range(256)], dtype=np.uint64)
_BYTE_BASE = np.uint64(splitmix(1001) | 1)
_ORDER = np.arange(256)

#: Bytes that part words: `[\x20\x09-\x0D]`.
SPACE = (_ORDER == 0x20) | ((_ORDER >= 0x09) & (_ORDER <= 0x0D))
#: Bytes that part words: `[\x00-\x2F\x3A-\x60\x7B-\x7F]`.
PUNCT = (_ORDER <= 0x2F) | ((_ORDER >= 0x3A) & (_ORDER <= 0x60)) | ((_ORDER >= 0x7B) & (_ORDER <= 0x7F))
#: A-Z to a-z, all else unchanged.
LOWER = np.where((_ORDER >= 65) & (_ORDER <= 90), _ORDER + 32, _ORDER).astype(np.uint8)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def ids(col: pa.Array) -> np.ndarray:
    return pc.fill_null(col.cast(pa.int64()), int(NULL_ID)).to_numpy(zero_copy_only=False)


def id_array(values: np.ndarray) -> pa.Array:
    return pa.array(values, type=pa.int64(), mask=values == NULL_ID)


def doc_slices(offs: np.ndarray, most: int = 1 << 20):
    """Ranges [a, b) of documents with about `most` bytes each, one document at least."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_spans(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray):
    """Starts and ends (bytes) of the words of consecutive documents, and each document's first word."""
    n = len(buf)
    word = ~sep[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)))
    at = np.arange(first[-1]) - np.repeat(first[:-1], lens)
    vals = _BYTE_KEYS[buf[at + np.repeat(starts, lens)]] * _powers(_BYTE_BASE, int(lens.max()))[at]
    return mix(np.add.reduceat(vals, first[:-1]) + lens.astype(np.uint64))


def hashed_words(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray, lower: bool):
    """For each slice of documents: (a, b, word hashes, first word of each document)."""
    for a, b in doc_slices(offs):
        part = buf[offs[a] : offs[b]]
        part = LOWER[part] if lower else part
        starts, ends, first = word_spans(part, offs[a : b + 1] - offs[a], sep)
        yield a, b, word_hashes(part, starts, ends), first


_ROLL = [np.uint64(splitmix(2001 + i) | 1) for i in range(2)]


def roll(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hash, modulo 2^64, of each n consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    if n <= 8:
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = out * _ROLL[which] + h[k : len(h) - n + 1 + k]
        return mix(out)
    up = _powers(_ROLL[which], len(h))
    down = _powers(np.uint64(pow(int(_ROLL[which]), -1, 1 << 64)), len(h) - n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)))
    return mix((sums[n:] - sums[:-n]) * down)


def windows_of(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts that stay in their document: (word index, document, start in the document)."""
    many = np.maximum(np.diff(first) - n + 1, 0)
    doc = np.repeat(np.arange(len(many)), many)
    start = np.arange(many.sum()) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])), many)
    return first[:-1][doc] + start, doc, start


# Packed columns: shuffled as one binary value for many rows.
_KINDS = {"B": np.uint8, "H": np.uint16, "I": np.uint32, "Q": np.uint64, "i": np.int32, "q": np.int64, "d": np.float64}
_CODE = {np.dtype(v): k for k, v in _KINDS.items()}


def pack(*cols: np.ndarray, raw: tuple[int, ...] = ()) -> bytes:
    """Arrays as bytes: zstd, but for the columns named in raw."""
    out = [struct.pack("<B", len(cols))]
    press = zstandard.ZstdCompressor(level=1)
    for i, c in enumerate(cols):
        data = np.ascontiguousarray(c).tobytes()
        small = i not in raw and len(data) > 64
        body = press.compress(data) if small else data
        out.append(struct.pack("<cBQQ", _CODE[c.dtype].encode(), small, len(c), len(body)))
        out.append(body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    cols, at, unpress = [], 1, zstandard.ZstdDecompressor()
    for _ in range(data[0]):
        code, small, n, size = struct.unpack_from("<cBQQ", data, at)
        at += 18
        kind = np.dtype(_KINDS[code.decode()])
        body = data[at : at + size]
        cols.append(np.frombuffer(unpress.decompress(body, max_output_size=n * kind.itemsize) if small else body, dtype=kind, count=n))
        at += size
    return cols


def deltas(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted column: small numbers, for zstd. Wraps around, so any int64 does."""
    y = x.astype(np.int64).view(np.uint64)
    return np.diff(y, prepend=np.uint64(0))


def undeltas(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64).view(np.int64)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    n = len(sorted_keys)
    if not n:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [n]))


def by_bucket(bucket: np.ndarray, n_buckets: int):
    """(bucket, row numbers in their order) for each bucket that has rows."""
    kind = np.uint16 if n_buckets <= 1 << 16 else np.uint32
    order = np.argsort(bucket.astype(kind), kind="stable")
    cut = runs(bucket[order])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """A hash's bucket of n, by its high 32 bits."""
    return (((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def by_group(batches, keys: int):
    """(key, table) of each run of rows that agree in the first `keys` columns (integers without nulls). Holds one run at a time."""
    held, now = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, dtype=bool)
        change[0] = True
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cut = np.append(np.flatnonzero(change), n)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            key = tuple(int(c[a]) for c in cols)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)
