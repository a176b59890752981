"""Substring dedup: Rabin-Karp hashes of every fixed-length token window.

Every window of `window` words gets a 64-bit rolling hash, and a second, independent one:
its high bits pick the bucket, and as many of its low bytes go along as the input's size asks for. Two windows pass
for one only if all of these agree. The bytes are so many that of all pairs of windows, less than one false
agreement in a thousand runs is expected: 0 of them for 10^9 windows, 2 for 10^13 in 65,536 buckets.
Map tasks keep a hash's first place of each segment (some million windows) and so send
a frequent passage once per segment, however often it occurs. A bucket's task
finds the places that aren't a hash's first; they go back to their rows, merge into
maximal intervals, and the words under them go. Buckets are as many as the input's size
asks for, and a task streams its bucket's texts past the places of that bucket.

Rows come in the order of their ids, null before all. Rows that repeat an id, or have none, are
documents of their own, in the order of a hash of what they hold; so of two different texts with
one id, the later in that order loses what they share. A row that is there twice is one place:
it loses nothing by itself.

Defined results: null or empty text has no words, and gives an empty text. A
text shorter than the window loses nothing. Columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import (
    SPACE,
    by_bucket,
    hashed_words,
    id_array,
    ids,
    pack,
    roll,
    runs,
    splitmix,
    spread,
    text_buffer,
    unpack,
    windows_of,
)
from ._store import bucket_count, dealt, input_size, ship

_SCHEMA = "key int, kind int, payload binary"
_ARROW = pa.schema([("key", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
#: Kinds of rows: windows for their hash's bucket; repeated places, and texts, for their row's.
_WINDOWS, _PLACES, _TEXTS = 0, 1, 2
#: Windows that a map task holds at a time: about 150 MB with what sorting needs.
SEGMENT = 3_000_000
#: Words of texts that a task gathers before it hands them on.
BATCH = 2_000_000


def twin_bytes(size: int, buckets: int) -> int:
    """Bytes of the second hash, for an input of size bytes (as stored: a byte or more a window): 2 log2(windows) + 10 bits, less those of the first hash and the bucket."""
    need = 2 * max(size, 1).bit_length() + 10 - 64 - (buckets.bit_length() - 1)
    return next((n for n in (0, 2) if 8 * n >= need), 4)


def _home(rows: np.ndarray, n: int) -> np.ndarray:
    """The bucket to which a row's text and places go, by the row's hash."""
    h = (rows.view(np.uint64) + np.uint64(7)) * np.uint64(splitmix(77) | 1)
    return spread(h ^ (h >> np.uint64(29)) * np.uint64(splitmix(78) | 1), n)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], schema=_ARROW)


class Windows:
    """Windows and the rows that they lie in: their places are ordered by (id, row hash, start)."""

    def __init__(self, doc: np.ndarray, row: np.ndarray, own: np.ndarray, start: np.ndarray, h: np.ndarray, g: np.ndarray):
        self.doc, self.row, self.own, self.start, self.h, self.g = doc, row, own, start, h, g
        order = np.lexsort((row, doc))
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.cumsum(new) - 1
        self.rank = rank  # of each row; that of equal rows is the same

    def judged(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows that are their hash's first place, or its only one; and windows whose hash has an earlier place."""
        order = np.argsort(self.h, kind="stable")
        s = self.h[order]
        twice = np.zeros(len(s), dtype=bool)
        same = s[1:] == s[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        at = order[twice]
        h, g, place, start = self.h[at], self.g[at], self.rank[self.own[at]], self.start[at]
        order = np.lexsort((start, place, g, h))
        at, h, g, place, start = at[order], h[order], g[order], place[order], start[order]
        begins = np.ones(len(at), dtype=bool)
        begins[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        lead = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        later = (place != place[lead]) | (start != start[lead])
        keep = np.ones(len(self.h), dtype=bool)
        keep[at] = begins
        return np.flatnonzero(keep), at[later]

    def of(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows `at` in the order of their rows, for packing: the rows' ids and hashes, how many each has, starts."""
        own, start = self.own[at], self.start[at]
        order = np.lexsort((start, own))
        own, start = own[order], start[order]
        cut = runs(own)
        of = own[cut[:-1]]
        return order, self.doc[of], self.row[of], np.diff(cut).astype(np.uint32), np.diff(start.astype(np.uint32), prepend=np.uint32(0))

    def places(self, at: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
        """Repeated windows, packed for their rows' buckets."""
        return [(b, _PLACES, pack(*self.of(at[x])[1:], raw=(1,))) for b, x in by_bucket(_home(self.row[self.own[at]], buckets), buckets)]


def _windows(n: int, buckets: int, most: int, twin: int):
    def segment(held):
        many = [len(x[0]) for x in held]
        shift = np.repeat(np.cumsum([0, *many[:-1]]), [len(x[2]) for x in held])
        doc, row, own, start, h, g = (np.concatenate(x) for x in zip(*held, strict=True))
        w = Windows(doc, row, own + shift, start, h, (g & np.uint64((1 << 8 * twin) - 1)).astype({0: np.uint8, 2: np.uint16, 4: np.uint32}[twin]))
        first, later = w.judged()
        out = w.places(later, buckets)
        for b, x in by_bucket(spread(g[first], buckets), buckets):
            at = first[x]
            order, *places = w.of(at)
            out.append((b, _WINDOWS, pack(*places, w.h[at[order]], w.g[at[order]], raw=(1, 4, 5))))
        return _batch(out)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            row_ids, doc_ids = batch.column(0).to_numpy(zero_copy_only=False), ids(batch.column(1))
            buf, offs = text_buffer(batch.column(2))
            for a, b, words, first in hashed_words(buf, offs, SPACE, False):
                at, doc, start = windows_of(first, n)
                if len(at):
                    held.append((doc_ids[a:b], row_ids[a:b], doc, start.astype(np.int64), roll(words, n)[at], roll(words, n, 1)[at]))
                    size += len(at)
                if size >= most:
                    yield segment(held)
                    held, size = [], 0
        if size:
            yield segment(held)

    return run


def _unpacked(payloads: list[bytes]):
    """(ids, row hashes, row of each window, starts, further columns) of packed windows."""
    cols = [unpack(p) for p in payloads]
    many = np.concatenate([c[2] for c in cols]).astype(np.int64)
    starts = np.concatenate([np.cumsum(c[3], dtype=np.uint32) for c in cols]).astype(np.int64)
    more = [np.concatenate([c[k] for c in cols]) for k in range(4, len(cols[0]))]
    return np.concatenate([c[0] for c in cols]), np.concatenate([c[1] for c in cols]), np.repeat(np.arange(len(many)), many), starts, *more


def _repeats(buckets: int):
    """Of a bucket's windows, the places that aren't their hash's first; places found before pass through."""

    def run(table: pa.Table) -> pa.Table:
        kinds, payloads = table.column("kind").to_numpy(), table.column("payload").to_pylist()
        bucket = int(table.column("bucket")[0].as_py())
        out = [(bucket, _PLACES, p) for k, p in zip(kinds, payloads, strict=True) if k == _PLACES]
        own = [p for k, p in zip(kinds, payloads, strict=True) if k == _WINDOWS]
        if own:
            w = Windows(*_unpacked(own))
            out += w.places(w.judged()[1], buckets)
        return pa.Table.from_batches([_batch(out)]) if out else _ARROW.empty_table()

    return run


def _texts(buckets: int):
    def run(batches):
        for batch in batches:
            row_ids, doc_ids = batch.column(0).to_numpy(zero_copy_only=False), ids(batch.column(1))
            buf, offs = text_buffer(batch.column(2))
            lens, out = np.diff(offs), []
            for b, at in by_bucket(_home(row_ids, buckets), buckets):
                body = np.concatenate([buf[offs[i] : offs[i + 1]] for i in at])
                out.append((b, _TEXTS, pack(doc_ids[at], row_ids[at], lens[at].astype(np.int64), body, raw=(1,))))
            if out:
                yield _batch(out)

    return run


_OUT = "doc_id bigint, text string, n_words bigint, n_removed bigint"


class Gone:
    """A bucket's repeated places, by row."""

    def __init__(self, payloads: list[bytes]):
        self.row = np.empty(0, np.int64)
        if payloads:
            doc, row, own, start = _unpacked(payloads)
            order = np.lexsort((start, doc[own], row[own]))
            self.row, self.doc, self.start = row[own][order], doc[own][order], start[order]

    def starts(self, row: int, doc: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.row, row, "left"), np.searchsorted(self.row, row, "right")
        return self.start[lo:hi][self.doc[lo:hi] == doc] if hi > lo else self.row[:0]


def _kept(words: list[bytes], starts: np.ndarray, n: int) -> list[bytes]:
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return [words[j] for j in np.flatnonzero(np.cumsum(edge[: len(words)]) == 0)]


def _removed(n: int):
    """Streams buckets: a bucket's places come first, and its texts pass by them."""

    def done(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([id_array(np.array(cols[0], np.int64)), pa.array(cols[1], pa.binary()).cast(pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    def run(batches):
        now, places, gone, out, size = None, [], None, [], 0
        for batch in batches:
            for bucket, kind, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != now:
                    now, places, gone = bucket, [], None
                if kind == _PLACES:
                    places.append(payload)
                    continue
                if gone is None:
                    gone, places = Gone(places), []
                doc_ids, row_ids, lens, body = unpack(payload)
                ends = np.cumsum(lens)
                for doc, row, a, b in zip(doc_ids.tolist(), row_ids.tolist(), (ends - lens).tolist(), ends.tolist(), strict=True):
                    words = body[a:b].tobytes().split()
                    starts = gone.starts(row, doc)
                    left = _kept(words, starts, n) if len(starts) else words
                    out.append((doc, b" ".join(left), len(words), len(words) - len(left)))
                    size += len(words)
                if size >= BATCH:
                    yield done(out)
                    out, size = [], 0
        if out:
            yield done(out)

    return run


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, twin: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text (the words left, joined by one space), n_words, n_removed.

    A word goes if a window over it also starts earlier: in a row before, or in
    the same row before. twin, the bytes of the second hash that go along (0, 2 or 4), follows from the input's size.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = bucket_count(src, 8)
    twin = twin_bytes(input_size(src), buckets) if twin is None else twin
    key = lambda rows: dealt(rows.withColumnRenamed("key", "bucket"), "bucket", buckets)
    places = key(src.mapInArrow(_windows(window, buckets, segment, twin), _SCHEMA)).groupBy("key").applyInArrow(_repeats(buckets), _SCHEMA)
    texts = src.mapInArrow(_texts(buckets), _SCHEMA)
    rows = key(places.unionByName(texts)).sortWithinPartitions("bucket", "kind")
    return rows.select("bucket", "kind", "payload").mapInArrow(_removed(window), _OUT)
