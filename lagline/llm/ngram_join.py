"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection.

A document's set is its distinct n-word shingles, as 64-bit hashes. Documents with
equal sets are one class. Two classes link when den * |A & B| >= num * |A | B|.

Tiles. Sizes are cut into bands; a band's scheme covers the sizes l..u that a
smaller member of the band can link to. Linked sets of a scheme differ in at most k
shingles. The scheme deals the shingle space into m = k + 1 + e parts by hash: k
differences spoil at most k parts, so 1 + e parts at least hold the same shingles in both
sets. At most e of them can be empty in both unless both sets leave 1 + e parts
empty, and such sets emit their empty parts, too. So a linked pair always shares a
tile (scheme, part, the part's content), and nothing else is compared.

Bitmaps. Every set has a parity bitmap (one bit toggled per shingle, four bits or more a
shingle). The bits in which two bitmaps differ are at most the shingles in which the sets
differ, so bit counts bound the overlap from above; what fails the bound is
dropped unseen. Survivors are verified by intersecting the sorted arrays.

The work goes in two rounds, and neither writes a group's pairs out:

* candidates. A tile of few members gives all its pairs; a larger one pairs its pivot (the
  member with the most larger tiles, so the text that a group was copied from) with
  each other. Pairs that pass the bound join classes into groups. In larger tiles whose members
  are not yet one group, blocks of members are compared by their bitmaps within a task,
  which returns a spanning forest: fewer rows than members.
* verification. Each class's array goes once to its group's task, which joins what links by
  union-find over exact intersections. A group too large for that first verifies two partners
  of each class, and then compares blocks of what is still apart, each block pair in
  a task of its own that returns a forest again.

Every pair of a tile is thus compared, unless its two classes are in one component already.

Defined results: null or empty text has an empty set and links with nothing. A text
with fewer words than n has its whole sequence as one shingle. A null id counts as no id:
it's reported as null and is never a component's smallest. Rows that repeat an id, or
have none, are judged each by its own text: inside, rows are told apart by what they hold.
Columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import SPACE, by_bucket, by_group, hashed_words, id_array, ids, mix, pack, roll, runs, spread, splitmix, text_buffer, unpack, windows_of
from ._store import bucket_count, dealt, partitions, ship, sieved, without, written
from .components import components, unite

#: Signatures that a map task holds at a time.
SEGMENT = 1_500_000
#: A tile of up to so many members gives all its pairs at once.
SMALL_TILE = 16
#: Members of a block of a larger tile, which has their bitmaps.
BLOCK = 4096
#: Members, and shingles, of a group (or of a block of a larger group), which has their arrays.
GROUP, GROUP_SHINGLES = 512, 4_000_000
#: Rows that a task gathers before it hands them on.
ROWS = 10_000


@dataclass(frozen=True)
class Rule:
    n: int = 4
    num: int = 85
    den: int = 100

    def schemes(self) -> list[tuple[int, int, int, int]]:
        """(l, u, k, m) of each band, up to 2^31 shingles."""
        out, low = [], 1
        while low < 1 << 31:
            nxt = low * 3 // 2 + 1
            u = (nxt - 1) * self.den // self.num
            k = (self.den - self.num) * (nxt - 1 + u) // (self.den + self.num)
            m = k + 1
            m += math.ceil(2 * m * math.exp(-low / m)) + 1 if k else 0
            out.append((low, u, k, m))
            low = nxt
        return out

    def sizes_fit(self, a: int, b: int) -> bool:
        return self.den * min(a, b) >= self.num * max(a, b)


_EMPTY = np.uint64(splitmix(31))
_MASK = (1 << 64) - 1
_SCHEME, _PART = np.uint64(splitmix(32) | 1), np.uint64(splitmix(33) | 1)
_TWIN = np.uint64(splitmix(34) | 1)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int):
    """For each slice of documents: (a, hashes sorted within each document and distinct, each document's first one)."""
    for a, b, words, first in hashed_words(buf, offs, SPACE, True):
        at, doc, _ = windows_of(first, n)
        g = roll(words, n)[at] if len(at) else np.empty(0, np.uint64)
        many = np.diff(first)
        for k in range(1, n):  # a short text's whole sequence
            own = np.flatnonzero(many == k)
            if len(own):
                g = np.concatenate((g, mix(roll(words, k)[first[own]] + np.uint64(k))))
                doc = np.concatenate((doc, own))
        order = np.lexsort((g, doc))
        g, doc = g[order], doc[order]
        keep = np.ones(len(g), dtype=bool)
        keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        g, doc = g[keep], doc[keep]
        yield a, g, np.searchsorted(doc, np.arange(b - a + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return c[first[1:]] - c[first[:-1]]


def digests(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two columns."""
    return np.stack((_sums(mix(g + _EMPTY), first), _sums(mix(g * _TWIN + _EMPTY), first)), axis=1)


def bitmap(g: np.ndarray) -> bytes:
    """Parity bitmap of 2^j bits, at least 256 and at least four a shingle."""
    bits = max(256, 1 << max(0, 4 * len(g) - 1).bit_length())
    count = np.bincount((g & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(count.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two parity bitmaps differ, the longer folded: never more than the sets do."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        x = np.frombuffer(a, np.uint8)
        a = (x[: len(x) // 2] ^ x[len(x) // 2 :]).tobytes()
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def signatures(g: np.ndarray, first: np.ndarray, scheme: int, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Part signatures of sets in one scheme, and the set of each."""
    many = np.diff(first)
    doc = np.repeat(np.arange(len(many)), many)
    part = spread(g, m)  # rises with g, so a set's parts lie in order
    cut = runs(doc * np.int64(m) + part)
    own = np.uint64((scheme + 1) * int(_SCHEME) & _MASK)
    d, p = doc[cut[:-1]], part[cut[:-1]]
    sig = mix(_sums(mix(g + _SCHEME), cut) + own + (p + 1).astype(np.uint64) * _PART)
    of_set, empty = d, m - np.bincount(d, minlength=len(many))
    for i in np.flatnonzero(empty >= m - k):  # many empty parts: they count, too
        none = np.setdiff1d(np.arange(m), p[of_set == i])
        sig = np.concatenate((sig, mix((none + 1).astype(np.uint64) * _PART + own + _EMPTY)))
        d = np.concatenate((d, np.full(len(none), i)))
    return sig, d


# One scan gives two kinds of rows: a document's set (bucket null), and tile members packed by bucket.
_SETS = "row bigint, doc_id bigint, n bigint, cls binary, c64 bigint, bits binary, bucket int, payload binary"
_SET_FIELDS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("c64", pa.int64()), ("bits", pa.binary()), ("bucket", pa.int32()), ("payload", pa.binary())])


def _sets(rule: Rule, buckets: int):
    schemes = [(s, *x) for s, x in enumerate(rule.schemes()) if x[2]]  # where k is 0, links are equal sets

    def segment(held):
        sig, own = (np.concatenate(x) for x in zip(*held, strict=True))
        rows = []
        for b, at in by_bucket(spread(sig, buckets), buckets):
            names, of = np.unique(own[at], return_inverse=True)
            order = np.argsort(of, kind="stable")
            rows.append((b, pack((sig[at][order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), names, np.diff(of[order], prepend=0).astype(np.uint32), raw=(0, 1))))
        cols = [pa.nulls(len(rows), f.type) for f in _SET_FIELDS][:6]
        return pa.RecordBatch.from_arrays([*cols, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_SET_FIELDS)

    def run(batches):
        held, size, seen = [], 0, set()
        for batch in batches:
            row, doc_ids = batch.column(0), id_array(ids(batch.column(1)))
            buf, offs = text_buffer(batch.column(2))
            for a, g, first in shingle_sets(buf, offs, rule.n):
                many = np.diff(first).astype(np.int64)
                d = digests(g, first)
                some = many > 0
                cls = [x.tobytes() if y else None for x, y in zip(d, some, strict=True)]
                bits = [bitmap(g[x:y]) if y > x else None for x, y in zip(first[:-1], first[1:], strict=True)]
                cols = [row.slice(a, len(many)), doc_ids.slice(a, len(many)), pa.array(many), pa.array(cls, pa.binary()), pa.array(d[:, 0].astype(np.int64), mask=~some), pa.array(bits, pa.binary()), pa.nulls(len(many), pa.int32()), pa.nulls(len(many), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema=_SET_FIELDS)
                new = np.zeros(len(many), dtype=bool)
                for i in np.flatnonzero(some):  # of equal sets of a segment, one goes on
                    new[i] = cls[i] not in seen
                    seen.add(cls[i])
                for s, low, high, k, m in schemes:
                    own = np.flatnonzero(new & (many >= low) & (many <= high))
                    if len(own):
                        at = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
                        sig, of = signatures(g[at], np.concatenate(([0], np.cumsum(many[own]))), s, k, m)
                        held.append((sig, d[own[of], 0].astype(np.int64)))
                        size += len(sig)
                if size >= SEGMENT:
                    yield segment(held)
                    held, size, seen = [], 0, set()
        if size:
            yield segment(held)

    return run


_PAIRS = "tile bigint, a bigint, b bigint"
_PAIR_FIELDS = pa.schema([("tile", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _pairs(small: int):
    """Of a bucket's tiles: all pairs of small ones (tile null), and the members of larger ones (b null)."""

    def run(table: pa.Table) -> pa.Table:
        cols = [unpack(p) for p in table.column("payload").to_pylist()]
        bucket = table.column("bucket")[0].as_py()
        sig = np.concatenate([c[0] for c in cols])
        own = np.concatenate([c[1][np.cumsum(c[2])] for c in cols])
        order = np.argsort(sig, kind="stable")
        s = sig[order]
        twice = np.zeros(len(s), dtype=bool)
        same = s[1:] == s[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        at = order[twice]
        sig, own = sig[at], own[at]
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        keep = np.ones(len(sig), dtype=bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
        sig, own = sig[keep], own[keep]
        cut = runs(sig)
        many = np.diff(cut)
        left = many[np.searchsorted(cut, np.arange(len(sig)), "right") - 1] if len(sig) else many  # each row's tile size
        place = np.arange(len(sig)) - np.repeat(cut[:-1], many)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for back in range(1, small):
            at = np.flatnonzero((place >= back) & (left <= small))
            a.append(own[at - back])
            b.append(own[at])
        ab = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0)
        big = np.flatnonzero(left > small)
        none = np.zeros(len(ab), np.int64)
        tile = pa.array(np.concatenate((none, (sig[big].astype(np.int64) << 24) + bucket)), mask=np.concatenate((none == 0, np.zeros(len(big), bool))))
        other = pa.array(np.concatenate((ab[:, 1], own[big])), mask=np.concatenate((none != 0, np.ones(len(big), bool))))
        return pa.table([tile, pa.array(np.concatenate((ab[:, 0], own[big]))), other], schema=_PAIR_FIELDS)

    return run


def _bound(rule: Rule):
    """Keeps the pairs whose bit counts allow the overlap, with the share that they allow."""

    def run(batches):
        for batch in batches:
            keep, share = [], []
            for x, y, p, q in zip(*(batch.column(k).to_pylist() for k in (4, 5, 2, 3)), strict=True):
                over = min((p + q - differing(x, y)) // 2, p, q)
                keep.append(rule.den * over >= rule.num * (p + q - over))
                share.append(over / max(p + q - over, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())], names=["a", "b", "share"]).filter(pa.array(keep, pa.bool_()))

    return run


def _folded(bits: list[bytes], width: int) -> np.ndarray:
    """Parity bitmaps folded to width bytes, as 64-bit words."""
    out = np.empty((len(bits), width // 8), np.uint64)
    for k, x in enumerate(bits):
        x = np.frombuffer(x, np.uint64)
        while 8 * len(x) > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[k] = x
    return out


def _near(rule: Rule, n: np.ndarray, bits: list[bytes], step: int = 64):
    """(i, others, overlap bounds) of members: all pairs that sizes and bit counts allow, each once."""
    order = np.argsort(n, kind="stable")
    size, width = n[order], np.array([len(bits[i]) for i in order])
    top = np.searchsorted(size, size * rule.den // rule.num, "right")  # sizes beyond can't link
    for w in np.unique(width).tolist():
        begin, end = np.searchsorted(width, [w, w + 1])
        stop = int(top[end - 1])
        own = _folded([bits[i] for i in order[begin:stop]], w)
        for p in range(begin, end, step):
            q = min(p + step, end)
            hi = int(top[q - 1])
            x, y = own[p - begin : q - begin], own[p - begin : hi - begin]
            differ = np.zeros((q - p, hi - p), np.int32)
            for k in range(x.shape[1]):
                differ += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
            both = size[p:q, None] + size[None, p:hi]
            over = np.minimum((both - differ) // 2, size[p:q, None])
            ok = np.triu(rule.den * over >= rule.num * (both - over), 1)
            for r in np.flatnonzero(ok.any(axis=1)):
                at = np.flatnonzero(ok[r])
                yield int(order[p + r]), order[p + at], over[r, at]


def _member_forest(rule: Rule):
    """Of each larger tile (or pair of its blocks): the candidate pairs that join different groups, as a forest."""

    def run(batches):
        out = []
        for (_, lo, hi), table in by_group(batches, 3):
            c64, n = table.column("c64").to_numpy(), table.column("n").to_numpy()
            block, label = table.column("block").to_numpy(), np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
            for i, others, _ in _near(rule, n, table.column("bits").to_pylist()):
                js = others[(label[others] != label[i]) & ((block[others] != block[i]) | (lo == hi))]
                for j in js:
                    if label[j] != label[i]:
                        out.append((int(c64[i]), int(c64[j])))
                        label[label == label[j]] = label[i]
            if len(out) >= ROWS:
                yield _long_pairs(out)
                out = []
        if out:
            yield _long_pairs(out)

    return run


def _long_pairs(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    return len(np.intersect1d(x, y, assume_unique=True))


def _group_links(rule: Rule, table: pa.Table, one: bool, every: bool) -> tuple[list, list]:
    """The classes of a group (one), or of a pair of a group's blocks, and their links (i, j, similarity), verified: all, or a forest of those between components."""
    cls, at = np.unique(np.array(table.column("cls").to_pylist(), dtype=object), return_index=True)
    table = table.take(pa.array(at))  # a repeated row gives its class again
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    n = np.array([len(x) for x in sets], np.int64)
    block, label = table.column("block").to_numpy(), np.unique(np.array(table.column("root").to_pylist(), dtype=object), return_inverse=True)[1]
    out = []
    for i, others, over in _near(rule, n, [bitmap(x) for x in sets]):
        keep = (block[others] != block[i]) | one
        for j in others[keep][np.argsort(-over[keep], kind="stable")].tolist():
            if not every and label[j] == label[i]:
                continue
            both = _overlap(sets[i], sets[j])
            size = int(n[i] + n[j]) - both
            if rule.den * both >= rule.num * size:
                out.append((i, j, both / size))
                label[label == label[j]] = label[i]
    return cls.tolist(), out


def _links(rule: Rule, every: bool):
    """Of each group (or pair of a group's blocks): its links."""

    def run(batches):
        out = []
        for (_, lo, hi), table in by_group(batches, 3):
            cls, links = _group_links(rule, table, lo == hi, every)
            out += [(cls[i], cls[j], x) for i, j, x in links]
            if len(out) >= ROWS:
                yield _cls_pairs(out)
                out = []
        if out:
            yield _cls_pairs(out)

    return run


def _stars(rule: Rule):
    """Of each whole group: its classes that link, and the smallest one that each reaches."""

    def run(batches):
        out = []
        for _, table in by_group(batches, 3):
            cls, links = _group_links(rule, table, True, False)
            out += unite((cls[i], cls[j]) for i, j, _ in links).items()
            if len(out) >= ROWS:
                yield _star_rows(out)
                out = []
        if out:
            yield _star_rows(out)

    return run


def _star_rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], names=["u", "root"])


def _cls_pairs(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.float64())], names=["a", "b", "similarity"])


_LINKS = "a binary, b binary, similarity double"


_ARRAYS = "cls binary, c64 bigint, grp bigint, nb bigint, shingles binary"


def _arrays(rule: Rule):
    """The sorted shingles of the wanted classes' texts; of a task's equal ones, the first."""

    def run(batches):
        seen = set()
        for batch in batches:
            cls = batch.column(0).to_pylist()
            buf, offs = text_buffer(batch.column(4))
            for a, g, first in shingle_sets(buf, offs, rule.n):
                keep, sets = [], []
                for i, d in enumerate(digests(g, first)):
                    if cls[a + i] == d.tobytes() and cls[a + i] not in seen:  # else another text with this row hash
                        seen.add(cls[a + i])
                        keep.append(a + i)
                        sets.append(g[first[i] : first[i + 1]].tobytes())
                own = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in range(4)), pa.array(sets, pa.binary())], names=["cls", "c64", "grp", "nb", "shingles"])

    return run


def _verify(rule: Rule):
    """Keeps the pairs that link: an exact intersection of sorted arrays."""

    def run(batches):
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = _overlap(x, y)
                if rule.den * both >= rule.num * (len(x) + len(y) - both):
                    out.append((a, b, both / (len(x) + len(y) - both)))
            if out:
                yield _cls_pairs(out)

    return run


class Join:
    """The steps over one table; each written once in the shared folder."""

    def __init__(self, docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL_TILE, block: int = BLOCK, group: int = GROUP):
        self.spark: SparkSession = docs.sparkSession
        ship(self.spark)
        self.rule, self.small, self.block, self.group = rule, small, block, group
        self.src = docs.select(row_hash(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        buckets = bucket_count(self.src)
        sets = written(self.src.mapInArrow(_sets(rule, buckets), _SETS), "sets")
        self.meta = sets.where("bucket is null").select("row", "doc_id", "n", "cls", "c64", "bits")
        agg = [F.min("row").alias("row"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("c64").alias("c64"), F.first("bits").alias("bits")]
        self.classes = written(self.meta.where("cls is not null").groupBy("cls").agg(*agg), "classes")
        chunks = sets.where("bucket is not null").select("bucket", "payload")
        self.found = written(dealt(chunks, "bucket", buckets).groupBy("key").applyInArrow(_pairs(small), _PAIRS), "tiles")

    def _allowed(self, pairs: DataFrame) -> DataFrame:
        """Of pairs of classes (a, b), those that pass the bounds of sizes and bits, with the share that the bits allow."""
        side = lambda x: self.classes.select(F.col("c64").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"x{x}"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fit = F.least("na", "nb") * self.rule.den >= F.greatest("na", "nb") * self.rule.num
        met = pairs.join(side("a"), "a").join(side("b"), "b").where(fit).select("a", "b", "na", "nb", "xa", "xb")
        return met.mapInArrow(_bound(self.rule), "a bigint, b bigint, share double")

    def _groups(self) -> tuple[DataFrame, DataFrame]:
        """Candidate pairs (a, b, share), and (u, root) of classes joined by them: linked classes are in one group."""
        pairs = self.found.where("tile is null").select("a", "b")
        member = self.found.where("tile is not null").select("tile", F.col("a").alias("c64"))
        large = not member.isEmpty()
        if large:
            weight = member.groupBy("c64").agg(F.count(F.lit(1)).alias("w"))
            pivot = member.join(weight, "c64").groupBy("tile").agg(F.max(F.struct("w", "c64"))["c64"].alias("a"))
            pairs = pairs.unionByName(member.join(pivot, "tile").where("c64 <> a").select("a", F.col("c64").alias("b")))
        allowed = written(self._allowed(pairs), "pairs")
        roots = components(allowed.select(F.col("a").alias("u"), F.col("b").alias("v")))
        if not large:
            return allowed, written(roots, "groups")
        more = written(self._larger(member, written(roots, "roots")), "larger")
        if not more.isEmpty():
            allowed = allowed.unionByName(more.select("a", "b", F.lit(0.0).alias("share")))
            roots = components(allowed.select(F.col("a").alias("u"), F.col("b").alias("v")))
        return allowed, written(roots, "groups")

    def _larger(self, member: DataFrame, roots: DataFrame) -> DataFrame:
        """Candidate pairs that join groups in larger tiles which hold members of several."""
        member = member.join(roots.withColumnRenamed("u", "c64"), "c64", "left").withColumn("root", F.coalesce("root", "c64"))
        apart = member.groupBy("tile").agg(F.count(F.lit(1)).alias("many"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("tile", F.ceil(F.col("many") / self.block).cast("long").alias("nb"))
        member = member.join(apart, "tile").withColumn("block", F.pmod(F.hash("c64"), F.col("nb")))
        member = member.join(self.classes.select("c64", "n", "bits"), "c64")
        return self._by_blocks(member.select("tile", "nb", "block", "c64", "root", "n", "bits"), "tile", _member_forest(self.rule), "a bigint, b bigint")

    def _by_blocks(self, rows: DataFrame, key: str, run, schema: str) -> DataFrame:
        """run over each key's pairs of blocks: rows with (key, lo, hi) side by side."""
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        rows = rows.select(key, "lo", "hi", *[c for c in rows.columns if c not in (key, "lo", "hi", "nb", "other")])
        dealt = rows.repartition(partitions(self.spark), key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")
        return dealt.mapInArrow(run, schema)

    def _texts(self, need: DataFrame) -> DataFrame:
        """The texts of the rows in need (row, ...), with its columns.

        A sieve of the wanted rows goes first: of a few rows' texts only those are shuffled to meet need.
        """
        return sieved(self.src.select("row", "text"), "row", need).where("__maybe").select("row", "text").join(need, "row")

    def _arrayed(self) -> tuple[DataFrame, DataFrame, bool]:
        """Candidate pairs; the arrays of the classes in groups, with nb, the blocks of the group; whether one has several."""
        allowed, roots = self._groups()
        sizes = self.classes.select("cls", "c64", "row", "n").join(roots.toDF("c64", "grp"), "c64")
        large = sizes.groupBy("grp").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("shingles")).where((F.col("many") > self.group) | (F.col("shingles") > GROUP_SHINGLES))
        large = written(large.select("grp", F.greatest(F.ceil(F.col("many") / self.group), F.ceil(F.col("shingles") / GROUP_SHINGLES)).cast("long").alias("nb")), "large")
        need = written(sizes.join(large, "grp", "left").select("cls", "c64", "row", "grp", F.coalesce("nb", F.lit(1).cast("long")).alias("nb")), "wanted")
        array = self._texts(need).select("cls", "c64", "grp", "nb", "text").mapInArrow(_arrays(self.rule), _ARRAYS)
        return allowed, written(array, "arrays"), not large.isEmpty()

    def _whole(self, array: DataFrame, run, schema: str) -> DataFrame:
        """run over each group that one task holds."""
        rows = array.where("nb = 1").select("grp", F.lit(0).cast("long").alias("block"), "nb", F.col("cls").alias("root"), "cls", "shingles")
        return self._by_blocks(rows, "grp", run, schema)

    def _large_links(self, allowed: DataFrame, array: DataFrame, every: bool) -> DataFrame:
        """The links of groups too large for a task."""
        block = F.pmod(F.hash("cls"), F.col("nb"))
        rows = array.select("grp", block.cast("long").alias("block"), "nb", F.col("cls").alias("root"), "cls", "shingles")
        if every:
            return self._by_blocks(rows, "grp", _links(self.rule, True), _LINKS)
        # First each class with the partner that has the most partners, and with that which the bits favour.
        both = allowed.unionByName(allowed.select(F.col("b").alias("a"), F.col("a").alias("b"), "share")).join(array.select(F.col("c64").alias("a")), "a", "left_semi")
        degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("w"))
        both = both.join(degree.toDF("b", "w"), "b")
        tries = both.groupBy("a").agg(F.max(F.struct("w", "b"))["b"].alias("x"), F.max(F.struct("share", "b"))["b"].alias("y"))
        tries = tries.select("a", F.explode(F.array_distinct(F.array("x", "y"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        side = lambda x: array.select(F.col("c64").alias(x), F.col("cls").alias(f"c{x}"), F.col("shingles").alias(f"s{x}"))
        tried = tries.join(side("a"), "a").join(side("b"), "b").select("ca", "cb", "sa", "sb")
        first = written(tried.mapInArrow(_verify(self.rule), _LINKS), "tried")
        roots = written(components(first.select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")
        rows = rows.drop("root").join(roots.toDF("cls", "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        rows = written(rows, "members")
        # What a group's largest component holds is compared with the rest alone, and not with itself.
        parts = rows.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("many"))
        parts = parts.groupBy("grp").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("many", "root"))["root"].alias("main")).where("parts > 1")
        rows = rows.join(parts, "grp").withColumn("inside", F.col("root") == F.col("main"))
        rest = rows.where("not inside").groupBy("grp").agg(F.count(F.lit(1)).alias("many"), F.sum(F.length("shingles") / 8).alias("shingles"))
        rest = rest.select("grp", F.greatest(F.ceil(F.col("many") / self.group), F.ceil(F.col("shingles") / GROUP_SHINGLES)).cast("long").alias("nr"))
        rows = rows.join(rest, "grp")
        n = F.col("nr")
        # Blocks 0 to nr - 1 are the rest's; the main component's come after them.
        block = F.when(F.col("inside"), n + F.pmod(F.hash("cls"), F.col("nb"))).otherwise(F.pmod(F.hash("cls"), n)).cast("long")
        last = n + F.col("nb") - 1
        other = F.explode(F.when(F.col("inside"), F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.sequence(F.lit(0).cast("long"), last)))
        rows = rows.withColumns({"block": block, "other": other}).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        rows = rows.select("grp", "lo", "hi", "block", "root", "cls", "shingles")
        dealt = rows.repartition(partitions(self.spark), "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")
        return first.unionByName(written(dealt.mapInArrow(_links(self.rule, False), _LINKS), "apart"))

    def _roots(self) -> DataFrame:
        """(cls, root) of every class that links with another."""
        allowed, array, large = self._arrayed()
        roots = self._whole(array, _stars(self.rule), "u binary, root binary")
        if large:
            links = self._large_links(allowed, array.where("nb > 1").dropDuplicates(["cls"]), False)
            roots = roots.unionByName(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        return roots.withColumnRenamed("u", "cls")

    def components(self) -> DataFrame:
        """(cls, component_id, stays) of every class: the smallest id that its links reach, and the row that stands for the component."""
        roots = self._roots()
        own = written(self.classes.select("cls", "rep", "row").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "components")
        # The row that stands for a component: that of the smallest id, and of its rows that of the smallest hash.
        first = F.min(F.struct(F.col("rep").isNull(), "rep", "row"))
        return own.join(own.groupBy("root").agg(F.min("rep").alias("component_id"), first["row"].alias("stays")), "root").select("cls", "component_id", "stays")

    def members(self) -> DataFrame:
        """One row per row of docs: row, doc_id, n_shingles, component_id, and the row that stands for the component."""
        out = self.meta.select("row", "doc_id", "n", "cls").join(self.components(), "cls", "left")
        alone = F.col("n") == 0
        return out.select("row", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("row")).otherwise(F.col("stays")).alias("stays"))

    def links(self) -> DataFrame:
        """Every link between classes, named by their smallest ids: a, b, similarity."""
        rep = self.classes.select("cls", "rep")
        allowed, array, large = self._arrayed()
        links = self._whole(array, _links(self.rule, True), _LINKS)
        if large:
            links = links.unionByName(self._large_links(allowed, array.where("nb > 1").dropDuplicates(["cls"]), True))
        out = links.join(rep.toDF("a", "ra"), "a").join(rep.toDF("b", "rb"), "b")
        return out.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "similarity")


def row_hash(doc_id, text):
    """What tells rows apart by what they hold; equal rows agree."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, **names) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    return Join(docs, Rule(n, num, den), **names).members().select("doc_id", "n_shingles", "component_id")


def similar_pairs(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, **names) -> DataFrame:
    """Every link between texts of different sets, by the sets' smallest ids: a, b, similarity."""
    return Join(docs, Rule(n, num, den), **names).links()


def drop_near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """docs with all their columns: of each component, one row, that with the smallest id (and of its texts the one of the smallest hash).

    Rows without words stay. Rows that go are named by their own hash and id, so a row that shares its id with them stays.
    """
    join = Join(docs, Rule(n, num, den), id_col=id_col, text_col=text_col, **names)
    out = join.members()
    same = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    judged = out.where("n_shingles > 0").groupBy(F.col("row").alias("__row"), same.alias("__id")).agg(F.count(F.lit(1)).alias("copies"), F.first(F.col("row") == F.col("stays")).alias("kept"))
    judged = written(judged.where("not kept or copies > 1").withColumn("__key", F.col("__row")), "judged")
    row = row_hash(F.col(id_col), F.col(text_col))
    rows = docs.withColumns({"__row": row, "__key": row, "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))})
    return without(rows, "__key", judged, ["__row", "__id"]).select(*docs.columns)
