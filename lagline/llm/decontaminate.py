"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over the training text.

Items become windows of `window` words (one window if they have fewer, but not
none). The windows' rolling hashes, one sorted array per window length, are
broadcast; a training text's rolling hashes are looked up in them, and each hit is
verified on its words. Hits are removed as spans or as documents.

What is broadcast has a bound: items are read in blocks of at most `block_mb` of text
(a longer item is cut into pieces that overlap by a window less a word), and a block's index is
flat arrays: its words, and for each window 8 bytes of hash and 12 of places, some 7 bytes for
a byte of text in all. One block, the usual case, is scanned in one pass without a shuffle. Of several,
each has a pass of its own, so that a worker holds one index at a time; their hits (rows
of documents that have any) are then put together by document.

Defined results: null or empty text has no words, no hits, and stays. An item
without words has no window. A null item_id counts as the item 'null'. Items that
repeat an id are one item. Rows that repeat are judged one by one. Columns other
than those named are carried through (remove) or ignored (scan).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import LOWER, PUNCT, doc_slices, id_array, ids, roll, text_buffer, windows_of, word_hashes, word_spans
from ._store import ship, written


class Index:
    """Windows of one block of items, as flat arrays: distinct phrases by hash, where their words are, and their items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        number: dict[str, int] = {}
        of = np.array([number.setdefault(item, len(number)) for item, _ in items], np.int64)
        self.names = list(number)
        parts = [np.frombuffer((text or "").encode(), np.uint8) for _, text in items]
        self.body = LOWER[np.concatenate(parts)] if parts else np.empty(0, np.uint8)
        offs = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
        starts, ends, first = word_spans(self.body, offs, PUNCT)
        h = word_hashes(self.body, starts, ends)
        many = np.diff(first)
        self.by_length = {}
        for length in sorted({*many[(many > 0) & (many < window)].tolist(), *([window] if (many >= window).any() else [])}):
            at, item, _ = windows_of(first, length)
            if length < window:  # items of just so many words
                own = many[item] == length
                at, item = at[own], item[own]
            key, twin = roll(h, length)[at], roll(h, length, 1)[at]
            order = np.lexsort((of[item], twin, key))
            key, twin, at, item = key[order], twin[order], at[order], of[item][order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (twin[1:] != twin[:-1])
            once = new.copy()  # an item once for each phrase
            once[1:] |= item[1:] != item[:-1]
            lead = np.flatnonzero(new)
            sieve = np.zeros(1 << 20, dtype=bool)  # a first look that stays in cache
            sieve[(key & np.uint64(0xFFFFF)).astype(np.int64)] = True
            of_phrase = np.concatenate(([0], np.cumsum(once)))[np.append(lead, len(key))]
            self.by_length[length] = (key[lead], at[lead].astype(np.int32), of_phrase.astype(np.int32), item[once].astype(np.int32), sieve)
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)

    def hits(self, buf, starts, ends, h, first):
        """(document, start, length, item names) of each verified window."""
        for length, (keys, at_word, of_phrase, item, sieve) in self.by_length.items():
            at, doc, _ = windows_of(first, length)
            if not len(at):
                continue
            g = roll(h, length)[at]
            some = np.flatnonzero(sieve[(g & np.uint64(0xFFFFF)).astype(np.int64)])
            k = np.searchsorted(keys, g[some])
            some, k = some[k < len(keys)], k[k < len(keys)]
            found = keys[k] == g[some]
            for j, p in zip(some[found].tolist(), k[found].tolist(), strict=True):
                i = at[j]
                phrase = [buf[starts[x] : ends[x]].tobytes() for x in range(i, i + length)]
                while p < len(keys) and keys[p] == g[j]:  # phrases of one hash
                    w = at_word[p]
                    if all(self.body[self.starts[w + x] : self.ends[w + x]].tobytes() == phrase[x] for x in range(length)):
                        yield int(doc[j]), int(i - first[doc[j]]), length, [self.names[x] for x in item[of_phrase[p] : of_phrase[p + 1]]]
                    p += 1


def pieces(text: str, window: int, most: int):
    """A text, or if it's longer than `most` bytes, pieces of about that size which between them hold all its windows."""
    body = text.encode()
    if len(body) <= most:
        yield text
        return
    starts, ends, _ = word_spans(LOWER[np.frombuffer(body, np.uint8)], np.array([0, len(body)]), PUNCT)
    a = 0
    while a < len(starts):
        b = max(int(np.searchsorted(ends, starts[a] + most, "right")), a + window)
        yield body[starts[a] : ends[min(b, len(starts)) - 1]].decode()
        if b >= len(starts):
            return
        a = b - window + 1


def _blocks(items: DataFrame, item_col: str, text_col: str, window: int, block_mb: int):
    """Lists of (item, text), streamed to the driver, each of at most block_mb of text (or one piece)."""
    block, size = [], 0
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for item, text in rows.toLocalIterator():
        for piece in pieces(text, window, max(block_mb << 20, 1 << 10)):
            if block and size + len(piece) > block_mb << 20:
                yield block
                block, size = [], 0
            block.append((item, piece))
            size += len(piece.encode())
    yield block


_SCHEMA = "doc_id bigint, text string, n_words bigint, starts array<int>, lengths array<int>, items array<string>"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _look(index: Index, texts: pa.Array):
    """Words of each text, and its hits: starts, lengths, item names."""
    buf, offs = text_buffer(texts)
    n = len(offs) - 1
    n_words, starts_, lengths_, items_ = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)], [set() for _ in range(n)]
    for a, b in doc_slices(offs):
        part = LOWER[buf[offs[a] : offs[b]]]
        starts, ends, first = word_spans(part, offs[a : b + 1] - offs[a], PUNCT)
        n_words[a:b] = np.diff(first)
        for doc, start, length, items in index.hits(part, starts, ends, word_hashes(part, starts, ends), first):
            starts_[a + doc].append(start)
            lengths_[a + doc].append(length)
            items_[a + doc].update(items)
    return n_words, starts_, lengths_, [sorted(x) for x in items_]


def _scan(index):
    """Every document with its hits."""

    def run(batches):
        for batch in batches:
            n_words, *found = _look(index.value, batch.column(1))
            lists = [pa.array(x, _FIELDS.field(k).type) for k, x in enumerate(found, 3)]
            yield pa.RecordBatch.from_arrays([id_array(ids(batch.column(0))), batch.column(1).cast(pa.string()), pa.array(n_words), *lists], schema=_FIELDS)

    return run


_HITS = "id bigint, row bigint, starts array<int>, lengths array<int>, items array<string>"


def _hits(index):
    """Documents with hits in one of several blocks."""

    def run(batches):
        for batch in batches:
            _, starts, lengths, items = _look(index.value, batch.column(2))
            some = np.flatnonzero([len(x) > 0 for x in starts])
            lists = [pa.array([x[i] for i in some], _FIELDS.field(k).type) for k, x in enumerate((starts, lengths, items), 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), *lists], names=["id", "row", "starts", "lengths", "items"])

    return run


def _keyed(id_col, text_col) -> list:
    """What names a row when its hits come back: its id, and a hash of id and text."""
    row = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), row.alias("row")]


def _by_blocks(spark: SparkSession, docs: DataFrame, indices: list, id_col: str, text_col: str) -> DataFrame:
    """(id, row, starts, lengths, items) of documents with hits in any of several blocks."""
    rows, every = docs.select(*_keyed(id_col, text_col), F.col(text_col).cast("string").alias("text")), None
    for k, index in enumerate(indices):
        one = rows.mapInArrow(_hits(index), _HITS).withColumn("block", F.lit(k))
        every = one if every is None else every.unionByName(one)
    every = written(every, "hits").dropDuplicates(["id", "row", "block"])  # a row that is there twice has its hits once
    joined = {c: F.flatten(F.collect_list(c)) for c in ("starts", "lengths", "items")}
    pairs = F.flatten(F.collect_list(F.arrays_zip("starts", "lengths")))
    got = every.groupBy("id", "row").agg(pairs.alias("spans"), F.array_sort(F.array_distinct(joined["items"])).alias("items"))
    return got.select("id", "row", F.col("spans.starts").alias("starts"), F.col("spans.lengths").alias("lengths"), "items")


def _indices(spark: SparkSession, items: DataFrame, item_col: str, text_col: str, window: int, block_mb: int) -> list:
    return [spark.sparkContext.broadcast(Index(block, window)) for block in _blocks(items, item_col, text_col, window, block_mb)]


def _counted(batches):
    """Documents that carry their hits: adds their words."""
    for batch in batches:
        n_words = np.zeros(batch.num_rows, np.int64)
        buf, offs = text_buffer(batch.column(1))
        for a, b in doc_slices(offs):
            n_words[a:b] = np.diff(word_spans(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], PUNCT)[2])
        lists = [pa.array([x or [] for x in batch.column(k).to_pylist()], _FIELDS.field(k + 1).type) for k in (2, 3, 4)]
        yield pa.RecordBatch.from_arrays([id_array(ids(batch.column(0))), batch.column(1).cast(pa.string()), pa.array(n_words), *lists], schema=_FIELDS)


def scan(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 10, block_mb: int = 16, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text, n_words, starts and lengths (in words) of the hits, items (sorted ids)."""
    ship(spark)
    indices = _indices(spark, items, item_col, item_text_col, window, block_mb)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if len(indices) == 1:
        return out.mapInArrow(_scan(indices[0]), _SCHEMA)
    hits = _by_blocks(spark, docs, indices, id_col, text_col)
    out = out.select("doc_id", "text", *_keyed("doc_id", "text")).join(hits, ["id", "row"], "left")
    return out.select("doc_id", "text", "starts", "lengths", "items").mapInArrow(_counted, _SCHEMA)


def _cut(n: int, starts, lengths) -> np.ndarray:
    """True for each word that a hit covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.asarray(starts, np.int64), 1)
    np.add.at(edge, np.asarray(starts, np.int64) + np.asarray(lengths, np.int64), -1)
    return np.cumsum(edge[:n]) > 0


def _judge(batches):
    for batch in batches:
        n_hit, digest, clean = [], [], []
        for text, n, starts, lengths, items in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
            hit = _cut(n, starts, lengths) if starts else np.zeros(n, bool)
            n_hit.append(int(hit.sum()))
            digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            if n_hit[-1]:
                text = _without(text, starts, lengths)
            clean.append(text)
        cols = [batch.column(0), batch.column(2), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in batch.column(5).to_pylist()], pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(clean, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text"])


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 10, **names) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, clean_text (without the hit spans)."""
    return scan(spark, docs, items, window, **names).mapInArrow(_judge, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, clean_text string")


def _without(text: str, starts, lengths) -> str:
    """The text without the words (and what is between them) of its hits."""
    body = text.encode()
    low = np.frombuffer(body, np.uint8)
    a, b, _ = word_spans(LOWER[low], np.array([0, len(body)]), PUNCT)
    keep = np.ones(len(body), bool)
    for start, length in zip(starts, lengths, strict=True):
        keep[a[start] : b[start + length - 1]] = False
    return low[keep].tobytes().decode()


def _dropping(index, text_at: int, whole: bool):
    def run(batches):
        for batch in batches:
            _, starts, lengths, _ = _look(index.value, batch.column(text_at))
            if whole:
                yield batch.filter(pa.array([not x for x in starts], pa.bool_()))
            else:
                yield _spans_gone(batch, text_at, starts, lengths)

    return run


def _spans_gone(batch: pa.RecordBatch, text_at: int, starts, lengths) -> pa.RecordBatch:
    if not any(starts):
        return batch
    texts = [_without(t, x, y) if x else t for t, x, y in zip(batch.column(text_at).to_pylist(), starts, lengths, strict=True)]
    cols = list(batch.columns)
    cols[text_at] = pa.array(texts, cols[text_at].type)
    return pa.RecordBatch.from_arrays(cols, schema=batch.schema)


def _dropping_found(text_at: int, many: int):
    """Rows that carry their hits in two more columns at the end."""

    def run(batches):
        for batch in batches:
            starts, lengths = ([x or [] for x in batch.column(many + k).to_pylist()] for k in (0, 1))
            yield _spans_gone(batch.select(list(range(many))), text_at, starts, lengths)

    return run


def remove(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 10, whole: bool = False, block_mb: int = 16, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with all their columns, without the hit spans of text_col, or without the documents hit (whole)."""
    ship(spark)
    indices, at = _indices(spark, items, item_col, item_text_col, window, block_mb), docs.columns.index(text_col)
    if len(indices) == 1:
        return docs.mapInArrow(_dropping(indices[0], at, whole), docs.schema)
    hits = _by_blocks(spark, docs, indices, id_col, text_col).select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("starts").alias("__starts"), F.col("lengths").alias("__lengths"))
    rows = docs.withColumns({f"__{n}": c for n, c in zip(("id", "row"), _keyed(id_col, text_col), strict=True)})
    if whole:
        return rows.join(hits.select("__id", "__row"), ["__id", "__row"], "left_anti").select(*docs.columns)
    rows = rows.join(hits, ["__id", "__row"], "left").select(*docs.columns, "__starts", "__lengths")
    return rows.mapInArrow(_dropping_found(at, len(docs.columns)), docs.schema)
