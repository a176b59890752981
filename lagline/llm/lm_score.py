"""LM scoring: an Elias-Fano n-gram trie in memory-mapped levels.

Level 1 is the vocabulary: the sorted 64-bit hashes of all training words (a word's rank is
its id) with exact counts. Level k holds the k-grams, sorted by (context, word): the
contexts that occur, pointers to where each one's successors begin, the successors' ids
shifted by their context's rank so that they rise throughout, and a quantised
log-probability for each. All three sequences are Elias-Fano coded; a lookup finds the context,
then searches the successor within the context's range alone.

Smoothing is hierarchical Dirichlet: p(w | c) = (n(c w) + mu * p'(w)) / (n(c) + mu) with p' of
the next shorter context, down to the unigrams' (n(w) + 1) / (N + V + 1). A level stores p of
the k-grams seen; others fall back with mu / (n(c) + mu).

Counts come from all training texts: map tasks add up a segment's distinct k-grams,
packed, by key range; a range's task merges them and writes its shard of the level to
the shared folder, where every worker maps it. Ranges are as many as the input's size asks for. A frequent context is split over ranges.
The driver sees a row per shard. Nothing is broadcast but the list of shards.

Defined results: null text counts as empty: its only token is the end. A null id is in
training. Without training texts N = V = 0, and every probability is 1 or falls
back to 1. Repeated rows count each. Columns other than id and text are ignored.
More than 2^32 distinct words, or an order whose keys pass 64 bits, are an error.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import SPACE, by_bucket, deltas, hashed_words, id_array, ids, pack, runs, splitmix, spread, text_buffer, undeltas, unpack
from ._store import bucket_count, dealt, fresh, ship
from .elias_fano import EliasFano, build, dump, load, part

END = np.uint64(splitmix(4001))
#: Tokens that a map task holds at a time.
SEGMENT = 2_000_000
_CODES = 255


def put(path: str, data: bytes) -> None:
    """Writes a file of the shared folder; a repeated task writes the same one again."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        os.makedirs(os.path.dirname(at.path), exist_ok=True)
        fd, tmp = tempfile.mkstemp(dir=os.path.dirname(at.path))
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        os.replace(tmp, at.path)
        return
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(where), recursive=True)
    with store.open_output_stream(where) as f:
        f.write(data)


_mapped: dict[str, dict[str, np.ndarray]] = {}


def mapped(path: str) -> dict[str, np.ndarray]:
    """A shard's arrays, memory-mapped: in place, or from a copy of a remote file that goes when it's closed."""
    if path not in _mapped:
        if len(_mapped) > 20_000:
            _mapped.clear()
        at = urlparse(path)
        if at.scheme in ("", "file"):
            block = np.memmap(at.path, np.uint8, "r")
        else:
            from pyarrow import fs

            store, where = fs.FileSystem.from_uri(path)
            with tempfile.NamedTemporaryFile() as tmp:
                with store.open_input_stream(where) as f:
                    while chunk := f.read(1 << 24):
                        tmp.write(chunk)
                tmp.flush()
                block = np.memmap(tmp.name, np.uint8, "r")
        _mapped[path] = load(block)
    return _mapped[path]


_coded: dict[tuple[str, str], EliasFano] = {}


def coded(path: str, name: str) -> EliasFano:
    """One coded sequence of a shard."""
    if (path, name) not in _coded:
        if len(_coded) > 60_000:
            _coded.clear()
        _coded[path, name] = EliasFano(part(mapped(path), name + "."))
    return _coded[path, name]


@dataclass
class Trie:
    """Where the levels lie. Small: a few numbers per shard."""

    at: str
    mu: float
    order: int
    total: int = 0  # N
    words: int = 0  # V
    shards: int = 0
    offsets: np.ndarray | None = None  # of the vocabulary's shards: ids begin there
    heavy: list[tuple[int, int]] = field(default_factory=list)  # (id, count) of the most frequent words of each shard
    cuts: dict[int, np.ndarray] = field(default_factory=dict)  # level -> first key of each range
    starts: dict[int, np.ndarray] = field(default_factory=dict)  # level -> first node id of each range

    def find_words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of sorted word hashes."""
        out, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        if not self.words:
            return out, count
        for b, at in by_bucket(spread(h, self.shards), self.shards):
            if self.offsets[b + 1] == self.offsets[b]:
                continue
            arrays = mapped(f"{self.at}/1-{b}")
            at = at[h[at] >= arrays["base"][0]]
            i, found = coded(f"{self.at}/1-{b}", "words").successor(h[at] - arrays["base"][0])
            out[at[found]] = i[found] + self.offsets[b]
            count[at[found]] = arrays["counts"][i[found]]
        return out, count

    def counts_of(self, level: int, node: np.ndarray) -> np.ndarray:
        """Counts of nodes (all known) of a level."""
        begins = self.offsets if level == 1 else self.starts[level]
        shard = np.searchsorted(begins, node, "right") - 1
        out = np.zeros(len(node), np.int64)
        for b in np.unique(shard):
            own = shard == b
            out[own] = mapped(f"{self.at}/{level}-{b}")["counts"][node[own] - begins[b]]
        return out

    def find(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node or -1, log10 p of the seen) for pairs of a context node of the level below and a word id.

        Works on distinct pairs in key order: a shard's are side by side, and each context is looked up once.
        """
        out, logp = np.full(len(word), -1, np.int64), np.zeros(len(word))
        some = np.flatnonzero((context >= 0) & (word >= 0))
        v = np.uint64(self.words)
        key, back = np.unique(context[some].astype(np.uint64) * v + word[some].astype(np.uint64), return_inverse=True)
        node, p = np.full(len(key), -1, np.int64), np.zeros(len(key))
        edges = np.append(np.searchsorted(key, self.cuts[level]), len(key))
        for b in np.flatnonzero((edges[1:] > edges[:-1]) & (np.diff(self.starts[level]) > 0)):
            own = key[edges[b] : edges[b + 1]]
            shard = f"{self.at}/{level}-{b}"
            arrays = mapped(shard)
            base, span = (int(x) for x in arrays["base"])
            c, w = (own // v).astype(np.int64) - base, own % v
            cut = runs(c)
            lone = c[cut[:-1]]
            ok = (lone >= 0) & (lone < span)
            rank, has = np.zeros(len(lone), np.int64), np.zeros(len(lone), bool)
            rank[ok], has[ok] = coded(shard, "contexts").successor(lone[ok])
            at, begin, end = rank[has], np.zeros(len(lone), np.int64), np.zeros(len(lone), np.int64)
            begin[has] = coded(shard, "pointers").at(at).astype(np.int64)
            end[has] = coded(shard, "pointers").at(at + 1).astype(np.int64)
            of = np.repeat(np.arange(len(lone)), np.diff(cut))
            row = np.flatnonzero(has[of])
            of = of[row]
            i, found = coded(shard, "next").successor(rank[of].astype(np.uint64) * v + w[row], begin[of], end[of])
            row, i = row[found] + edges[b], i[found]
            node[row] = i + self.starts[level][b]
            p[row] = arrays["codebook"][arrays["codes"][i]]
        out[some], logp[some] = node[back], p[back]
        return out, logp


def unigram(trie: Trie, count: np.ndarray) -> np.ndarray:
    return (count + 1) / (trie.total + trie.words + 1)


_CHUNK = "key int, payload binary"


def _chunks(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["key", "payload"])


def _tokens(batches, most: int = SEGMENT):
    """Segments of whole documents: (doc ids, hashes of words and ends, each document's first token)."""
    held, size = [], 0
    for batch in batches:
        doc_ids = ids(batch.column(0))
        for a, b, words, first in hashed_words(*text_buffer(batch.column(1)), SPACE, True):
            n = b - a
            at = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))
            h = np.full(len(words) + n, END, np.uint64)
            h[at] = words
            held.append((doc_ids[a:b], h, np.diff(first) + 1))
            size += len(h)
            if size >= most:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    docs, h, many = (np.concatenate(x) for x in zip(*held, strict=True))
    return docs, h, np.concatenate(([0], np.cumsum(many)))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = runs(key)
    return key[cut[:-1]], np.add.reduceat(n[order], cut[:-1]) if len(key) else n, order[cut[:-1]]


def _count_words(shards: int):
    def run(batches):
        for _, h, _ in _tokens(batches):
            word, n = np.unique(h, return_counts=True)
            yield _chunks([(b, pack(deltas(word[at]), n[at].astype(np.uint32))) for b, at in by_bucket(spread(word, shards), shards)])

    return run


def _write_words(at: str):
    def run(table: pa.Table) -> pa.Table:
        cols = [unpack(p) for p in table.column("payload").to_pylist()]
        word, n, _ = _summed(np.concatenate([undeltas(c[0]).view(np.uint64) for c in cols]), np.concatenate([c[1] for c in cols]).astype(np.int64))
        shard = int(table.column("bucket")[0].as_py())
        base, span = word[0], int(word[-1] - word[0]) + 1
        arrays = {f"words.{k}": v for k, v in build(word - base, span).items()} | {"base": np.array([base], np.uint64), "counts": n.astype(np.uint32 if n.max() < 1 << 32 else np.uint64)}
        put(f"{at}/1-{shard}", dump(arrays))
        top = np.sort(np.argsort(-n, kind="stable")[:64])
        return pa.table([pa.array([shard], pa.int64()), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([top.tolist()], pa.list_(pa.int64())), pa.array([n[top].tolist()], pa.list_(pa.int64()))], names=["shard", "size", "total", "top", "top_n"])

    return run


def nodes(trie: Trie, level: int, h: np.ndarray, first: np.ndarray):
    """For each token: its word id and count, and up to the level the nodes and log10 p of the k-grams that end at it.

    A document's first token has the end as its context; longer contexts stay in the document.
    """
    word, back = np.unique(h, return_inverse=True)
    wid, count = trie.find_words(word)
    wid, count = wid[back], count[back]
    starts = np.zeros(len(h), bool)
    starts[first[:-1]] = True
    end = trie.find_words(np.array([END]))[0][0]
    node, found = wid, []
    for k in range(2, level + 1):
        context = np.concatenate(([end], node[:-1]))
        context[starts] = end if k == 2 else -1
        node, logp = trie.find(k, context, wid)
        found.append((context, node, logp))
    return wid, count, end, starts, found


def by_orders(trie: Trie, count, found):
    """p of each token by order, from the unigrams' up; shorter contexts fill in what wasn't seen."""
    p = unigram(trie, count)
    yield p
    for k, (context, node, logp) in enumerate(found, 2):
        p = p.copy()
        seen = node >= 0
        known = np.flatnonzero((context >= 0) & ~seen)
        c = trie.counts_of(k - 1, context[known])
        p[known] = trie.mu * p[known] / (c + trie.mu)
        p[seen] = 10.0 ** logp[seen]
        yield p


def _count_grams(trie, level: int):
    """A segment's distinct k-grams by key range: keys, counts and log10 p under the next shorter context."""

    def run(batches):
        t = trie.value
        for _, h, first in _tokens(batches):
            wid, count, end, starts, found = nodes(t, level - 1, h, first)
            if level == 2:
                context = np.concatenate(([end], wid[:-1]))
                context[starts] = end
                lower = unigram(t, count)
            else:
                context = np.concatenate(([-1], found[-1][1][:-1]))
                context[starts] = -1
                *_, lower = by_orders(t, count, found)
            ok = context >= 0
            key, n, at = _summed(context[ok].astype(np.uint64) * np.uint64(t.words) + wid[ok].astype(np.uint64), np.ones(int(ok.sum()), np.int64))
            code = np.minimum(np.round(-np.log10(lower[ok][at]) * 2000), 65535).astype(np.uint16)
            shard = np.searchsorted(t.cuts[level], key, "right") - 1
            yield _chunks([(b, pack(deltas(key[x]), n[x].astype(np.uint32), code[x])) for b, x in by_bucket(shard, len(t.cuts[level]))])

    return run


def _write_level(trie, level: int):
    """Merges a key range and writes its shard: contexts, pointers, successors, codes, counts."""

    def run(table: pa.Table) -> pa.Table:
        t = trie.value
        shard = int(table.column("bucket")[0].as_py())
        cols = [unpack(p) for p in table.column("payload").to_pylist()]
        key, n, at = _summed(np.concatenate([undeltas(c[0]).view(np.uint64) for c in cols]), np.concatenate([c[1] for c in cols]).astype(np.int64))
        lower = 10.0 ** (np.concatenate([c[2] for c in cols])[at] / -2000.0)
        context, word = (key // np.uint64(t.words)).astype(np.int64), key % np.uint64(t.words)
        cut = runs(context)
        own = context[cut[:-1]]
        rank = np.repeat(np.arange(len(own)), np.diff(cut))
        c = t.counts_of(level - 1, own)[rank]
        logp = np.log10((n + t.mu * lower) / (c + t.mu))
        codebook = np.linspace(logp.min(), logp.max(), _CODES + 1)
        codes = np.round((logp - codebook[0]) / max(codebook[-1] - codebook[0], 1e-9) * _CODES).astype(np.uint8)
        base, span = int(own[0]), int(own[-1] - own[0]) + 1
        arrays = {"base": np.array([base, span], np.int64), "codebook": codebook, "codes": codes}
        if level < t.order:
            arrays["counts"] = n.astype(np.uint32 if n.max() < 1 << 32 else np.uint64)
        for name, values, universe in (("contexts", (own - base).astype(np.uint64), span), ("pointers", cut.astype(np.uint64), len(key) + 1), ("next", rank.astype(np.uint64) * np.uint64(t.words) + word, len(own) * t.words)):
            arrays |= {f"{name}.{k}": v for k, v in build(values, universe).items()}
        put(f"{t.at}/{level}-{shard}", dump(arrays))
        return pa.table([pa.array([shard], pa.int64()), pa.array([len(key)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([[]], pa.list_(pa.int64())), pa.array([[]], pa.list_(pa.int64()))], names=["shard", "size", "total", "top", "top_n"])

    return run


_STATS = "shard bigint, size bigint, total bigint, top array<bigint>, top_n array<bigint>"


def _built(rows: DataFrame, count, write, shards: int) -> list:
    """Runs one level; the driver gets a row per shard."""
    chunks = rows.mapInArrow(count, _CHUNK).withColumnRenamed("key", "bucket")
    return sorted(dealt(chunks, "bucket", shards).groupBy("key").applyInArrow(write, _STATS).collect(), key=lambda r: r["shard"])


def _cuts(trie: Trie, masses: np.ndarray, shards: int) -> np.ndarray:
    """First keys of ranges of about equal token counts: a frequent word's successors are split by their ids, which are hash ranks."""
    share = trie.total / shards
    edges = [0]
    for b in range(trie.shards):
        lo, hi = int(trie.offsets[b]), int(trie.offsets[b + 1])
        heavy = [(i, n) for i, n in trie.heavy if lo <= i < hi and n > share / 4]
        rest = max(masses[b] - sum(n for _, n in heavy), 0)
        parts = max(1, round(rest / share))
        own = [(lo + (hi - lo) * j // parts) * trie.words for j in range(parts)]
        for i, n in heavy:
            cuts = max(1, round(n / share))
            own += [i * trie.words + trie.words * j // cuts for j in range(cuts)] + [(i + 1) * trie.words]
        edges += own
    return np.unique(np.array(edges, np.uint64))


def train(docs: DataFrame, order: int = 2, mu: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> Trie:
    """A trie of all the rows' texts, in the shared folder."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = bucket_count(rows, 8)
    trie = Trie(fresh(spark, "trie"), mu, order, shards=n)
    stats = {r["shard"]: r for r in _built(rows, _count_words(n), _write_words(trie.at), n)}
    sizes = [stats[b]["size"] if b in stats else 0 for b in range(n)]
    masses = np.array([stats[b]["total"] if b in stats else 0 for b in range(n)])
    trie.offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    trie.words, trie.total = int(sum(sizes)), int(masses.sum())
    trie.heavy = [(int(trie.offsets[b] + i), int(c)) for b, r in stats.items() for i, c in zip(r["top"], r["top_n"], strict=True)]
    for level in range(2, order + 1 if trie.words else 2):
        if trie.words >= 1 << 32:
            raise ValueError("more than 2^32 distinct words: their pairs don't fit 64-bit keys")
        if level == 2:
            trie.cuts[2] = _cuts(trie, masses, n)
        else:  # nodes of the level below are about as many in each range
            top = int(trie.starts[level - 1][-1])
            if top * trie.words >= 1 << 63:
                raise ValueError("an order too high for 64-bit keys")
            trie.cuts[level] = np.unique(np.array([top * j // n * trie.words for j in range(n)], np.uint64))
        many = len(trie.cuts[level])
        sent = spark.sparkContext.broadcast(trie)
        got = {r["shard"]: r["size"] for r in _built(rows, _count_grams(sent, level), _write_level(sent, level), many)}
        trie.starts[level] = np.concatenate(([0], np.cumsum([got.get(b, 0) for b in range(many)]))).astype(np.int64)
        sent.unpersist()
    return trie


def _score(trie):
    def run(batches):
        t = trie.value
        for doc_ids, h, first in _tokens(batches, 1_000_000):
            wid, count, _, _, found = nodes(t, t.order if t.words else 1, h, first)
            doc = np.repeat(np.arange(len(doc_ids)), np.diff(first))
            total = lambda x: np.bincount(doc, weights=x, minlength=len(doc_ids))  # noqa: E731, B023
            scores = [total(np.log10(p)) for p in by_orders(t, count, found)]
            scores += scores[-1:] * (t.order - len(scores))  # no training texts, no levels
            by_order = pa.ListArray.from_arrays(np.arange(len(doc_ids) + 1, dtype=np.int32) * t.order, np.stack(scores, axis=1).ravel())
            cols = [id_array(doc_ids), pa.array(np.diff(first).astype(np.int64)), pa.array(total(count > 0).astype(np.int64)), pa.array(scores[0]), pa.array(scores[-1]), by_order]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "n_known", "base_score", "score", "by_order"])

    return run


def score(docs: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score (unigrams), score (the trie's order), by_order (1 to that order); all log10."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(trie)
    out = rows.mapInArrow(_score(sent), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, by_order array<double>")
    return out.withColumn("train_tokens", F.lit(trie.total).cast("long"))
