"""Language ID: segmentation-marginalised unigrams over a fixed public vocabulary.

Every language has a probability for each piece of the vocabulary. A word's
probability in a language is the sum, over all ways to cut it into pieces, of the product of
their probabilities, by a forward algorithm; a text's is the product over its
words. Bayes' rule over the languages gives the prediction and its probability.

Training counts every word of every training text by language, map-side first. The piece
probabilities come from these counts by expectation maximisation: expected piece counts
by forward-backward under the model so far, one count added to each piece. The
vocabulary is a parameter's file, read by the driver and broadcast; its size, and
the languages' number (an error beyond `most_languages`), bound the model. Words of more than `most_word` code points are cut
into stretches of that length, in training and in scoring; no word is left out.

Words are maximal runs of letters (Unicode categories L), lower-cased. Letters that no piece covers are
pieces of their own, one probability for all of them.

Defined results: null text, or text without a letter, is 'und' with score 0. Without any
training text every text is 'und'. Ties go to the first language by code point. Repeated
rows count each in training. Columns other than those named are ignored (predict) or carried
through (filter).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import mix, runs
from ._store import ship, written

#: Runs of letters, and of numbers that aren't decimal digits (a half, a circled one), which words() takes out.
_RUNS = re.compile(r"[^\W\d_]+")
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Word types that a task remembers.
REMEMBERED = 150_000
#: Words of one lattice; texts at a time.
STEP, ROWS = 4_000, 200


def read_vocabulary(path: str) -> list[str]:
    """The vocabulary's pieces made of letters only, lower-cased: sorted, distinct."""
    import sentencepiece

    if not Path(path).is_file():
        raise FileNotFoundError(f"no vocabulary at {path}: give the path of a SentencePiece model, which the driver reads")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i).replace("▁", "").lower() for i in range(sp.get_piece_size()))
    return sorted({p for p in pieces if p.isalpha()})


def word_counts(text: str | None, most_word: int) -> dict[str, int]:
    """The text's words and how often each is there; longer ones in stretches."""
    out = Counter(_RUNS.findall(text.lower())) if text else Counter()
    for w in [w for w in out if not w.isalpha()]:
        n = out.pop(w)
        for x in "".join(c if c.isalpha() else " " for c in w).split():
            out[x] += n
    if out and max(map(len, out)) > most_word:
        for w in [w for w in out if len(w) > most_word]:
            n = out.pop(w)
            for i in range(0, len(w), most_word):
                out[w[i : i + most_word]] += n
    return out


_BASE = np.uint64(0x9E3779B97F4A7C15)
#: What each letter's place is scaled by, so that products over a word of up to 40 letters stay within a double.
SCALE = 1e6


def _keys(chars: np.ndarray, size: int, before: np.ndarray | None) -> np.ndarray:
    """Hash of the `size` code points from each place, from that of one less."""
    own = chars[size - 1 :].astype(np.uint64) + np.uint64(1)
    return mix(own * _BASE + (before[: len(own)] if before is not None else np.uint64(0)))


def _key(piece: str) -> int:
    chars, h = np.frombuffer(piece.encode("utf-32-le"), np.uint32), None
    for size in range(1, len(chars) + 1):
        h = _keys(chars, size, h)
    return int(h[0])


@dataclass
class Model:
    langs: list[str]
    keys: np.ndarray  # the pieces' hashes, sorted
    prob: np.ndarray  # (pieces + 1, languages), in the order of keys; the last row is for uncovered letters
    prior: np.ndarray  # log, by language
    longest: int
    lens: np.ndarray | None = None  # letters of each row's piece: 1 for all of them, if not given

    def sieve(self) -> np.ndarray:
        """A first look at hashes that stays in cache; made once in each worker."""
        if getattr(self, "_sieve", None) is None:
            self._sieve = np.zeros(1 << 20, dtype=bool)
            self._sieve[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
        return self._sieve

    def scaled(self) -> np.ndarray:
        """prob times the scale of the piece's letters."""
        lens = np.ones(len(self.prob)) if self.lens is None else self.lens
        return self.prob * (SCALE**lens)[:, None]

    def lattice(self, many: list[str]):
        """All pieces in many words, as edges between the places of their letters.

        Returns (from, to, row) of each edge, sorted by how far into its word it begins; where
        each such distance begins in that order; and each word's first place. A word of n
        letters has n + 1 places.
        """
        lens = np.array([len(w) for w in many], np.int64)
        chars = np.frombuffer("".join(many).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(many)), lens)
        begin = np.concatenate(([0], np.cumsum(lens)))
        into = np.arange(len(chars)) - begin[word]
        left = lens[word] - into
        froms, sizes, rows, h, sieve = [], [], [], None, self.sieve()
        for size in range(1, self.longest + 1):
            if size > len(chars):
                break
            h = _keys(chars, size, h)
            ok = np.flatnonzero(left[: len(h)] >= size)
            if size > 1:
                ok = ok[sieve[(h[ok] & np.uint64(0xFFFFF)).astype(np.int64)]]
            at = np.minimum(np.searchsorted(self.keys, h[ok]), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == h[ok] if len(self.keys) else np.zeros(len(ok), bool)
            if size == 1:
                at, hit = np.where(hit, at, len(self.keys)), np.ones(len(ok), bool)
            froms.append(ok[hit])
            rows.append(at[hit])
            sizes.append(np.full(int(hit.sum()), size))
        start, row, size = np.concatenate(froms), np.concatenate(rows), np.concatenate(sizes)
        order = np.lexsort((start, into[start]))
        start, row, size = start[order], row[order], size[order]
        source = start + word[start]
        cuts = np.searchsorted(into[start], np.arange(int(lens.max()) + 1))
        return source, source + size, row, cuts, begin + np.arange(len(begin))

    def log_probs(self, many: list[str]) -> np.ndarray:
        """Log-probability of each word in each language: the sum over all its segmentations."""
        source, to, row, cuts, first = self.lattice(many)
        scaled = self.scaled()
        alpha = np.zeros((first[-1], len(self.langs)))
        alpha[first[:-1]] = 1.0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            # Edges from one distance into the words: no two of them end at the same place.
            alpha[to[a:b]] += alpha[source[a:b]] * scaled[row[a:b]]
        return np.log(np.maximum(alpha[first[1:] - 1], 1e-300)) - (np.diff(first) - 1)[:, None] * np.log(SCALE)


def expected(model: Model, many: list[str], lang: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Expected piece counts of (word, language, count) rows, by forward-backward."""
    source, to, row, cuts, first = model.lattice(many)
    of = np.searchsorted(first, source, "right") - 1
    p = model.scaled()[row, lang[of]]  # the scales cancel out below
    alpha, beta = np.zeros(first[-1]), np.zeros(first[-1])
    alpha[first[:-1]] = 1.0
    beta[first[1:] - 1] = 1.0
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    for a, b in spans:
        alpha[to[a:b]] += alpha[source[a:b]] * p[a:b]
    for a, b in reversed(spans):
        if a < b:
            cut = runs(source[a:b])[:-1]
            beta[source[a:b][cut]] += np.add.reduceat(beta[to[a:b]] * p[a:b], cut)
    whole = np.maximum(alpha[first[1:] - 1], 1e-300)[of]
    out = np.zeros(model.prob.shape)
    np.add.at(out, (row, lang[of]), count[of] * alpha[source] * p * beta[to] / whole)
    return out


def _count_words(most_word: int):
    def run(batches):
        held: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, n in word_counts(text, most_word).items():
                    held[lang, w] = held.get((lang, w), 0) + n
                if len(held) > REMEMBERED:
                    yield _counted(held)
                    held = {}
        if held:
            yield _counted(held)

    return run


def _counted(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])


def _expect(model):
    def run(batches):
        m, total = model.value, None
        at = {x: i for i, x in enumerate(m.langs)}
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                lang = np.array([at[x] for x in part.column(0).to_pylist()], np.int64)
                got = expected(m, part.column(1).to_pylist(), lang, part.column(2).to_numpy().astype(float))
                total = got if total is None else total + got
        if total is not None:
            row, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[row, lang])], names=["row", "lang", "n"])

    return run


def train(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = 2, most_word: int = 32, most_languages: int = 1_000, pieces: list[str] | None = None, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from every row of docs with a language; rows without one are left out. pieces, if given, are the vocabulary."""
    if not 1 <= most_word <= 40:
        raise ValueError("most_word must be from 1 to 40")
    spark: SparkSession = docs.sparkSession
    ship(spark)
    pieces = read_vocabulary(vocabulary) if pieces is None else sorted(set(pieces))
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null")
    # The counts of word types: combined in each task, then by one shuffle; texts are not shuffled.
    counts = rows.mapInArrow(_count_words(most_word), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = written(counts, "words")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages: raise most_languages, which bounds the model")
    langs = sorted(sizes)
    n_docs = np.array([sizes[x] for x in langs], float)
    shape = (len(pieces) + 1, len(langs))
    keyed = sorted((_key(p), len(p)) for p in pieces)
    lens = np.array([n for _, n in keyed] + [1], float)
    model = Model(langs, np.array([k for k, _ in keyed], np.uint64), np.full(shape, 1.0 / shape[0]), np.log(n_docs / max(n_docs.sum(), 1)), max(map(len, pieces), default=1), lens)
    for _ in range(rounds if langs else 0):
        sent = spark.sparkContext.broadcast(model)
        got = counts.select("lang", "word", "n").mapInArrow(_expect(sent), "row bigint, lang bigint, n double").groupBy("row", "lang").agg(F.sum("n").alias("n")).toPandas()
        n = np.ones(shape)
        # Ordered sums, so that runs agree.
        got = got.sort_values(["row", "lang"])
        n[got["row"].to_numpy(int), got["lang"].to_numpy(int)] += got["n"].to_numpy(float).round(6)
        model = replace(model, prob=n / n.sum(axis=0))
        sent.unpersist()
    return model


def _predict(model, most_word: int):
    def run(batches):
        m = model.value
        known, table = {}, np.empty((0, len(m.langs)))
        for batch in batches:
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for begin in range(0, batch.num_rows if m.langs else 0, ROWS):
                texts = batch.column(1).slice(begin, ROWS).to_pylist()
                counts = [word_counts(text, most_word) for text in texts]
                if len(known) > REMEMBERED:
                    known, table = {}, table[:0]
                new = list(set().union(*counts).difference(known))
                new.sort()
                parts = [table]
                for a in range(0, len(new), STEP):
                    parts.append(m.log_probs(new[a : a + STEP]))
                known.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                table = np.concatenate(parts)
                for i, c in enumerate(counts, begin):
                    if not c:
                        continue
                    at = np.array(list(map(known.__getitem__, c)))
                    total = m.prior + np.array(list(c.values()), float) @ table[at]
                    best = int(np.argmax(total))
                    lang[i] = m.langs[best]
                    score[i] = 1.0 / float(np.exp(np.minimum(total - total[best], 0.0)).sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, most_word: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (the language's probability, 0 to 1)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(sent, most_word), "doc_id bigint, lang_pred string, score double")


def _keep(model, most_word: int, at: int, least: float):
    inner = _predict(model, most_word)

    def run(batches):
        for batch in batches:
            text = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["doc_id", "text"])
            for judged in inner([text]):
                none = not model.value.langs
                ok = [none or x != "und" and s >= least for x, s in zip(judged.column(1).to_pylist(), judged.column(2).to_pylist(), strict=True)]
                yield batch.filter(pa.array(ok, pa.bool_()))

    return run


def drop_unidentified(docs: DataFrame, model: Model, least: float = 0.5, most_word: int = 32, text_col: str = "text") -> DataFrame:
    """docs with all their columns, without texts without a letter, or with no language of probability `least`. That probability is among the learned languages alone: a text of more than a few words in a language that wasn't learned is nearly always kept. A model without languages judges nothing."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(sent, most_word, docs.columns.index(text_col), least), docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """crc32 of the id as text, modulo folds, is fold; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


__all__ = ["Model", "train", "predict", "drop_unidentified", "held_out", "read_vocabulary"]
