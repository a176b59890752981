"""Trained operators against plain versions of themselves."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_cases import docs

from lagline.llm import language_id, quality
from lagline.llm.queries import QUERIES


def cuts(word, pieces):
    """All segmentations: pieces of the vocabulary, and single letters that it lacks as '?'."""
    if not word:
        yield ()
        return
    for k in range(1, len(word) + 1):
        x = word[:k] if word[:k] in pieces else "?" if k == 1 else None
        if x is not None:
            for rest in cuts(word[k:], pieces):
                yield (x, *rest)


def test_language_model_and_posterior(spark):
    pieces = ["a", "b", "ab", "ba", "aba", "c", "cab"]
    rows = [("x", "abab cab ba"), ("x", "aba AB z"), ("y", "cab cab bac"), ("y", "cc ab zz"), ("y", "abba"), (None, "ccc ccc")]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.train(df, pieces=pieces, rounds=3)
    known = [*pieces, "?"]
    langs = ["x", "y"]
    p = {g: dict.fromkeys(known, 1 / len(known)) for g in langs}
    weight = lambda g, cut: math.prod(p[g][x] for x in cut)
    for _ in range(3):
        n = {g: dict.fromkeys(known, 1.0) for g in langs}
        for lang, text in rows:
            for w in text.lower().split() if lang else ():
                every = list(cuts(w, set(pieces)))
                total = sum(weight(lang, c) for c in every)
                for c in every:
                    for x in c:
                        n[lang][x] += weight(lang, c) / total
        p = {g: {x: v / sum(n[g].values()) for x, v in n[g].items()} for g in langs}
    row = {k: i for i, k in enumerate(model.keys.tolist())}
    for j, g in enumerate(langs):
        assert model.prob[-1, j] == pytest.approx(p[g]["?"], rel=1e-4)
        for x in pieces:
            assert model.prob[row[language_id._key(x)], j] == pytest.approx(p[g][x], rel=1e-4)
    tests = ["abab", "cab ab", "zz c", "ba ba ba aba", "½ ²", "", None, "ABBA, cc"]
    got = language_id.predict(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).collect()
    prior = {"x": 2 / 5, "y": 3 / 5}
    for r in got:
        words = "".join(c if c.isalpha() else " " for c in (tests[r["doc_id"]] or "").lower()).split()
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        joint = {g: prior[g] * math.prod(sum(weight(g, c) for c in cuts(w, set(pieces))) for w in words) for g in langs}
        best = max(langs, key=lambda g: joint[g])
        assert r["lang_pred"] == best and r["score"] == pytest.approx(joint[best] / sum(joint.values()), rel=1e-3)


def test_long_words_of_rare_letters_differ_by_language(spark):
    """Words of 32 letters that no piece covers: probabilities of 10^-400 still count."""
    model = language_id.Model(["x", "y"], np.array([], np.uint64), np.array([[1e-13, 1e-12]]), np.log([0.5, 0.5]), 1)
    got = language_id.predict(spark.createDataFrame([(1, "ж" * 32)], "doc_id long, text string"), model).first()
    assert got["lang_pred"] == "y" and got["score"] > 0.999
    assert np.allclose(model.log_probs(["ж" * 32])[0], 32 * np.log([1e-13, 1e-12]))


def test_language_limits(spark):
    df = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="most_languages"):
        language_id.train(df, pieces=["a"], most_languages=4)
    with pytest.raises(FileNotFoundError, match="no vocabulary"):
        language_id.train(df, vocabulary="/nowhere/x.model")


def test_ties_go_to_the_first_language(spark):
    df = spark.createDataFrame([(1, "abc", "y"), (2, "abc", "x")], "doc_id long, text string, lang string")
    model = language_id.train(df, pieces=["a", "b"])
    assert language_id.predict(df, model).first()["lang_pred"] == "x"


def test_importance_weights(spark):
    """With as many buckets as make collisions unlikely, the hashed models are plain n-gram models with half a count added."""
    texts = ["a b c", "a b b", "", None, "C c a", "d"]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    good = spark.createDataFrame([(0,), (4,), (None,), (77,)], "doc_id long")
    buckets = 1 << 16
    grams = lambda t: [*(w := (t or "").lower().split()), *zip(w, w[1:], strict=False)]
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        target.update(grams(t) if i in (0, 4) else [])
    nr, nt = sum(raw.values()) + buckets / 2, sum(target.values()) + buckets / 2
    ratio = lambda g: math.log((target[g] + 0.5) / nt) - math.log((raw[g] + 0.5) / nr)
    got = {r["doc_id"]: r for r in quality.score(df, quality.log_ratio(df, good, buckets=buckets)).collect()}
    for i, t in enumerate(texts):
        want = sum(map(ratio, grams(t)))
        assert got[i]["log_weight"] == pytest.approx(want, abs=1e-9) and got[i]["score"] == pytest.approx(want / max(len(grams(t)), 1), abs=1e-9)


def test_temperature_and_null_ids(spark):
    df = spark.createDataFrame([(None, k, float(k % 3), float(k % 3) * 1000) for k in range(600)], "doc_id long, row long, score double, log_weight double")
    cold = quality.gumbel_top_k(df, 1 / 3).where("selected").toPandas()
    assert set(cold["score"]) == {2.0}  # noise decides nothing
    warm = quality.gumbel_top_k(df, 1 / 3, temperature=1e6).where("selected").toPandas()
    assert len(warm) == 200 and warm["row"].nunique() == 200 and set(warm["score"]) == {0.0, 1.0, 2.0}  # nor do the weights; each null id has its own
    even = quality.gumbel_top_k(df, 1 / 3, by_length=True).where("selected").toPandas()
    assert 0 < (even["score"] < 2).sum() < (even["score"] == 2).sum()


def test_op7_ranks_labels_that_it_never_saw(spark, duck, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["op7_quality"](spark, sf_dir).collect()}
    lab = [(i, bool(y)) for i, y in duck.sql("SELECT doc_id, quality = 1 AND toxic = 0 FROM labels").fetchall() if i in got]
    held = defaultdict(list)
    for i, y in lab:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if got[i]["held_out"]:
            held[y].append(got[i]["score"])
    pairs = [(a > b) + (a == b) / 2 for a in held[True] for b in held[False]]
    assert sum(pairs) / len(pairs) > 0.75  # AUC
