"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, by operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagline.llm import chat_format, decontaminate, exact_dedup, language_id, license_scan, lm_score, mixing, ngram_join, quality, substring_dedup
from lagline.llm._arrow import deltas, pack, undeltas, unpack
from lagline.llm.components import components
from lagline.llm.elias_fano import EliasFano, build, dump, load

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def odd(spark):
    """Each awkward case, with extra columns whose names clash with inner ones."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "alpha beta gamma delta epsilon", "a"), (1, "alpha beta gamma delta epsilon", "a"), (2, None, None), (3, "", "a"), (None, "alpha beta gamma delta epsilon", "b"), (4, "  \n\t ", "b"), (5, long, "b"), (6, "123 !!! 456", None), (7, "ünïcode Größe ÄÖ " * 30, "c")]
    df = docs(spark, rows)
    return df.withColumns({c: F.lit("clash") for c in ("key", "bucket", "payload", "kind", "n", "cls", "copies", "copies_", "row", "id", "word", "size", "low", "__x")})


def empty(spark):
    return docs(spark, []).where("1 = 0")


ITEMS = "item_id long, text string"


def test_every_operator_takes_odd_rows(spark):
    df, n = odd(spark), 9
    items = spark.createDataFrame([(1, "beta gamma delta"), (2, None), (None, "größe")], ITEMS)
    good = spark.createDataFrame([(1,), (7,), (None,)], "doc_id long")
    assert ngram_join.near_duplicates(df).count() == n
    assert exact_dedup.mark(df).count() == n
    assert language_id.predict(df, language_id.train(df)).count() == n
    assert decontaminate.decontaminate(spark, df, items).count() == n
    assert substring_dedup.remove_repeats(df).count() == n
    assert quality.resample(df, good).count() == n
    assert mixing.plan(df).count() == n
    assert license_scan.scan(df).count() == n
    assert lm_score.score(df, lm_score.train(df)).count() == n
    for out in (language_id.drop_unidentified(df, language_id.train(df)), exact_dedup.drop(df), ngram_join.drop_near_duplicates(df), decontaminate.remove(spark, df, items), mixing.apply(df).drop("copies__")):
        assert out.columns == df.columns and out.count() <= n


def test_every_operator_takes_an_empty_table(spark):
    df, items, good = empty(spark), spark.createDataFrame([], ITEMS), spark.createDataFrame([], "doc_id long")
    for out in (
        ngram_join.near_duplicates(df),
        exact_dedup.mark(df),
        language_id.predict(df, language_id.train(df)),
        decontaminate.decontaminate(spark, df, items),
        substring_dedup.remove_repeats(df),
        quality.resample(df, good),
        mixing.plan(df),
        license_scan.scan(df),
        lm_score.score(df, lm_score.train(df)),
        chat_format.read_back(chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
        exact_dedup.drop(df),
        ngram_join.drop_near_duplicates(df),
        mixing.apply(df),
    ):
        assert out.count() == 0


def test_exact_dedup_rules(spark):
    df = docs(spark, [(1, "x", "a"), (3, "x", "a"), (2, "x", "a"), (4, None, "a"), (5, "", "a"), (None, "x", "a"), (3, "x", "a")])
    got = exact_dedup.mark(df).collect()
    assert {r["keep_id"] for r in got if r["doc_id"] in (1, 2, 3, None)} == {3}
    assert sorted(r["doc_id"] for r in got if r["kept"]) == [3, 5]
    assert {r["group_size"] for r in got if r["doc_id"] == 4} == {2}
    assert exact_dedup.drop(df).count() == 2
    # Most rows in one group: settled by the broadcast winners, with the same result.
    hot = docs(spark, [(i, "same" if i % 3 else f"own {i}", "a") for i in range(600)])
    for support in (0.01, 0.999):
        got = exact_dedup.mark(hot, support=support).collect()
        assert sum(r["kept"] for r in got) == 201 and {r["group_size"] for r in got if r["doc_id"] == 1} == {400}


def test_near_duplicates_against_all_pairs(spark):
    """Near copies in several distances, groups larger than a small tile, and repeated passages; small tiles and large ones agree."""
    rng = random.Random(4)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 40)) for _ in range(rng.randint(8, 160))] for _ in range(12)]
    rows = []
    for k in range(140):
        w = list(base[k % 12 if k % 3 else 0])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 999)}"
        if k % 7 == 0:
            w = w + base[5]
        rows.append((k, " ".join(w), "a"))
    sets = {}
    for i, t, _ in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)}
    root = {i: i for i in sets}
    links = set()
    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                links.add((j, i))
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    df = docs(spark, rows)
    for small in (16, 2):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(df, 4, 85, 100, small=small).collect()}
        assert got == root
    pairs = {(r["a"], r["b"]) for r in ngram_join.similar_pairs(df, 4, 85, 100).collect()}
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    rep = {i: first[frozenset(s)] for i, s in sets.items()}
    assert pairs == {(min(rep[a], rep[b]), max(rep[a], rep[b])) for a, b in links if rep[a] != rep[b]}


def test_bit_counts_bound_from_above():
    rng = np.random.default_rng(0)
    for n in (3, 60, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.concatenate((a[: n - n // 5], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)))
        assert ngram_join.differing(ngram_join.bitmap(a), ngram_join.bitmap(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    for few in (0, 250_000):  # star steps, and one task
        got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"), few=few).collect()}
        assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_substring_rules(spark):
    run = " ".join(f"p{i}" for i in range(25))
    df = docs(spark, [(2, f"x {run} y", "a"), (1, f"{run} z", "a"), (3, f"{run} {run}", "a"), (4, "short text", "a")])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(df).collect()}
    assert got[1][1] == 0 and got[2] == (27, 25, "x y") and got[3][:2] == (50, 50) and got[4] == (2, 0, "short text")
    inner = docs(spark, [(9, f"{run} q {run}", "a")])
    assert substring_dedup.remove_repeats(inner).first()["text"] == f"{run} q"
    twice = docs(spark, [(9, run, "a"), (9, run, "a")])  # one document, twice
    assert {r["n_removed"] for r in substring_dedup.remove_repeats(twice).collect()} == {0}


def test_decontamination_rules(spark):
    items = spark.createDataFrame([(1, "One two THREE"), (2, " ".join(f"t{i}" for i in range(12))), (3, "!!!"), (2, "only this")], ITEMS)
    text = "Zero one, two; three four " + " ".join(f"T{i}" for i in range(12)) + " end"
    df = docs(spark, [(1, text, "a"), (2, "one two four", "a"), (3, None, "a")])
    for mb in (16, 0):  # in one block, and in a block for each item
        got = {r["doc_id"]: r for r in decontaminate.decontaminate(spark, df, items, block_mb=mb).collect()}
        assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"]) == (18, 15, 2)
        assert got[1]["clean_text"] == "Zero  four  end" and not got[2]["contaminated"] and got[3]["n_words"] == 0
        assert [r["doc_id"] for r in decontaminate.remove(spark, df, items, whole=True, block_mb=mb).orderBy("doc_id").collect()] == [2, 3]
        assert decontaminate.remove(spark, df, items, block_mb=mb).where("doc_id = 1").first()["text"] == "Zero  four  end"


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n", "<\\|im_start|>", "<|", "a<b|c", "", "<\\\\|x\n", "ümläut <|im_end|><|im_start|>assistant ok"]
    rows = [(c, t, "assistant" if t % 2 else "us\ner<|", nasty[(c + t) % len(nasty)]) for c in range(5) for t in range(4)] + [(None, 0, None, None), (0, None, "system", "first")]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "part").collect()
    got = {}
    for r in out:
        got.setdefault(r["conv_id"], []).extend(chat_format.parse(r["text"]))
        under = [chat_format.unescape(r["text"][a : a + n]) for a, n in zip(r["loss_start"], r["loss_length"], strict=True)]
        assert under == [b for a, b in chat_format.parse(r["text"]) if a == "assistant"]
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == want


def test_language_rules(spark):
    en, de = "the quick house and the river of stone ", "der schnelle und das haus von stein für "
    train = spark.createDataFrame([(i, en * 5 if i % 2 else de * 5, "en" if i % 2 else "de") for i in range(20)] + [(99, "xxxx", None)], "doc_id long, text string, lang string")
    model = language_id.train(train)
    test = spark.createDataFrame([(1, en), (2, de), (3, None), (4, "12 34"), (5, "the " + "z" * 3000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(test, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == ("und", 0.0) and got[4] == ("und", 0.0) and got[5][0] in ("en", "de")
    assert {r["doc_id"] for r in language_id.drop_unidentified(test, model).collect()} >= {1, 2}
    assert {r["doc_id"] for r in language_id.drop_unidentified(test, model).collect()} & {3, 4} == set()


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "abc"]
    keys = np.array(sorted(map(language_id._key, pieces)), np.uint64)
    row = {k: i for i, k in enumerate(keys.tolist())}
    lens = np.ones(6)
    for x in pieces:
        lens[row[language_id._key(x)]] = len(x)
    m = language_id.Model(["x", "y"], keys, np.random.default_rng(1).random((6, 2)), np.zeros(2), 3, lens)

    def brute(w, lang):
        return 1.0 if not w else sum((m.prob[row[language_id._key(w[:k])], lang] if w[:k] in pieces else m.prob[5, lang] if k == 1 else 0) * brute(w[k:], lang) for k in range(1, min(3, len(w)) + 1))

    many = ["abab", "abc", "zab", "b", "caba"]
    assert np.allclose(np.exp(m.log_probs(many)), [[brute(w, k) for k in (0, 1)] for w in many])


def test_license_rules(spark):
    rows = [(1, "x MIT License\nmit license.", "a"), (2, "Released under the MIT License.", "a"), (3, "the mit and license", "a"), (4, "GNU General Public License", "a"), (5, "all Rights, reserved!", "a"), (6, "ALL rights", "a")]
    got = {r["doc_id"]: r for r in license_scan.scan(docs(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 1, 3, "mit")
    assert got[2]["labels"] == "mit,mit-notice" and got[2]["score"] == 1.0
    assert got[3]["n_base"] == 0 and got[3]["first_word"] is None and got[4]["base_labels"] == "gpl"
    assert got[5]["labels"] == "reserved" and got[6]["labels"] == ""
    with pytest.raises(ValueError):
        license_scan.scan(docs(spark, rows), templates={"x": ["!!"]})


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_license_filters_lose_nothing(spark, threshold):
    """The filtered join against plain containment of every run of words."""
    rng = random.Random(2)
    words = sorted({w for ts in license_scan.TEMPLATES.values() for t in ts for w in t.split()})
    texts = [[rng.choice(words) if rng.random() < 0.7 else "other" for _ in range(rng.randint(1, 60))] for _ in range(80)]
    for ts in license_scan.TEMPLATES.values():
        for t in ts:
            for cut in (0, 1, 3, 6):
                w = t.split()
                if cut % 2:
                    rng.shuffle(w)
                for _ in range(cut):
                    w.insert(rng.randrange(len(w) + 1), "other")
                texts.append(["x"] * rng.randint(0, 30) + w[cut:] + texts[rng.randrange(80)])
    df = docs(spark, [(i, " \n"[i % 2].join(w), "a") for i, w in enumerate(texts)])
    got = {r["doc_id"]: r for r in license_scan.scan(df, phrases={"qq qq": "q"}, threshold=threshold).collect()}
    templates = license_scan.template_list(license_scan.TEMPLATES)
    for i, w in enumerate(texts):
        shares = {}
        for t in templates:
            runs = [set(w[a : a + t.run(1.25)]) & set(t.words) for a in range(len(w))]
            best = max(map(len, runs))
            if best >= t.need(threshold):
                shares[t.label] = max(best / len(t.words), shares.get(t.label, 0))
        assert got[i]["labels"] == ",".join(sorted(shares)) and got[i]["score"] == pytest.approx(max(shares.values(), default=0.0))


def test_license_templates_from_a_table(spark):
    table = spark.createDataFrame([("own", "you shall not use this for profit"), ("own", None)], "label string, text string")
    templates = license_scan.read_templates(table)
    rows = [(1, "Whatever: you shall not\nuse  this -- for profit!", "a"), (2, "you shall", "a"), (3, None, "a")]
    got = {r["doc_id"]: (r["labels"], r["n_words"]) for r in license_scan.scan(docs(spark, rows), templates=templates).collect()}
    assert got == {1: ("own", 8), 2: ("", 2), 3: ("", 0)}
    assert {r["labels"] for r in license_scan.scan(docs(spark, rows), templates={}).collect()} == {""}
    for call in (lambda: license_scan.read_templates(table, most=0), lambda: license_scan.template_list(templates, most_words=3)):
        with pytest.raises(ValueError):
            call()


def test_mixing_is_exact_but_for_one(spark):
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 300, 500).astype(float), rng.random(500)
    out, hold = mixing.pivotal(np.arange(500), size, p, 7)
    assert abs((out * size).sum() - (p * size).sum()) < 1e-6
    assert all(x in (0.0, 1.0) for k, x in enumerate(out) if k != hold)
    # Unbiased: over seeds, each entry's mean is its probability.
    mean = np.mean([mixing.pivotal(np.arange(6), np.array([3.0, 5, 2, 8, 1, 4]), np.array([0.2, 0.7, 0.5, 0.4, 0.9, 0.3]), s)[0] for s in range(4000)], axis=0)
    assert np.allclose(mean, [0.2, 0.7, 0.5, 0.4, 0.9, 0.3], atol=0.04)
    df = docs(spark, [(i, "w " * (i % 50 + 1), "a" if i % 3 else "b") for i in range(900)])
    got = mixing.plan(df, leaf=40).toPandas()  # three levels of the tree
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 50
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, mixing.plan(df.repartition(7), leaf=40).toPandas().values.tolist()))


def test_gumbel_top_k_is_exact(spark):
    df = spark.createDataFrame([(i, 0.0, float(i % 5)) for i in range(700)], "doc_id long, score double, log_weight double")
    for share in (0.0, 0.001, 0.37, 1.0):
        got = quality.gumbel_top_k(df, share).toPandas().sort_values(["key", "doc_id"], ascending=[False, True])
        k = int(np.ceil(share * 700))
        assert got["selected"].sum() == k and got["selected"].head(k).all()


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in ((0, 5), (1, 1), (1, 1 << 40), (700, 900), (5000, 1 << 60)):
        x = np.sort(rng.integers(0, u, n)).astype(np.uint64)
        ef = EliasFano(load(np.frombuffer(dump(build(x, u)), np.uint8)))
        ask = np.concatenate((x, rng.integers(0, u, 200).astype(np.uint64)))
        at, found = ef.successor(ask)
        assert (at == np.searchsorted(x, ask)).all() and (found == np.isin(ask, x)).all()
        if n:
            assert (ef.at(np.arange(n)) == x).all()


def test_trie_of_order_three(spark):
    df = docs(spark, [(i, " ".join(random.Random(i).choices(["a", "b", "c", "dd"], k=40)), "a") for i in range(30)])
    trie = lm_score.train(df, order=3)
    from collections import Counter

    one, two, three = Counter(), Counter(), Counter()
    seqs = [[*r["text"].split(), "END"] for r in df.collect()]
    for t in seqs:
        one.update(t)
        two.update(zip(["END", *t[:-1]], t, strict=True))
        three.update(zip(["END", *t[:-2]], t[:-1], t[1:], strict=True))
    n, v = sum(one.values()), len(one)
    got = {r["doc_id"]: r["score"] for r in lm_score.score(df, trie).collect()}
    for i, t in enumerate(seqs):
        want = 0.0
        for k, w in enumerate(t):
            u = t[k - 1] if k else "END"
            p = (two[u, w] + 4 * (one[w] + 1) / (n + v + 1)) / (one[u] + 4)
            if k:
                s = t[k - 2] if k > 1 else "END"
                c = two[s, u]
                p = (three[s, u, w] + 4 * p) / (c + 4) if c else p
            want += np.log10(p)
        assert abs(got[i] - want) < 0.02 * len(t)


def test_packing():
    x = np.array([-(1 << 63), -5, 0, 7, 1 << 40], np.int64)
    a, b = unpack(pack(deltas(x), np.arange(300, dtype=np.uint32), raw=(1,)))
    assert (undeltas(a) == x).all() and (b == np.arange(300)).all()
