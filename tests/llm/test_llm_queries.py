"""Every query of the subpackage against its SQL, or a brute-force version, on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest import same

from lagline.llm.queries import ORACLE, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, sf_dir, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE[name]).df())


def texts(duck):
    return {i: t for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}


def components(sets, num, den):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)
    for i, s in sets.items():
        over = Counter(j for x in s for j in held[x] if j < i)
        for j, n in over.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def shingles(text, n):
    w = WORD.findall(low(text))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_op1(spark, duck, sf_dir):
    sets = {i: shingles(t, 4) for i, t in texts(duck).items()}
    want = components(sets, 85, 100)
    for r in QUERIES["op1_ngram_join"](spark, sf_dir).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])


def test_op3(spark, duck, sf_dir):
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    got = {r["doc_id"]: r for r in QUERIES["op3_language_id"](spark, sf_dir).collect()}
    assert len(got) == len(lang)
    held = [i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[i]["lang_pred"] == lang[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_op7(spark, duck, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["op7_quality"](spark, sf_dir).collect()}
    assert sum(r["selected"] for r in got.values()) == math.ceil(0.75 * len(got))
    cut = min(r["key"] for r in got.values() if r["selected"])
    assert all(r["selected"] == (r["key"] >= cut) for r in got.values())
    lab = duck.sql("SELECT doc_id, quality = 1 AND toxic = 0 AS good FROM labels").fetchall()
    mean = lambda g: sum(got[i]["score"] for i, y in lab if y == g) / sum(y == g for _, y in lab)
    assert mean(True) > mean(False)


def test_op8(spark, duck, sf_dir):
    src = {i: (s, len(WORD.findall(t or ""))) for i, s, t in duck.sql("SELECT doc_id, source, text FROM documents").fetchall()}
    size = Counter()
    for s, n in src.values():
        size[s] += n
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(size, key=lambda s: s.encode()))}
    total, capped = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in weight if s not in capped and weight[s] * level > 3 * size[s]}
        if not over:
            break
        capped |= over
    want = {s: 3 * size[s] if s in capped else weight[s] * level for s in size}
    rows = QUERIES["op8_mixing"](spark, sf_dir).collect()
    taken, largest = Counter(), Counter()
    for r in rows:
        s, n = src[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, size[s]) and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * n
        taken[s] += r["taken"]
        largest[s] = max(largest[s], n)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in size)
    assert sorted(rows) == sorted(QUERIES["op8_mixing"](spark, sf_dir).repartition(3).collect())


def test_op10(spark, duck, sf_dir):
    tokens = {i: [*WORD.findall(low(t)), None] for i, t in texts(duck).items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    one, two = Counter(), Counter()
    for i, t in tokens.items():
        if not held[i]:
            one.update(t)
            two.update(zip([None, *t[:-1]], t, strict=True))
    n, v, mu = sum(one.values()), len(one), 4.0
    for r in QUERIES["op10_lm_score"](spark, sf_dir).collect():
        t = tokens[r["doc_id"]]
        p = [(one[w] + 1) / (n + v + 1) for w in t]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(one[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(map(math.log10, p)), abs=1e-6)
        full = sum(math.log10((two[u, w] + mu * q) / (one[u] + mu)) for u, w, q in zip([None, *t[:-1]], t, p, strict=True))
        assert abs(r["bigram_score"] - full) <= 0.02 * len(t) + 1e-6  # the stored probabilities are quantised


def test_pipeline(spark, duck, sf_dir):
    """Each stage on its own input, by brute force."""
    import corpus_pipeline as cp

    from lagline.llm._store import written

    assert [n for n, _ in cp.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for _, stage in cp.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = written(stage(spark, docs, sf_dir), "test")
        seen.append((before, {r["doc_id"] for r in docs.select("doc_id").collect()}))
        assert docs.columns[: len(columns)] == columns
    before, after = seen[0]
    assert {i for i, t in before.items() if any(c.isalpha() for c in t or "")} == after
    before, after = seen[1]
    last = {}
    for i, t in before.items():
        last[t] = max(i, last.get(t, i))
    assert set(last.values()) == after
    before, after = seen[2]
    root = components({i: shingles(t, 5) for i, t in before.items()}, 80, 100)
    assert {i for i, r in root.items() if i == r} == after
    before, after = seen[3]
    hit = {r["doc_id"] for r in QUERIES["op4_decontaminate"](spark, sf_dir).where("contaminated").collect()}
    assert set(before) - hit == after
    before, after = seen[4]
    assert after <= set(before) and {r["copies"] for r in docs.collect()} <= {1, 2, 3}


def test_kept_sha(spark, duck, sf_dir):
    """Texts without a repeat come back word by word."""
    text = texts(duck)
    for r in QUERIES["op5_substring_dedup"](spark, sf_dir).where("n_removed = 0").limit(50).collect():
        assert r["kept_sha256"] == hashlib.sha256(" ".join(WORD.findall(text[r["doc_id"]])).encode()).hexdigest()
