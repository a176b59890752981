"""Rows that repeat an id or have none, with texts of their own: near duplicates and substrings against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lagline.llm import ngram_join, substring_dedup

SCHEMA = "doc_id long, text string"


def near(rows, n, num, den):
    """(doc_id, set size, smallest id of the component) of each row."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[j : j + n]) for j in range(len(w) - n + 1)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = {}
    for k, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        for j, c in Counter(j for x in s for j in held[x] if j < k).items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, len(sets[k]), low.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def mutated(rng, words, k):
    w = list(words)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randint(0, 99999)}"
    return " ".join(w)


@pytest.mark.parametrize("options", [{}, {"small": 2, "group": 12, "block": 20}])
def test_near_duplicates(spark, options):
    """A group without its original, one with it, chains, and ids that say nothing."""
    rng = random.Random(7)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(200)] for _ in range(6)]
    rows = [(rng.choice([None, 5, 5, k]), mutated(rng, base[k % 6], rng.choice([0, 1, 2, 3]))) for k in range(90)]
    rows += [(200 + k, mutated(rng, base[0], 3)) for k in range(60)] + rows[:9] + [(None, None), (None, " "), (7, "a b"), (8, "A  b")]
    df = spark.createDataFrame(rows, SCHEMA)
    for n, num in ((5, 80), (4, 85)):
        got = ngram_join.near_duplicates(df, n, num, 100, **options).collect()
        assert sorted(map(tuple, got), key=str) == near(rows, n, num, 100)


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(1)
    a, b = ([f"{x}{k}" for k in range(120)] for x in "ab")
    near_a, other = mutated(rng, a, 1), mutated(rng, b, 100)
    rows = [(2, " ".join(a)), (5, near_a), (5, other), (None, mutated(rng, a, 1)), (None, " ".join(b)), (None, mutated(rng, b, 1)), (9, other), (9, other), (3, None), (3, None), (None, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash"))
    got = ngram_join.drop_near_duplicates(df).collect()
    assert [r["key"] for r in got] == ["clash"] * len(got)
    got = Counter((r["doc_id"], r["text"]) for r in got)
    assert got[2, " ".join(a)] == 1 and got[5, near_a] == 0 and got[5, other] == 1 and got[9, other] == 0  # 5's other text stays
    assert sum(n for (i, t), n in got.items() if i is None and t) == 1  # of two near copies without an id
    assert got[3, None] == 2 and got[None, ""] == 1


def test_rows_that_are_there_twice_leave_one(spark):
    df = spark.createDataFrame([(4, "one two three four five six")] * 3 + [(None, "x y z")] * 2, SCHEMA)
    assert sorted((r["doc_id"] or 0) for r in ngram_join.drop_near_duplicates(df).collect()) == [0, 4]


def repeats(rows, n):
    """Each row without the words under windows that start before, in the order of (id, row hash, start)."""
    rows = [((i is not None, i or 0, h), (t or "").split()) for i, t, h in rows]
    first = {}
    for key, w in rows:
        for s in range(len(w) - n + 1):
            first[tuple(w[s : s + n])] = min((key, s), first.get(tuple(w[s : s + n]), (key, s)))
    out = []
    for key, w in rows:
        gone = {k for s in range(len(w) - n + 1) if first[tuple(w[s : s + n])] < (key, s) for k in range(s, s + n)}
        out.append((key[1] if key[0] else None, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [3_000_000, 400])
def test_substrings(spark, segment):
    rng = random.Random(3)
    passages = [[f"p{k}_{j}" for j in range(rng.randint(15, 60))] for k in range(12)]

    def text():
        return " ".join(w for _ in range(rng.randint(0, 8)) for w in (rng.choice(passages) if rng.random() < 0.6 else [f"x{rng.randint(0, 10**7)}" for _ in range(rng.randint(1, 30))]))

    rows = [(rng.choice([None, 1, 2, 3, k, k, k]), rng.choice([None, "", text(), text(), text()])) for k in range(200)]
    df = spark.createDataFrame(rows + rows[:15], SCHEMA).repartition(5)
    hashed = [tuple(r) for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text")).collect()]
    assert sorted(map(tuple, substring_dedup.remove_repeats(df, 20, segment=segment).collect()), key=str) == repeats(hashed, 20)
