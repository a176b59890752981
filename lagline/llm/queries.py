"""The operators applied to the synthetic tables, one query each, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, language_id, license_scan, lm_score, mixing, ngram_join, quality, substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


ORACLE["op2_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op4_decontaminate(spark, sf_dir):
    out = decontaminate.decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("clean_text")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op4_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS phrase
      FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
l AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, l WHERE len(ws) >= n)),
h AS (SELECT doc_id, g.n, i, item FROM g JOIN p ON g.n = p.n AND g.phrase = p.phrase),
w AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op5_substring_dedup(spark, sf_dir):
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE["op5_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS phrase FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS k FROM r) GROUP BY doc_id),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
x AS (SELECT DISTINCT doc_id, unnest(gone) AS k FROM g),
s AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.k) AS kept FROM u ANTI JOIN x ON u.doc_id = x.doc_id AND u.k = x.k GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN s USING (doc_id)
"""

CONTROL = "<|im_end|><|im_start|>assistant ok"


@query
def op6_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id bigint, turn bigint, role string, text string")
    return chat_format.read_back(chat_format.format_chats(turns.unionByName(made)))


ORACLE["op6_chat_format"] = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query
def op8_mixing(spark, sf_dir):
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op1_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


ORACLE["op1_ngram_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT a AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(b) AS component_id FROM r LEFT JOIN n ON n.doc_id = a GROUP BY 1, 2
"""


@query
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.where("not held_out"))
    out = language_id.predict(docs, model)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query
def op7_quality(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").where(~language_id.held_out()).select("doc_id")
    out = quality.resample(table(spark, sf_dir, "documents"), good, share=0.75)
    return out.withColumn("held_out", language_id.held_out())  # labels of those weren't learned from


@query
def op10_lm_score(spark, sf_dir):
    held = language_id.held_out(folds=7)
    docs = table(spark, sf_dir, "documents")
    trie = lm_score.train(docs.where(~held), order=3)
    out = lm_score.score(docs, trie)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.element_at("by_order", 2).alias("bigram_score"))


def _license_sql() -> str:
    """Plain containment of every run of words in every template, without the filters."""
    templates = license_scan.template_list(license_scan.TEMPLATES)
    named = ", ".join(f"({k}, '{t.label}', {t.words!r}, {t.run(1.25)}, {t.need(0.8)})" for k, t in enumerate(templates))
    places = []
    for phrase in license_scan.PHRASES:
        ps = phrase.split()
        same = " AND ".join(f"ws[i + {k}] = '{p}'" for k, p in enumerate(ps))
        places.append(f"list_filter(range(1, len(ws) - {len(ps)} + 2), lambda i: {same})")
    at = ", ".join(f"{p} AS at_{label}" for p, label in zip(places, license_scan.PHRASES.values(), strict=True))
    every = "list_concat(" * (len(places) - 1) + "at_" + list(license_scan.PHRASES.values())[0] + "".join(f", at_{label})" for label in list(license_scan.PHRASES.values())[1:])
    base = "list_filter([" + ", ".join(f"CASE WHEN len(at_{label}) > 0 THEN '{label}' END" for label in license_scan.PHRASES.values()) + "], lambda x: x IS NOT NULL)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, {at} FROM d),
t(k, label, words, run, need) AS (VALUES {named}),
u AS (SELECT k, label, run, need, len(words) AS m, unnest(words) AS word FROM t),
w AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
x AS (SELECT r, k, label, run, need, m, w.word, pos FROM w JOIN u USING (word)),
n AS (SELECT label, r, need, m, count(DISTINCT word) OVER (PARTITION BY r, k ORDER BY pos RANGE BETWEEN CURRENT ROW AND run - 1 FOLLOWING) AS held FROM x),
s AS (SELECT r, list(DISTINCT label) AS more, max(held / CAST(m AS DOUBLE)) AS score FROM n WHERE held >= need GROUP BY r),
q AS (SELECT p.doc_id, n_words, {every} AS every, {base} AS base, more, score FROM p LEFT JOIN s USING (r))
SELECT doc_id, n_words, CAST(len(every) AS BIGINT) AS n_base, list_min(every) - 1 AS first_word, list_max(every) - 1 AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels, coalesce(score, 0.0) AS score
FROM q
"""


ORACLE["op9_license_scan"] = _license_sql()
