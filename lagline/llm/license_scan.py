"""License scans, JVM-side only: phrases, and an exact set-similarity join with templates.

A text's blocks are, for a template of L words, all its runs of ceil(`slack` * L) consecutive words,
wherever lines break (a shorter text is one block). A block meets a template if it holds at
least `threshold` of the template's distinct words (containment). The join is exact:

* the templates' words are ordered by how often all texts hold them, rarest first (words break ties);
* prefix filter: a block that meets a template of m words holds at least
  need = ceil(threshold * m) of them, so it holds one of the m - need + 1 rarest. An inverted
  list from these words to templates is joined with the places where texts hold them;
* length filter: a block has need distinct words of the templates' at least;
* positional filter, on both sides: a block is judged at its rarest template word alone. If
  that is at place p of the order (from 0), at most m - p of the template's words are in the block,
  so p <= m - need; and the block's words within reach whose places are p or more must be need at least.

One pass over the texts keeps the words that templates or phrases know, with their positions, in a
table; counts, phrases and the join work on that. What is shuffled is counts by word, and a row for each
candidate that passed the filters. The templates, their order and the inverted list are bounded by
the templates' size (an error beyond `most_words` words), whatever the corpus; Spark decides whether to broadcast them.

Defined results: null or empty text has no words and no labels. A template without words is an
error. Repeated rows are judged one by one. Columns other than id and text are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import written

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Templates of the method, by label: notices that licences are given by, and passages of widespread licences. Fixed values.
TEMPLATES = {
    "mit-notice": ["released under the mit license", "licensed under the mit license see license in the project root"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mit-terms": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ],
    "apache-notice": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"],
    "apache-terms": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "gpl-notice": ["this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license"],
    "gpl-terms": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd-notice": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-terms": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "cc-notice": ["this work is licensed under a creative commons attribution license"],
    "reserved": ["all rights reserved"],
}


def lower(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)


def split_words(text: Column) -> Column:
    """The words of a lower-cased text; after the last one, an empty string if the text goes on."""
    return F.split(F.regexp_replace(text, "^" + _BREAKS, ""), _BREAKS, -1)


class Template:
    def __init__(self, label: str, text: str):
        every = re.findall(WORDS, text.translate(str.maketrans(_UPPER, _LOWER)))
        if not every:
            raise ValueError("a template without words")
        self.label, self.length, self.words = label, len(every), sorted(set(every))

    def need(self, threshold: float) -> int:
        return math.ceil(threshold * len(self.words) - 1e-9)

    def run(self, slack: float) -> int:
        return math.ceil(slack * self.length - 1e-9)


def template_list(templates: dict[str, list[str]], most_words: int = 1_000_000) -> list[Template]:
    out = [Template(label, text) for label, texts in templates.items() for text in texts]
    if sum(t.length for t in out) > most_words:
        raise ValueError(f"templates of more than {most_words} words: raise most_words, which bounds what is broadcast")
    return out


def read_templates(table: DataFrame, label_col: str = "label", text_col: str = "text", most: int = 10_000) -> dict[str, list[str]]:
    """Templates from a table of at most `most` rows."""
    rows = table.select(F.col(label_col).cast("string"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).orderBy(label_col, text_col).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    out: dict[str, list[str]] = {}
    for label, text in rows:
        out.setdefault(label, []).append(text)
    return out


def known_words(docs: DataFrame, known: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, and its known words (word, at) with their places from 0, in order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), split_words(lower(F.col(text_col))).alias("ws"))
    held = F.filter(F.transform("ws", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(known))
    return rows.select("doc_id", (F.size("ws") - (F.element_at("ws", -1) == "").cast("int")).cast("long").alias("n_words"), held.alias("held"))


def _values(spark: SparkSession, columns: str, rows: list[str]) -> DataFrame:
    """A literal table; words hold no quotes or backslashes."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({columns})")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def block_matches(spark: SparkSession, texts: DataFrame, templates: list[Template], threshold: float, slack: float) -> DataFrame:
    """(row, label, share): for each text (row, held) and template, the best containment in a block that meets it, from each candidate place."""
    counts = texts.select(F.explode("held.word").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["word"]: r["n"] for r in counts.collect()}  # a row for each word of the templates or phrases at most
    ranked = [sorted(t.words, key=lambda w: (counts.get(w, 0), w)) for t in templates]
    prefix = [(w, k, p) for k, (t, ws) in enumerate(zip(templates, ranked, strict=True)) for p, w in enumerate(ws[: len(ws) - t.need(threshold) + 1])]
    lists = _values(spark, "word, template, place", [f"({_quoted(w)}, {k}, {p})" for w, k, p in prefix])
    facts = _values(spark, "template, label, words, need, run", [f"({k}, {_quoted(t.label)}, array({', '.join(map(_quoted, ws))}), {t.need(threshold)}, {t.run(slack)})" for k, (t, ws) in enumerate(zip(templates, ranked, strict=True))])
    reach = max(t.run(slack) for t in templates) - 1
    # Each place of a prefix word, with what is within reach of it.
    rare = sorted({w for w, _, _ in prefix})
    near = lambda j: F.slice("held", F.greatest(j + 1 - reach, F.lit(1)), reach + F.least(j, F.lit(reach)) + 1)
    places = F.filter(F.transform("held", lambda x, j: F.struct(x["word"].alias("word"), x["at"].alias("at"), j.alias("j"))), lambda x: x["word"].isin(rare))
    places = texts.select("row", "held", F.explode(places).alias("x")).select("row", "x.word", "x.at", near(F.col("x.j")).alias("near"))
    met = places.join(lists, "word").join(facts, "template")
    later = F.slice("words", F.col("place") + 1, F.size("words"))
    inside = F.filter("near", lambda x: (F.abs(x["at"] - F.col("at")) < F.col("run")) & F.array_contains(later, x["word"]))
    met = met.withColumn("inside", inside).where(F.size(F.array_distinct("inside.word")) >= F.col("need"))
    # A block that begins between the template's words holds no more than the one that begins at the next of them.
    begins = F.filter("inside.at", lambda a: a <= F.col("at"))
    held = lambda a: F.size(F.array_distinct(F.transform(F.filter("inside", lambda x: (x["at"] >= a) & (x["at"] < a + F.col("run"))), lambda x: x["word"])))
    best = met.select("row", "label", "need", F.size("words").alias("m"), F.array_max(F.transform(begins, held)).alias("best"))
    return best.where("best >= need").select("row", "label", (F.col("best") / F.col("m").cast("double")).alias("share"))


def _places(phrase: str) -> Column:
    """Where the phrase's words stand consecutively, in a text's known words."""
    words = phrase.split()

    def here(x):
        ok = x["word"] == words[0]
        for k, w in enumerate(words[1:], 1):
            after = F.get("held", x["j"] + k)
            ok = ok & F.coalesce((after["word"] == w) & (after["at"] == x["at"] + k), F.lit(False))
        return ok

    numbered = F.transform("held", lambda x, j: F.struct(x["word"].alias("word"), x["at"].alias("at"), j.alias("j")))
    return F.transform(F.filter(numbered, here), lambda x: x["at"])


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8, slack: float = 1.25, id_col: str = "doc_id", text_col: str = "text", most_words: int = 1_000_000) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The actions that it takes are the pass over the texts and the count of the known words.
    """
    if not 0 < threshold <= 1 or slack < 1:
        raise ValueError("threshold must be above 0 and at most 1, slack at least 1")
    spark = docs.sparkSession
    phrases = PHRASES if phrases is None else phrases
    made = template_list(TEMPLATES if templates is None else templates, most_words)
    known = sorted({w for t in made for w in t.words} | {w for p in phrases for w in p.split()})
    rows = written(known_words(docs, known, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "known")
    if made:
        hits = block_matches(spark, rows, made, threshold, slack).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("score"))
        rows = rows.join(hits, "row", "left")
    else:
        rows = rows.withColumns({"found": F.lit(None).cast("array<string>"), "score": F.lit(None).cast("double")})
    rows = rows.withColumns({f"at_{k}": _places(phrase) for k, phrase in enumerate(phrases)})
    none = F.array().cast("array<string>")
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())])) if phrases else none
    every = F.concat(F.array().cast("array<int>"), *[F.col(f"at_{k}") for k in range(len(phrases))])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce("found", none))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
