"""Cases in which an operator did less than its whole job."""

import math
import zlib
from collections import Counter

import pytest
from test_cases import docs
from test_llm_queries import WORD, low, texts

from lagline.llm import license_scan
from lagline.llm.queries import QUERIES


def test_op10_counts_and_looks_up_trigrams(spark, duck, sf_dir):
    tokens = {i: [*WORD.findall(low(t)), None] for i, t in texts(duck).items()}
    grams = [Counter() for _ in range(4)]
    begun = lambda t: [None, *t]  # noqa: E731  the end stands before a document's first token
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            grams[1].update((w,) for w in t)
            for k in (2, 3):
                grams[k].update(tuple(begun(t)[j : j + k]) for j in range(len(t) - k + 2))
    n, v, mu = sum(grams[1].values()), len(grams[1]), 4.0
    for r in QUERIES["op10_lm_score"](spark, sf_dir).collect():
        t, full = begun(tokens[r["doc_id"]]), 0.0
        for j in range(1, len(t)):
            p = (grams[1][t[j],] + 1) / (n + v + 1)
            for k in range(2, min(3, j + 1) + 1):
                seen = grams[k - 1][tuple(t[j - k + 1 : j])]
                p = (grams[k][tuple(t[j - k + 1 : j + 1])] + mu * p) / (seen + mu) if seen else p
            full += math.log10(p)
        assert r["score"] == pytest.approx(full, abs=0.02 * len(t) + 1e-6)


def test_license_notices_wrapped_over_lines(spark):
    mit = " * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal"
    gpl = "# You can redistribute it and/or modify\n# it under the terms of the GNU\n# General Public License as published"
    bsd = "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions\r\nare met:"
    far = "permission is hereby granted free of charge\n" + "other words \n" * 30 + "to any person obtaining a copy of this software and associated documentation files"
    rows = [(1, mit, "a"), (2, gpl, "a"), (3, bsd, "a"), (4, far, "a"), (5, "all\nrights\nreserved", "a"), (6, "all\nrights", "a"), (7, None, "a")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got[1] == ("mit-grant", 1.0) and got[3] == ("bsd-notice", 1.0) and got[5] == ("reserved", 1.0)
    assert got[2] == ("gpl,gpl-notice", 1.0)
    assert got[4] == ("", 0.0) and got[6] == ("", 0.0) and got[7] == ("", 0.0)
