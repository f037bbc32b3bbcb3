"""Ranked search against scores worked out document by document."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from spanforge.llm import lexical, queries

from ..compare import connect, same

DOC, ITEM = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        rows = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                rows.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(rows)[:10])]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé0") for _ in range(rng.randrange(1, 4))) for _ in range(60)] + ["Straße", "日本", "İx", "K"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(n)]
    docs = [(rng.randrange(3 * n), t) for t in texts] + [(k, texts[0]) for k in range(50)] + [(None, texts[0]), (None, "abc"), (7, None), (8, ""), (9, " -- "), (10, "b " * 4000)]
    docs += docs[:5]
    rng.shuffle(docs)
    return docs, [(k, texts[k]) for k in range(8)] + [(3, "STRASSE Straße, 日本!"), (20, None), (None, "a"), (21, "..."), (22, "nowhere0000")]


@pytest.mark.parametrize("leaf,shard", [(2, 40), (lexical.LEAF, lexical.SHARD)])
def test_ranked(spark, monkeypatch, leaf, shard):
    monkeypatch.setattr(lexical, "LEAF", leaf)
    monkeypatch.setattr(lexical, "SHARD", shard)
    docs, items = corpus(leaf, 400)
    d = spark.createDataFrame(docs, DOC).repartition(3).withColumns({c: F.lit("x") for c in ("n", "terms", "score", "rank", "item_id", "docs")})
    q = spark.createDataFrame(items, ITEM).withColumns({c: F.lit("x") for c in ("doc_id", "score")})
    assert sorted(map(tuple, lexical.ranked(d, q).collect()), key=str) == brute(docs, items)


def test_ranked_passes_and_empty(spark, monkeypatch):
    docs, items = corpus(5, 60)
    d, q = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    monkeypatch.setattr(lexical, "MAX_CHARS", 300)
    assert sorted(map(tuple, lexical.ranked(d, q).collect()), key=str) == brute(docs, items)
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.where("text is null"), q)):
        assert lexical.ranked(a, b).count() == 0


def test_trees_open_few_leaves(monkeypatch):
    """Branch and bound leaves most ranges closed where one document stands out."""
    import numpy as np

    n = 20_000
    rng = np.random.default_rng(1)
    doc, term = np.repeat(np.arange(n), 3), rng.integers(0, 50, 3 * n)
    score = rng.integers(1, 100, 3 * n)
    score[:60] += 10_000
    f = lexical.Forest(doc, term, score, n)
    opened = []
    real = lexical.np.flatnonzero
    monkeypatch.setattr(lexical.np, "flatnonzero", lambda x: opened.append(1) or real(x))
    mine = np.zeros(50, bool)
    mine[:] = True
    best = f.best(np.arange(50), mine, list(range(n)), [])
    totals = np.bincount(doc, score, n).astype(int)
    assert best == sorted((-int(s), False, i) for i, s in enumerate(totals))[:10]
    assert len(opened) < 10


def test_ranked_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(queries.QUERIES["op13_ranked_search"](spark, sf), connect(sf), queries.ORACLE_SQL["op13_ranked_search"])
