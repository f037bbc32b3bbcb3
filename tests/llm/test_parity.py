"""The Jaccard join of shingle sets against all pairs of them."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from spanforge.llm import parity

DOC = "doc_id long, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def brute(docs):
    sets = [(i, frozenset(shingles(t))) for i, t in docs]
    ids: dict = {}
    for i, s in sets:
        ids.setdefault(s, []).append(i)
    different = [s for s in ids if s]
    up = {s: s for s in different}

    def root(s):
        while up[s] is not s:
            s = up[s]
        return s

    for i, a in enumerate(different):
        for b in different[i + 1 :]:
            both = len(a & b)
            if 100 * both >= 85 * (len(a) + len(b) - both):
                up[root(a)] = root(b)
    least: dict = {}
    for s in different:
        own = [i for i in ids[s] if i is not None]
        r = root(s)
        least[r] = min([*own, *([least[r]] if least.get(r) is not None else [])], default=None)
    return sorted(((i, len(s), least[root(s)] if s else i) for i, s in sets), key=str)


def corpus(seed, families):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    text = lambda n: rng.choices(words, k=n)
    texts = []
    for size, members, edits in families:
        base = text(size)
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(len(own))] = rng.choice(words) + "x"
            texts.append(own)
    passage = text(60)
    texts += [text(rng.randrange(1, 60)) + passage + text(rng.randrange(1, 60)) for _ in range(40)]  # share much, link seldom
    texts += [text(rng.randrange(1, 12)) for _ in range(60)]
    chain = text(120)
    for k in range(12):  # each links with the next alone
        texts.append(chain[3 * k :] + text(3 * k))
    texts = [" ".join(t) for t in texts] + ["", None, " \t\n", "one", "ONE", "one two", "a b c d", "a b c D", "q " * 3000, "É é", "é É"]
    texts += [texts[0].upper(), texts[0].replace(" ", "\n\t ")]
    docs = [(k, t) for k, t in enumerate(texts)]
    rng.shuffle(docs)
    return [*docs, docs[0], docs[1], (None, texts[0]), (None, "alone here"), (None, None), (5, "other text of five")]


@pytest.mark.parametrize("most,families", [(4000, [(150, 30, 3), (300, 25, 12), (40, 20, 2), (2000, 6, 60)]), (12, [(150, 60, 7), (80, 50, 3), (30, 20, 1)])])
def test_similar_sets(spark, monkeypatch, most, families):
    monkeypatch.setattr(parity, "MOST", most)
    monkeypatch.setattr(parity, "HELD", 7)
    docs = corpus(most, families)
    frame = spark.createDataFrame(docs, DOC).repartition(5).withColumns({c: F.lit("x") for c in ("id", "n", "keys", "sketch", "t1", "d1", "root", "a", "b", "key", "_of", "of")})
    assert sorted(map(tuple, parity.similar_sets(frame).collect()), key=str) == brute(docs)


def test_empty(spark):
    none = spark.createDataFrame([], DOC)
    assert parity.similar_sets(none).count() == 0
    assert sorted(map(tuple, parity.similar_sets(spark.createDataFrame([(3, None), (2, ""), (None, "")], DOC)).collect()), key=str) == [(2, 0, 2), (3, 0, 3), (None, 0, None)]


def test_sets_that_link_share_a_key():
    """At the greatest difference that links, over sizes on both sides of a band's edge."""
    rng = np.random.default_rng(3)
    for n in [5, 6, 7, 8, 9, 13, 20, 54, 55, 63, 64, 65, 100, 109, 127, 128, 129, 300, 871, 900, 1023, 1024, 1200, 5000]:
        for m in sorted({n, min(n + 1, 100 * n // 85), (n + 100 * n // 85) // 2, 100 * n // 85}):
            for _ in range(20):
                both = -(-85 * (n + m) // 185)
                h = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64) * np.uint64(2)
                a, b = np.unique(h[:n]), np.unique(np.append(h[:both], h[n:]))
                assert parity.linked(a, b)
                assert parity.may_link(n, m, parity.sketch_of(a), parity.sketch_of(b))
                assert (a.tolist() == b.tolist()) or len(np.intersect1d(parity.keys_of(a), parity.keys_of(b)))


def test_sketches_bound_from_below():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        a, b = parity.mixed(a), parity.mixed(b)
        x, y = parity.sketch_of(a), parity.sketch_of(b)
        words = min(len(x), len(y))
        assert np.bitwise_count(parity.folded(x, words) ^ parity.folded(y, words)).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("rows", [3, 50_000])
def test_meeting_streams(rows, monkeypatch):
    """Small keys give all pairs, large ones a star and their rows, however the rows are dealt into batches."""
    import pyarrow as pa

    monkeypatch.setattr(parity, "ROWS", rows)
    rng = random.Random(rows)
    sizes = {k: rng.choice([1, 1, 2, 3, 7, 8, 9, 10, 30]) for k in range(60)}
    flat = [(k, 1000 * k + i) for k, n in sizes.items() for i in range(n)]
    parts = []
    while flat:
        n = rng.randrange(1, 6)
        parts.append(pa.RecordBatch.from_pylist([{"key": k, "id": i} for k, i in flat[:n]]))
        flat = flat[n:]
    got = [r for b in parity._meeting(iter(parts)) for r in b.to_pylist()]
    pairs = sorted((r["a"], r["b"]) for r in got if r["key"] is None)
    late = sorted((r["key"], r["a"]) for r in got if r["key"] is not None)
    ids = {k: [1000 * k + i for i in range(n)] for k, n in sizes.items()}
    want = [(a, b) for k, n in sizes.items() for i, a in enumerate(ids[k]) for b in ids[k][i + 1 :] if n <= parity.FEW or i == 0]
    assert pairs == sorted(want)
    assert late == sorted((k, i) for k, n in sizes.items() if n > parity.FEW for i in ids[k])
