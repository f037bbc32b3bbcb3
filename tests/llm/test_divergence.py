"""The source divergence audit against whole counts in Python's integers, and its tries."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from spanforge.llm import divergence, queries

from ..compare import connect, same

DOC = "doc_id long, text string, lang string, source string"


def brute(docs, least, best):
    per, df, groups = {}, Counter(), set()
    for _, text, lang, source in docs:
        key = (lang or "", source or "")
        groups.add(key)
        ts = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        per.setdefault(key, Counter()).update(ts)
        df.update((key[0], t) for t in set(ts))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for (k, t), n in df.items() if k == lang and n >= least), key=str.encode)
        sources = sorted(s for k, s in groups if k == lang)

        def p_of(c, kept=kept):
            whole = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // whole for t in kept}

        p = {s: p_of(per[lang, s]) for s in sources}
        q = p_of(sum((per[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[u][t]) for t in kept), u.encode()) for u in sources if u != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if per[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:best])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(rows)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abAé") for _ in range(rng.randrange(1, 7))) for _ in range(80)] + ["日本", "日本語", "Ünder", "under", "x" * 3000, "𝄞clef", "﻿mark"]
    docs = []
    for k in range(160):
        n = rng.randrange(0, 60)
        docs.append((k, "1, ".join(rng.choices(words, k=n)), rng.choice(["en", "en", "de", None]), rng.choice(["s", "t", "u", "é", "V", None])))
    docs += [(1, None, "en", "empty"), (2, "", "fr", "a"), (3, "-- 12", "fr", "b"), (4, "lone", "it", "only"), (None, words[0], "en", "s")] + docs[:6]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("settings", [{}, {"PREFIX": 1, "LEAVES": 20, "SLICE": 7, "BLOCK": 2, "HELD": 50, "TERMS": 40, "BEST": 4}])
def test_divergence(spark, monkeypatch, settings):
    for name, value in {"LEAST_DOCS": 5, **settings}.items():
        monkeypatch.setattr(divergence, name, value)
    docs = corpus(len(settings))
    clashing = spark.createDataFrame(docs, DOC).repartition(4).withColumns({c: F.lit("x") for c in ("term", "part", "item", "value", "rank", "slice", "k", "n", "v", "prefix", "a", "b")})
    got = sorted(map(tuple, divergence.divergence(clashing).collect()))
    assert got == brute(docs, 5, divergence.BEST)
    assert {r[2] for r in got} == {"pair", "term"}


def test_nothing_kept_and_empty(spark):
    docs = corpus(9)[:20]
    frame = spark.createDataFrame(docs, DOC)
    assert sorted(map(tuple, divergence.divergence(frame).collect())) == brute(docs, 30, 50)
    assert divergence.divergence(frame.limit(0)).count() == 0


def listed(trie):
    return [(t, {trie.sources[trie.source[i]]: (int(trie.count[i]), int(trie.docs[i])) for i in range(trie.begin[k], trie.begin[k + 1])}) for k, t in enumerate(trie.terms)]


def test_tries():
    rng = random.Random(4)
    want: dict = {}
    pieces = []
    for _ in range(3):
        terms = sorted({bytes(rng.choice(b"ab\xc3\xff") for _ in range(rng.randrange(1, 8))) for _ in range(400)}, key=lambda t: rng.random())
        entries = []
        for _ in range(2000):
            k, s, n = rng.randrange(len(terms)), rng.randrange(3), rng.randrange(1, 5)
            entries.append((k, s, n, 1))
            held = want.setdefault(terms[k], {}).setdefault("xyz"[s], [0, 0])
            held[0] += n
            held[1] += 1
        trie = divergence.Trie.of(list("xyz"), terms, np.array(entries, np.int64).T)
        assert listed(divergence.Trie.unpacked(trie.sources, trie.packed())) == listed(trie)
        cut = list(trie.cut(2))
        assert all(t.startswith(prefix) for prefix, p in cut for t in p.terms) and [x for _, p in cut for x in listed(p)] == listed(trie)
        pieces += [divergence.Trie.unpacked(p.sources, p.packed()) for _, p in cut]
    want = sorted((t, {s: tuple(c) for s, c in w.items()}) for t, w in want.items())
    assert listed(divergence.Trie.merged(pieces)) == want
    assert listed(divergence.Trie.merged(pieces, 12)) == [(t, w) for t, w in want if sum(d for _, d in w.values()) >= 12]
    assert listed(divergence.Trie.merged([])) == []
    big = divergence.Trie.of(["s", "t"], [b"ab", b"a"], np.array([[0, 0, 1 << 40, 3], [0, 1, 2, 2], [1, 0, 1, 1]]).T)
    assert listed(divergence.Trie.unpacked(big.sources, big.packed())) == [(b"a", {"s": (1, 1)}), (b"ab", {"s": (1 << 40, 3), "t": (2, 2)})]


def test_shares_are_exact():
    rng = np.random.default_rng(2)
    whole = rng.integers(1, 9 * 10**15, 300)
    counts = (rng.random(300) * whole).astype(np.int64)
    assert divergence.shares(counts, whole).tolist() == [1 + 10**9 * (c + 5) // w for c, w in zip(counts.tolist(), whole.tolist(), strict=True)]


def test_divergence_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(queries.QUERIES["op12_source_divergence"](spark, sf), connect(sf), queries.ORACLE_SQL["op12_source_divergence"])
