"""Source divergence audit: byte tries of terms with counters by source, merged by ranges of prefixes."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stage, trimmed, width
from .terms import LOWER, UPPER, table_of, terms_of

#: A term is kept in a language that has it in so many documents. Best terms of a group that are told.
LEAST_DOCS, BEST = 30, 50
#: Different terms of a language, and entries (document, term), that a task counts before it sends its tries.
TERMS, HELD = 400_000, 3_000_000
#: Bytes of a prefix whose terms merge together. A prefix with more leaves is cut at twice the length. Leaves of a row that
#: travels at most, so that ranges of as many rows are alike in bytes.
PREFIX, LEAVES, PIECE = 3, 200_000, 500
#: Terms that are compared at a time; sources of a language that are compared with each other at a time.
SLICE, BLOCK = 2000, 256
_TABLE = table_of(LOWER)
_PIECE = "lang string, prefix binary, leaves long, sources array<string>, blob binary"


@dataclass
class Trie:
    """A radix trie of byte strings, laid flat in the order of their bytes, which is that of UTF-8: a leaf is a term, and
    counters of its sources stand side by side. The path to a leaf is what it shares with the leaf before, and its tail.

    terms[i] has the counters begin[i] to begin[i + 1]: source (a place in sources), occurrences, documents.
    """

    sources: list[str]
    terms: list[bytes]
    begin: np.ndarray
    source: np.ndarray
    count: np.ndarray
    docs: np.ndarray

    @classmethod
    def of(cls, sources: list[str], terms: list[bytes], entries: np.ndarray, least: int = 1) -> Trie:
        """From entries (place in terms, place in sources, occurrences, documents) in any order, each as often as it comes;
        terms of fewer than `least` documents are left out."""
        key = entries[0] * len(sources) + entries[1]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        sums = [np.add.reduceat(x[order], first) if len(first) else x for x in entries[2:]]
        term, source = key[first] // max(1, len(sources)), key[first] % max(1, len(sources))
        whole = np.zeros(len(terms), np.int64)
        np.add.at(whole, term, sums[1])
        place = np.full(len(terms), -1)
        kept = sorted(np.flatnonzero(whole >= least).tolist(), key=terms.__getitem__)
        place[kept] = np.arange(len(kept))
        own = np.flatnonzero(place[term] >= 0)
        own = own[np.argsort(place[term[own]], kind="stable")]
        begin = np.append(0, np.cumsum(np.bincount(place[term[own]], minlength=len(kept)))).astype(np.int64)
        return cls(sources, [terms[k] for k in kept], begin, source[own], sums[0][own], sums[1][own])

    @classmethod
    def merged(cls, tries: Iterable[Trie], least: int = 1) -> Trie:
        """One trie of all; counters of one term and source add up."""
        terms: defaultdict = defaultdict(itertools.count().__next__)
        sources: defaultdict = defaultdict(itertools.count().__next__)
        parts = []
        for t in tries:
            at = np.array([terms[x] for x in t.terms], np.int64)
            of = np.array([sources[x] for x in t.sources], np.int64)
            parts.append(np.stack([np.repeat(at, np.diff(t.begin)), of[t.source], t.count, t.docs]))
        return cls.of(list(sources), list(terms), np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64), least)

    def cut(self, depth: int) -> Iterator[tuple[bytes, Trie]]:
        """Tries of terms that share their first depth bytes, of PIECE terms at most."""
        heads = [t[:depth] for t in self.terms]
        edges = [0, *(k for k in range(1, len(heads)) if heads[k] != heads[k - 1]), len(heads)] if heads else [0]
        edges = [k for a, b in itertools.pairwise(edges) for k in range(a, b, PIECE)] + edges[-1:]
        for a, b in itertools.pairwise(edges):
            i, j = self.begin[a], self.begin[b]
            named, source = np.unique(self.source[i:j], return_inverse=True)
            yield heads[a], Trie([self.sources[k] for k in named], self.terms[a:b], self.begin[a : b + 1] - i, source, self.count[i:j], self.docs[i:j])

    def packed(self) -> bytes:
        shared = [0]
        for a, b in itertools.pairwise(self.terms):
            n = 0
            for x, y in zip(a, b, strict=False):
                if x != y:
                    break
                n += 1
            shared.append(n)
        tails = [t[n:] for t, n in zip(self.terms, shared, strict=False)]
        ints = np.concatenate([[len(self.terms), len(self.source)], shared[: len(tails)], list(map(len, tails)), np.diff(self.begin), self.source, self.count, self.docs]).astype(np.int64)
        small = ints.astype("<u4") if ints.max() < 1 << 32 else ints.astype("<u8")
        return bytes([small.itemsize]) + small.tobytes() + b"".join(tails)

    @classmethod
    def unpacked(cls, sources: list[str], blob: bytes) -> Trie:
        n, m = (int(x) for x in np.frombuffer(blob, f"<u{blob[0]}", 2, 1))
        size = 2 + 3 * n + 3 * m
        ints = np.frombuffer(blob, f"<u{blob[0]}", size, 1).astype(np.int64)
        shared, tail, sizes, source, count, docs = np.split(ints[2:], np.cumsum([n, n, n, m, m]))
        terms, term, at = [], b"", 1 + size * blob[0]
        for k, t in zip(shared.tolist(), tail.tolist(), strict=True):
            term = term[:k] + blob[at : at + t]
            at += t
            terms.append(term)
        return cls(sources, terms, np.append(0, np.cumsum(sizes)), source, count, docs)


_ARROW = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("leaves", pa.int64()), ("sources", pa.list_(pa.string())), ("blob", pa.binary())])


def _sent(tries: Iterable[tuple[str, Trie]], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows of pieces of tries, cut by prefixes of depth bytes."""
    held, size = [], 0
    for lang, trie in tries:
        for prefix, piece in trie.cut(depth):
            blob = piece.packed()
            held.append({"lang": lang, "prefix": prefix, "leaves": len(piece.terms), "sources": piece.sources, "blob": blob})
            size += len(blob)
            if len(held) == 500 or size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


class _Counts:
    """Counts of the documents of one language in a task."""

    def __init__(self) -> None:
        self.terms: defaultdict = defaultdict(itertools.count().__next__)
        self.sources: defaultdict = defaultdict(itertools.count().__next__)
        self.at, self.of, self.n, self.held = [], [], [], 0

    def add(self, words: list[bytes], source: str) -> None:
        at, n = np.unique(np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words)), return_counts=True)
        self.at.append(at)
        self.n.append(n)
        self.of.append((self.sources[source], len(at)))
        self.held += len(at)

    def trie(self) -> Trie:
        of, sizes = np.array(self.of, np.int64).T
        at = np.concatenate(self.at)
        return Trie.of(list(self.sources), list(self.terms), np.stack([at, np.repeat(of, sizes), np.concatenate(self.n), np.ones(len(at), np.int64)]))


def _counted(docs: DataFrame) -> DataFrame:
    """Pieces of the tries that tasks count over their documents."""

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, _Counts] = {}
        held = 0

        def over() -> Iterator[pa.RecordBatch]:
            yield from _sent(((lang, c.trie()) for lang, c in counts.items()), PREFIX)
            counts.clear()

        for b in it:
            for text, lang, source in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                words = terms_of(text, _TABLE)
                if words:
                    c = counts.setdefault(lang, _Counts())
                    held -= c.held
                    c.add(words, source)
                    held += c.held
                    if held > HELD or len(c.terms) > TERMS:
                        yield from over()
                        held = 0
        yield from over()

    return stage(docs.mapInArrow(trimmed(pieces), _PIECE))


def _cut(pieces: DataFrame) -> DataFrame:
    """Pieces of prefixes with over LEAVES leaves are cut at longer ones, till a task can merge each prefix."""
    depth = PREFIX
    while True:
        full = pieces.groupBy("lang", "prefix").agg(F.sum("leaves").alias("n")).where((F.col("n") > LEAVES) & (F.octet_length("prefix") == depth))
        full = stage(full.select("lang", "prefix"))
        if full.isEmpty():
            return pieces
        depth *= 2

        def again(it: Iterator[pa.RecordBatch], depth=depth) -> Iterator[pa.RecordBatch]:
            for b in it:
                yield from _sent(((p["lang"], Trie.unpacked(p["sources"], p["blob"])) for p in b.to_pylist()), depth)

        on = ["lang", "prefix"]
        pieces = stage(pieces.join(full, on, "left_anti").unionByName(pieces.join(full, on, "left_semi").mapInArrow(trimmed(again), _PIECE)))


def _kept(pieces: DataFrame) -> DataFrame:
    """lang, term, slice, sources, counts of each kept term. Slices hold up to SLICE terms that follow each other."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("slice", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (p for b in it for p in b.to_pylist())
        out, slice_, n, before = [], TaskContext.get().partitionId() << 32, 0, None
        for (lang, _), own in itertools.groupby(rows, lambda p: (p["lang"], p["prefix"])):
            trie = Trie.merged((Trie.unpacked(p["sources"], p["blob"]) for p in own), LEAST_DOCS)
            if lang != before:
                before, slice_, n = lang, slice_ + 1, 0
            for k, term in enumerate(trie.terms):
                if n == SLICE:
                    slice_, n = slice_ + 1, 0
                n += 1
                i, j = trie.begin[k], trie.begin[k + 1]
                out.append({"lang": lang, "term": term.decode("utf-8", "replace"), "slice": slice_, "sources": [trie.sources[s] for s in trie.source[i:j]], "counts": trie.count[i:j].tolist()})
                if len(out) == 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    spread = pieces.repartitionByRange(width(pieces.sparkSession), "lang", "prefix").sortWithinPartitions("lang", "prefix")
    return stage(spread.mapInArrow(trimmed(merge), "lang string, term string, slice long, sources array<string>, counts array<long>"))


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (counts + 5) / whole), exact in 64 bits while whole is below 9 * 10^15: three digits at a time."""
    out, rest = np.divmod(counts + 5, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return out + 1


def _compared(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of each slice: with part 'pair' the summed differences of two sources over its terms, with
    'term' the BEST terms of a source. groups: lang, source, k (its place), n, whole_lang, v."""
    blocks = groups.groupBy("lang").agg((F.floor((F.max("k")) / BLOCK)).cast("int").alias("last"))
    grid = blocks.select("lang", F.explode(F.sequence(F.lit(0), "last")).alias("a"), "last").select("lang", "a", F.explode(F.sequence("a", "last")).alias("b"))
    slices = kept.select("lang", "slice").distinct().join(grid, "lang")
    block = F.floor(F.col("k") / BLOCK)
    heads = groups.join(slices, "lang").where((block == F.col("a")) | (block == F.col("b")))
    heads = heads.select("lang", "a", "b", "slice", F.lit("").alias("term"), F.lit(0).alias("role"), "source", "k", (F.col("n") + 5 * F.col("v")).alias("whole"), (F.col("n_lang") + 5 * F.col("v")).alias("whole_lang"), F.lit(None).cast("array<string>").alias("sources"), F.lit(None).cast("array<long>").alias("counts"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("k", "int"), ("whole", "long"), ("whole_lang", "long"))]
    leaves = kept.join(grid, "lang").select("lang", "a", "b", "slice", "term", F.lit(1).alias("role"), *none, "sources", "counts")
    keys = ["lang", "a", "b", "slice"]
    spread = heads.unionByName(leaves).repartition(width(kept.sparkSession), *keys).sortWithinPartitions(*keys, "role", "k", "term")
    schema = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in it for r in b.to_pylist())
        for (lang, a, b, _), own in itertools.groupby(rows, lambda r: (r["lang"], r["a"], r["b"], r["slice"])):
            heads, terms, at = [], [], []
            place: dict[str, int] = {}
            for r in own:
                if not r["role"]:
                    place[r["source"]] = len(heads)
                    heads.append(r)
                    continue
                hit = [(place[s], c) for s, c in zip(r["sources"], r["counts"], strict=True) if s in place]
                at += [(len(terms), k, c) for k, c in hit]
                terms.append((r["term"], sum(r["counts"])))
            counts = np.zeros((len(terms), len(heads)), np.int64)
            if at:
                row, col, n = np.array(at, np.int64).T
                counts[row, col] = n
            p = shares(counts, np.array([h["whole"] for h in heads], np.int64))
            q = shares(np.array([n for _, n in terms], np.int64), np.int64(heads[0]["whole_lang"]))
            block = np.array([h["k"] // BLOCK for h in heads])
            names = [h["source"] for h in heads]
            for i, name in enumerate(names):
                others = np.flatnonzero((block == (b if block[i] == a else a)) & (np.arange(len(names)) != i))
                value = np.abs(p[:, others] - p[:, [i]]).sum(0)
                out = [("pair", names[j], v) for j, v in zip(others.tolist(), value.tolist(), strict=True)]
                if a == b:
                    over = np.where(counts[:, i] > 0, p[:, i] - q, 0)
                    best = np.argsort(-over, kind="stable")[:BEST]  # terms ascend, so equal values keep their order
                    out += [("term", terms[t][0], int(over[t])) for t in best.tolist() if over[t] > 0]
                part, item, value = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(part, pa.string()), pa.array([name] * len(out), pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], schema=schema)

    return spread.mapInArrow(trimmed(compare), "lang string, part string, source string, item string, value long")


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of each language of docs (text, lang, source) differ.

    Part pair: every other source of the language, by the summed differences of the shares of all kept terms. Part term:
    the BEST terms that a source has more of than its language. Tasks count into byte tries by language, cut them by
    prefixes and send the pieces; a prefix merges in one task, of at most LEAVES leaves. Kept terms then stream in UTF-8
    order, SLICE at a time. Null text, lang or source reads as ''. Repeated rows count each; a source without terms,
    and a language without kept ones, still gives pairs, of value 0 in the latter; one source alone gives none; an
    empty table gives no rows; further columns are not read. The result grows with the square of a language's sources.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = _kept(_cut(_counted(docs)))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("n_lang"))
    of_group = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stage(docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "v", "n_lang"]).withColumn("k", place))
    found = stage(_compared(kept, groups))
    one = groups.where("v = 0")
    bare = one.select("lang", "source").join(one.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(bare)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    place = F.row_number().over(order)
    terms = found.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= BEST)  # tasks keep BEST before rows move
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank")).unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def oracle_sql() -> str:
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
    w AS (SELECT id, lang, source, unnest(ts) AS t FROM d),
    k AS (SELECT lang, t FROM w GROUP BY lang, t HAVING count(DISTINCT id) >= {LEAST_DOCS}),
    v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
    c AS (SELECT lang, source, t, count(*) AS n FROM w JOIN k USING (lang, t) GROUP BY lang, source, t),
    g AS (SELECT d.lang, d.source, any_value(coalesce(s.n, 0)) AS big_n FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s USING (lang, source) GROUP BY d.lang, d.source),
    p AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (big_n + 5 * v)::HUGEINT AS p
          FROM g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
    q AS (SELECT lang, t, 1 + (1000000000::HUGEINT * (n + 5)) // (big_n + 5 * v)::HUGEINT AS q FROM (SELECT lang, t, sum(n) AS n FROM c GROUP BY lang, t)
          JOIN (SELECT lang, sum(n) AS big_n FROM c GROUP BY lang) USING (lang) JOIN v USING (lang)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN (SELECT i.lang, i.source, j.source AS item, sum(abs(i.p - j.p)) AS value FROM p i JOIN p j ON i.lang = j.lang AND i.t = j.t AND i.source <> j.source GROUP BY ALL) x
              ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
    terms AS (SELECT p.lang, p.source, p.t AS item, p - q AS value FROM p JOIN q ON p.lang = q.lang AND p.t = q.t WHERE n > 0 AND p > q)
    SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
    UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms) WHERE rank <= {BEST}"""
