"""Ranked lexical search: a hierarchical max tree over document ranges for each term, searched best first."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stage, trimmed
from .terms import LOWER, UPPER, table_of, terms_of

#: Characters of benchmark items that are searched in one pass over the documents; a larger benchmark takes more passes.
MAX_CHARS = 4_000_000
#: Documents of a leaf, children of a node, documents and postings of one forest of trees.
LEAF, FAN, SHARD, POSTINGS = 32, 8, 1 << 14, 3_000_000
BEST = 10
_TABLE = table_of(LOWER + "0123456789")
_ROWS = "doc_id long, n long, terms array<int>, counts array<long>, docs long, words long"


def _items(benchmark: DataFrame) -> Iterator[dict[int, set[bytes]]]:
    """Terms of each item, for parts of the benchmark of a bounded size."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    passes = max(1, -(-(items.agg(F.sum(F.char_length("text"))).first()[0] or 0) // MAX_CHARS))
    for k in range(passes):
        out: dict[int, set[bytes]] = {}
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).toLocalIterator():
            out.setdefault(r["item_id"], set()).update(terms_of(r["text"], _TABLE))
        yield {i: t for i, t in out.items() if t}


def _counted(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """A row for each document that holds one of the numbered terms: its length and its counts of them. And one row of
    each task with n null: in how many of its documents each term is, documents with a term, and terms of them all."""
    held = docs.sparkSession.sparkContext.broadcast(number)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, frequency, n_docs, n_words = held.value.get, Counter(), 0, 0
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("docs", pa.int64()), ("words", pa.int64())])
        for b in it:
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = terms_of(text, _TABLE)
                n_docs += bool(words)
                n_words += len(words)
                got = Counter(map(find, words))
                got.pop(None, None)
                if got:
                    frequency.update(got.keys())
                    ids.append(doc_id)
                    sizes.append(len(words))
                    terms.append(list(got))
                    counts.append(list(got.values()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, sizes, terms, counts, [None] * len(ids), [None] * len(ids)), schema.types, strict=True)], schema=schema)
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, list(frequency), list(frequency.values()), n_docs, n_words), schema.types, strict=True)], schema=schema)

    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(count), _ROWS))


class Forest:
    """Max trees of the terms of some documents, which are in ascending order of doc_id, null last.

    A tree's leaves are ranges of LEAF documents, its inner nodes ranges of FAN nodes; a node holds the greatest score
    that its term has in its range. Nodes without the term aren't stored.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, score: np.ndarray, n: int):
        self.n, self.levels = n, []
        order = np.argsort(doc, kind="stable")
        self.doc, self.term, self.score = doc[order], term[order], score[order]
        self.at = np.searchsorted(self.doc, np.arange(n + 1))
        width, node = -(-n // LEAF), doc // LEAF
        while True:
            key = term.astype(np.int64) * width + node
            order = np.argsort(key, kind="stable")
            key, score = key[order], score[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            term, node, score = key[first] // width, key[first] % width, np.maximum.reduceat(score, first) if len(key) else score
            self.levels.append((width, term, node, score))
            if width == 1:
                break
            width, node = -(-width // FAN), node // FAN

    def bounds(self, terms: np.ndarray) -> list[np.ndarray]:
        """For each level the summed greatest scores of the terms (ascending) by node."""
        out = []
        for width, term, node, score in self.levels:
            a, b = np.searchsorted(term, terms), np.searchsorted(term, terms, "right")
            at = np.repeat(a - np.append(0, np.cumsum(b - a)[:-1]), b - a) + np.arange((b - a).sum())
            total = np.zeros(width, np.int64)
            np.add.at(total, node[at], score[at])
            out.append(total)
        return out

    def best(self, terms: np.ndarray, mine: np.ndarray, ids: list, found: list) -> list:
        """The BEST least (-score, without id, id) of found and of the documents that score above 0. mine: marks terms.

        Nodes are opened by falling bound. Those whose bound is the last score kept are opened too, as an equal score
        counts if its id is smaller, unless all ids of the range are greater.
        """
        bounds = self.bounds(terms)
        heap = [(-int(bounds[-1][0]), len(bounds) - 1, 0)] if self.n and bounds[-1][0] > 0 else []
        while heap:
            bound, level, node = heapq.heappop(heap)
            if len(found) == BEST:
                if -bound < -found[-1][0]:
                    break
                first = ids[min(node * LEAF * FAN**level, self.n - 1)]
                if (bound, first is None, first or 0) > found[-1]:
                    continue
            if level:
                for k in range(node * FAN, min((node + 1) * FAN, len(bounds[level - 1]))):
                    if bounds[level - 1][k] > 0:
                        heapq.heappush(heap, (-int(bounds[level - 1][k]), level - 1, k))
                continue
            low, high = node * LEAF, min((node + 1) * LEAF, self.n)
            a, b = self.at[low], self.at[high]
            own = np.flatnonzero(mine[self.term[a:b]]) + a
            total = np.zeros(high - low, np.int64)
            np.add.at(total, self.doc[own] - low, self.score[own])
            rows = [(-s, ids[low + k] is None, ids[low + k] or 0) for k, s in enumerate(total.tolist()) if s > 0]
            found = heapq.nsmallest(BEST, [*found, *rows])
        return found


def _searched(counted: DataFrame, items: dict[int, np.ndarray], weight: np.ndarray, n_docs: int, n_words: int) -> DataFrame:
    """The best documents of each task for each item."""
    held = counted.sparkSession.sparkContext.broadcast((items, weight))

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = held.value
        found: dict[int, list] = {}
        mine = np.zeros(len(weight), bool)

        def over(rows: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(rows).sort_by("doc_id").combine_chunks()
            ids, lengths = t.column("doc_id").to_pylist(), t.column("n").to_pylist()
            norm = np.array([8 * (10 + 90 * n * n_docs // n_words) for n in lengths], np.int64)
            terms = t.column("terms").combine_chunks()
            term, count = terms.flatten().to_numpy().astype(np.int64), t.column("counts").combine_chunks().flatten().to_numpy()
            doc = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
            forest = Forest(doc, term, weight[term] * (1_000_000_000 * count // (1000 * count + norm[doc])), len(ids))
            for item, own in items.items():
                mine[own] = True
                found[item] = forest.best(own, mine, ids, found.get(item, []))
                mine[own] = False

        rows, n, size = [], 0, 0
        for b in it:
            for k in range(0, b.num_rows, LEAF):
                part = b.slice(k, LEAF)
                more = len(part.column("terms").flatten())
                if rows and (n + part.num_rows > SHARD or size + more > POSTINGS):
                    over(rows)
                    rows, n, size = [], 0, 0
                rows.append(part)
                n, size = n + part.num_rows, size + more
        if rows:
            over(rows)
        out = [(item, None if none else i, -s) for item, best in found.items() for s, none, i in best]
        cols = list(zip(*out, strict=True)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["item_id", "doc_id", "score"])

    return counted.where("n is not null").select("doc_id", "n", "terms", "counts").mapInArrow(trimmed(search), "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the ten best rows of docs (doc_id, text) for each item of benchmark (item_id, text).

    A first pass counts the items' terms in each document, in how many documents each is, and the lengths of all; a
    second one builds trees over shards of documents and searches them for all items. No document moves: tasks send
    the best ten of each item. Items without id or text, or without a term, give no rows; rows of one item_id are one
    item. Null and empty texts hold no term. Documents of an equal score rank by doc_id, null last; repeated rows rank
    each. Further columns are not read; an empty table on either side gives no rows. What is broadcast (terms of items)
    is bounded by MAX_CHARS.
    """
    spark = docs.sparkSession
    prepare(spark)
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for terms in _items(benchmark):
        number = {t: k for k, t in enumerate(sorted(set().union(*terms.values())))}
        counted = _counted(docs, number)
        tasks = counted.where("n is null")
        n_docs, n_words = tasks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        if not n_docs:
            continue
        each = tasks.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
        weight = np.zeros(len(number), np.int64)
        for t, df in each.toLocalIterator():  # one row for each term of the items
            weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        items = {i: np.array(sorted(number[t] for t in ts), np.int64) for i, ts in terms.items()}
        out = out.unionByName(_searched(counted, items, weight, n_docs, n_words))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST).select("item_id", "rank", "doc_id", "score")


def oracle_sql() -> str:
    """The same by joining all terms of all documents with those of the items."""
    terms = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
    WITH d AS (SELECT doc_id, {terms} AS ts FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, len(ts)::BIGINT AS n, ts FROM d WHERE len(ts) > 0),
    s AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM c),
    q AS (SELECT DISTINCT item_id, unnest({terms}) AS t FROM benchmark WHERE text IS NOT NULL),
    p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM c) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
    w AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM p GROUP BY t), s),
    r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
          FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY item_id, doc_id)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM
    (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= {BEST}"""
