"""Nearest neighbours by cosine: lists, score-aware 4-bit product codes, table scans, exact reranking of all that bounds leave."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stage, trimmed, width

#: Vectors that centroids and codebooks are fitted on at most; every vector is indexed.
MAX_SAMPLE = 20_000
MAX_LISTS = 1024
#: Numbers of the sample that queries are held against first, for a floor under their results.
FLOOR_NUMBERS = 2_000_000
#: Dimensions of a subspace and codes of its book (4 bits).
SUB, CODES = 2, 16
#: Cosine from which errors along a vector are made to matter more than errors across it.
AIM = 0.3
#: Vectors of one scan, and how many of them, best by their codes, are scored exactly before bounds decide on the rest.
CHUNK, RERANKED = 8192, 100
#: More than single precision adds to a score of codes or to a bound.
ROUNDING = 1e-5


@dataclass
class Index:
    """What the sample gives: of a bounded size, so tasks get it with their code."""

    dim: int
    centroids: np.ndarray
    books: np.ndarray
    weight: float

    def lists(self, unit: np.ndarray) -> np.ndarray:
        return np.argmax(unit @ self.centroids.T, axis=1)

    def encode(self, unit: np.ndarray, lists: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes that lessen |r|^2 + (weight - 1) (r . x)^2 of the error r of each x, one subspace after another."""
        return _assign(_split(unit), _split(self.centroids[lists]), self.books, self.weight, rounds)

    def errors(self, unit: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each vector is from what its list and codes say: no score of codes is off by more."""
        said = self.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)[:, : unit.shape[1]]
        return np.linalg.norm(unit - self.centroids[lists] - said, axis=1)


def _split(x: np.ndarray) -> np.ndarray:
    short = -x.shape[1] % SUB
    return np.pad(x, ((0, 0), (0, short))).reshape(len(x), -1, SUB)


def _assign(x: np.ndarray, base: np.ndarray, books: np.ndarray, weight: float, rounds: int) -> np.ndarray:
    n, m, _ = x.shape
    goal = x - base
    codes = np.stack([np.argmin(((goal[:, j, None] - books[j]) ** 2).sum(2), axis=1) for j in range(m)], 1)
    along = np.stack([((goal[:, j] - books[j][codes[:, j]]) * x[:, j]).sum(1) for j in range(m)], 1)
    for _ in range(rounds):
        for j in range(m):
            errors = goal[:, j, None] - books[j]
            own = (errors * x[:, j, None]).sum(2)
            rest = along.sum(1) - along[:, j]
            codes[:, j] = np.argmin((errors**2).sum(2) + (weight - 1) * (rest[:, None] + own) ** 2, axis=1)
            along[:, j] = own[np.arange(n), codes[:, j]]
    return codes.astype(np.uint8)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, spherical: bool, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T - (0 if spherical else (c**2).sum(1) / 2), axis=1)
        sums, n = np.zeros_like(c), np.bincount(at, minlength=k)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def train(unit: np.ndarray, total: int, rounds: int = 4) -> Index:
    """Centroids and score-aware codebooks from unit vectors: codes and books are improved in turn."""
    rng = np.random.default_rng(5)
    dim = unit.shape[1]
    k = int(np.clip(np.sqrt(total), 1, min(MAX_LISTS, max(1, len(unit) // 16))))
    centroids = _means(unit, k, rng, True)
    weight = max(1.0, (dim - 1) * AIM**2 / (1 - AIM**2))
    x, base = _split(unit), _split(centroids[np.argmax(unit @ centroids.T, axis=1)])
    goal = x - base
    books = np.stack([_means(goal[:, j], CODES, rng, False) for j in range(x.shape[1])])
    for _ in range(rounds):
        codes = _assign(x, base, books, weight, 1)
        along = np.stack([((goal[:, j] - books[j][codes[:, j]]) * x[:, j]).sum(1) for j in range(x.shape[1])], 1)
        for j in range(x.shape[1]):
            rest = along.sum(1) - along[:, j]
            pull = goal[:, j] + (weight - 1) * x[:, j] * (rest + (goal[:, j] * x[:, j]).sum(1))[:, None]
            push = np.eye(SUB) + (weight - 1) * x[:, j, :, None] * x[:, j, None, :]
            for c in range(CODES):
                own = codes[:, j] == c
                if own.any():
                    books[j, c] = np.linalg.solve(push[own].sum(0), pull[own].sum(0))
            along[:, j] = ((goal[:, j] - books[j][codes[:, j]]) * x[:, j]).sum(1)
    return Index(dim, centroids, books, weight)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of q to each row of x in doubles, summed alike for every row, so equal vectors score the same."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def scan(index: Index, lists: np.ndarray, codes: np.ndarray, q: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Approximate scores of queries to vectors (their lists and codes), from one table of 16 entries per subspace and
    query; minus infinity where a query doesn't look into a vector's list (wanted: queries x lists)."""
    unit = _unit(q)
    tables = np.einsum("qmd,mkd->qmk", _split(unit), index.books).astype(np.float32)
    out = (unit @ index.centroids.T).astype(np.float32)[:, lists]
    for j in range(codes.shape[1]):
        out += tables[:, j][:, codes[:, j]]
    out[~wanted[:, lists]] = -np.inf
    return out


def blocks_of(counts: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(first block, blocks) of each list: small lists share a block of up to `size` vectors, larger ones are cut into
    blocks of their own."""
    first, parts, n, held = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // size)), 0, 0
    for k, c in enumerate(counts.tolist()):
        if held and (held + c > size):
            n, held = n + 1, 0
        first[k] = n
        held += c
        if c > size:
            n, held = n + int(parts[k]), 0
    return first, parts


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """Rows that take part: a vec_id, and a vector without nulls or non-finite components that isn't zero."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    Rows that agree in their vector are one entry of the index, standing for its k + 1 smallest vec_ids: no other of
    them can be among the k nearest. Equal queries are searched once. Lists are cut into blocks of a bounded size, so
    a list with a third of all vectors is scanned by many tasks; a vector goes to its block once, and the queries that look
    into a block stream past it. Nothing near is missed: a query leaves out a list only if no vector at the list's greatest
    angle could reach the floor that the sample gives, and a vector only if its score by codes and their error can't
    reach the k + 1 best found, so all others are scored exactly. Components may be of any numeric type. Rows of another length than most in the sample take
    no part, like those without a vec_id, null, zero or with null or non-finite components. A vec_id that repeats is
    one candidate for each different vector; a query never finds its own vec_id, but other vectors of that id take places
    among the k + 1 looked for, so it may find fewer. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = valid_vectors(vectors)
    kind = rows.schema["embedding"].dataType.simpleString()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MAX_SAMPLE).select("embedding").toPandas()["embedding"]
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(sample.map(len).mode().max())
    unit = _unit(np.stack([np.asarray(x, np.float64) for x in sample if len(x) == dim]))
    rows = rows.where(F.size("embedding") == dim)
    index = train(unit, rows.count())
    lists = len(index.centroids)

    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")

    def coded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                u = _unit(_matrix(b.column("embedding")))
                at = index.lists(u)
                codes = index.encode(u, at)
                near, off = (u * index.centroids[at]).sum(1), index.errors(u, at, codes)
                packed = [c.tobytes() for c in codes[:, ::2] | np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))[:, 1::2] << 4]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column("vec_id"), pa.array(packed, pa.binary()), pa.array(off), pa.array(near), b.column("embedding")], names=["list", "vec_id", "codes", "bound", "near", "embedding"])

    entries = stage(few.mapInArrow(coded, f"list int, vec_id long, codes binary, bound double, near double, embedding {kind}"))
    counts, widest = np.zeros(lists, np.int64), np.zeros(lists)  # two numbers per list, of which there are MAX_LISTS at most
    for r in entries.groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect():
        counts[r["list"]], widest[r["list"]] = r["n"], np.arccos(np.clip(r["near"], -1, 1))
    first, parts = blocks_of(counts)

    asked = rows.where(F.col("vec_id") % every == 0)
    known = unit[: max(k + 1, FLOOR_NUMBERS // dim)].astype(np.float32)

    def probed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block that a query looks into, with the lists it looks into there and the least score it needs."""
        for b in it:
            if not b.num_rows:
                continue
            q = _unit(_matrix(b.column("embedding")))
            floor = np.partition(q.astype(np.float32) @ known.T, -k - 1, axis=1)[:, -k - 1] - ROUNDING if len(known) > k else np.full(len(q), -1.0)
            reach = np.cos(np.maximum(0, np.arccos(np.clip(q @ index.centroids.T, -1, 1)) - widest))
            row, own = np.nonzero((reach >= floor[:, None] - ROUNDING) & (counts > 0))
            n = parts[own]
            row, own, block = np.repeat(row, n), np.repeat(own, n), np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            sort = np.lexsort((own, block, row))
            row, own, block = row[sort], own[sort], block[sort]
            new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])))
            looked = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(own.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(block[new].astype(np.int32)), b.column("query").take(pa.array(row[new])), b.column("embedding").take(pa.array(row[new])), looked, pa.array(floor[row[new]].astype(np.float64))], names=["block", "query", "embedding", "lists", "bound"])

    different = stage(asked.groupBy("embedding").agg(F.min("vec_id").alias("query")))
    wanted = different.mapInArrow(probed, f"block int, query long, embedding {kind}, lists array<int>, bound double")
    first_, parts_ = (F.array(*(F.lit(int(x)) for x in xs)) for xs in (first, parts))
    place = F.col("list") + 1
    block = F.element_at(first_, place) + F.pmod(F.xxhash64("vec_id"), F.element_at(parts_, place)).cast("int")
    left = entries.select(block.alias("block"), F.lit(0).alias("role"), "list", "vec_id", "codes", "bound", "embedding", F.lit(None).cast("array<int>").alias("lists"))
    right = wanted.select("block", F.lit(1).alias("role"), F.lit(None).cast("int").alias("list"), F.col("query").alias("vec_id"), F.lit(None).cast("binary").alias("codes"), "bound", "embedding", "lists")

    def searched(block: tuple, queries: pa.RecordBatch) -> pa.RecordBatch:
        ids, x, own, at, codes, off = block
        out: dict[str, list] = {"query": [], "vec_id": [], "score": []}
        q, looked, floors = _matrix(queries.column("embedding")), queries.column("lists").to_pylist(), queries.column("bound").to_numpy()
        for k0 in range(0, len(q), 128):
            part, looks = q[k0 : k0 + 128], np.zeros((len(q[k0 : k0 + 128]), lists), bool)
            for i, ls in enumerate(looked[k0 : k0 + 128]):
                looks[i, ls] = True
            near = scan(index, at, codes, part, looks)
            tops = np.argpartition(-near, RERANKED - 1, axis=1)[:, :RERANKED] if len(ids) > RERANKED else np.tile(np.arange(len(ids)), (len(part), 1))
            for one, unit, query, top, score, floor in zip(part, _unit(part), queries.column("vec_id")[k0 : k0 + 128].to_pylist(), tops, near, floors[k0 : k0 + 128], strict=True):
                first = own[top[score[top] > -np.inf]] @ unit
                if len(first) > k:
                    floor = max(floor, np.partition(first, -k - 1)[-k - 1])
                top = np.flatnonzero(score + off >= floor - ROUNDING)
                top = top[own[top] @ unit >= floor - ROUNDING]
                score = cosines(one, x[top])
                best = np.lexsort((ids[top], -score))[: k + 1]
                out["query"] += [query] * len(best)
                out["vec_id"] += ids[top][best].tolist()
                out["score"] += score[best].tolist()
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Holds the vectors of a block, which come first, and streams its queries past them."""
        now, held, ready = None, [], None
        for b in it:
            if not b.num_rows:
                continue
            side = b.column("block").to_numpy().astype(np.int64) * 2 + b.column("role").to_numpy()
            for part in (b.slice(i, j - i) for i, j in itertools.pairwise([0, *(np.flatnonzero(np.diff(side)) + 1).tolist(), len(side)])):
                if part.column("block")[0].as_py() != now:
                    now, held, ready = part.column("block")[0].as_py(), [], None
                if part.column("role")[0].as_py() == 0:
                    held.append(part)
                elif held:
                    if ready is None:
                        own = pa.Table.from_batches(held)
                        packed = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8).reshape(own.num_rows, -1)
                        codes = np.stack([packed & 15, packed >> 4], 2).reshape(own.num_rows, -1)[:, : len(index.books)]
                        x = _matrix(own.column("embedding").combine_chunks())
                        ready = own.column("vec_id").to_numpy(), x, _unit(x), own.column("list").to_numpy(), codes, own.column("bound").to_numpy()
                    yield searched(ready, part)

    met = left.unionByName(right).repartition(width(spark), "block").sortWithinPartitions("block", "role", "list", "vec_id")
    found = met.mapInArrow(trimmed(search), "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).groupBy("query").agg(F.collect_list(F.struct("n", "vec_id", "score")).alias("top"))
    answers = different.join(top, "query").select("embedding", "top")
    each = asked.join(answers, "embedding").select(F.col("vec_id").alias("query_id"), F.slice(F.filter(F.array_sort("top"), lambda t: t["vec_id"] != F.col("vec_id")), 1, k).alias("top"))
    return each.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).alias("rank"), "t.vec_id", "t.score")
