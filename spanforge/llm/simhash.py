"""SimHash near-duplicates: fingerprints, keys from a Golay code over their segments, exact links, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage, texts_of, trimmed, width
from .graph import components, forest
from .spans import identity

WORDS, SEED, BITS = 4, 42, 4
#: Places of the three segments of a fingerprint: lowest bit and number of bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator of the binary (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Groups up to this are compared all at once; larger ones row by row.
SMALL = 16
#: Larger groups of one key are dealt over tasks by pairs of blocks of this size.
MOST = 20_000


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """64-bit fingerprints: a bit is set where it is set in over half of the shingles' hashes; without words, 0."""
    hashes: list[int] = []
    sizes = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1 if words else np.zeros(0, int)
        starts = np.concatenate([[0], ends + 1])[: len(words)]
        ends = ends[WORDS - 1 :] if len(words) >= WORDS else ends[-1:]
        hashes += [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)]
        sizes.append(len(ends))
    out, size = np.zeros(len(texts), np.uint64), np.array(sizes)
    own = np.flatnonzero(size)
    if len(own):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.concatenate([[0], np.cumsum(size[own])[:-1]])
        counts = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        out[own] = np.packbits(counts * 2 > size[own][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _remainder(v: int) -> int:
    for k in range(22, 10, -1):
        if v >> k & 1:
            v ^= GENERATOR << (k - 11)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders by byte, and the error of at most 3 bits that belongs to each remainder: the code is perfect."""
    remainders = np.array([[_remainder((b << 8 * k) & 0x7FFFFF) for b in range(256)] for k in range(3)], np.uint32)
    errors = np.zeros(2048, np.uint32)
    ones = [1 << k for k in range(23)]
    for i in range(23):
        for j in range(i + 1):
            for k in range(j + 1):
                e = ones[i] | ones[j] | ones[k]
                errors[_remainder(e)] = e
    return remainders, errors


_REMAINDERS, _ERRORS = _tables()


def nearest_codeword(v: np.ndarray) -> np.ndarray:
    """12-bit indices of the codewords nearest to 23-bit words."""
    s = _REMAINDERS[0][v & 255] ^ _REMAINDERS[1][v >> 8 & 255] ^ _REMAINDERS[2][v >> 16]
    return (v ^ _ERRORS[s]) >> 11


def near_indices(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the codewords of v and of all words at one bit. Two words at two bits or less have a word within
    one bit of both, so they share an index; each has six different ones at most."""
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    got = np.sort(nearest_codeword(v[:, None] ^ flips), axis=1)
    new = np.ones(got.shape, bool)
    new[:, 1:] = got[:, 1:] != got[:, :-1]
    rows, cols = np.nonzero(new)
    return rows, got[rows, cols]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): two fingerprints that differ in 4 bits or less share a key.

    Either a segment agrees, and then another one differs in 2 bits or less: keys of the first's bits and an index of
    the second. Or all differ, two of them in one bit, so one half of each of these agrees, and the third in 2 bits
    or less: keys of two halves and an index of the third.
    """
    parts = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]
    near = [near_indices(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    halves = [(p & 0x7FF, p >> 11) for p in parts]
    rows, keys, tag = [], [], 0
    for x in range(3):
        for y in {0, 1, 2} - {x}:
            r, index = near[y]
            rows.append(r)
            keys.append(np.uint64(tag) << np.uint64(40) | parts[x][r].astype(np.uint64) << np.uint64(12) | index.astype(np.uint64))
            tag += 1
    for x in range(3):
        r, index = near[x]
        p, q = sorted({0, 1, 2} - {x})
        for i in range(2):
            for j in range(2):
                rows.append(r)
                both = halves[p][i][r].astype(np.uint64) << np.uint64(11) | halves[q][j][r].astype(np.uint64)
                keys.append(np.uint64(tag) << np.uint64(40) | both << np.uint64(12) | index.astype(np.uint64))
                tag += 1
    return np.concatenate(rows), np.concatenate(keys)


def links_in(keys: np.ndarray, fp: np.ndarray, most: int | None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links among the fingerprints of each key, thinned to a forest; and the rows of keys with over `most` rows."""
    order = np.lexsort((fp, keys))
    keys, fp = keys[order], fp[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(keys)))
    size = np.repeat(sizes, sizes)
    pairs, late = [], np.zeros(0, int)
    own = np.flatnonzero((size > 1) & (size <= SMALL))
    k, f = keys[own], fp[own]
    for d in range(1, SMALL):
        hit = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= BITS)) if len(k) > d else []
        if len(hit):
            pairs.append(np.stack([f[hit], f[hit + d]], 1))
    for at, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        if most and n > most:
            late = np.append(late, order[at : at + n])
            continue
        f = np.unique(fp[at : at + n])
        label = np.arange(len(f))
        for i in range(len(f) - 1):
            hit = np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= BITS) + i + 1
            new = hit[label[hit] != label[i]]
            if len(new):
                others, first = np.unique(label[new], return_index=True)
                pairs.append(np.stack([np.full(len(first), f[i]), f[new[first]]], 1))
                label[np.isin(label, others)] = label[i]
    if not pairs:
        return [], late
    found = np.unique(np.concatenate(pairs).view(np.int64), axis=0)
    return forest(map(tuple, found.tolist())), late


def _links(it: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    got = list(it)
    if not got:
        return
    t = pa.Table.from_batches(got)
    keys, fp = t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
    pairs, late = links_in(keys, fp, most)
    a, b = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])
    yield pa.RecordBatch.from_arrays([pa.array(fp[late].view(np.int64)), pa.nulls(len(late), pa.int64()), pa.array(keys[late])], names=["a", "b", "key"])


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints fp (long) as all links of 4 bits or less do.

    Keys of a group of near copies fall into many different partitions. A task thins its links to a forest, so no
    group is written out as pairs. Keys with over MOST fingerprints go through a second pass, in which each pair of
    their blocks is a group of its own: all links are still found, and no task holds more than two blocks at a time.
    """
    spark = prints.sparkSession

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = b.column("fp").to_numpy()
            rows, keys = keys_of(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(fp[rows])], names=["key", "fp"])

    spread = prints.mapInArrow(trimmed(keyed), "key long, fp long").repartition(width(spark), "key")
    found = stage(spread.mapInArrow(trimmed(lambda it: _links(it, MOST)), "a long, b long, key long"))
    edges, late = found.where("key is null").select("a", "b"), found.where("key is not null").select("key", F.col("a").alias("fp"))
    if late.isEmpty():
        return edges
    blocks = late.join(late.groupBy("key").agg(F.ceil(F.count("*") / (MOST / 2)).cast("int").alias("n")), "key")
    block = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    pairs = blocks.select("key", "fp", block.alias("g"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("h"))
    again = pairs.select(F.xxhash64("key", F.least("g", "h"), F.greatest("g", "h")).alias("key"), "fp").repartition(width(spark) * 4, "key")
    return edges.unionByName(again.mapInArrow(trimmed(lambda it: _links(it, None)), "a long, b long, key long").select("a", "b"))


def _printed(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (128 bits that stand for the text), fp of each row of docs."""

    def prints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "t1", "t2")), pa.array(fingerprints_of(texts_of(b)).view(np.int64))], names=["doc_id", "t1", "t2", "fp"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *identity(), "text")
    return stage(rows.mapInArrow(trimmed(prints), "doc_id long, t1 long, t2 long, fp long"))


def _classes(rows: DataFrame) -> DataFrame:
    """fp, root of each fingerprint of rows."""
    prints = stage(rows.select("fp").distinct())
    roots = components(link_fingerprints(prints))
    return stage(prints.join(roots, prints.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of docs (doc_id, text).

    Rows link where their fingerprints differ in 4 bits or less, so also where they agree; a component's id is the
    smallest doc_id in it. Null, empty and blank texts have fingerprint zero. A row without doc_id takes part but
    gives no id; a component of such rows alone has a null id. Repeated rows each keep theirs; further columns are
    not read; an empty table gives no rows.
    """
    rows = _printed(docs).select("doc_id", "fp")
    of = _classes(rows)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(of, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    ids = of.join(least, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs, all columns, of each component of near_duplicates: that of the smallest doc_id (null last), and of
    rows with that doc_id the one whose text hash is least. Rows that agree in doc_id and text count as one."""
    rows = _printed(docs)
    by_print = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("at"))
    kept = by_print.join(_classes(rows), "fp").groupBy("root").agg(F.min("at").alias("at")).select("at.doc_id", "at.t1", "at.t2")
    again = rows.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "t1", "t2", F.lit(True).alias("again"))
    same = lambda a, b: a.doc_id.eqNullSafe(b.doc_id) & (a.t1 == b.t1) & (a.t2 == b.t2)
    kept = stage(kept.join(again, same(kept, again), "left").select(kept.doc_id.alias("_doc_id"), kept.t1.alias("_t1"), kept.t2.alias("_t2"), "again"))
    t1, t2 = identity()

    def of(some: DataFrame) -> DataFrame:
        return docs.join(some, docs.doc_id.cast("long").eqNullSafe(some._doc_id) & (t1 == some._t1) & (t2 == some._t2), "left_semi")

    # rows that repeat are rare; only they need to be told from each other
    once, several = of(kept.where("again IS NULL")), of(kept.where("again"))
    return once.unionByName(several.withColumns({"_t1": t1, "_t2": t2}).dropDuplicates(["doc_id", "_t1", "_t2"]).drop("_t1", "_t2"))
