"""Line dedup: MinHash signatures of character shingles, banding, exact Jaccard, union-find, one line a component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage, trimmed, width
from .graph import components
from .spans import identity

#: Characters of a shingle; a shorter line is one shingle. Lines link from this Jaccard similarity on.
SHINGLE, SIMILAR = 8, 0.8
#: Two lines at similarity 0.8 share one of 12 bands of 4 minima with a chance of 0.998, more similar ones sooner.
BANDS, ROWS = 12, 4
BINS = BANDS * ROWS
#: Lines of one key that meet by pairs.
FEW = 8
#: Pairs, and characters of pairs, that are compared at a time.
PAIRS, PAIR_CHARS = 1000, 1_000_000
#: Lines of one band that meet in one task at most; more are dealt by pairs of blocks.
MOST = 4000


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every shingle of every line."""
    size = np.array([len(x) for x in lines])
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    codes = np.append(codes, np.zeros(SHINGLE, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1F123BB5)
    power, s = np.uint64(0xD6E8FEB86659FD93), 1
    with np.errstate(over="ignore"):
        while s < SHINGLE:
            codes = codes[:-s] * power + codes[s:]
            power = power * power
            s *= 2
        count = np.maximum(1, size - SHINGLE + 1)
        start, begin = np.cumsum(size) - size, np.cumsum(count) - count
        at = np.repeat(start - begin, count)
        at += np.arange(len(at))
        h = codes[at]
        for k in np.flatnonzero(size < SHINGLE):
            h[begin[k]] = np.uint64(hash_of(lines[k]))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return np.repeat(np.arange(len(lines)), count), h


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) keys. One hash is dealt over BINS bins whose least values make the signature; an empty bin
    takes the value of a full one that a hash of the bin picks, so it still agrees with the chance of the similarity."""
    line, h = _shingle_hashes(lines)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(len(lines) * BINS, none, np.uint64)
    place = line * BINS + ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(least, place, h)
    least = least.reshape(-1, BINS)
    full = least != none
    out, done = least.copy(), full.copy()
    bins, tries = np.arange(BINS, dtype=np.uint64), 0
    with np.errstate(over="ignore"):
        while not done.all():
            tries += 1
            pick = ((bins * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tries) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)) % np.uint64(BINS)
            pick = pick.astype(np.int64)
            new = ~done & full[:, pick]
            out[new] = (least[:, pick] + np.uint64(tries))[new]
            done |= new
        key = np.zeros((len(lines), BANDS), np.uint64)
        for r in range(ROWS):
            key = (key ^ out[:, r::ROWS]) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(28)
        return key * np.uint64(2 * BANDS + 1) + np.arange(BANDS, dtype=np.uint64)


def shingles(line: str) -> frozenset[str]:
    return frozenset(line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1)))


def similar(a: frozenset[str], b: frozenset[str]) -> bool:
    both = len(a & b)
    return both >= SIMILAR * (len(a) + len(b) - both)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def links_among(ids: list, lines: list[str]) -> list[tuple]:
    """A forest of the links among lines: each line reached looks for others among those not reached yet. Shingles are
    numbered by their hashes, and counted as such; where a wrong count of one could decide, they are compared."""
    n = len(lines)
    bits = np.uint64(n.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    line, h = _shingle_hashes(lines)
    key = _distinct(h & ~low | line.astype(np.uint64))
    number = np.cumsum(np.append(True, key[1:] >> bits != key[:-1] >> bits)) - 1
    own = (key & low).astype(np.int64)
    flat = number[np.argsort(own, kind="stable")]
    size = np.bincount(own, minlength=n)
    begin = np.cumsum(size) - size
    marked, rest, out = np.zeros(number[-1] + 1, bool), np.ones(n, bool), []
    while rest.any():
        todo = [int(np.argmax(rest))]
        rest[todo] = False
        while todo and rest.any():
            i = todo.pop()
            mine = flat[begin[i] : begin[i] + size[i]]
            marked[mine] = True
            both = np.add.reduceat(marked[flat], begin, dtype=np.int64)
            marked[mine] = False
            over = both - SIMILAR * (size[i] + size - both)
            near = rest & (over >= 0)
            for j in np.flatnonzero(rest & (np.abs(over) < 2)).tolist():
                near[j] = similar(shingles(lines[i]), shingles(lines[j]))
            rest &= ~near
            found = np.flatnonzero(near).tolist()
            todo += found
            out += [(ids[i], ids[j]) for j in found]
    return out


def _keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        if b.num_rows:
            keys = band_keys(b.column("line").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), b.column("id").take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))], names=["key", "id"])


def _shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is to meet: the lines of a key that many have, with their number; of a key that few have each pair, under a
    key of its own, so that a pair which shares several bands is looked at once."""
    got = list(it)
    if not got:
        return
    t = pa.Table.from_batches(got)
    keys, ids = t.column("key").to_numpy().view(np.uint64), t.column("id").to_numpy()
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(keys)))
    n = np.repeat(sizes, sizes)
    many, few = n > FEW, np.flatnonzero((n > 1) & (n <= FEW))
    out = [(keys[many], ids[many], n[many])]
    k, i = keys[few], ids[few]
    with np.errstate(over="ignore"):
        for d in range(1, min(FEW, len(k))):
            at = np.flatnonzero(k[d:] == k[:-d])
            a, b = i[at], i[at + d]
            pair = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            out += [(pair, a, np.full(len(a), 2)), (pair, b, np.full(len(a), 2))]
    keys, ids, n = (np.concatenate(x) for x in zip(*out, strict=True))
    _, first = np.unique(np.stack([keys, ids.view(np.uint64)], 1), axis=0, return_index=True) if len(keys) else (None, np.zeros(0, int))
    yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(ids[first]), pa.array(n[first].astype(np.int32))], names=["key", "id", "n"])


def similar_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """Whether a[k] and b[k] are similar, for all k. Shingles of all pairs are counted together as hashes, of which the
    low bits tell the pair; where a wrong count of one could decide, the shingles themselves are compared."""
    n = len(a)
    low = np.uint64((1 << max(1, n.bit_length())) - 1)
    line, h = _shingle_hashes([*a, *b])
    key, first = h & ~low | (line % n).astype(np.uint64), line < n
    left, right = _distinct(key[first]), _distinct(key[~first])
    met = np.sort(np.concatenate([left, right]))
    count = lambda x: np.bincount((x & low).astype(np.int64), minlength=n)
    both, sizes = count(met[1:][met[1:] == met[:-1]]), count(left) + count(right)
    over = both - SIMILAR * (sizes - both)
    out = over >= 0
    for k in np.flatnonzero(np.abs(over) < 2).tolist():
        out[k] = similar(shingles(a[k]), shingles(b[k]))
    return out


_LINK = pa.schema([(n, pa.int64()) for n in ("a1", "a2", "b1", "b2")])


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(id, id2, line) of each key; rows come sorted by key."""
    key, group = None, []
    for b in it:
        for k, *row in zip(*(b.column(n).to_pylist() for n in ("key", "id", "id2", "line")), strict=True):
            if k != key and group:
                yield group
                group = []
            key = k
            group.append(tuple(row))
    if group:
        yield group


def _linked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the lines of each key. Keys of two lines are compared many at a time."""
    pairs, held, out = [], 0, []

    def compared() -> list[tuple]:
        fine = similar_pairs([x[2] for x, _ in pairs], [y[2] for _, y in pairs]) if pairs else np.zeros(0, bool)
        return [(*pairs[k][0][:2], *pairs[k][1][:2]) for k in np.flatnonzero(fine).tolist()]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 4)], schema=_LINK)

    for group in _groups(it):
        if len(group) == 2:
            pairs.append(group)
            held += len(group[0][2]) + len(group[1][2])
        elif len(group) > 2:
            out += [(*x, *y) for x, y in links_among([r[:2] for r in group], [r[2] for r in group])]
        if len(pairs) >= PAIRS or held >= PAIR_CHARS:
            out += compared()
            pairs, held = [], 0
        if len(out) > 10_000:
            yield batch()
            out = []
    out += compared()
    yield batch()


def line_links(lines: DataFrame) -> DataFrame:
    """Edges (a1, a2, b1, b2) that connect the different lines (id, id2: long, line) as all pairs that share a band and
    have a similarity of SIMILAR or more do. Lines find each other by id alone: should two lines share it, both come
    along. Texts move only for lines that share a band. A band with over MOST lines is dealt by pairs of blocks of
    lines, so no task holds more than two blocks of one."""
    n = width(lines.sparkSession)
    shared = lines.select("id", "line").mapInArrow(trimmed(_keys), "key long, id long").repartition(n, "key").mapInArrow(trimmed(_shared), "key long, id long, n int")
    blocks = F.ceil(F.col("n") / (MOST // 2)).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    split = shared.withColumn("other", F.explode(F.when(F.col("n") <= MOST, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), blocks - 1))))
    key = F.when(F.col("other") < 0, F.col("key")).otherwise(F.xxhash64("key", F.least(block, "other"), F.greatest(block, "other")))
    wanted = split.select("id", key.alias("key")).groupBy("id").agg(F.collect_set("key").alias("keys"))
    met = lines.join(wanted, "id").select(F.explode("keys").alias("key"), "id", "id2", "line")
    return met.repartition(n, "key").sortWithinPartitions("key").mapInArrow(trimmed(_linked), "a1 long, a2 long, b1 long, b2 long")


def _line_ids() -> list:
    """Columns id and id2: 128 bits that stand for the line."""
    return [F.xxhash64("line").alias("id"), F.xxhash64(F.lit(2), "line").alias("id2")]


def _lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, no, line, id, id2 of every line of every row of docs (doc_id, text) that isn't blank."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *identity(F.col("doc_id")))
    lines = rows.select("doc_id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.where(F.trim("line") != "").select("*", *_line_ids())


def linked_lines(lines: DataFrame) -> DataFrame:
    """id, id2, root of each line (id, line) that links to another one; root: a number of its component."""
    gathered = lines.select("id", "line").groupBy("id").agg(F.collect_set("line").alias("lines"))
    different = gathered.select("id", F.explode("lines").alias("line")).select("id", "line", _line_ids()[1])
    links = stage(line_links(different))
    ends = links.select(F.col("a1").alias("id"), F.col("a2").alias("id2")).unionByName(links.select(F.col("b1").alias("id"), F.col("b2").alias("id2"))).distinct()
    nodes = stage(ends.withColumn("node", F.monotonically_increasing_id()))
    a, b = (nodes.select(F.col("id").alias(f"{x}1"), F.col("id2").alias(f"{x}2"), F.col("node").alias(x)) for x in "ab")
    roots = components(links.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("a", "b"))
    return nodes.join(roots, "node", "left").select("id", "id2", F.coalesce("root", "node").alias("root"))


def kept_lines(docs: DataFrame) -> DataFrame:
    """t1, t2, kept: the numbers of the lines that stay in each document that keeps any.

    Lines that are equal or linked by similarity, however indirectly, make a component, of which the line that comes
    first by doc_id (null first), text hash and number stays. Lines are told apart by 128 bits of their text.
    """
    lines = _lines_of(docs)
    placed = lines.select("id", "id2", F.struct("doc_id", "t1", "t2", "no").alias("at")).groupBy("id", "id2").agg(F.min("at").alias("at"))
    classes = placed.join(linked_lines(lines), ["id", "id2"], "left")
    own = [F.when(F.col("root").isNull(), F.col(c)).alias(c) for c in ("id", "id2")]
    firsts = classes.select("root", *own, "at").groupBy("root", "id", "id2").agg(F.min("at").alias("at")).select("at.*")
    return firsts.groupBy("t1", "t2").agg(F.array_sort(F.collect_list("no")).alias("kept"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers of the lines that go, from 0) of each row of docs (doc_id, text).

    Lines end at line feeds. Blank lines stay. Rows that agree in doc_id and text count as one document and get the
    same answer; a null text has no lines; further columns are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    parts = F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))
    full = F.filter(F.transform(parts, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(parts).alias("n_lines"), full.alias("full"), *identity(F.col("doc_id")))
    removed = F.array_except("full", F.coalesce("kept", F.array().cast("array<int>")))
    out = rows.join(kept_lines(docs), ["t1", "t2"], "left").select("doc_id", "n_lines", removed.alias("removed"))
    return out.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


def deduplicated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text of each row of docs without the lines that line_report says go; a null text becomes empty."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text", *identity(F.col("doc_id").cast("long")))
    parts = F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))
    stays = F.filter(F.transform(parts, lambda x, i: F.when((F.trim(x) == "") | F.coalesce(F.array_contains("kept", i), F.lit(False)), x)), lambda x: x.isNotNull())
    return rows.join(kept_lines(docs), ["t1", "t2"], "left").select("doc_id", F.array_join(stays, "\n").alias("text"))
