"""Jaccard join of word shingles by parity sketches: parts of sketches by pigeonhole for each size band, exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage, trimmed, width
from .graph import components
from .spans import identity

WORDS = 4
#: Sets link from this many hundredths of their union on.
SIMILAR = 85
#: Parts of a band's sketch for each part that may differ: more parts leave a set the choice of its fullest ones.
SLACK = 1.25
#: Bits of a part.
PART = 1 << 16
#: Sets of one key that meet by all pairs; sets of a larger key that meet in one task at most.
FEW, MOST = 8, 4000
#: Rows that a task works on at a time, sets that it remembers as sent, sets that are held against one other in a task.
ROWS, SEEN, HELD = 50_000, 100_000, 500
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(h: np.ndarray) -> np.ndarray:
    """64 bits, each of which depends on all of those given."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingles_of(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles in order; of the whole sequence where it has fewer words; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _STEPS[k]
    return np.unique(mixed(total))


def most_apart(a: int, b: int) -> int:
    """Elements that are in one alone of two sets of a and b elements that link, at most."""
    return (100 - SIMILAR) * (a + b) // (100 + SIMILAR)


def budget(n: int) -> int:
    """The same for a set of n elements and any other."""
    return most_apart(n, 100 * n // SIMILAR)


def bands_of(n: int) -> list[int]:
    """Bands are sizes from 2^k to below 2^(k+1). A set is in its own and, if a set that links may be there, the next."""
    k = n.bit_length() - 1
    return [k, k + 1] if 100 * n // SIMILAR >= 2 << k else [k]


def parts_of(k: int) -> int:
    return int(np.ceil(SLACK * (budget((2 << k) - 1) + 1)))


def keys_of(shingles: np.ndarray) -> np.ndarray:
    """Keys of the parts of a set's sketch in its bands: two sets that link share one.

    A band's sketch has parts of PART bits; an element turns over one bit, so sketches differ in no more bits, and no
    more parts, than there are elements in one set alone: budget(n) parts at most. Put the parts of both in one order
    of their contents. Of the first budget(n) + 1 of a set one at least is in both, and the first that is in both is
    among the first so many of each. The order is by the number of bits set, so that common, nearly empty parts go last.
    """
    n = len(shingles)
    if not budget(n):
        return np.zeros(0, np.uint64)  # only equal sets link
    out = []
    for k in bands_of(n):
        parts = parts_of(k)
        at = np.sort((shingles >> np.uint64(32)) % np.uint64(parts) << np.uint64(16) | shingles & np.uint64(PART - 1))
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        at = at[first[np.diff(np.append(first, n)) % 2 == 1]]  # bits that were turned over an even number of times are 0
        part = at >> np.uint64(16)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(at) else np.zeros(0, np.int64)
        tag = np.uint64(k + 1) << np.uint64(56)
        key = mixed(np.bitwise_xor.reduceat(mixed(at + tag), first) + part[first] + tag) if len(at) else np.zeros(0, np.uint64)
        order = np.lexsort((key, -np.diff(np.append(first, len(at)))))[: budget(n) + 1]
        out.append(key[order])
        if (more := budget(n) + 1 - len(order)) > 0:
            none = np.setdiff1d(np.arange(parts, dtype=np.uint64), part)
            out.append(np.sort(mixed(none + tag))[:more])
    return np.concatenate(out)


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Parity of the elements by their last bits: 2 to 4 bits for each element, a power of two of words."""
    bits = max(64, 2 << len(shingles).bit_length())
    return np.packbits(np.bincount((shingles >> np.uint64(8) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").view("<u8")


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch (or rows of sketches) of fewer words."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def may_link(a: int, b: int, x: np.ndarray, y: np.ndarray) -> bool:
    words = min(len(x), len(y))
    return SIMILAR * max(a, b) <= 100 * min(a, b) and int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= most_apart(a, b)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = int((np.searchsorted(a, b, "right") > np.searchsorted(a, b)).sum()) if len(a) and len(b) else 0
    return both > 0 and 100 * both >= SIMILAR * (len(a) + len(b) - both)


def _sketched(docs: DataFrame) -> DataFrame:
    """A row for each of docs: id, doc_id, t1, t2 (its text), n, d1, d2 (its set), and keys and sketch of the set where the
    task hasn't sent them yet."""
    kinds = {"id": pa.int64(), "doc_id": pa.int64(), "t1": pa.int64(), "t2": pa.int64(), "n": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "keys": pa.list_(pa.int64()), "sketch": pa.binary()}

    def sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for b in it:
            out = []
            for text in b.column("text").to_pylist():
                s = shingles_of(text)
                d = [int(x) for x in np.array([np.bitwise_xor.reduce(mixed(s)), mixed(s + _STEPS[0]).sum(dtype=np.uint64)], np.uint64).view(np.int64)]
                row = [len(s), *d, None, None]
                if len(s) and tuple(row[:3]) not in seen:
                    if len(seen) == SEEN:
                        seen.clear()
                    seen.add(tuple(row[:3]))
                    row[3:] = keys_of(s).view(np.int64), sketch_of(s).tobytes()
                out.append(row)
            own = dict(zip(list(kinds)[4:], zip(*out, strict=True), strict=True)) if out else {c: () for c in kinds}
            yield pa.RecordBatch.from_arrays([pa.array(own[c], t) if c in own else b.column(c) for c, t in kinds.items()], schema=pa.schema(list(kinds.items())))

    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), *identity(), "text")
    return stage(rows.mapInArrow(trimmed(sketch), "id long, doc_id long, t1 long, t2 long, n long, d1 long, d2 long, keys array<long>, sketch binary"))


def _meeting(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, id) in order: pairs of the sets of small keys; of larger ones pairs with the first, and each set by key."""

    def told(a: list, b: list, late: list, key: list) -> pa.RecordBatch:
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        a, b, late, key = cat(a), cat(b), cat(late), cat(key)
        none = [pa.nulls(len(x), pa.int64()) for x in (a, late)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a), pa.array(late)]), pa.concat_arrays([pa.array(b), none[1]]), pa.concat_arrays([none[0], pa.array(key)])], names=["a", "b", "key"])

    def work(keys: np.ndarray, ids: np.ndarray, large: tuple[int, int] | None, last: bool) -> tuple:
        """What is told of whole keys; the rows of the last key if it may go on, or if it is large that and its first set."""
        a, b, late, key = [], [], [], []
        if large and len(keys) and keys[0] == large[0]:
            n = int(np.searchsorted(keys, large[0], "right"))
            a, b, late, key = [np.full(n, large[1])], [ids[:n]], [ids[:n]], [keys[:n]]
            if n == len(keys) and not last:
                return told(a, b, late, key), keys[n:], ids[n:], large
            keys, ids = keys[n:], ids[n:]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        size, stop, large = np.diff(np.append(first, len(keys))), len(keys), None
        if len(first) and not last:
            if size[-1] > FEW:
                large = (int(keys[-1]), int(ids[first[-1]]))
            else:
                first, size, stop = first[:-1], size[:-1], int(first[-1])
        each, begin = np.repeat(size, size), np.repeat(first, size)
        for d in range(1, FEW):
            own = np.flatnonzero((each <= FEW) & (np.arange(stop) - begin + d < each))
            a.append(ids[own])
            b.append(ids[own + d])
        own = np.flatnonzero(each > FEW)
        late.append(ids[own])
        key.append(keys[own])
        own = own[own > begin[own]]
        a.append(ids[begin[own]])
        b.append(ids[own])
        return told(a, b, late, key), keys[stop:], ids[stop:], large

    keys, ids, large, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], None, 0
    for batch in it:
        keys.append(batch.column("key").to_numpy())
        ids.append(batch.column("id").to_numpy())
        size += batch.num_rows
        if size >= ROWS:
            out, k, i, large = work(np.concatenate(keys), np.concatenate(ids), large, False)
            keys, ids, size = [k], [i], 0
            yield out
    yield work(np.concatenate(keys), np.concatenate(ids), large, True)[0]


def _passing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches let them link."""

    def close(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = zip(*(b.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True)
            yield b.select(["a", "b"]).filter(pa.array([may_link(n, m, np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for n, m, x, y in rows], pa.bool_()))

    one = sketches.select(F.col("id").alias("a"), "n", F.col("sketch").alias("x"))
    two = sketches.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    near = pairs.join(one.select("a", "n"), "a").join(two.select("b", "m"), "b").where(F.greatest("n", "m") * SIMILAR <= F.least("n", "m") * 100).select("a", "b")
    return near.join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(trimmed(close), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that link, by their whole texts. A set meets the others that it is paired with as these stream past, in
    several tasks where they are many."""

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.zeros(0, np.uint64)
        for batch in it:
            out = []
            for a, salt, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "text")), strict=True):
                s = shingles_of(text)
                if b is None:
                    at, held = (a, salt), s
                elif at == (a, salt) and linked(held, s):
                    out.append((a, b))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    spark = docs.sparkSession
    pairs = stage(pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / HELD).alias("tasks")), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("salt")))
    need = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id").join(sets.select("id", "of", "t1", "t2"), "id")
    t1, t2 = identity()
    own = docs.select(F.col("doc_id").cast("long").alias("_of"), t1.alias("_t1"), t2.alias("_t2"), "text")
    texts = stage(own.join(need, (own._t1 == need.t1) & (own._t2 == need.t2) & own._of.eqNullSafe(need.of)).select("id", "text"))
    heads = pairs.select("a", "salt").distinct().join(texts, F.col("a") == F.col("id")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    tails = pairs.join(texts, F.col("b") == F.col("id")).select("a", "salt", "b", "text")
    spread = heads.unionByName(tails).repartition(width(spark), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return stage(spread.mapInArrow(trimmed(check), "a long, b long").distinct())


def _across(it: Iterator[pa.RecordBatch], forest: bool) -> Iterator[pa.RecordBatch]:
    """Of groups of sets (a key, or two blocks of one): pairs of different roots whose sketches let them link; with forest
    only such as join roots that no pair before has joined."""

    def pairs(rows: list[dict]) -> Iterator[tuple[int, int]]:
        rows.sort(key=lambda r: (r["n"], r["id"]))
        n, ids = np.array([r["n"] for r in rows], np.int64), np.array([r["id"] for r in rows], np.int64)
        label = np.unique([r["root"] for r in rows], return_inverse=True)[1]
        kinds: dict[int, tuple[int, np.ndarray]] = {}  # sketches of one length stand side by side
        words = np.array([len(r["sketch"]) // 8 for r in rows])
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words == w)
            kinds[w] = int(own[0]), np.frombuffer(b"".join(rows[k]["sketch"] for k in own), "<u8").reshape(-1, w)
        half = {w: folded(s, w // 2) for w, (_, s) in kinds.items() if w > 1}
        for i in range(len(rows) - 1):
            stop = int(np.searchsorted(n, 100 * n[i] // SIMILAR, "right"))
            w = int(words[i])
            start, block = kinds[w]
            mine = block[i - start]
            here = min(stop, start + len(block))
            apart = [np.bitwise_count(block[i + 1 - start : here - start] ^ mine).sum(1)]
            if stop > here:
                apart.append(np.bitwise_count(half[2 * w][: stop - here] ^ mine).sum(1))
            apart = np.concatenate(apart)
            hit = np.flatnonzero((apart <= (100 - SIMILAR) * (n[i + 1 : stop] + n[i]) // (100 + SIMILAR)) & (label[i + 1 : stop] != label[i])) + i + 1
            if forest:
                new, first = np.unique(label[hit], return_index=True)
                hit = hit[first]
                label[np.isin(label, new)] = label[i]
            yield from ((int(ids[i]), int(ids[j])) for j in hit)

    def grouped() -> Iterator[list[dict]]:
        at, rows = None, []
        for b in it:
            for r in b.to_pylist():
                if rows and r["key"] != at:
                    yield rows
                    rows = []
                at = r["key"]
                rows.append(r)
        if rows:
            yield rows

    for rows in grouped():
        found = list(pairs(rows))
        for k in range(0, len(found), ROWS):
            a, b = zip(*found[k : k + ROWS], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _open_pairs(late: DataFrame, edges: DataFrame, sketches: DataFrame, forest: bool) -> DataFrame | None:
    """Pairs of sets of one large key that no links join yet; None if there are none. Keys are dealt by pairs of blocks."""
    roots = components(edges)
    named = late.join(roots, late.id == roots.node, "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    size = named.groupBy("key").agg(F.count("*").alias("n_ids"), F.min("root").alias("one"), F.max("root").alias("two")).where("one < two")
    size = stage(size.select("key", F.ceil(F.col("n_ids") / (MOST / 2)).cast("int").alias("blocks")))
    if size.isEmpty():
        return None
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = named.join(size, "key").select("key", "id", "root", block.alias("g"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("h"))
    dealt = dealt.select(F.xxhash64("key", F.least("g", "h"), F.greatest("g", "h")).alias("key"), "id", "root").join(sketches, "id")
    spread = dealt.repartition(width(late.sparkSession), "key").sortWithinPartitions("key")
    return spread.mapInArrow(trimmed(lambda it: _across(it, forest)), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text): the number of its distinct shingles of WORDS
    words, and the smallest doc_id that links reach. Rows link where their sets agree in SIMILAR hundredths or more.

    Equal sets are one from the start. Others meet by the parts of their sketches (see keys_of, no link is missed). Sets
    of a key with up to FEW meet all each other, those of a larger one its first, and then, if links have not joined all
    of the key, also all others of a different component by sketches: first as many as would join them, then the rest.
    Whole sketches bound the distance from below, and whole texts decide. Sets are known by 128 bits, elements by 64.
    Null, empty and blank texts have no elements and link with nothing, themselves their component. A row without doc_id
    takes part but gives no id. Repeated rows each keep theirs; further columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = _sketched(docs)
    first = F.min(F.when(F.col("sketch").isNotNull(), F.struct("id", "doc_id", "t1", "t2")))
    sets = rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("least"), first.alias("f"))
    sets = stage(sets.select("n", "d1", "d2", "least", "f.id", F.col("f.doc_id").alias("of"), "f.t1", "f.t2"))
    mine = rows.where("sketch IS NOT NULL").join(sets.select("id"), "id", "left_semi")
    sketches = stage(mine.select("id", "n", "sketch"))
    keyed = mine.select("id", F.explode("keys").alias("key")).repartition(width(spark), "key").sortWithinPartitions("key", "id")
    found = stage(keyed.mapInArrow(trimmed(_meeting), "a long, b long, key long"))
    late = found.where("key is not null").select("key", F.col("a").alias("id"))
    tried = stage(_passing(found.where("key is null").select("a", "b").distinct(), sketches))
    edges = _verified(tried, sets, docs)
    for forest in (True, False):
        more = _open_pairs(late, edges, sketches, forest)
        if more is None:
            break
        more = stage(more.join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(more)
        edges = edges.unionByName(_verified(more, sets, docs))
    roots = components(edges)
    named = stage(sets.join(roots, sets.id == roots.node, "left").select("n", "d1", "d2", "least", F.coalesce("root", "id").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("n", "d1", "d2", "component")
    whole = rows.where("n > 0").join(named, ["n", "d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return whole.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
