"""Suffix-array dedup: bytes in strings of LENGTH bytes that also start elsewhere, by interval expansion on BWTs.

No transform of the whole corpus is needed. Each string of LENGTH bytes has a key, the least hash of the GRAM-byte
strings in it, so equal strings have equal keys; consecutive strings with one key make a segment. Keys with one segment
only are dropped; the segments of the others meet by key, and one transform is built for some keys together. Keys whose
segments hold over HEAVY bytes are too much for a transform: they are parted to finer keys first, see below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import repeated_starts
from .common import prepare, stage, texts_of, trimmed, width
from .spans import identity, lists_of, merged, without

LENGTH, GRAM = 400, 128
#: Bytes of one transform at least, and bytes of a key's segments at most, that meet in one task.
BATCH, HEAVY = 1 << 19, 1 << 20
_BASE = 0x9E3779B97F4A7C15


def hashes(b: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hashes of all strings of `size` bytes, by doubling, then joined from the powers of two in size."""
    h = b.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019)
    out, done, s = None, 0, 1
    power = np.uint64(base)
    n = len(b)
    while True:
        if size & s:
            if out is None:
                out = h
            else:
                m = n - done - s + 1
                out = out[:m] * power + h[done : done + m]
            done += s
            if done == size:
                break
        m = len(h) - s
        if m <= 0:
            return np.zeros(0, np.uint64)
        h = h[:m] * power + h[s : s + m]
        s *= 2
        power = power * power
    out = out[: n - size + 1].copy()
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def _least(x: np.ndarray, over: int) -> np.ndarray:
    """Least of each `over` consecutive values."""
    s = 1
    while s * 2 <= over:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[: len(x) - over + s], x[over - s :]) if over > s else x


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first start, last start, twice) of each run of strings of `length` bytes with one key; twice: the key's
    gram is there more than once, so the run may repeat within itself. Data is looked at in blocks of 8 MB."""
    parts = []
    over, mask = length - gram + 1, np.uint64((1 << 24) - 1)
    for at in range(0, max(1, len(data) - length + 1), 1 << 23):
        b = np.frombuffer(data, np.uint8)[at : at + (1 << 23) + length - 1]
        if len(b) < length:
            continue
        with np.errstate(over="ignore"):
            h = hashes(b, gram, _BASE)
        high, place = h & ~mask, np.arange(len(h), dtype=np.uint64)
        left = (_least(high | place, over) & mask).astype(np.int64)
        right = (mask - (_least(high | (mask - place), over) & mask)).astype(np.int64)
        key = h[left]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        twice = np.minimum.reduceat(left, new) != np.maximum.reduceat(right, new)
        parts.append((key[new].view(np.int64), new + at, np.append(new[1:], len(key)) - 1 + at, twice))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_SEGMENT = pa.schema([("key", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("known", pa.bool_())])
_SEGMENT_TYPES = "key long, t1 long, t2 long, first int, last int, known boolean"


def _emit(rows: list[tuple], known: bool) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 50_000):
        c = np.array(rows[k : k + 50_000], np.int64).T
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in c[:3]), *(pa.array(x.astype(np.int32)) for x in c[3:]), pa.array([known] * c.shape[1])], schema=_SEGMENT)


def _keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of this task's texts. Of a key that comes more than once here, all but one are known to meet others,
    and one goes on to meet the other tasks': so a frequent key leaves a task once in search of others."""
    first: dict[int, tuple] = {}
    for b in it:
        met: list[tuple] = []
        for t1, t2, text in zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), texts_of(b), strict=True):
            keys, starts, ends, twice = segments(text.encode("utf-8", "surrogatepass"))
            for key, a, z, self_met in zip(keys.tolist(), starts.tolist(), ends.tolist(), twice.tolist(), strict=True):
                own = (key, t1, t2, a, z)
                if self_met:
                    met.append(own)
                    first[key] = (*first.get(key, own)[:5], True)
                    continue
                held = first.setdefault(key, own)
                if held is not own and held != own:
                    met.append(own)
                    if len(held) == 5:
                        first[key] = (*held, True)
        yield from _emit(met, True)
    yield from _emit([r[:5] for r in first.values() if len(r) == 6], True)
    # what stands for its key in other tasks: once more where it is known already, with last = -1
    yield from _emit([(*r[:4], -1) if len(r) == 6 else r for r in first.values()], False)


def _meeting(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments that are known to meet others, and those whose key another task has too."""
    got = list(it)
    if not got:
        return
    t = pa.Table.from_batches(got)
    known = t.column("known").to_numpy()
    c = {n: t.column(n).to_numpy() for n in ("key", "t1", "t2", "first", "last")}
    own = np.flatnonzero(~known)
    own = own[np.lexsort((c["first"][own], c["t2"][own], c["t1"][own], c["key"][own]))]
    k = c["key"][own]
    other = (k[1:] != k[:-1]) | (c["t1"][own][1:] != c["t1"][own][:-1]) | (c["t2"][own][1:] != c["t2"][own][:-1]) | (c["first"][own][1:] != c["first"][own][:-1])
    start = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    group = np.cumsum(start) - 1
    places = np.bincount(group, weights=np.concatenate([[1], other]) if len(k) else None) if len(k) else np.zeros(0)
    alone = np.zeros(len(k), bool)
    if len(k):
        # a row with last = -1 stands for at least two segments of its task
        alone = (places[group] == 1) & ~np.isin(k, k[c["last"][own] == -1])
    keep = own[~alone & (c["last"][own] >= 0)]
    out = np.concatenate([np.flatnonzero(known), keep]).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(c[n][out]) for n in ("key", "t1", "t2", "first", "last")], names=["key", "t1", "t2", "first", "last"])


_PART_TYPES = "key long, t1 long, t2 long, first int, bytes binary"


def _parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of segments that are to meet."""
    for b in it:
        rows = []
        for t1, t2, text, segs in zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), texts_of(b), b.column("segs").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            rows += [(s["key"], t1, t2, s["first"], data[s["first"] : s["last"] + LENGTH]) for s in segs]
        for k in range(0, len(rows), 2000):
            cols = list(zip(*rows[k : k + 2000], strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], names=["key", "t1", "t2", "first", "bytes"])


# Heavy keys. Every string of LENGTH bytes of such a key holds the key's gram, its anchor. A cell is the strings of a
# text that begin between `low` and `high` bytes before an anchor; `start` and `stop` are those that matter. All strings
# of a cell hold its core, the bytes that they have in common, so equal strings are in cells of one core: the core is a
# finer key. Cells that are the same in all bytes count as one that repeats. Cells of one core that are light enough go
# to a transform; heavier ones are parted, which makes their cores longer, until there is only one string in a cell and
# the core is that string. So a passage that a third of all documents share costs each of them a few rows a round, and
# equal cells are counted by partial aggregation.

_CELL = pa.schema([("key", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("anchor", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.int32()), ("bytes", pa.binary()), ("core", pa.binary()), ("full", pa.binary())])
_CELL_TYPES = "key long, t1 long, t2 long, anchor int, low int, high int, start int, stop int, base int, bytes binary, core binary, full binary"
PARTED = 4


def _cell(key: int, t1: int, t2: int, anchor: int, low: int, high: int, start: int, stop: int, data: bytes, at: int) -> tuple | None:
    """A cell from data, which begins `at` bytes into the text; None without strings that matter."""
    start, stop = max(start, anchor - high), min(stop, anchor - low)
    if start > stop:
        return None
    part = data[max(0, anchor - high - at) : anchor - low + LENGTH - at]
    base = max(at, anchor - high)
    mark = f"{key} {low} {high} ".encode()
    core = hashlib.blake2b(mark + part[anchor - low - base : anchor - high + LENGTH - base], digest_size=16).digest()
    whole = base == anchor - high and len(part) == high - low + LENGTH
    return key, t1, t2, anchor, low, high, start, stop, base, part, core, hashlib.blake2b(mark + part, digest_size=16).digest() if whole else None


def _as_cells(rows: list[tuple | None]) -> Iterator[pa.RecordBatch]:
    rows = [r for r in rows if r]
    for k in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 2000], strict=True), _CELL, strict=True)], schema=_CELL)


def _parted(low: int, high: int) -> list[tuple[int, int]]:
    step = -(-(high - low + 1) // PARTED)
    return [(k, min(high, k + step - 1)) for k in range(low, high + 1, step)]


def _first_cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = np.uint64((1 << 24) - 1)
    for b in it:
        rows = []
        for t1, t2, text, segs in zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), texts_of(b), b.column("segs").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for s in segs:
                first, last = s["first"], s["last"]
                for at in range(first, last + 1, 1 << 23):
                    end = min(last, at + (1 << 23) - 1)
                    with np.errstate(over="ignore"):
                        h = hashes(np.frombuffer(data, np.uint8)[at : end + LENGTH], GRAM, _BASE)
                    left = at + (_least(h & ~mask | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1) & mask).astype(np.int64)
                    new = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
                    for i, j in zip(new.tolist(), [*new[1:].tolist(), len(left)], strict=True):
                        rows += [_cell(s["key"], t1, t2, int(left[i]), low, high, at + i, at + j - 1, data, 0) for low, high in _parted(0, LENGTH - GRAM)]
        yield from _as_cells(rows)


def _next_cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rows = []
        for r in b.to_pylist():
            rows += [_cell(r["key"], r["t1"], r["t2"], r["anchor"], low, high, r["start"], r["stop"], r["bytes"], r["base"]) for low, high in _parted(r["low"], r["high"])]
        yield from _as_cells(rows)


def _heavy_ranges(cells: DataFrame) -> list[DataFrame]:
    """t1, t2, range of the strings of cells that repeat, by rounds of parting."""
    out = []
    while True:
        cells = stage(cells)
        row = F.struct(*[F.col(n) for n in _CELL.names if n != "full"], "full")
        fulls = stage(cells.where("full is not null").groupBy("full").agg(F.count("*").alias("n"), F.min(row).alias("row")).where("n > 1").select("full", "row"))
        packed = F.col("start").cast("long") * (1 << 32) + F.col("stop") + LENGTH
        out.append(cells.join(fulls, "full", "left_semi").select("t1", "t2", packed.alias("range")))
        # one of the cells that are all the same goes on, to be met by others that have some of its strings
        alone = cells.join(fulls, "full", "left_anti").select(*_CELL.names, F.lit(True).alias("open"))
        rest = alone.unionByName(fulls.select("row.*", F.lit(False).alias("open"))).where("high > low")
        cores = rest.groupBy("core").agg(F.count("*").alias("n"), F.max("open").alias("any"), F.sum(F.col("stop") - F.col("start") + LENGTH).alias("size")).where("n > 1 and any").select("core", (F.col("size") > HEAVY).alias("heavy"))
        rest = stage(rest.join(cores, "core").select(*_CELL.names, "heavy"))
        own = F.substring("bytes", F.col("start") - F.col("base") + 1, F.col("stop") - F.col("start") + LENGTH)
        out.append(_by_transforms(rest.where("NOT heavy").select(F.xxhash64("core").alias("key"), "t1", "t2", F.col("start").alias("first"), own.alias("bytes"))))
        rest = rest.where("heavy")
        if rest.isEmpty():
            return out
        cells = rest.select(*_CELL.names).mapInArrow(trimmed(_next_cells), _CELL_TYPES)


def _by_transforms(parts: DataFrame) -> DataFrame:
    """t1, t2, range of the strings of parts (key, t1, t2, first, bytes) that repeat within their key."""
    return parts.repartition(width(parts.sparkSession), "key").sortWithinPartitions("key").mapInArrow(trimmed(_repeated), "t1 long, t2 long, range long")


def _runs(t1: np.ndarray, t2: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(starts.astype(np.int64) << 32 | ends.astype(np.int64))], names=["t1", "t2", "range"])


def _expand(group: list[tuple]) -> Iterator[pa.RecordBatch]:
    t1, t2, lo, hi = [], [], [], []
    for (a, b, first, _), at in zip(group, repeated_starts([g[3] for g in group], LENGTH), strict=True):
        if len(at):
            runs = merged(np.stack([at + first, at + first + LENGTH], 1))
            t1 += [a] * len(runs)
            t2 += [b] * len(runs)
            lo += runs[:, 0].tolist()
            hi += runs[:, 1].tolist()
    if t1:
        yield _runs(np.array(t1), np.array(t2), np.array(lo), np.array(hi))


def _repeated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key: segments are gathered to transforms of BATCH bytes or somewhat more, whole keys each."""
    group: list[tuple] = []
    held, key = 0, None
    for b in it:
        for k, t1, t2, first, part in zip(*(b.column(n).to_pylist() for n in ("key", "t1", "t2", "first", "bytes")), strict=True):
            if k != key:
                if held >= BATCH:
                    yield from _expand(group)
                    group, held = [], 0
                key = k
            group.append((t1, t2, first, part))
            held += len(part)
    if group:
        yield from _expand(group)


def repeated_bytes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, texts). rows: doc_id, t1, t2 of each row of docs; texts: t1, t2, text, n (rows that have it), ranges.

    ranges: packed start and end of bytes in strings of LENGTH bytes that start in another text or elsewhere in this
    one. A text with n > 1 repeats as a whole; texts are told apart by 128 bits.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *identity())
    texts = rows.groupBy("t1", "t2").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"), F.count("*").alias("n"))
    keyed = rows.where(F.octet_length("text") >= LENGTH).select("t1", "t2", "text").mapInArrow(trimmed(_keyed), _SEGMENT_TYPES)
    home = F.when(F.col("known"), F.col("t1")).otherwise(F.col("key"))
    met = stage(keyed.repartition(width(spark), home).mapInArrow(trimmed(_meeting), "key long, t1 long, t2 long, first int, last int").distinct())
    heavy = met.groupBy("key").agg(F.sum(F.col("last") - F.col("first") + LENGTH).alias("size")).where(F.col("size") > HEAVY).select("key")
    heavy = stage(heavy)

    def with_text(some: DataFrame) -> DataFrame:
        segs = some.groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "first", "last")).alias("segs"))
        return texts.join(segs, ["t1", "t2"]).select("t1", "t2", "text", "n", "segs")

    parts = with_text(met.join(heavy, "key", "left_anti")).mapInArrow(trimmed(_parts), _PART_TYPES)
    found = _by_transforms(parts)
    if not heavy.isEmpty():
        for more in _heavy_ranges(with_text(met.join(heavy, "key", "left_semi")).mapInArrow(trimmed(_first_cells), _CELL_TYPES)):
            found = found.unionByName(more)
    ranges = stage(found.groupBy("t1", "t2").agg(F.collect_list("range").alias("ranges")))
    return rows.select("doc_id", "t1", "t2"), texts.join(ranges, ["t1", "t2"], "left").select("t1", "t2", "text", "n", "ranges")


_KEPT = "t1 long, t2 long, text binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        out = []
        for text, n, packed in zip(texts_of(b), b.column("n").to_pylist(), lists_of(b.column("ranges")), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            if n > 1 and len(data) >= LENGTH:
                runs = np.array([[0, len(data)]])
            else:
                runs = merged(np.stack([packed >> 32, packed & 0xFFFFFFFF], 1))
            kept = without(data, runs)
            out.append((kept, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([b.column("t1"), b.column("t2"), pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.string())], names=["t1", "t2", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, digests_only: bool = False) -> DataFrame:
    """doc_id, text (kept bytes; left out with digests_only), n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text).

    A byte goes where a string of LENGTH bytes that covers it also starts anywhere else, in the same row or another;
    rows are judged on the input, so of two equal long texts both go. Null reads as empty; doc_id only names rows and
    may repeat or be null; texts shorter than LENGTH stay whole; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows, texts = repeated_bytes(docs)
    cut = texts.mapInArrow(trimmed(_cut), _KEPT)
    cut = cut.drop("text") if digests_only else cut
    return rows.join(cut, ["t1", "t2"]).drop("t1", "t2")
