"""Substring dedup by content-defined chunks: a gear rolling hash sets the cuts, chunks are deduplicated by digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, texts_of, trimmed, width
from .spans import identity, lists_of, merged, without

#: A cut has the greatest rolling hash within this many bytes to each side, so chunks have over REACH bytes, about
#: twice that on average, and cuts depend on the bytes around them alone. Longer stretches without one are cut at MOST.
#: A repeated passage of 50 words (300 bytes) has to hold some whole chunks, so they can't be much longer.
REACH, MOST = 32, 1024
#: Bytes of repeated chunks side by side that go at least: half a sentence that comes again in other prose stays.
LEAST_RUN = 100
#: Bytes that the hash covers; it shifts by two bits for each.
WINDOW, SHIFT = 16, 2
#: Different digests that a task holds before it sends them on.
HELD = 100_000
GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: h = (h << SHIFT) + GEAR[byte] in 32 bits, by doubling the bytes covered."""
    h = GEAR[data]
    s = 1
    while s < WINDOW:
        h[s:] = h[s:] + (h[:-s] << np.uint32(SHIFT * s))
        s *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data, in order; none for no data. A cut never parts the bytes of a character."""
    n = len(data)
    if n <= REACH:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    h = rolling(b)
    after, before, s = h.copy(), h.copy(), 1
    while s <= REACH:
        step = min(s, REACH + 1 - s)
        after[:-step] = np.maximum(after[:-step], after[step:])
        before[step:] = np.maximum(before[step:], before[:-step])
        s += step
    peak = np.flatnonzero((h[REACH:-REACH] == after[REACH:-REACH]) & (h[REACH:-REACH] == before[REACH:-REACH])) + REACH + 1 if n > 2 * REACH else np.zeros(0, int)
    out, last = [], 0
    for c in [*peak.tolist(), n]:
        while c < n and b[c] & 0xC0 == 0x80:
            c += 1
        if c - last <= REACH and c < n:
            continue
        while c - last > MOST:
            last += MOST
            while b[last] & 0xC0 == 0x80:
                last += 1
            out.append(last)
        if c > last:
            out.append(c)
            last = c
    return out


_CHUNK = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("pos", pa.int32()), ("size", pa.int32())])
_TYPES = "d1 long, d2 long, doc_id long, t1 long, t2 long, pos int, size int"


def _firsts(first: dict[bytes, tuple]) -> Iterator[pa.RecordBatch]:
    keys, rows = list(first), list(first.values())
    for k in range(0, len(rows), 50_000):
        cols, d = np.array(rows[k : k + 50_000], np.int64).T, np.frombuffer(b"".join(keys[k : k + 50_000]), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), *(pa.array(c) for c in cols[:3]), *(pa.array(c.astype(np.int32)) for c in cols[3:])], schema=_CHUNK)


def _digested(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each HELD different digests of this task the first occurrence; the others, without digest, as they come.

    So a chunk that many documents hold leaves a task seldom, and the memory is that of HELD chunks and the longest text."""
    digest = xxhash.xxh3_128_digest
    first: dict[bytes, tuple] = {}
    for b in it:
        late: list[tuple] = []
        for doc, t1, t2, text in zip(b.column("doc_id").to_pylist(), b.column("t1").to_pylist(), b.column("t2").to_pylist(), texts_of(b), strict=True):
            data, at = text.encode("utf-8", "surrogatepass"), 0
            doc = -(1 << 63) if doc is None else doc
            for end in cuts(data):
                d, own = digest(data[at:end]), (doc, t1, t2, at, end - at)
                held = first.setdefault(d, own)
                if held is not own and held != own:
                    if own < held:
                        first[d], own = own, held
                    late.append(own)
                at = end
        if late:
            cols = np.array(late, np.int64).T
            none = pa.nulls(len(late), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *(pa.array(c) for c in cols[:3]), *(pa.array(c.astype(np.int32)) for c in cols[3:])], schema=_CHUNK)
        if len(first) >= HELD:
            yield from _firsts(first)
            first = {}
    yield from _firsts(first)


def _repeats(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the tasks' first occurrences, all but the first of each digest; rows without digest as they are."""
    got = list(it)
    if not got:
        return
    t = pa.Table.from_batches(got)
    known = t.column("d1").is_valid().to_numpy()
    none = np.flatnonzero(~known)
    own = np.flatnonzero(known)
    col = {n: t.column(n).to_numpy() for n in ("doc_id", "t1", "t2", "pos", "size")}
    d1, d2 = (t.column(n).fill_null(0).to_numpy()[own] for n in ("d1", "d2"))
    order = np.lexsort((col["pos"][own], col["t2"][own], col["t1"][own], col["doc_id"][own], d2, d1))
    d1, d2 = d1[order], d2[order]
    same = np.flatnonzero((d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1])) + 1
    at = own[order]
    # the same place of rows that agree in doc_id and text is no repeat
    same = same[~np.logical_and.reduce([col[n][at[same]] == col[n][at[same - 1]] for n in ("doc_id", "t1", "t2", "pos")])] if len(same) else same
    out = np.concatenate([none, at[same]]).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(col[n][out]) for n in ("t1", "t2", "pos", "size")], names=["t1", "t2", "pos", "size"])


def chunk_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs (struct row, text, t1, t2) with `ranges`: packed start and end bytes of the chunks to remove.

    A chunk goes where its digest occurred before, in the order of doc_id (null first), text hash and place. Rows
    that agree in doc_id and text count as one document. Null texts read as empty.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", *identity(F.col("doc_id")))
    chunks = rows.select("doc_id", "t1", "t2", "text").mapInArrow(trimmed(_digested), _TYPES)
    home = F.when(F.col("d1").isNull(), F.col("t1")).otherwise(F.col("d1"))
    gone = chunks.repartition(width(docs.sparkSession), home).mapInArrow(trimmed(_repeats), "t1 long, t2 long, pos int, size int")
    packed = F.col("pos").cast("long") * (1 << 24) + F.col("size")
    by = gone.groupBy("t1", "t2").agg(F.collect_list(packed).alias("ranges"))
    return rows.join(by, ["t1", "t2"], "left").select("row", "text", "ranges")


def _ranges(packed: np.ndarray, size: int, least: int) -> np.ndarray:
    """Runs of repeated chunks of `least` bytes or more, or all of a text of `size` bytes."""
    runs = merged(np.stack([packed >> 24, (packed >> 24) + (packed & 0xFFFFFF)], 1))
    n = runs[:, 1] - runs[:, 0]
    return runs[(n >= least) | (n == size)]


def deduplicated_text(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """doc_id, text without its repeated chunks, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs: see chunk_repeats.

    Repeated chunks go where they make up `least_run` bytes side by side, or a whole text. A document whose chunks all
    occurred before keeps an empty text. An empty table gives no rows.
    """
    prepare(docs.sparkSession)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for text, packed in zip(texts_of(b), lists_of(b.column("ranges")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                runs = _ranges(packed, len(data), least_run)
                kept = without(data, runs)
                out.append((kept.decode("utf-8", "surrogatepass"), len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.string())], names=["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = chunk_repeats(docs.select("doc_id", "text")).select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "ranges")
    return rows.mapInArrow(trimmed(cut), "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
