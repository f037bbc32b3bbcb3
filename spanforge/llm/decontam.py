"""Benchmark decontamination: the q-gram lemma over diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, texts_of, trimmed

#: Characters of a q-gram; longer items are looked for by windows, each STEP characters, so a passage of an item of
#: WINDOW + STEP - 1 characters is sure to hold a whole window; edits for each character.
Q, WINDOW, STEP, RATE = 10, 80, 40, 0.08
#: Diagonals of a band; bands overlap by the edits of a window, at most WINDOW * RATE.
BAND = 32
#: Characters of the benchmark that one pass holds in each task; a larger benchmark takes more passes.
MAX_CHARS = 8_000_000
_SIZE = 0x110000
_BITS = 22


def _signs() -> np.ndarray:
    """What each code point counts as: letters and digits as themselves, all others as a space."""
    out = np.full(_SIZE, 32, np.uint32)
    for start, stop in ((0, 0xD800), (0xE000, _SIZE)):
        out[start:stop] = [c if chr(c).isalnum() else 32 for c in range(start, stop)]
    return out


_SIGNS: list[np.ndarray] = []


def normalised(text: str) -> np.ndarray:
    """Code points of the text in lower case, with runs of anything but letters and digits as one space, none at the ends."""
    if not _SIGNS:
        _SIGNS.append(_signs())
    codes = _SIGNS[0][np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = codes != 32
    keep[1:] |= codes[:-1] != 32
    codes = codes[keep]
    return codes[int(len(codes) > 0 and codes[0] == 32) : len(codes) - int(len(codes) > 0 and codes[-1] == 32)]


def grams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the q-grams of codes."""
    h, power = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
    full, out, done, s = np.uint64(power), None, 0, 1
    with np.errstate(over="ignore"):
        while done < Q:
            if Q & s:
                out = h if out is None else out[: max(0, len(codes) - done - s + 1)] * full + h[done : len(codes) - s + 1]
                done += s
            m = max(0, len(h) - s)
            h = h[:m] * full + h[s : s + m]
            full = full * full
            s *= 2
        return (out ^ out >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9) if len(codes) >= Q else np.zeros(0, np.uint64)


class Patterns:
    """Windows of the items, their q-grams and bounds. A window shares at least `size - Q + 1 - Q * edits` q-grams
    with a place that it matches within its edits. Of a window's q-grams the most frequent may be left out as long as
    the bound, less one for each, stays above half of what it was: the lemma holds for those that are left."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.codes, self.short = [], [], []
        for item, text in items:
            codes = normalised(text)
            if not len(codes):
                continue
            if len(codes) < Q:
                self.short.append((item, "".join(map(chr, codes))))
                continue
            starts = list(range(0, max(1, len(codes) - WINDOW + 1), STEP))
            if starts[-1] + WINDOW < len(codes):
                starts.append(len(codes) - WINDOW)
            for a in starts:
                self.item.append(item)
                self.codes.append(codes[a : a + WINDOW])
        self.size = np.array([len(c) for c in self.codes], np.int64)
        # as many edits as leave a q-gram in common, so that the lemma covers all that is looked for
        self.edits = np.minimum(np.floor(self.size * RATE).astype(np.int64), (self.size - Q) // Q)
        bound = self.size - Q + 1 - Q * self.edits
        own = [grams(c) for c in self.codes]
        gram = np.concatenate([*own, np.zeros(0, np.uint64)])
        window = np.repeat(np.arange(len(own)), [len(g) for g in own])
        place = np.concatenate([*(np.arange(len(g)) for g in own), np.zeros(0, np.int64)]).astype(np.int64)
        kinds, inverse, counts = np.unique(gram, return_inverse=True, return_counts=True)
        order = np.lexsort((-counts[inverse], window))
        nth = np.arange(len(order)) - np.searchsorted(window[order], window[order])
        drop = np.zeros(len(gram), bool)
        drop[order] = (nth < (bound // 2)[window[order]]) & (counts[inverse][order] > 8)
        self.bound = bound - np.bincount(window[drop], minlength=len(own))
        order = np.argsort(gram[~drop], kind="stable")
        gram, self.window, self.place = gram[~drop][order], window[~drop][order], place[~drop][order]
        self.kinds, self.start = np.unique(gram, return_index=True)
        self.count = np.diff(np.append(self.start, len(gram)))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.kinds >> np.uint64(64 - _BITS)] = True

    def candidates(self, h: np.ndarray, text: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(text, window, first diagonal of the band, from the text's begin) where enough q-grams of the window lie in a
        band of diagonals of one text. h: q-grams of all texts, one after another; text: the text of each."""
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - _BITS)]) if len(self.kinds) else np.zeros(0, np.int64)
        k = np.searchsorted(self.kinds, h[at])
        k = np.minimum(k, max(0, len(self.kinds) - 1))
        real = self.kinds[k] == h[at] if len(at) else np.zeros(0, bool)
        at, k = at[real], k[real]
        n = self.count[k]
        post = np.repeat(self.start[k] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
        window, own = self.window[post], text[at]
        diagonal = np.repeat(at - begin[own], n) - self.place[post] + WINDOW
        band = diagonal // BAND + 1
        low = diagonal % BAND < self.edits[window]
        pair = (np.repeat(own, n) * len(self.codes) + window) << 28
        key = np.sort(np.concatenate([pair | band, pair[low] | (band[low] - 1)]))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        pair = key[first] >> 28
        kept = np.diff(np.append(first, len(key))) >= self.bound[pair % max(1, len(self.codes))]
        pair, band = pair[kept], (key[first][kept] & ((1 << 28) - 1)) - 1
        return np.stack([pair // max(1, len(self.codes)), pair % max(1, len(self.codes)), band * BAND - WINDOW], 1)

    def distances(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Least edits between each candidate's window and a place of its text, flat[begin[t] : end[t]], on its band's
        diagonals. Nothing outside of the text takes part: there each sign differs from all."""
        least = np.full(len(found), 1 << 30)
        for size in np.unique(self.size[found[:, 1]]) if len(found) else ():
            for own in np.array_split(o := np.flatnonzero(self.size[found[:, 1]] == size), -(-len(o) // 256)):
                w = np.stack([self.codes[k] for k in found[own, 1]])
                slack = int(self.edits[found[own[0], 1]])
                width = BAND + 3 * slack + 1
                base = begin[found[own, 0]] + found[own, 2] - slack
                low, high = begin[found[own, 0]][:, None], end[found[own, 0]][:, None]
                d = np.zeros((len(own), width), np.int32)
                ramp = np.arange(width, dtype=np.int32)
                for i in range(size):
                    place = base[:, None] + i + ramp
                    inside = (place >= low) & (place < high)
                    chars = np.where(inside, flat[np.clip(place, 0, len(flat) - 1)], 0)
                    up = np.full_like(d, 1 << 20)
                    up[:, :-1] = d[:, 1:] + 1
                    d = np.minimum(d + (chars != w[:, i, None]), up)
                    d = np.minimum.accumulate(d - ramp, axis=1) + ramp
                least[own] = d.min(1)
        return least

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, windows matched, least edits) of the texts that hold a window of an item within its edits. What
        is found in a text doesn't depend on the texts beside it."""
        parts = [normalised(t) for t in texts]
        size = np.array([len(p) for p in parts], np.int64)
        flat = np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.uint32)
        end = np.cumsum(size)
        text = np.repeat(np.arange(len(parts)), size)
        h = grams(flat)
        whole = text[: len(h)] == text[Q - 1 :][: len(h)]
        h[~whole] = 0  # q-grams over the end of a text are none
        found = self.candidates(h, text, end - size)
        out: dict[tuple[int, int], list] = {}
        least = self.distances(flat, end - size, end, found)
        for (t, w, _), d in zip(found.tolist(), least.tolist(), strict=True):
            if d <= self.edits[w]:
                held = out.setdefault((t, self.item[w]), [set(), d])
                held[0].add(w)
                held[1] = min(held[1], d)
        for t, p in enumerate(parts if self.short else ()):
            own = f" {''.join(map(chr, p))} "
            for item, words in self.short:
                if f" {words} " in own:
                    out.setdefault((t, item), [{-1}, 0])
        return [(t, item, len(ws), d) for (t, item), (ws, d) in out.items()]


def _passes(benchmark: DataFrame) -> Iterator[Patterns]:
    """Patterns of parts of the benchmark of a bounded size; items without id or text don't count."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = max(1, -(-(items.agg(F.sum(F.char_length("text"))).first()[0] or 0) // MAX_CHARS))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Patterns([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, edits: the documents (doc_id, text) that hold an item of benchmark (item_id, text), or
    one of its windows of WINDOW characters, within RATE edits a character (of fewer than 2 Q characters: none; than 3 Q:
    one). Case and signs don't count. Items of fewer than Q characters match as whole words. Null texts hold nothing; rows with one doc_id give one row an item; an empty
    table on either side gives no rows; further columns are not read. Texts stay where they are: only matches move."""
    spark = docs.sparkSession
    prepare(spark)
    out = None
    for patterns in _passes(benchmark):
        held = spark.sparkContext.broadcast(patterns)

        def search(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in it:
                ids = b.column("doc_id")
                rows = held.value.matches(texts_of(b))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "item_id", "n_windows", "edits"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(search), "doc_id long, item_id long, n_windows int, edits int")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.min("edits").alias("edits"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no item of benchmark: see leaks."""
    prepare(docs.sparkSession)
    schema = docs.schema
    for patterns in _passes(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(patterns)

        def clean(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in it:
                keep = np.ones(b.num_rows, bool)
                keep[[t for t, *_ in held.value.matches(texts_of(b))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(trimmed(clean), schema)
    return docs
