"""Static range asymmetric numeral system over token ids, vectorised over the lanes of all blocks of a shard.

A shard is one byte string:

    magic, counts | document index | frequency table | block directory | blocks

The frequency table is shared by all blocks of the shard. A block holds BLOCK ids dealt over LANES interleaved
coder states (id t*LANES+k belongs to lane k) and one stream of 32-bit words. Its directory entry has the number
of ids, the number of words and a CRC-32 of its bytes. Checkpoints (all lane states and the place in the word
stream) stand before step 0 and then every STRIDE steps, so each stretch between two of them can be decoded alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, STEPS, STRIDE, SCALE = 64, 1024, 256, 16
BLOCK = LANES * STEPS
MAGIC = b"SFRANS01"
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<8sIIQI")


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols present, their frequencies, at least 1 each, 2**SCALE in all, and the symbols' places by id."""
    all_counts = np.bincount(ids, minlength=1)
    symbols = np.flatnonzero(all_counts)
    counts = all_counts[symbols]
    room = (1 << SCALE) - len(symbols)
    if room < 0:
        raise ValueError(f"more than {1 << SCALE} symbols in one shard")
    f = 1 + counts * room // max(1, counts.sum())
    if len(f):
        f[np.argmax(f)] += (1 << SCALE) - f.sum()
    places = np.zeros(len(all_counts), np.int32)
    places[symbols] = np.arange(len(symbols))
    return symbols, f.astype(np.uint64), places


def _encode(sym: np.ndarray, f: np.ndarray, cum: np.ndarray):
    """sym: (blocks, steps, lanes) places in the table. Gives words, which were sent, and the checkpoint states."""
    nb, steps, lanes = sym.shape
    x = np.full((nb, lanes), LOW, np.uint64)
    words, sent = np.zeros(sym.shape, np.uint32), np.zeros(sym.shape, bool)
    marks = np.zeros((nb, -(-steps // STRIDE), lanes), np.uint64)
    s16, s32, s47 = np.uint64(SCALE), np.uint64(32), np.uint64(47)
    for t in range(steps - 1, -1, -1):
        s = sym[:, t]
        fs = f[s]
        over = x >= (fs << s47)
        sent[:, t] = over
        words[:, t] = x.astype(np.uint32)
        x = np.where(over, x >> s32, x)
        q = x // fs
        x = (q << s16) + (x - q * fs) + cum[s]
        if t % STRIDE == 0:
            marks[:, t // STRIDE] = x
    return words, sent, marks


def _blocks(sym: np.ndarray, f: np.ndarray, cum: np.ndarray, n: list[int]) -> list[tuple[int, int, bytes]]:
    words, sent, marks = _encode(sym, f, cum)
    out = []
    for b in range(len(sym)):
        stream = words[b][sent[b]]
        before = np.concatenate([[0], np.cumsum(sent[b].sum(1))])[: -1 : STRIDE].astype("<u4")
        out.append((n[b], len(stream), before.tobytes() + marks[b].astype("<u8").tobytes() + stream.astype("<u4").tobytes()))
    return out


def pack(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    """One shard from the ids of whole documents, in order; lengths: ids of each document."""
    symbols, f, places = frequencies(ids)
    cum = np.concatenate([[0], np.cumsum(f)])[:-1].astype(np.uint64)
    sym = places[ids]
    full = len(sym) // BLOCK
    blocks = _blocks(sym[: full * BLOCK].reshape(full, STEPS, LANES), f, cum, [BLOCK] * full) if full else []
    if rest := len(sym) - full * BLOCK:
        last = np.full(-(-rest // LANES) * LANES, int(np.argmax(f)), np.int32)
        last[:rest] = sym[full * BLOCK :]
        blocks += _blocks(last.reshape(1, -1, LANES), f, cum, [rest])
    directory = b"".join(struct.pack("<III", n, w, zlib.crc32(x)) for n, w, x in blocks)
    known = np.array([x is not None for x in doc_ids], "u1")
    index = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + known.tobytes() + np.asarray(lengths, "<u4").tobytes()
    tables = symbols.astype("<u4").tobytes() + (f - np.uint64(1)).astype("<u2").tobytes()
    return HEAD.pack(MAGIC, len(doc_ids), len(symbols), len(ids), len(blocks)) + index + tables + directory + b"".join(x for _, _, x in blocks)


def _decode(stream: np.ndarray, x: np.ndarray, at: np.ndarray, steps: int, slots: np.ndarray, f: np.ndarray, cum: np.ndarray) -> np.ndarray:
    """Decodes many stretches in step. stream: words of all of them; x: (stretches, lanes) states; at: first words."""
    out = np.empty((len(x), steps, x.shape[1]), np.int32)
    low, s16, s32 = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    stream = np.append(stream, np.uint32(0))
    for t in range(steps):
        slot = x & low
        s = slots[slot]
        out[:, t] = s
        x = f[s] * (x >> s16) + slot - cum[s]
        need = x < LOW
        place = np.cumsum(need, axis=1)
        word = stream[np.minimum(at[:, None] + place - 1, len(stream) - 1)]
        x = np.where(need, (x << s32) | word, x)
        at = at + place[:, -1]
    return out


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """document ids, lengths and token ids of a shard. Raises ValueError where a checksum does not hold."""
    magic, nd, ns, n, nb = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        a = np.frombuffer(data, kind, count, at)
        at += a.nbytes
        return a

    docs, known, lengths = take("<i8", nd), take("u1", nd), take("<u4", nd)
    symbols, f = take("<u4", ns), take("<u2", ns).astype(np.uint64) + np.uint64(1)
    directory = take("<u4", 3 * nb).reshape(nb, 3)
    cum = np.concatenate([[0], np.cumsum(f)])[:-1].astype(np.uint64)
    slots = np.repeat(np.arange(ns, dtype=np.int32), f.astype(np.int64))
    states, places, sizes, streams, base = [], [], [], [], 0
    for m, w, crc in directory.tolist():
        steps = -(-m // LANES)
        marks = -(-steps // STRIDE)
        if zlib.crc32(data[at : at + marks * (4 + 8 * LANES) + 4 * w]) != crc:
            raise ValueError("a block's checksum does not hold")
        places.append(take("<u4", marks).astype(np.int64) + base)
        states.append(take("<u8", marks * LANES).reshape(marks, LANES))
        streams.append(take("<u4", w))
        sizes += [min(STRIDE, steps - k * STRIDE) for k in range(marks)]
        base += w
    ids = np.empty(n, np.uint32)
    if nb:
        x, p, stream, size = np.concatenate(states).astype(np.uint64), np.concatenate(places), np.concatenate(streams), np.array(sizes)
        ends = np.cumsum(size * LANES)
        for steps in np.unique(size):
            own = np.flatnonzero(size == steps)
            got = symbols[_decode(stream, x[own], p[own], int(steps), slots, f, cum)].reshape(len(own), -1)
            for k, g in zip(own, got, strict=True):
                start = ends[k] - steps * LANES
                ids[start : ends[k]] = g[: max(0, n - start)]
    return [int(d) if k else None for d, k in zip(docs, known, strict=True)], lengths, ids
