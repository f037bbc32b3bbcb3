"""Token-ID / binary output: whole texts to token ids in checksummed rANS shards, and back."""

from __future__ import annotations

import codecs
import gc
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import new_folder, prepare, trimmed, width

END_ID = 0
#: Characters of one shard at least, but for the last one of a partition; bounds the memory of a task.
SHARD_CHARS = 5_000_000
#: Distinct words in each of two generations whose ids a worker keeps.
KEPT = 300_000
SHARD = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("shard", pa.binary())])
#: Texts of these alone mean the same to any version of the pattern's character classes.
COMMON = re.compile("[\t-\r -~¡-ɏ‐-‧]*")
#: Where one of these is, a word isn't just a run of letters, digits or other signs with a space before it at most.
SPECIAL = ["\t", "\x0b", "\x0c", "\r", "  ", " \n", "\n ", "\n\n", *(f"'{x}" for x in ("s", "t", "m", "d", "re", "ve", "ll"))]
#: The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = sorted({*range(256)} - {*_PLAIN})
SIGNS = "".join(chr(b) if b in _PLAIN else chr(256 + _OTHERS.index(b)) for b in range(256))
#: Kinds of characters below U+0250: letter, number, other sign, space, line feed.
LETTER, NUMBER, OTHER, SPACE, FEED = range(5)
KINDS = np.array([SPACE if c == 32 else FEED if c == 10 else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x250)], np.uint8)
#: Settings of the tokenizer under which its words are known here.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_TOKENIZERS: dict = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes at which the byte-level pre-tokenizer's words begin, in UTF-8 texts of common characters without anything
    SPECIAL that begin at `starts`: runs of one kind, with a space before them at most, and line feeds."""
    kind = KINDS[np.minimum(data, 127)]
    kind[data > 127] = OTHER
    two = np.flatnonzero((data > 0xC1) & (data < 0xCA))
    kind[two] = kind[two + 1] = KINDS[(data[two] & 31).astype(np.int32) << 6 | data[two + 1] & 63]
    new = np.ones(len(data), bool)
    new[1:] = ((kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)) | (kind[1:] == FEED)
    new[starts[starts < len(data)]] = True
    return np.flatnonzero(new)


class Pieces:
    """Encodes texts with the tokenizers library, which merges each distinct word once.

    A byte-level pre-tokenizer cuts a text into words, and the ids of a text are those of its words, one after another.
    Words of plain texts are cut all at once, those of texts that hold something SPECIAL by the published pattern.
    Texts with other than common characters and those that hold an added token go to the library as they are, as do all
    texts if its settings aren't those of a byte-level pre-tokenizer.
    """

    def __init__(self, path: str):
        import os

        import public_tokenizers
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        self.contents = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        about = json.loads(Path(path).read_text(encoding="utf-8"))
        model, cutter = about["model"], about["pre_tokenizer"] or {}
        self.byte_level = about["normalizer"] is None and model["type"] == "BPE" and BYTE_LEVEL.items() <= cutter.items()
        # the library's merges without its own cache of words: those met are kept here
        self.merges = BPE(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], cache_capacity=0) if self.byte_level else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        known, older, tokenize, code = self.known, self.older.get, self.merges.tokenize, self.code
        new = [w for w in words if w not in known]
        signs = codecs.charmap_decode("\0".join(new).encode(), "strict", SIGNS)[0].split(SIGNS[0]) if new else []
        for w, s in zip(new, signs, strict=True):
            known[w] = older(w) or array(code, [t.id for t in tokenize(s)]).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of each text's."""
        own = [self.byte_level and COMMON.fullmatch(t) is not None and not any(c in t for c in self.contents) for t in texts]
        special = [o and any(x in t for x in SPECIAL) for o, t in zip(own, texts, strict=True)]
        others = iter(self._whole([t for o, t in zip(own, texts, strict=True) if not o]))
        found = [self.pattern.findall(t) if s else () for s, t in zip(special, texts, strict=True)]
        plain = pa.array([t if o and not s else "" for t, o, s in zip(texts, own, special, strict=True)], pa.large_string())
        at = np.frombuffer(plain.buffers()[1], np.int64)[: len(texts) + 1]
        data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[: at[-1]]
        starts = word_starts(data, at[:-1])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data))
        coded = words.dictionary_encode() if len(starts) else pa.array([], pa.large_string()).dictionary_encode()
        distinct, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self._learn([*distinct, *{w for f in found for w in f}.difference(distinct)])
        known = self.known
        # the table's rows: distinct words, then for each text what it is that isn't plain
        rows = [known[w] for w in distinct]
        rows += [b"".join([known[w] for w in f]) if o else next(others) for f, o in zip(found, own, strict=True)]
        size = np.fromiter(map(len, rows), np.int64, len(rows)) // np.dtype(self.kind).itemsize
        table, begin = np.frombuffer(b"".join(rows), self.kind), np.cumsum(size) - size
        cut = np.searchsorted(starts, at[:-1])
        place = np.insert(place, cut, len(distinct) + np.arange(len(texts)))
        n = size[place]
        ends = np.cumsum(n)
        source = np.repeat(begin[place] - (ends - n), n)
        source += np.arange(len(source))
        last = np.append(cut[1:] + np.arange(1, len(texts)), len(place)) - 1 if len(texts) else np.zeros(0, np.int64)
        return table[source], np.diff(np.append(0, ends[last]))


def pieces(path: str) -> Pieces:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Pieces(path)
    return _TOKENIZERS[path]


def encode_tokens(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = END_ID) -> str:
    """Writes the ids of docs (doc_id, text) in ascending doc_id order to path and gives path back.

    Ids are those of the tokenizer's plain encode(text, add_special_tokens=False).
    Rows of a doc_id that repeats follow each other by the hash of their text and then the text; a null doc_id
    comes first; a null text counts as empty and so holds the end id only; further columns are not read. An empty
    table gives a folder without shards. Memory of a task: one shard and the longest document.
    """
    spark, vocab = docs.sparkSession, vocab or vocabulary()
    prepare(spark)

    def shards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = pieces(vocab), TaskContext.get().partitionId(), 0
        keys, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, texts, held, seq
            ids, sizes = coder.encode(texts)
            all_ids = np.full(len(ids) + len(sizes), end_id, coder.kind)
            own = np.ones(len(all_ids), bool)
            own[np.cumsum(sizes + 1) - 1] = False
            all_ids[own] = ids
            out = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_ids": len(all_ids), "shard": rans.pack(all_ids, keys, sizes + 1)}], schema=SHARD)
            keys, texts, held, seq = [], [], 0, seq + 1
            return out

        gc.disable()  # the caches hold many small objects and no cycles
        try:
            for b in it:
                keys += b.column("doc_id").to_pylist()
                new = [x or "" for x in b.column("text").to_pylist()]
                texts += new
                held += sum(map(len, new))
                if held >= SHARD_CHARS:
                    yield flush()
            if keys:
                yield flush()
        finally:
            gc.enable()

    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(width(spark), F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie, "text")
    ordered.mapInArrow(trimmed(shards), "part int, seq int, n_ids long, shard binary").write.mode("overwrite").option("compression", "none").parquet(path)
    return path


def _index(shards: DataFrame) -> DataFrame:
    """Ids before each shard: sums by part first, so no task sees more rows than there are parts."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return shards.select("part", "seq", own.alias("own")).join(before, "part").select("part", "seq", (F.col("before") + F.col("own")).alias("first"))


def decode_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, seq, pos (ids before it in its shard), ids (little-endian unsigned 32-bit integers)."""
    prepare(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("pos", pa.int64()), ("ids", pa.binary())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, seq, shard in zip(b.column("part").to_pylist(), b.column("seq").to_pylist(), b.column("shard"), strict=True):
                keys, sizes, ids = rans.unpack(shard.as_py())
                ends = np.cumsum(sizes, dtype=np.int64)
                for k in range(0, len(keys), 1000):
                    own = range(k, min(k + 1000, len(keys)))
                    yield pa.RecordBatch.from_pylist([{"doc_id": keys[i], "part": part, "seq": seq, "pos": int(ends[i] - sizes[i]), "ids": ids[ends[i] - sizes[i] : ends[i]].astype("<u4").tobytes()} for i in own], schema=schema)

    return spark.read.schema("part int, seq int, n_ids long, shard binary").parquet(path).mapInArrow(trimmed(rows), "doc_id long, part int, seq int, pos long, ids binary")


def token_digests(docs: DataFrame) -> DataFrame:
    """Encodes docs, reads the files back: doc_id, start, n_tokens, ids_crc32 of each document (see encode_tokens)."""
    spark = docs.sparkSession
    path = encode_tokens(docs, new_folder(spark, "tokens"))
    read = decode_tokens(spark, path).select("doc_id", "part", "seq", "pos", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    index = _index(spark.read.schema("part int, seq int, n_ids long, shard binary").parquet(path).select("part", "seq", "n_ids"))
    return read.join(index, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("pos")).alias("start"), "n_tokens", "ids_crc32")
