"""Operator 6: token ids in word-aligned Simple-8b files, written by Spark and read back."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchline.llm.common import small_batches, table
from pitchline.llm.parts import Parts
from pitchline.llm.registry import register
from pitchline.llm.text import SLICE, slices
from pitchline.session import scratch_path

# --- coding: a 64-bit word is a 4-bit selector and 60 bits that hold COUNT values of WIDTH bits each -----------------

COUNT = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)      # fixed values of the code
WIDTH = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_COUNTS = np.array([*COUNT[:14], 2, 1])
#: Selector 15 with this bit set isn't a value of 60 bits but the place of a wider one in the table of escapes.
ESCAPE = 1 << 59
BLOCK = 1024
MAGIC = b"PLS8"
_HEAD = struct.Struct("<4sIQQQQQ")


def _selectors(values: np.ndarray) -> np.ndarray:
    """Selector of each word and, with it, a mask of where words begin: both in a (blocks x BLOCK) layout."""
    blocks = -(-len(values) // BLOCK)
    width = np.full((blocks, BLOCK), 255, np.uint8)
    flat = width.reshape(-1)
    bits = np.zeros(len(values), np.uint8)
    for w in range(1, 61):
        over = values >= (1 << (w - 1))
        if not over.any():
            break
        bits += over
    bits[values >= ESCAPE] = 60
    flat[:len(values)] = bits

    def ahead(a: np.ndarray, k: int) -> np.ndarray:
        out = np.full_like(a, 255)
        out[:, :-k] = a[:, k:]
        return out

    widest = {1: width}                                # the widest of the next n values, 255 beyond the block
    for n, a, b in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4),
                    (15, 8, 7), (20, 10, 10), (30, 20, 10), (60, 30, 30), (120, 60, 60), (240, 120, 120)):
        widest[n] = np.maximum(widest[a], ahead(widest[b], a))
    best = np.full((blocks, BLOCK), 15, np.uint8)
    for s in range(14, -1, -1):
        best[widest[COUNT[s]] <= WIDTH[s]] = s
    begins = np.zeros((blocks, BLOCK), bool)
    lengths = np.full(blocks, BLOCK)
    lengths[-1:] = len(values) - (blocks - 1) * BLOCK
    lane, place = np.arange(blocks), np.zeros(blocks, np.int64)
    counts = np.array(COUNT)
    while len(lane):                                   # all blocks move on by one word at a time
        begins[lane, place] = True
        place += counts[best[lane, place]]
        open_ = place < lengths[lane]
        lane, place = lane[open_], place[open_]
    return best, begins


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block (one more than blocks) and escapes of unsigned 64-bit values."""
    values = np.ascontiguousarray(values, np.uint64)
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.uint64)
    wide = values >= ESCAPE
    escapes = values[wide]
    best, begins = _selectors(values)
    if len(escapes):
        values = values.copy()
        values[wide] = np.arange(len(escapes), dtype=np.uint64) | np.uint64(ESCAPE)
    at = np.flatnonzero(begins)
    selector = best.reshape(-1)[at]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        if WIDTH[s]:
            of = np.flatnonzero(selector == s)
            for k in range(COUNT[s]):
                words[of] |= values[at[of] + k] << np.uint64(k * WIDTH[s])
    offsets = np.concatenate([[0], np.cumsum(begins.sum(1))]).astype(np.uint64)
    return words, offsets, escapes


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of whole blocks of words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNT)[selector]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector):
        if WIDTH[s]:
            of, mask = np.flatnonzero(selector == s), np.uint64((1 << WIDTH[s]) - 1)
            for k in range(COUNT[s]):
                out[at[of] + k] = (words[of] >> np.uint64(k * WIDTH[s])) & mask
    wide = np.flatnonzero(out >= ESCAPE)
    if len(wide):
        out[wide] = escapes[(out[wide] ^ np.uint64(ESCAPE)).astype(np.int64)]
    return out


def to_bytes(doc_ids: np.ndarray, known: np.ndarray, ends: np.ndarray, values: np.ndarray) -> bytes:
    """A file: head, ids of its documents (and whether they have one), end of each in ids, block offsets, words, escapes."""
    words, offsets, escapes = pack(values)
    head = _HEAD.pack(MAGIC, BLOCK, len(doc_ids), len(values), len(offsets), len(words), len(escapes))
    parts = (doc_ids.astype("<i8"), known.astype("<i8"), ends.astype("<u8"), offsets.astype("<u8"), words.astype("<u8"), escapes.astype("<u8"))
    return head + b"".join(p.tobytes() for p in parts)


class Reader:
    """One file. ``ids(low, high)`` decodes only the blocks that hold the range."""

    def __init__(self, data: bytes) -> None:
        magic, self.block, docs, self.n_ids, blocks, words, escapes = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        sizes, at, parts = (docs, docs, docs, blocks, words, escapes), _HEAD.size, []
        for kind, n in zip(("<i8", "<i8", "<u8", "<u8", "<u8", "<u8"), sizes):
            parts.append(np.frombuffer(data, kind, n, at))
            at += 8 * n
        self.doc_ids, self.known, self.ends, self.offsets, self.words, self.escapes = parts

    def ids(self, low: int = 0, high: int | None = None) -> np.ndarray:
        high = self.n_ids if high is None else high
        if low >= high:
            return np.zeros(0, np.uint64)
        first, last = low // self.block, -(-high // self.block)
        part = self.words[int(self.offsets[first]):int(self.offsets[last])]
        return unpack(part, self.escapes)[low - first * self.block:high - first * self.block]


# --- tokens ----------------------------------------------------------------------------------------------------------

class Encoder(Parts):
    """Ids of whole texts, the same as the library's plain call on each.

    Added tokens (such as ``<|endoftext|>``) stay what they are to the library: a text that holds one is encoded whole, as are all texts
    where the pre-tokenizer isn't the usual byte-level one.
    """

    LIMIT = 800_000
    RUN = 512                                          # parts that the library gets as one text

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        before = described.get("pre_tokenizer") or {}
        usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        size = self.tokenizer.get_vocab_size()
        #: Tokens that begin with a space. A space in front of another character always begins a piece, so it begins a token, too.
        self.spaced = np.fromiter(((self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)), bool, size)
        super().__init__(self._library, usual and not described.get("normalizer"),
                         [t["content"].encode() for t in described.get("added_tokens") or []])

    def _library(self, parts: list[bytes]) -> list[list[int]]:
        texts = [p.decode("utf-8", "replace") for p in parts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _found(self, parts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Parts of one space and what follows it are encoded many at a time and parted again where tokens begin with a space."""
        if not self.cuts:
            return super()._found(parts)
        plain, others = [], []
        for part in parts:
            (plain if part[:1] == b" " and len(part) > 1 and part.count(b" ") == 1 else others).append(part)
        others, flat, size = super()._found(others)
        runs = self._library([b"".join(plain[low:low + self.RUN]) for low in range(0, len(plain), self.RUN)])
        run = np.concatenate([np.zeros(0, np.uint32), *(np.array(ids, np.uint32) for ids in runs)])
        ends = np.append(np.flatnonzero(self.spaced[run]), len(run))
        if len(ends) != len(plain) + 1:
            raise ValueError("a token goes on over the begin of a part")
        return plain + others, np.concatenate([run, flat]), np.concatenate([np.diff(ends), size])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- files -----------------------------------------------------------------------------------------------------------

_FILES = "part int, seq int, first long, n_docs long, n_ids long, content binary"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, file_ids: int = 250_000) -> DataFrame:
    """Encode ``docs`` into token files of about ``file_ids`` ids and return them, one row each (``content`` holds the bytes).

    Documents stand in ascending ``doc_id`` order over all files (nulls first; rows repeated under one id in order of their
    text) and end with ``end_id``. A null text is empty. The texts are dealt out by ranges of ``doc_id``; a task holds one file
    at a time. The files are the rows of a Parquet table under ``folder``, so any store that Spark writes to will do and
    Spark's commit decides which attempt counts. ``first`` is the number of ids before a file in its ``part``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq, first = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, first
            doc_ids, known, sizes, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first]), pa.array([len(sizes)]), pa.array([len(ids)]),
                 pa.array([to_bytes(doc_ids, known, np.cumsum(sizes), ids)], pa.binary())],
                ["part", "seq", "first", "n_docs", "n_ids", "content"])
            seq, first = seq + 1, first + len(ids)
            return row

        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            doc_ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for low, high, data, bounds in slices(batch.column(1), min(SLICE, 4 * file_ids)):
                ids, sizes = own.encode(data, bounds)
                out = np.full(len(ids) + high - low, end_id, np.uint64)
                out[np.arange(len(ids)) + np.repeat(np.arange(high - low), sizes)] = ids
                held.append((doc_ids[low:high], known[low:high], sizes + 1, out))
                if sum(len(h[3]) for h in held) >= file_ids:
                    yield flush()
        if held:
            yield flush()

    ordered.mapInArrow(run, _FILES).write.mode("overwrite").parquet(folder)
    return spark.read.schema(_FILES).parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the token files under ``folder``: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32`` (of its ids as
    little-endian unsigned 32-bit integers). Only the totals of parts are ordered together and broadcast, one row of two numbers per task
    that wrote."""
    files = spark.read.schema(_FILES).parquet(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("all")) \
        .select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(parts), "part").select((F.col("base") + F.col("first")).alias("start"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                reader = Reader(content.as_py())
                ids = reader.ids().astype("<u4")
                ends = reader.ends.astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.doc_ids, pa.int64(), mask=reader.known == 0), pa.array(start + begins),
                     pa.array(ends - begins), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to a new folder of the shared store and read its documents back from the files."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write(docs, folder, tokenizer or tokenizer_path())
    return read(docs.sparkSession, folder)


@register("op6_simple8b_tokens")
def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
