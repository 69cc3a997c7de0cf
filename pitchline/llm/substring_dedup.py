"""Operator 2: substring dedup. Word windows that occur anywhere else are found by FM-indexes of content-defined shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline.llm.common import small_batches, table
from pitchline.llm.fm_index import repeated
from pitchline.llm.registry import register
from pitchline.llm.text import Words, cut, list_column, mix, ragged, range_hashes, slices
from pitchline.session import materialize

WINDOW, ANCHOR = 35, 8
#: Words in one index. A shard holds whole keys, so it may exceed this by the sequences of one key.
SHARD_WORDS = 400_000
#: A key with more distinct segments is filed window by window.
HOT = 50_000
_OTHER = np.uint64(0xD1B54A32D192ED03)


def _contents(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice 64 bits that stand for the words of each range."""
    return range_hashes(h, starts, ends).view(np.int64), range_hashes(mix(h ^ _OTHER), starts, ends).view(np.int64)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost least value among each ``span`` consecutive ones."""
    best, place, width = values, np.arange(len(values)), 1
    while width < span:
        step = min(width, span - width)
        right = best[step:] < best[:-step]
        best, place = np.where(right, best[step:], best[:-step]), np.where(right, place[step:], place[:-step])
        width += step
    return place


def segments(words: Words, window: int, anchor: int) -> dict[str, np.ndarray]:
    """Runs of windows of one document that share an anchor: the least-hashed run of ``anchor`` words of each.

    Equal windows have equal anchors, wherever they stand, so all their occurrences come under one key. Columns: doc, start
    (first window), windows, key (hash of the anchor), content (hash of all words; compared under one key only).
    """
    h, owner = words.hashes(), words.owner()
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return dict.fromkeys(("doc", "start", "windows", "key", "content"), none)
    heads = np.arange(len(h) - anchor + 1)
    shingle = range_hashes(h, heads, heads + anchor)
    place = _least(mix(shingle), window - anchor + 1)
    valid = owner[:n] == owner[window - 1:]
    begin = np.ones(n + 1, bool)
    begin[1:n] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1]) | (owner[1:n] != owner[:n - 1])
    edges = np.flatnonzero(begin)
    at, count = edges[:-1], np.diff(edges)
    at, count = at[valid[at]], count[valid[at]]
    content = range_hashes(h, at, at + count + window - 1).view(np.int64)
    doc = owner[at]
    return {"doc": doc, "start": at - words.first[doc], "windows": count, "key": shingle[place[at]].view(np.int64), "content": content}


def _rows(docs: DataFrame) -> DataFrame:
    """``id`` and ``row`` together name a row by its id and its text; rows equal in both have equal windows anyway."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63)).alias("id"),
                       F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), "doc_id", "text")


_SEGMENT = "id long, row long, start int, windows int, key long, content long"


def _filed(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for low, _, data, bounds in slices(batch.column(2)):
                s = segments(cut(data, bounds), window, anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[low + s["doc"]]), pa.array(rows[low + s["doc"]]), pa.array(s["start"], pa.int32()),
                     pa.array(s["windows"], pa.int32()), pa.array(s["key"]), pa.array(s["content"])],
                    ["id", "row", "start", "windows", "key", "content"])

    return _rows(docs).select("id", "row", "text").mapInArrow(run, _SEGMENT)


_UNIT = "id long, row long, start int, key long, content long, times long, words binary"


def _units(docs: DataFrame, wanted: DataFrame, window: int, spread: bool) -> DataFrame:
    """The words (as hashes) of the wanted segments; with ``spread`` window by window, each under a key of its own words."""
    asked = wanted.groupBy("id", "row").agg(F.collect_list(F.struct("start", "windows", "key", "content", "times")).alias("asked"))
    joined = _rows(docs).join(asked.hint("shuffle_hash"), ["id", "row"]).select("id", "row", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            doc_of = np.repeat(np.arange(len(sizes)), sizes)
            flat = {name: column.to_numpy(zero_copy_only=False) for name, column in zip(
                ("start", "windows", "key", "content", "times"), lists.flatten().flatten())}
            for low, high, data, bounds in slices(batch.column(2)):
                words = cut(data, bounds)
                h = words.hashes()
                own = np.flatnonzero((doc_of >= low) & (doc_of < high))
                f = {name: c[own] for name, c in flat.items()}
                doc = doc_of[own]
                at = words.first[doc - low] + f["start"]
                if spread:
                    count = f["windows"].astype(np.int64)
                    start = ragged(f["start"].astype(np.int64), count)
                    doc, times, at = np.repeat(doc, count), np.repeat(f["times"], count), ragged(at, count)
                    size = np.full(len(at), window)
                    key, content = _contents(h, at, at + size)
                else:
                    start, key, content, times, size = f["start"], f["key"], f["content"], f["times"], f["windows"] + window - 1
                offsets = np.concatenate([[0], np.cumsum(size.astype(np.int64) * 8)]).astype(np.int32)
                body = pa.py_buffer(h[ragged(at, size.astype(np.int64))].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc]), pa.array(rows[doc]), pa.array(start, pa.int32()), *(pa.array(c) for c in (key, content, times)),
                     pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), body])],
                    ["id", "row", "start", "key", "content", "times", "words"])

    return joined.mapInArrow(run, _UNIT)


def _matches(units: DataFrame, window: int) -> DataFrame:
    """``key``, ``content`` and, per run of repeated windows in them, ``low`` and ``high``: an index per shard of whole keys."""
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.select("key", "content", "times", "words").repartition(parts, "key").sortWithinPartitions("key")

    def search(held: list[dict]) -> pa.RecordBatch:
        words = np.frombuffer(b"".join(w for part in held for w in part["words"]), np.uint64)
        lengths = np.array([len(w) // 8 for part in held for w in part["words"]])
        key, content, times = (np.concatenate([part[c] for part in held]) for c in ("key", "content", "times"))
        which, low, high = repeated(words, lengths, times, window)
        return pa.RecordBatch.from_arrays([pa.array(key[which]), pa.array(content[which]), pa.array(low, pa.int32()),
                                           pa.array(high, pa.int32())], ["key", "content", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            part = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(("key", "content", "times"))}
            part["words"] = batch.column(3).to_pylist()
            if total >= SHARD_WORDS:                   # close the shard where the next key begins
                cuts = np.flatnonzero(part["key"] != held[-1]["key"][-1])
                at = int(cuts[0]) if len(cuts) else len(part["key"])
                held.append({c: v[:at] for c, v in part.items()})
                part = {c: v[at:] for c, v in part.items()}
                if len(part["key"]):
                    yield search(held)
                    held, total = [], 0
            if len(part["key"]):
                held.append(part)
                total += sum(len(w) for w in part["words"]) // 8
        if held:
            yield search(held)

    return dealt.mapInArrow(run, "key long, content long, low int, high int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """``id``, ``row``, ``spans`` (structs ``low``, ``high``): words covered by windows that start anywhere else, too.

    1. Anchors are counted. A window that occurs twice has an anchor that does, so all others are done with.
    2. Segments under the remaining anchors are reduced to distinct ones with their number of copies, and the words of
       one copy of each are fetched.
    3. Segments are dealt out by anchor. A shard of whole anchors is indexed and its segments are streamed through the index.
    4. What was found holds for every copy of the segment.

    An anchor with over ``hot`` distinct segments (the edge of a passage that very many documents share) would be too much for
    one index; its windows are filed one by one under their own words instead, so that equal windows are
    summed before they meet and different ones spread over all tasks.
    """
    small_batches(docs.sparkSession)
    counts = _filed(docs, window, anchor).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keys = materialize(counts.select("key"), "anchors")
    cold = materialize(_filed(docs, window, anchor).join(keys, "key", "left_semi"), "segments")
    lead = F.min(F.struct("id", "row", "start"))
    one = materialize(cold.groupBy("key", "content", "windows").agg(F.count(F.lit(1)).alias("times"), lead.alias("lead"))
                      .select("lead.*", "windows", "key", "content", "times"), "distinct")
    crowded = materialize(one.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("key"), "crowded")
    on, columns, found = ["key", "content"], ["id", "row", "start", "low", "high"], []
    if not crowded.isEmpty():
        warm = cold.join(crowded, "key", "left_semi").withColumn("times", F.lit(1).cast("long"))
        cold, one = (frame.join(crowded, "key", "left_anti") for frame in (cold, one))
        units = materialize(_units(docs, warm, window, True), "windows")
        distinct = units.groupBy(*on).agg(F.sum("times").alias("times"), F.first("words").alias("words"))
        found.append(units.drop("words", "times").join(materialize(_matches(distinct, window), "matches"), on).select(*columns))
    found.append(cold.join(materialize(_matches(_units(docs, one, window, False), window), "matches"), on).select(*columns))
    spans = reduce(DataFrame.unionByName, found)
    low, high = F.col("start") + F.col("low"), F.col("start") + F.col("high") + window
    return spans.groupBy("id", "row").agg(F.collect_set(F.struct(low.alias("low"), high.alias("high"))).alias("spans"))


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def drop_repeated_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, keep_text: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, with ``keep_text``, the kept words as ``text``.

    A word is removed if a window of ``window`` words that covers it starts anywhere else in the input, the same document
    included. Words are what lies between the six ASCII blanks, kept words are joined by one space; a null text has
    none. Rows repeated under one id count as two places, so texts of ``window`` words lose them all. A null id stays null.
    """
    spans = materialize(repeated_windows(docs, window, anchor, hot), "spans")        # so that the texts are shuffled once for them
    joined = _rows(docs).join(spans.hint("shuffle_hash"), ["id", "row"], "left").select("doc_id", "text", "spans.low", "spans.high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, lows, highs in zip(*(batch.column(i) for i in (1, 2, 3))):
                words = (text.as_py() or "").encode().split()
                kept, n = words, len(words)
                if lows.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, lows.values.to_numpy(), 1)
                    np.add.at(edge, highs.values.to_numpy(), -1)
                    open_ = np.cumsum(edge[:-1]) == 0
                    kept = [w for w, k in zip(words, open_.tolist()) if k]
                body = b" ".join(kept)
                out.append((n, n - len(kept), hashlib.sha256(body).hexdigest(), *([body.decode()] if keep_text else [])))
            if not out:
                continue
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "text"][:1 + len(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    return joined.select(F.col("doc_id").cast("long"), "text", "low", "high").mapInArrow(run, _RESULT + (", text string" if keep_text else ""))


@register("op2_fm_index_substrings")
def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_substrings(table(spark, sf_dir, "documents"), keep_text=False)
