"""Operator 1: benchmark decontamination with a BM25 index of the test items and block-max WAND."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline.llm.common import small_batches, table
from pitchline.llm.registry import register
from pitchline.llm.text import LOWER, RUNS, WORD, Words, cut, list_column, ragged, range_hashes, slices
from pitchline.session import materialize

#: Bytes of item text in one index. More items are split into several, each held against all documents; statistics are those of all items.
INDEX_BYTES = 8 << 20
#: Items of up to so many words share an index and its passages; the next class reaches four times as far.
CLASS_WORDS = 64
BLOCK = 64
K1, B = 1.2, 0.75
_TABLE_BITS = 20


def _letters(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Runs of letters and digits only; punctuation and case don't count."""
    words = cut(data, bounds, RUNS)
    keep = words.kinds == WORD
    starts = words.starts[keep]
    return Words(data, bounds, starts, words.ends[keep], np.searchsorted(starts, bounds), words.kinds[keep])


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words (of the whole sequence if it is shorter)."""
    n = len(h) - size + 1
    if len(h) == 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(max(n, 1))
    return range_hashes(h, starts, np.minimum(starts + size, len(h)))


def _answer_start(text: str) -> int:
    """Where the last sentence or line begins: the answer of an item, what stands before it being the question."""
    marks = [m.end() for m in re.finditer(r"\n|[.?!]\s", text.rstrip())]
    return marks[-1] if marks else len(text)


@dataclass
class Index:
    """Postings by term in item order.

    Impacts are BM25 weights over the least weight of a passage that holds enough of the item's shingles, so such a passage scores 1
    or more against every item.
    """

    terms: np.ndarray         # sorted term hashes
    slots: np.ndarray         # first term of each leading bit pattern, for direct lookup
    first: np.ndarray         # postings of term t are first[t]:first[t + 1]
    items: np.ndarray
    impacts: np.ndarray
    highest: np.ndarray       # per term
    block_first: np.ndarray   # blocks of term t are block_first[t]:block_first[t + 1]
    block_last: np.ndarray    # last item of each block
    block_high: np.ndarray    # highest impact of each block
    essential: np.ndarray     # per posting: the term belongs to those an item can't reach 1 without
    rest: np.ndarray          # per item: what its other terms can add
    item_ids: np.ndarray
    share: np.ndarray         # per item: that least weight as a share of its full weight
    lengths: np.ndarray       # per item: its words
    shingles: list            # per item: its distinct shingles
    asked: list               # per item: which of them lie wholly in the question

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for words that no item has."""
        if not len(self.terms):
            return np.full(len(h), -1)
        slot = (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        at = self.slots[slot]
        end, found = self.slots[slot + 1], np.full(len(h), -1)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            hit = self.terms[at[open_]] == h[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return found


@dataclass
class Statistics:
    """Of all items that have words: their number, their mean length, and the number of items per term (sorted by term)."""

    items: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def _hashed(texts: list[str | None]) -> list[tuple[np.ndarray, int]]:
    """Word hashes of each text and the number of its words that lie in the question."""
    out = []
    for text in texts:
        raw = (text or "").encode()
        words = _letters(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        start = len((text or "")[:_answer_start(text or "")].encode())
        out.append((words.hashes(LOWER), int(np.searchsorted(words.starts, start))))
    return out


def statistics(texts: list[str | None]) -> Statistics:
    """Statistics of a list of items, as ``contaminated`` gathers them from a table."""
    hashes = [h for h, _ in _hashed(texts) if len(h)]
    terms, df = np.unique(np.concatenate([np.unique(h) for h in hashes]), return_counts=True) if hashes else (np.zeros(0, np.uint64), np.zeros(0, int))
    return Statistics(len(hashes), sum(map(len, hashes)) / max(1, len(hashes)), terms, df)


def _least_share(impact: np.ndarray, item: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """What is left of each item's weight without its ``lost`` heaviest terms."""
    order = np.lexsort((-impact, item))
    rank = np.arange(len(order)) - np.searchsorted(item[order], np.arange(len(lost)))[item[order]]
    left = rank >= lost[item[order]]
    return np.bincount(item[order][left], impact[order][left], len(lost))


def build_index(item_ids: np.ndarray, texts: list[str | None], all_items: Statistics, size: int, overlap: float) -> Index:
    """Items without words are left out: nothing can leak of them."""
    parts = _hashed(texts)
    full = [i for i, (h, _) in enumerate(parts) if len(h)]
    hashes, question = [parts[i][0] for i in full], [parts[i][1] for i in full]
    lengths = np.array([len(h) for h in hashes], np.int64)
    owner = np.repeat(np.arange(len(hashes)), lengths)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    terms, number = np.unique(flat, return_inverse=True)
    pair, tf = np.unique(number.astype(np.int64) * max(1, len(hashes)) + owner, return_counts=True)
    term, item = pair // max(1, len(hashes)), pair % max(1, len(hashes))
    df = all_items.df[np.searchsorted(all_items.terms, terms)] if len(terms) else np.zeros(0)
    idf = np.log(1 + (all_items.items - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (lengths / max(1.0, all_items.mean))[item]))
    impact = weight / np.bincount(item, weight, len(hashes))[item]
    shingles, asked, lost = [], [], []
    for h, q in zip(hashes, question):
        every = _shingles(h, size)
        s, at = np.unique(every, return_index=True)
        shingles.append(s)
        asked.append(at + min(size, len(h)) <= q)
        # every distinct term that is lost has a place whose shingle (ending there or beginning there) is missing: no more terms are
        # lost than places of missing shingles
        lost.append(len(s) - _needed(len(s), overlap) + len(every) - len(s))
    share = np.maximum(_least_share(impact, item, np.array(lost, np.int64)), 1e-6) if hashes else np.zeros(0)
    impact = impact / share[item]
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    # an item's commonest terms, up to half of what is needed, can't bring it there alone
    order = np.lexsort((-df[term], item))
    run = np.cumsum(impact[order])
    head = np.searchsorted(item[order], np.arange(len(hashes)))
    run -= (run[head] - impact[order][head])[item[order]]
    essential = np.ones(len(term), bool)
    essential[order[run <= 0.5]] = False
    rest = np.bincount(item[~essential], impact[~essential], len(hashes))
    blocks = (np.diff(first) + BLOCK - 1) // BLOCK
    heads = ragged(np.zeros(len(terms), np.int64), blocks) * BLOCK + np.repeat(first[:-1], blocks)
    tails = np.minimum(heads + BLOCK, np.repeat(first[1:], blocks)) - 1
    slots = np.searchsorted(terms >> np.uint64(64 - _TABLE_BITS), np.arange((1 << _TABLE_BITS) + 1, dtype=np.uint64))
    none = not len(term)
    return Index(terms, slots, first, item, impact, np.zeros(0) if none else np.maximum.reduceat(impact, first[:-1]),
                 np.concatenate([[0], np.cumsum(blocks)]), item[tails] if len(tails) else tails,
                 np.zeros(0) if none else np.maximum.reduceat(impact, heads), essential, rest,
                 np.asarray(item_ids)[full] if full else np.zeros(0, np.int64), share, lengths, shingles, asked)


def _needed(shingles: int, overlap: float) -> int:
    """Distinct shingles that a passage must hold."""
    return ceil(overlap * shingles - 1e-9)


def retrieve(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """Items whose score for a passage with these distinct terms reaches ``threshold``, by block-max WAND."""
    slack = 1e-9
    cursors = []                                       # [item, term, place, postings, blocks]
    for t in terms:
        items = index.items[index.first[t]:index.first[t + 1]].tolist()
        cursors.append([items[0], t, 0, items])
    found = []
    while cursors:
        cursors.sort(key=lambda c: c[0])
        bound, pivot = 0.0, None
        for k, c in enumerate(cursors):
            bound += index.highest[c[1]]
            if bound >= threshold - slack:
                pivot = k
                break
        if pivot is None:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        head, limit, step = cursors[:pivot + 1], 0.0, None
        for c in head:                                 # the block that holds the pivot item, found without reading postings
            low, high = index.block_first[c[1]], index.block_first[c[1] + 1]
            block = low + bisect_left(index.block_last[low:high], item)
            if block < high:
                limit += index.block_high[block]
                end = int(index.block_last[block]) + 1
                step = end if step is None else min(step, end)
        if limit >= threshold - slack:
            if cursors[0][0] == item:
                score = sum(index.impacts[index.first[c[1]] + c[2]] for c in head)
                if score >= threshold - slack:
                    found.append((item, float(score)))
                target = item + 1
            else:
                target = item
        else:                                          # no item before the end of these blocks can reach the threshold
            after = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else None
            target = step if step is not None else item + 1
            target = max(item + 1, target if after is None else min(target, after))
        for c in head:
            if c[0] < target:
                c[2] = bisect_left(c[3], target, c[2])
                c[0] = c[3][c[2]] if c[2] < len(c[3]) else -1
        cursors = [c for c in cursors if c[0] >= 0]
    return found


def _candidates(index: Index, term: np.ndarray, cell: np.ndarray, threshold: float) -> np.ndarray:
    """Cells that begin a passage in which the essential terms of some item leave the threshold in reach."""
    hit = np.flatnonzero(term >= 0)
    counts = np.diff(index.first)[term[hit]]
    postings = ragged(index.first[term[hit]], counts)
    place = np.repeat(cell[hit], counts)
    keep = index.essential[postings]
    postings, place = postings[keep], place[keep]
    width = max(1, len(index.rest))
    key = np.concatenate([place, place - 1]) * width + np.tile(index.items[postings], 2)
    pairs, where = np.unique(key, return_inverse=True)
    total = np.bincount(where, np.tile(index.impacts[postings], 2), len(pairs)) + index.rest[pairs % width]
    return np.unique(pairs[total >= threshold - 1e-9] // width)


def _best_window(at: np.ndarray, which: np.ndarray, width: int, n: int, needed: int) -> np.ndarray | None:
    """Which of ``n`` shingles the fullest run of ``width`` places holds (the first of the fullest), given the places of those met, if they
    are enough."""
    if len(np.unique(which)) < needed:
        return None
    held, distinct, low, best = np.zeros(n, np.int64), 0, 0, (0, 0, 0)
    places, numbers = at.tolist(), which.tolist()
    for high, (place, number) in enumerate(zip(places, numbers)):
        distinct += held[number] == 0
        held[number] += 1
        while places[low] <= place - width:
            held[numbers[low]] -= 1
            distinct -= held[numbers[low]] == 0
            low += 1
        if distinct > best[0]:
            best = (int(distinct), low, high)
    if best[0] < needed:
        return None
    has = np.zeros(n, bool)
    has[which[best[1]:best[2] + 1]] = True
    return has


def _search(index: Index, data: np.ndarray, bounds: np.ndarray, stride: int, size: int, overlap: float, part: float) -> dict:
    """Verified (document, item) -> (score, overlap, question, answer) of one slice. A passage is two strides, half overlapping; a
    stride is at least twice as long as any item of the index."""
    words = _letters(data, bounds)
    h, owner = words.hashes(LOWER), words.owner()
    counts = np.diff(words.first)
    cells = (counts + stride - 1) // stride + 1        # one spare cell keeps passages of two documents apart
    base = np.concatenate([[0], np.cumsum(cells)])
    cell = base[owner] + (np.arange(len(h)) - words.first[owner]) // stride
    term = index.lookup(h)
    best: dict = {}
    for c in _candidates(index, term, cell, 1.0):
        d = int(np.searchsorted(base, c, "right")) - 1
        if d < 0:
            continue
        low = words.first[d] + (c - base[d]) * stride
        high = min(low + 2 * stride, words.first[d + 1])
        if low >= high:
            continue
        known = np.unique(term[low:high])
        passage: dict[int, np.ndarray] = {}
        for item, score in retrieve(index, known[known >= 0], 1.0):
            length, wanted = int(index.lengths[item]), index.shingles[item]
            short = min(size, length)
            if short not in passage:
                passage[short] = _shingles(h[low:high], short) if high - low >= short else np.zeros(0, np.uint64)
            which = np.searchsorted(wanted, passage[short])
            which[which == len(wanted)] = 0
            at = np.flatnonzero(wanted[which] == passage[short])
            has = _best_window(at, which[at], 2 * length - short + 1, len(wanted), _needed(len(wanted), overlap))
            if has is None:
                continue
            asked = index.asked[item]
            shares = [float(has[of].mean()) if of.any() else None for of in (asked, ~asked)]
            if all(of.sum() < size or x >= part for of, x in zip((asked, ~asked), shares)):
                value = (score * float(index.share[item]), float(has.mean()), *shares)
                best[d, item] = max(best.get((d, item), value), value, key=lambda v: (v[1], v[0]))
    return best


_SCHEMA = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def _item_terms(items: DataFrame) -> DataFrame:
    """``length`` and distinct ``terms`` per row of ``items(text)`` that has words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [h for h, _ in _hashed(batch.column(0).to_pylist()) if len(h)]
            distinct = [np.unique(h) for h in rows]
            flat = np.concatenate(distinct) if distinct else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([len(h) for h in rows], pa.int64()), list_column(
                flat.view(np.int64), np.array([len(t) for t in distinct], np.int64), pa.int64())], ["length", "terms"])

    return items.select("text").mapInArrow(run, "length long, terms array<long>")


def contaminated(docs: DataFrame, items: DataFrame, size: int = 5, overlap: float = 0.8, part: float = 0.5) -> DataFrame:
    """One row per document and test item that leaked into it.

    A pair is reported if some run of words of the document, at most twice as long as the item, holds ``overlap`` of the item's
    distinct ``size``-word shingles (an item with fewer words is one shingle), and ``part`` of those of its question and of those
    of its answer, each where it has ``size`` of them or more (a word or two can't decide). The answer is the item's last sentence or line; shingles that touch it count
    for it. ``overlap``, ``question_overlap`` and ``answer_overlap`` are those shares in the fullest run. Words are runs of letters and
    digits, A-Z lowered.

    Every passage of every whole text queries the index. An item is retrieved if the BM25 weight of its terms in the passage is as
    high as that of any passage with enough of its shingles must be: its full weight less that of as many of its heaviest
    terms as the missing shingles can cost. So retrieval loses no pair, and as both the passages and the least weight belong to the item,
    a pair doesn't depend on which other items there are. ``score`` is the share of the item's full weight.

    Statistics cover all items; only an index of about ``INDEX_BYTES`` of text is sent to the tasks at a time, one for each class of item
    lengths, so a very long item widens no one else's passages. Null or empty texts and items match nothing, nor do items without an
    id; repeated items and rows each give their pairs, null ids of documents are kept, other columns are ignored, empty tables give none.
    There is no shuffle of documents: a document is searched where it is read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and item_id is not null")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    length = F.regexp_count("text", F.lit("[0-9A-Za-z_\\x{80}-\\x{10FFFF}]+"))
    filed = wanted.withColumn("class", F.length(F.conv(F.greatest(F.lit(0), F.floor((length - 1) / CLASS_WORDS)).cast("string"), 10, 4)))
    filed = filed.withColumn("class", F.when(length <= CLASS_WORDS, 0).otherwise(F.col("class")))
    measured = materialize(_item_terms(wanted), "items")
    n, mean = measured.agg(F.count(F.lit(1)), F.avg("length")).first()
    frequency = measured.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def against(own: DataFrame, stride: int) -> DataFrame:
        terms = _item_terms(own).select(F.explode("terms").alias("term")).distinct().join(frequency, "term").toPandas()
        known = own.orderBy("item_id", "text").select("item_id", "text").toPandas()
        order = np.argsort(terms["term"].to_numpy(np.int64).view(np.uint64))
        own_statistics = Statistics(n, mean or 0.0, terms["term"].to_numpy(np.int64).view(np.uint64)[order], terms["df"].to_numpy()[order])
        shared = spark.sparkContext.broadcast(build_index(known["item_id"].to_numpy(), known["text"].tolist(), own_statistics, size, overlap))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, out = batch.column(0).to_pylist(), []
                for low, _, data, bounds in slices(batch.column(1)):
                    found = _search(index, data, bounds, stride, size, overlap, part)
                    out += [(ids[low + d], int(index.item_ids[i]), *v) for (d, i), v in sorted(found.items())]
                columns = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 4)],
                    ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        return rows.mapInArrow(run, _SCHEMA)

    found = []
    for kind, bytes_ in filed.groupBy("class").agg(F.sum(F.octet_length("text"))).orderBy("class").collect():
        parts = max(1, -(-bytes_ // INDEX_BYTES))
        found += [against(filed.filter((F.col("class") == kind) & (F.pmod(F.xxhash64("text"), F.lit(parts)) == p)), 2 * CLASS_WORDS * 4 ** kind)
                  for p in range(parts)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _SCHEMA)


def drop_contaminated(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the documents that hold a test item; rows with a null id stay."""
    gone = contaminated(docs, items, **parameters).filter("doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


@register("op1_bm25_decontamination")
def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
