"""Operator 10: quality by importance resampling, the ratio of hashed n-gram models of target and raw text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline.llm.common import small_batches, table
from pitchline.llm.registry import register
from pitchline.llm.text import LOWER, RUNS, WORD, cut, mix, range_hashes, slices
from pitchline.session import materialize

FOLDS = 2
#: The key sought is first bracketed on a grid that widens with the distance from 0: this many steps for each doubling.
FINE = 256
#: Places of the grids inside a step.
GRID = 4096
_PACK = 1 << 14


@dataclass(frozen=True)
class Settings:
    """``fit_rows``: target rows used at most (a sample by hashed id beyond it); everything else reads every row.

    ``prior``: pseudo-count of both models. ``z``, ``slack``: log ratios count as the median ratio unless they differ from it by
    more than ``slack`` and their target count from the expected one by more than ``z`` standard deviations.
    """

    bits: int = 18
    fit_rows: int = 200_000
    prior: float = 1.0
    z: float = 4.0
    slack: float = 0.5
    seed: int = 7


def _ngrams(data: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of every unigram, bigram and echo, and each document's fold.

    An echo is a word said for the fourth time at steps of one or two places; all echoes of one step are one n-gram, as
    what repeats itself is rarely a word that other documents repeat.

    The fold is drawn from the smallest hash of the document's runs of four words (of its words, if it has fewer), so copies and
    most near copies share a fold and no document is judged by a model that has read its own text.
    """
    words = cut(data, bounds, RUNS)
    h, owner = words.hashes(LOWER), words.owner()
    pair = owner[1:] == owner[:-1]
    two = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[pair]
    fold = np.zeros(len(bounds) - 1, np.int64)
    full = np.diff(words.first) > 0
    if full.any():
        runs = np.full(len(h), np.iinfo(np.uint64).max)
        heads = np.flatnonzero(owner[3:] == owner[:-3])
        runs[heads] = range_hashes(h, heads, heads + 4)
        first = words.first[:-1][full]
        least = np.minimum.reduceat(runs, first)
        short = least == np.iinfo(np.uint64).max
        least[short] = np.minimum.reduceat(h, first)[short]
        fold[full] = (mix(least) % np.uint64(FOLDS)).astype(np.int64)
    keys, owners = [h, two], [owner, owner[1:][pair]]
    for step in (1, 2):
        same = (h[step:] == h[:-step]) & (owner[step:] == owner[:-step]) & (words.kinds[step:] == WORD)
        again = same[2 * step:] & same[step:-step] & same[:-2 * step]
        owners.append(owner[3 * step:][again])
        keys.append(np.full(len(owners[-1]), mix(np.array([step], np.uint64))[0]))
    return (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners), fold


def bucket_counts(docs: DataFrame, target_ids: np.ndarray, bits: int) -> DataFrame:
    """Per n-gram bucket and fold: target documents that hold it and all that do. Each task sends one row per bucket it met.

    An n-gram counts once per document, so a document that repeats itself weighs no more than another.
    """
    small_batches(docs.sparkSession)
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros((2, FOLDS * size), np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            chosen = np.isin(ids, target_ids)
            for low, high, data, bounds in slices(batch.column(1)):
                buckets, owner, fold = _ngrams(data, bounds, bits)
                once = np.unique(owner * size + buckets)
                owner, at = once // size, once % size + size * fold[once // size]
                raw += np.bincount(at, minlength=FOLDS * size)
                target += np.bincount(at[chosen[low:high][owner]], minlength=FOLDS * size)
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(target[met]), pa.array(raw[met])], ["at", "target", "raw"])

    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "at long, target long, raw long")
    return sent.groupBy("at").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def _fetched(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Target and raw counts of all places below ``size``, packed by the executors so that the driver gets arrays and not rows."""
    def packed(key, rows):
        import pandas as pd

        table = np.zeros((2, _PACK), np.int64)
        table[:, rows["at"].to_numpy() % _PACK] = rows["target"].to_numpy(), rows["raw"].to_numpy()
        return pd.DataFrame({"slot": [key[0]], "counts": [table.tobytes()]})

    parts = counts.groupBy(F.floor(F.col("at") / _PACK).alias("slot")).applyInPandas(packed, "slot long, counts binary").collect()
    out = np.zeros((2, -(-size // _PACK) * _PACK), np.int64)
    for slot, part in parts:
        out[:, slot * _PACK:(slot + 1) * _PACK] = np.frombuffer(part, np.int64).reshape(2, _PACK)
    return out[0, :size], out[1, :size]


def log_ratios(at: np.ndarray, target: np.ndarray, raw: np.ndarray, settings: Settings) -> np.ndarray:
    """FOLDS x buckets: log of the target model over the raw model, each fold's from the other folds' counts."""
    counts = np.zeros((2, FOLDS, 1 << settings.bits))
    counts[0].reshape(-1)[at], counts[1].reshape(-1)[at] = target, raw
    out = np.zeros((FOLDS, 1 << settings.bits), np.float32)
    for fold in range(FOLDS):
        t, r = (c.sum(0) - c[fold] for c in counts)
        if not t.sum():
            continue
        expected = r * (t.sum() / r.sum())
        ratio = np.log((t + settings.prior) / (expected + settings.prior))
        order = np.argsort(ratio, kind="stable")
        middle = ratio[order[np.searchsorted(np.cumsum(r[order]), r.sum() / 2)]]
        at_middle = expected * np.exp(middle)
        clear = (np.abs(t - at_middle) > settings.z * np.sqrt(at_middle + 1)) & (np.abs(ratio - middle) > settings.slack)
        out[fold] = np.where(clear, ratio - middle, 0)
    return out


def uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each id, the same on every machine."""
    h = mix(mix(ids.astype(np.uint64) + np.uint64(1)) + np.uint64(seed))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0 ** 52


def target_ids(labels: DataFrame, settings: Settings) -> np.ndarray:
    """Ids of good, harmless labelled documents: all, or the ``fit_rows`` with the smallest hashed ids."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")) \
        .filter("doc_id is not null and quality = 1 and toxic = 0")
    rows = good.orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(settings.fit_rows).select("doc_id").toPandas()
    return np.sort(rows["doc_id"].to_numpy(np.int64))


def weights(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Columns ``doc_id``, ``log_weight``, ``gumbel_key`` and ``is_target`` per row of ``docs``.

    ``log_weight`` is the sum of the log ratios of all n-grams of the whole text, ``gumbel_key`` adds Gumbel noise drawn from
    the id and the seed. The model has a fixed number of buckets, so what the driver fetches and each task holds is
    bounded by ``bits``. Null and empty texts have no n-grams and weight 0; a null id is drawn as -1; with no target
    rows all weights are 0. Rows repeated under one id are scored alike.
    """
    spark, ids = docs.sparkSession, target_ids(labels, settings)
    small_batches(spark)
    size = FOLDS << settings.bits
    target, raw = _fetched(bucket_counts(docs, ids, settings.bits), size)
    ratios = spark.sparkContext.broadcast(log_ratios(np.arange(size), target, raw, settings))
    bits, seed = settings.bits, settings.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ratios.value
        for batch in batches:
            own = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            total = np.zeros(len(own))
            for low, high, data, bounds in slices(batch.column(1)):
                buckets, owner, fold = _ngrams(data, bounds, bits)
                total[low:high] = np.bincount(owner, model[fold[owner], buckets], high - low)
            key = total - np.log(-np.log(uniform(own, seed)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(key), pa.array(np.isin(own, ids))],
                                             ["doc_id", "log_weight", "gumbel_key", "is_target"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, log_weight double, gumbel_key double, is_target boolean")


def _step(key: str = "gumbel_key"):
    """A whole number that never falls as the key rises; a few thousand steps span keys of any size."""
    size = F.floor(F.log2(1 + F.abs(F.col(key))) * FINE)
    return F.when(F.col(key) < 0, -size).otherwise(size).cast("int")


def _line(targets: DataFrame, keep_target: float) -> float | None:
    """The key of the last of the ``keep_target`` highest of ``targets``, from counts on ``_step`` and then inside its step."""
    steps = targets.groupBy(_step().alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
    left = ceil(keep_target * sum(r["n"] for r in steps))
    for r in steps:
        if left <= r["n"]:
            break
        left -= r["n"]
    else:
        return None
    inside = targets.filter(_step() == r["step"])
    while True:                                        # narrows the step to the values around the one sought
        low, high, n = inside.agg(F.min("gumbel_key"), F.max("gumbel_key"), F.count(F.lit(1))).first()
        if low == high or left >= n:
            return low
        if left <= 1:
            return high
        place = F.floor((F.col("gumbel_key") - low) / (high - low) * GRID).cast("int")
        counts = inside.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("place")).collect()
        for c in counts:
            if left <= c["n"]:
                break
            left -= c["n"]
        inside = inside.filter(place == c["place"])


def resample(docs: DataFrame, labels: DataFrame, keep_target: float = 0.99, settings: Settings = Settings()) -> DataFrame:
    """``weights`` and ``kept``: the Gumbel top-k, k being the least that holds ``keep_target`` of the target rows.

    The k-th key is found exactly from counts on grids of keys, each inside one step of the one before, never by sorting the corpus;
    rows of that very key are ties and are kept together. Without target rows all are kept.
    """
    scored = materialize(weights(docs, labels, settings), "weights")
    line = _line(scored.filter("is_target").select("gumbel_key"), keep_target)
    return scored.withColumn("kept", F.lit(True) if line is None else F.col("gumbel_key") >= line)


def drop_rejected(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the rows that the sample leaves out; rows with a null id stay."""
    gone = resample(docs, labels, **parameters).filter("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


@register("op10_importance_resampling")
def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
