"""Operator 13: phrase collocations by Toivonen's sampling: a sample proposes, one full pass counts proposals and negative border."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchline.llm.common import small_batches, table
from pitchline.llm.registry import register
from pitchline.llm.text import BASE, LOWER, cut, mix, ragged, range_hashes, slices
from pitchline.session import materialize

#: Classes of bytes: blanks part words, the others end a piece that phrases don't cross.
BLANK, WORD, END = 0, 1, 2
KINDS = np.full(256, WORD, np.uint8)
KINDS[[0x20, 0x09]] = BLANK
KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = END
#: Texts are counted in slices of about this size, so that a task hands on few rows per distinct phrase.
SLICE = 1 << 20
#: Bits of a map of phrases: 16 for each phrase within these bounds, so what is broadcast has at most 16 MB however many there are.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
_SLOT = 1 << 16


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends)


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    parts = [_hashes(data, bounds[:-1], bounds[1:]) for _, _, data, bounds in slices(langs)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _longer(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a phrase from the key of all but its last word and the hash of that word."""
    return mix(head * np.uint64(BASE) + word)


def _phrase_keys(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """Keys of phrases whose words stand one space apart, the same as those of their windows in a text."""
    seeds, out = _lang_hashes(langs), []
    for low, high, data, bounds in slices(phrases):
        words = cut(data, bounds, KINDS)
        h, first, n = _hashes(data, words.starts, words.ends), words.first[:-1], np.diff(words.first)
        key = mix(h[first] + seeds[low:high])
        for j in range(1, int(n.max(initial=0))):
            more = np.flatnonzero(n > j)
            key[more] = _longer(key[more], h[first[more] + j])
        out.append(key)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def _holds(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = _places(keys, 8 * len(marks))
    return (marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def phrase_map(phrases: DataFrame) -> Broadcast:
    """Broadcast map of ``phrases(lang, phrase)``: every phrase is found in it, and seldom one that isn't there (which costs a count, no more).

    Built in parts of 8 KB by the executors, whatever the number of phrases; the driver sets at most ``MOST_BITS`` bits together.
    """
    wanted = 16 * phrases.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(wanted - 1, 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(_places(_phrase_keys(batch.column(0), batch.column(1)), bits))
            yield pa.RecordBatch.from_arrays([pa.array(place // _SLOT), pa.array((place % _SLOT).astype(np.int32))], ["slot", "place"])

    def packed(key, rows):
        set_ = np.zeros(_SLOT, np.uint8)
        set_[rows["place"].to_numpy()] = 1
        import pandas as pd

        return pd.DataFrame({"slot": [key[0]], "part": [np.packbits(set_, bitorder="little").tobytes()]})

    parts = phrases.select("lang", "phrase").mapInArrow(places, "slot long, place int").distinct() \
        .groupBy("slot").applyInPandas(packed, "slot long, part binary").collect()
    marks = np.zeros(bits // 8, np.uint8)
    for slot, part in parts:
        marks[slot * _SLOT // 8:(slot + 1) * _SLOT // 8] = np.frombuffer(part, np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(marks)


def _tally(codes: list[np.ndarray], distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of one window of each distinct tuple of word codes, and how often the tuple occurs. No hash decides."""
    key, bound = codes[0], distinct
    for code in codes[1:]:
        if bound * distinct >= 1 << 62:
            found, key = np.unique(key, return_inverse=True)
            bound = len(found)
        key, bound = key * distinct + code, bound * distinct
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    return at, n


def _slice_counts(langs: pa.Array, data: np.ndarray, bounds: np.ndarray, longest: int, now, earlier: list, everything: bool):
    """(language, words, phrase, count) arrays of one slice; see ``counts``."""
    data = LOWER[data]
    runs = cut(data, bounds, KINDS)
    is_word, owner = runs.kinds == WORD, runs.owner()
    piece = (np.cumsum(~is_word) + owner)[is_word]
    owner, starts, ends = owner[is_word], runs.starts[is_word], runs.ends[is_word]
    names = langs.dictionary_encode()
    lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner]
    seeds, h = _lang_hashes(langs), _hashes(data, starts, ends)
    keys, windows = [mix(h + seeds[owner])], {}
    if everything or now is None:
        windows[1] = np.arange(len(starts))
    for k in range(2, longest + 1):
        head, tail = keys[-1][:-1], keys[-1][1:]
        fits = piece[k - 1:] == piece[:len(piece) - k + 1]
        head, tail = head[:len(fits)], tail[:len(fits)]
        if now is not None:
            at = np.flatnonzero(fits)
            at = at[_holds(now, head[at])]
            at = at[_holds(now, tail[at])]
            for old in earlier:
                at = at[~(_holds(old, head[at]) & _holds(old, tail[at]))]
            windows[k] = at
        else:
            windows[k] = np.flatnonzero(fits)
        keys.append(_longer(head, h[k - 1:]))
    used = np.zeros(len(starts), bool)
    for k, at in windows.items():
        for j in range(k):
            used[at + j] = True
    which = np.flatnonzero(used)
    sizes = (ends - starts)[which]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    words = pa.Array.from_buffers(pa.large_binary(), len(which), [
        None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[ragged(starts[which], sizes)])]).dictionary_encode()
    code = np.zeros(len(starts), np.int64)
    code[which] = words.indices.to_numpy(zero_copy_only=False)
    several = len(names.dictionary)
    marked, distinct = code * several + lang, max(1, len(words.dictionary)) * several
    for k, at in windows.items():
        if len(at):
            one, n = _tally([marked[at + j] for j in range(k)], distinct)
            one = at[one]
            phrase = pc.binary_join_element_wise(*(words.dictionary.take(pa.array(code[one + j])) for j in range(k)),
                                                 pa.scalar(b" ", pa.large_binary()))
            yield names.dictionary.take(pa.array(lang[one])), k, phrase, n
    if everything:
        total = np.bincount(lang, minlength=several)
        yield names.dictionary, 0, pa.array([b""] * several, pa.large_binary()), total


def counts(rows: DataFrame, longest: int, now: Broadcast | None, earlier: list[Broadcast], everything: bool) -> DataFrame:
    """Columns ``lang``, ``words``, ``phrase``, ``n`` of ``rows(lang, text)``, summed over all rows.

    Without a map every phrase of up to ``longest`` words is counted. With the map ``now`` only those whose two parts of one word less
    are in it (the proposals and their negative border) and were not counted under a map of ``earlier``. ``everything`` adds all single
    words, and as ``words`` 0 the number of word occurrences of the language.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, old = now and now.value, [m.value for m in earlier]
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            langs = whole.column(0).combine_chunks() if whole.num_rows else pa.array([], pa.string())
            for low, high, data, bounds in slices(whole.column(1), SLICE):
                for lang, k, phrase, n in _slice_counts(langs[low:high], data, bounds, longest, mine, old, everything):
                    yield pa.RecordBatch.from_arrays(
                        [lang.cast(pa.string()), pa.array(np.full(len(n), k, np.int32)), phrase.cast(pa.large_string()).cast(pa.string()),
                         pa.array(n.astype(np.int64))], ["lang", "words", "phrase", "n"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SLICE:
                yield from flush()
                held.clear()
                size = 0
        if held:
            yield from flush()

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "lang string, words int, phrase string, n long") \
        .groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, least: int = 30, longest: int = 4, share: float = 0.1, id_column: str = "doc_id", text_column: str = "text",
             lang_column: str = "lang") -> DataFrame:
    """Columns ``lang``, ``words``, ``phrase``, ``n``: every phrase of up to ``longest`` words that occurs ``least`` times or more, exactly.

    As ``words`` 0 there is one row per language with the number of its word occurrences. Texts are lowered (A-Z), cut into pieces at
    ``.,;:!?`` and line ends, and pieces into words at spaces and tabs. A null text is empty, a null language ``und``; ids only
    choose the sample; other columns are ignored, an empty table gives an empty one.

    A ``share`` of the documents, chosen by hash, proposes phrases at half the threshold that falls to it. One pass over all texts then
    counts the proposals and their border exactly. Where the border turns out frequent, its phrases join the map and a further pass
    counts the border that is new, until nothing shorter than ``longest`` is new. A bad sample costs passes, never a phrase.
    """
    text, lang = F.coalesce(F.col(text_column), F.lit("")), F.coalesce(F.col(lang_column), F.lit("und"))
    rows = docs.select(lang.alias("lang"), text.alias("text"))
    chosen = F.pmod(F.xxhash64(F.col(id_column), text), F.lit(10_000)) < int(share * 10_000)
    sample = docs.filter(chosen).select(lang.alias("lang"), text.alias("text"))
    proposed = materialize(counts(sample, longest, None, [], False).filter(F.col("n") >= max(1, int(least * share / 2) + 1)), "proposed")
    now, earlier = phrase_map(proposed), []
    found = materialize(counts(rows, longest, now, earlier, True).filter(f"n >= {least} or words = 0"), "frequent")
    shorter = F.col("words").between(1, longest - 1)
    news = found.filter(shorter).join(proposed, ["lang", "phrase"], "left_anti")
    while not news.isEmpty():
        earlier.append(now)
        now = phrase_map(found.filter(shorter))
        more = materialize(counts(rows, longest, now, earlier, False).filter(F.col("n") >= least), "frequent")
        found, news = found.unionByName(more), more.filter(shorter)
    for old in [now, *earlier]:
        old.unpersist()
    return found


def collocations(found: DataFrame, nested: int = 80, best: int = 2000) -> DataFrame:
    """The best phrases of each language of ``found`` (see ``frequent``): ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase cut after its first words gives ``l`` and ``r``, the counts of both parts, and a score of 2,000,000 a / (l + r), floored; its
    lowest cut counts, ties to the shortest first part. A phrase goes if a longer one that holds it has ``nested`` hundredths of
    its count or more; only longer ones by one word need a look, since no phrase is more frequent than its parts. Products
    are decimals. Only ``best`` rows per language and task are ordered together.
    """
    found = materialize(found, "found")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    phrases = found.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda low, size: F.array_join(F.slice("w", low, size), " ")
    cuts = phrases.select("lang", "phrase", "words", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k")) \
        .select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"),
                joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    part = lambda name, count: found.filter("words >= 1").select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]) \
        .withColumn("both", (wide("l") + wide("r")).cast("decimal(20,0)")).withColumn("many", (wide("a") * F.lit(2_000_000)).cast("decimal(27,0)")) \
        .withColumn("score", F.expr("many div both"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = phrases.filter("words >= 3").select("lang", F.col("a").alias("longer"), F.explode(F.array(
        joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1))).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * F.lit(nested)))
    totals = found.filter("words = 0").select("lang", F.col("n").alias("total"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


@register("op13_phrase_mining")
def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(frequent(table(spark, sf_dir, "documents")))
