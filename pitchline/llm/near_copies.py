"""Near copies of whole texts: SimHash fingerprints and MinHash bands propose pairs of documents, the Jaccard similarity of their word
shingles decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.llm import simhash
from pitchline.llm.common import small_batches
from pitchline.llm.components import components
from pitchline.llm.text import LOWER, cut, list_column, mix, range_hashes, slices
from pitchline.session import materialize, scratch, shuffles_freed

#: Two sets with similarity s share none of the bands with chance (1 - s ** ROWS) ** BANDS: 3e-6 at 0.8, less above.
BANDS, ROWS = 24, 4
#: Of a band's members all are held against each other up to the first number, or the second once the band was refined; beyond it the band
#: is refined, at most so often, by so many further rows of the signature a time.
SMALL, REFINED, ROUNDS, MORE_ROWS = 24, 1024, 7, 2
#: Further members of a larger band with which all others are held, drawn by hash.
DRAWN = 2
#: Pairs whose signatures agree in a share of rows this much below the similarity asked for aren't looked at: five standard deviations.
MARGIN = 0.2
#: Rows of the longer signature of texts that the first turn leaves apart, and their margin: five standard deviations again.
LONG, LONG_MARGIN = 1024, 0.0625
#: Rows of it that are looked at before the others, with ``MARGIN``.
HEAD = 128
#: Bytes of sets and signatures in a block of a large band; two blocks meet in a task.
BLOCK = 4 << 20
_FACTORS = mix(np.arange(1, LONG + 1, dtype=np.uint64)) | np.uint64(1)


def _sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all documents of a slice, one document after the other, and where each document's begin.

    A document of fewer than ``size`` words is one shingle.
    """
    words = cut(data, bounds)
    h, counts = words.hashes(LOWER), np.diff(words.first)
    shingles = np.maximum(counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), shingles)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + words.first[:-1][owner]
    hashes = range_hashes(h, begin, np.minimum(begin + size, words.first[1:][owner]))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(counts) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``h1``, ``h2`` as given, ``k`` (hash of the set of shingles), ``n`` (their number), ``bands`` and ``marks`` (16 bits of each
    row of the signature) per row of ``rows(doc_id, h1, h2, text)``. A text without words has no bands."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in slices(batch.column(3)):
                hashes, first = _sets(data, bounds, size)
                n = np.diff(first)
                some = np.flatnonzero(n)
                bands, marks = np.zeros((len(some), BANDS), np.uint64), np.zeros((len(some), BANDS * ROWS), np.int16)
                for b in range(BANDS):
                    key = np.full(len(some), b + 1, np.uint64)
                    for row in range(b * ROWS, (b + 1) * ROWS):
                        if len(some):
                            key = mix(key + (least := np.minimum.reduceat(hashes * _FACTORS[row], first[:-1][some])))
                            marks[:, row] = (mix(least) >> np.uint64(48)).astype(np.uint16).view(np.int16)
                    bands[:, b] = key
                lists = [list_column(values.reshape(-1), np.where(n > 0, values.shape[1], 0), kind)
                         for values, kind in ((bands.view(np.int64), pa.int64()), (marks, pa.int16()))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[low:high] for c in range(3)), pa.array(_sums(mix(hashes), first).view(np.int64)), pa.array(n), *lists],
                    ["doc_id", "h1", "h2", "k", "n", "bands", "marks"])

    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, k long, n long, bands array<long>, marks array<short>")


def _shingles(texts: DataFrame, size: int, marked: bool = False) -> DataFrame:
    """``k`` and ``shingles`` per row of ``texts(k, text)``; if ``marked`` their number ``n`` and ``marks``, 8 bits of each of ``LONG`` rows, too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in slices(batch.column(1)):
                hashes, first = _sets(data, bounds, size)
                columns = {"k": batch.column(0)[low:high],
                           "shingles": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))}
                if marked:
                    n = np.diff(first)
                    some = np.flatnonzero(n)
                    marks = np.zeros((len(some), LONG), np.uint8)
                    for row in range(LONG if len(some) else 0):
                        marks[:, row] = mix(np.minimum.reduceat(hashes * _FACTORS[row], first[:-1][some])) >> np.uint64(56)
                    columns |= {"n": pa.array(n), "marks": list_column(marks.reshape(-1).view(np.int8), np.where(n > 0, LONG, 0), pa.int8())}
                yield pa.RecordBatch.from_pydict(columns)

    return texts.mapInArrow(run, "k long, shingles array<long>" + ", n long, marks array<tinyint>" * marked)


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose shingles are similar enough."""
    a, b = (sets.select(F.col("k").alias(s), F.col("shingles").alias(f"set_{s}")) for s in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(a, "a").join(b, "b").filter(both >= least * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The distinct pairs (``a``, ``b``) whose sizes allow the similarity and whose signatures suggest it."""
    pairs = pairs.distinct()
    a, b = (nodes.select(F.col("k").alias(s), F.col("n").alias(f"n_{s}"), F.col("marks").alias(f"marks_{s}")) for s in "ab")
    equal = F.size(F.filter(F.zip_with("marks_a", "marks_b", lambda x, y: x == y), lambda e: e))
    return pairs.join(a, "a").join(b, "b").filter(
        (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")) & (equal >= (least - MARGIN) * BANDS * ROWS)).select("a", "b")


def _marks(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), LONG)


def _star(met: DataFrame, sets: DataFrame, turn: int, least: float) -> DataFrame:
    """Pairs (``a``, ``b``) as of ``_likely`` of the members of large bands of ``met(key, k, c, m)`` and the centres of their bands."""
    large, centres = _centres(met.join(sets.select("k", "n", "marks"), "k"), turn, F.struct("k", "c", "n", "marks"))
    fits = lambda to: (F.col("c") != to["c"]) & (F.least("n", to["n"]) >= least * F.greatest("n", to["n"]))
    rows = large.join(centres, "key").select("k", "marks", F.explode(F.filter("centres", fits)).alias("to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.count_nonzero(_marks(batch.column(1)) == _marks(batch.column(3)), axis=1) >= (least - LONG_MARGIN) * LONG
            one, two = (batch.column(i).to_numpy()[near] for i in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    return rows.select("k", "marks", F.col("to.k").alias("k2"), F.col("to.marks").alias("marks2")).mapInArrow(run, "a long, b long")


def _within(met: DataFrame, sets: DataFrame, turn: int, least: float) -> DataFrame:
    """Pairs (``a``, ``b``) as of ``_likely`` within each small band of ``met(key, k, c, m)``, across groups ``c``.

    A band's members, at most ``REFINED``, meet in a task, so pairs that their signatures rule out never become rows. Of the bands that two
    texts share only the one with the least key gives the pair.
    """
    own = met.filter(F.col("m") <= _small(turn)).groupBy("k").agg(F.first("c").alias("c"), F.array_sort(F.collect_list("key")).alias("keys"))
    rows = own.join(sets.select("k", "n", "marks"), "k").select(F.explode("keys").alias("key"), "k", "c", "n", "marks", "keys")
    small_batches(met.sparkSession)

    def near(rows: pa.RecordBatch) -> pa.RecordBatch:
        key, k, c, n = (rows.column(name).to_numpy(zero_copy_only=False) for name in ("key", "k", "c", "n"))
        marks, lists = _marks(rows.column("marks")), rows.column("keys")
        sizes, places = lists.value_lengths().to_numpy(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        keys = lists.flatten().to_numpy()[places[:, None] + np.minimum(np.arange(sizes.max(initial=0)), sizes[:, None] - 1)]
        ends = np.searchsorted(key, key, "right")
        one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(k)):
            j = np.arange(i + 1, ends[i])
            j = j[(c[j] != c[i]) & (np.minimum(n[j], n[i]) >= least * np.maximum(n[j], n[i]))]
            if len(j):
                j = j[np.count_nonzero(marks[j] == marks[i], axis=1) >= (least - LONG_MARGIN) * LONG]
                j = j[~np.isin(keys[j], keys[i][keys[i] < key[i]]).any(1)]
                one.append(np.minimum(k[i], k[j]))
                two.append(np.maximum(k[i], k[j]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))            # the last band may go on in the next batch
            if last or held and held[-1].column("key")[0] != batch.column("key")[0]:
                yield near(pa.concat_batches([*held, batch[:last]]))
                held = []
            held.append(batch[last:])
        if held:
            yield near(pa.concat_batches(held))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _fingerprinted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) to be looked at for their SimHash fingerprints, linked as in operator 8.

    Texts of one fingerprint are held against one of them, and that one against those of the fingerprints linked to it.
    """
    fps = simhash.fingerprints(rows.select("h1", "text"), "h1").withColumnRenamed("doc_id", "h1").distinct()
    held = materialize(fps.join(found.filter("n > 0").select("h1", "k").distinct(), "h1").select("fp", "k").distinct(), "fingerprints")
    one = materialize(held.groupBy("fp").agg(F.min("k").alias("one")), "one")
    near = materialize(simhash.links(one.select("fp")), "near-fingerprints")
    a, b = (one.select(F.col("fp").alias(side), F.col("one").alias(f"one_{side}")) for side in "ab")
    across = near.join(a, "a").join(b, "b").select(F.least("one_a", "one_b").alias("a"), F.greatest("one_a", "one_b").alias("b"))
    return held.join(one, "fp").select(F.least("k", "one").alias("a"), F.greatest("k", "one").alias("b")).unionByName(across).filter("a <> b")


def _small(turn: int) -> int:
    """Bands of up to so many members are settled in a turn by holding all against each other; in the first turn none is."""
    return (0, SMALL)[turn] if turn < 2 else REFINED


def _met(members: DataFrame) -> DataFrame:
    """``members(key, k, c)`` of bands that hold different groups ``c``, with the number ``m`` of members of the band."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("low"), F.max("c").alias("high")) \
        .filter("low <> high").select("key", "m")
    return materialize(members.join(sizes, "key"), "met")


def _centres(met: DataFrame, turn: int, member) -> tuple[DataFrame, DataFrame]:
    """The rows of large bands of ``met(key, k, c, m)``, and ``key`` and ``centres`` of these bands, each described by ``member``.

    A centre is the member that meets the most others: a text that others were made from meets more of them than they meet each
    other. From the second turn on some are drawn anew, too.
    """
    large = met.filter(F.col("m") > _small(turn))
    known = large.groupBy("k").agg(F.sum("m").alias("meets"))
    draws = [F.xxhash64("k", "key", F.lit(DRAWN * turn + i)) for i in range(DRAWN if turn else 0)]
    return large, large.join(known, "k").groupBy("key").agg(F.array(
        F.max_by(member, F.struct("meets", "k")), *(F.max_by(member, F.struct(d.alias("draw"), "k")) for d in draws)).alias("centres"))


def _pairs(met: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of the members of large bands of ``met(key, k, c, m)`` and the centres of their bands, across groups ``c``, and these members."""
    large, centres = _centres(met, turn, F.struct("k", "c"))
    star = large.join(centres, "key").select("k", "c", F.explode("centres").alias("to")).filter("c <> to.c")
    return star.select(F.least("k", "to.k").alias("a"), F.greatest("k", "to.k").alias("b")), large.select("key", "k", "c")


def _refined(large: DataFrame, sets: DataFrame, ways: int) -> DataFrame:
    """``members`` of the bands of ``large`` refined, ``ways`` times independently, by further rows of the longer signature."""
    each = large.select("key", "k", "c", F.explode(F.array(*map(F.lit, range(ways)))).alias("way")).join(sets.select("k", "marks"), "k")
    rows = [F.element_at("marks", (F.pmod(F.xxhash64("key", "way", F.lit(i)), F.lit(LONG - BANDS * ROWS)) + BANDS * ROWS + 1).cast("int"))
            for i in range(MORE_ROWS)]
    return each.select(F.xxhash64("key", "way", *rows).alias("key"), "k", "c")


def _apart(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows(key, k)`` of the bands that hold different groups, with the group ``c`` of each."""
    now = rows.join(groups.withColumnRenamed("node", "k"), "k", "left").select("key", "k", F.coalesce("root", "k").alias("c"))
    apart = now.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")
    return now.join(apart, "key", "left_semi")


def _blocks(left: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``left(key, k, c)`` with their block ``at`` and the two blocks ``x`` and ``y`` of each task they take part in.

    A band's members are dealt into blocks of about ``BLOCK`` bytes, those of a group that fills a block into blocks of its own. Each two
    blocks meet, and each meets itself, unless both hold the same one group.
    """
    sized = materialize(left.join(sets.select("k", (F.col("n") * 8 + LONG).alias("bytes")), "k"), "sized")
    alone = F.col("bytes") >= BLOCK
    by_group = sized.groupBy("key", "c").agg(F.sum("bytes").alias("bytes")).select(
        "key", "c", "bytes", F.when(alone, 1).otherwise(0).alias("alone"), F.when(alone, F.col("c")).otherwise(0).alias("pool"))
    pools = by_group.groupBy("key", "alone", "pool").agg(F.ceil(F.sum("bytes") / BLOCK).cast("int").alias("blocks"))
    listed = pools.select("key", "alone", "pool", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    of_band = listed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("alone", "pool", "block"))).alias("all"))
    placed = by_group.drop("bytes").join(pools, ["key", "alone", "pool"]).join(of_band, "key")
    own = F.struct("alone", "pool", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("block"))
    met = sized.select("key", "k", "c").join(placed, ["key", "c"]).select("key", "k", "c", "all", own.alias("own"))
    other = lambda to, i: F.when((to["alone"] == 0) | (to["pool"] != F.col("own.pool")) | (F.col("own.alone") == 0), i + 1)
    met = met.select("key", "k", "c", F.array_position("all", F.col("own")).cast("int").alias("at"),
                     F.explode(F.array_compact(F.transform("all", other))).alias("to"))
    return met.select("key", F.least("at", "to").alias("x"), F.greatest("at", "to").alias("y"), "at", "k", "c")


def _across(left: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (``a``, ``b``) that join what is similar enough in each band of ``left(key, k, c)``: all its members are held against each other
    across groups ``c``.

    Each two blocks of a band meet in a task, which compares the whole sets of what the signatures don't rule out, and of texts that it has
    linked no further pair: what it gives are fewer rows than it takes, however alike they are. Of the bands that two texts share only the one with
    the least key holds them against each other.
    """
    keys = left.groupBy("k").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    rows = _blocks(left, sets).join(keys, "k").join(sets.select("k", "n", "marks", "shingles"), "k")

    def near(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks().to_batches()[0]
        key, x, y = (rows.column(name)[0].as_py() for name in ("key", "x", "y"))
        at, k, c, n = (rows.column(name).to_numpy(zero_copy_only=False) for name in ("at", "k", "c", "n"))
        marks, shingles, keys = _marks(rows.column("marks")), rows.column("shingles"), rows.column("keys")
        flat, first = shingles.flatten().to_numpy(), shingles.offsets.to_numpy() - shingles.offsets[0].as_py()
        values, places = keys.flatten().to_numpy(), keys.offsets.to_numpy() - keys.offsets[0].as_py()
        before = [values[low:high][values[low:high] < key] for low, high in zip(places, places[1:])]
        group, found = np.unique(c, return_inverse=True)[1], []
        for i in range(len(k)):
            j = np.arange(i + 1, len(k))
            j = j[(group[j] != group[i]) & ((x == y) | (at[j] != at[i])) & (np.minimum(n[j], n[i]) >= least * np.maximum(n[j], n[i]))]
            j = j[np.count_nonzero(marks[j, :HEAD] == marks[i, :HEAD], axis=1) >= (least - MARGIN) * HEAD]
            j = j[np.count_nonzero(marks[j] == marks[i], axis=1) >= (least - LONG_MARGIN) * LONG]
            mine = flat[first[i]:first[i + 1]]
            for o in j.tolist():
                if group[o] == group[i] or np.isin(before[o], before[i]).any():
                    continue
                both = len(np.intersect1d(mine, flat[first[o]:first[o + 1]], assume_unique=True))
                if both >= least * (n[i] + n[o] - both):
                    found.append((min(k[i], k[o]), max(k[i], k[o])))
                    group[group == group[o]] = group[i]
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return rows.groupBy("key", "x", "y").applyInArrow(near, "a long, b long").distinct()


def _texts(some: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``k`` and ``text`` of the nodes ``some(k)``."""
    chosen = nodes.join(some.distinct(), "k", "left_semi").select("k", "text.h1", "text.h2")
    return rows.select("h1", "h2", "text").join(chosen, ["h1", "h2"]).dropDuplicates(["k"]).select("k", "text")


def _joined(groups: DataFrame | None, linked: DataFrame) -> DataFrame:
    """``groups`` (``node``, ``root``) after the links ``linked`` between their members."""
    if groups is None:
        return materialize(components(linked), "groups", outer=True)
    if linked.isEmpty():
        return groups
    near = linked
    for side in "ab":
        of = groups.select(F.col("node").alias(side), F.col("root").alias("root"))
        near = near.join(of, side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    joined = components(near).select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = groups.join(joined, groups["root"] == joined["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    return materialize(moved.unionByName(joined.select(F.col("old").alias("node"), F.col("new").alias("root"))), "groups", outer=True)


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """Columns ``doc_id``, ``component_id`` (smallest ``doc_id`` reachable) per row, linked at a Jaccard similarity of ``least`` or more.

    The sets compared are the distinct runs of ``size`` words, A-Z lowered, split at the six ASCII blanks. Every link is verified on
    the whole sets. Texts with equal sets are one node. Nodes whose SimHash fingerprints lie within operator 8's two bits are held against each
    other. All nodes under one band key are held against one of them first, which connects a
    group of near copies without making its pairs. Nodes of bands that still hold different groups get a longer signature, which tells pairs
    below the similarity from those at it. They are held against each other if they are few; larger bands are held against a few more members,
    refined by further rows of the signature and go round again, so the rows of a round are a
    fixed multiple of the nodes in them. The rounds only join early what can be: of every large band that holds different groups after them
    all members are held against each other, in blocks. No pair within a group is looked at. Every band of every node takes part; a pair is
    missed if it shares no band. Texts without words are copies of one another. A null id takes part in no minimum;
    each row counts by its own text, also under a repeated id; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"),
                       F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    spark = docs.sparkSession
    with shuffles_freed(spark), scratch(spark):
        found = materialize(signatures(rows, size), "signatures", outer=True)
        nodes = materialize(found.groupBy("k").agg(F.min("doc_id").alias("low"), F.min(F.struct("h1", "h2")).alias("text"), F.first("n").alias("n"),
                                                   F.first("bands").alias("bands"), F.first("marks").alias("marks")), "nodes")
        members, groups, tried, sets = nodes.select(F.explode("bands").alias("key"), "k", F.col("k").alias("c")), None, None, None
        crowded = None
        for turn in range(ROUNDS):
            with scratch(spark):
                met = _met(members)
                pairs, open_ = _pairs(met, turn)
                if not turn:
                    tried = likely = materialize(_likely(pairs.unionByName(_fingerprinted(rows, found)), nodes, least), "likely", outer=True)
                    ends = _texts(likely.select(F.explode(F.array("a", "b")).alias("k")), rows, nodes)
                    compared = materialize(_shingles(ends, size), "shingles")
                else:
                    likely = _star(met, sets, turn, least).unionByName(_within(met, sets, turn, least)).distinct()
                    likely, compared = materialize(likely.join(tried, ["a", "b"], "left_anti"), "likely", outer=True), sets
                    tried = tried.unionByName(likely)
                groups = _joined(groups, materialize(_alike(likely, compared, least), "linked"))
                if turn + 1 == ROUNDS or open_.isEmpty():
                    break
                still = materialize(_apart(open_.drop("c"), groups), "apart", outer=turn < 2)
                if still.isEmpty():
                    break
                if turn == 1:
                    crowded = still
                if not turn:
                    sets = materialize(_shingles(_texts(still.select("k"), rows, nodes), size, marked=True), "sets", outer=True)
                members = materialize(_refined(still, sets, 2 if turn < 3 else 1), "members", outer=True) if turn else still
        if crowded is not None:
            with scratch(spark):
                left = materialize(_apart(crowded.drop("c"), groups), "left")
                if not left.isEmpty():
                    groups = _joined(groups, materialize(_across(left, sets, least), "across"))
        placed = materialize(nodes.select("k", "low").join(groups.withColumnRenamed("node", "k"), "k", "left")
                             .select("k", "low", F.coalesce("root", "k").alias("root")), "placed", outer=True)
    least_ids = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return found.select("doc_id", "k").join(placed.select("k", "root").join(least_ids, "root"), "k").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the documents that have a smaller id in their component; rows with a null id stay."""
    gone = near_copies(docs, **parameters).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
