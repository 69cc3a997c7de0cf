"""Operator 8: SimHash fingerprints, linked within a few bits by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchline.llm.common import small_batches, table
from pitchline.llm.components import components
from pitchline.llm.registry import register
from pitchline.session import materialize

BITS, SEGMENTS, SEED = 64, 2, 42
#: A key of a segment table with more members is refined, at most so often.
CROWDED, DEPTH = 32, 3
_CHUNK = 1 << 16


def fingerprint(text: bytes, size: int = 3) -> int:
    """Bit k is 1 if it is set in over half of the shingles' hashes (signed 64-bit value; no words: 0)."""
    words = text.lower().split()                       # of bytes: lowers A-Z, splits at the six ASCII blanks
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for low in range(0, len(shingles), _CHUNK):
        hashes = np.array([digest(s, SEED) for s in shingles[low:low + _CHUNK]], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3) -> DataFrame:
    """Columns ``doc_id`` and ``fp`` (long) per row of ``docs``. A null text has no words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = [fingerprint(t.as_py() or b"", size) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _parts(width: int, at: list[int]) -> list[list[int]]:
    """``at`` dealt into ``width`` runs of nearly equal length."""
    size, more = divmod(len(at), width)
    ends = [size * (k + 1) + min(k + 1, more) for k in range(width)]
    return [at[low:high] for low, high in zip([0, *ends], ends)]


def _mask(bits: list[int]) -> int:
    """The bits of a signed 64-bit value."""
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _refined(known: list[int], open_: list[int], depth: int, max_bits: int) -> list[list[tuple[int, int, int]]]:
    """Per depth (path, path at the depth before, mask): the known bits and one of ``max_bits`` + 1 parts of the others, and so on."""
    levels, now = [], [(0, known, open_)]
    for _ in range(depth):
        level, after = [], []
        for path, bits, left in now:
            for part in _parts(max_bits + 1, left):
                number = len(level)
                level.append((number, path, _mask(bits + part)))
                after.append((number, bits + part, [b for b in left if b not in part]))
        levels.append(level)
        now = after
    return levels


def links(values: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (``a``, ``b``) between all ``fp`` of ``values`` (distinct) that differ in at most ``max_bits`` bits.

    There is a table for each of ``SEGMENTS`` segments, filed by the value of that segment. Of two fingerprints within the bound one
    segment differs in at most ``max_bits // SEGMENTS`` bits, so each fingerprint looks up the Hamming ball of that radius around
    each of its segments; the complete distance of what it meets is verified. A key with more than ``CROWDED`` members is
    refined: of the bits outside the segment, dealt into ``max_bits`` + 1 parts, one part is equal, and its value joins the key; then
    the same with what is left. At the last depth the bits that aren't in the key are too few for a large bucket, so lookups stay in
    proportion to fingerprints however crowded a segment is, and no link is lost.

    The planner sizes what is looked up as if a fingerprint had one lookup, so a broadcast of it, which the driver would hold, is ruled out.
    """
    if not 0 <= max_bits < BITS // 2:
        raise ValueError("max_bits is out of range")
    radius, segments = max_bits // SEGMENTS, _parts(SEGMENTS, list(range(BITS)))
    tables, lookups = [], []
    for number, bits in enumerate(segments):
        flips = [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(bits, r)]
        flips = F.array(*[F.lit(f - (1 << BITS) if f >> (BITS - 1) else f) for f in flips])
        segment = values.select("fp", F.lit(number).alias("segment"), F.lit(0).alias("path"), F.lit(_mask(bits)).alias("mask"))
        tables.append(segment.select("segment", "path", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), F.lit(0).cast("long").alias("more"), "fp"))
        lookups.append(segment.select("segment", "path", F.explode(F.transform(
            flips, lambda f: F.col("fp").bitwiseXOR(f).bitwiseAND(F.col("mask")))).alias("value"), F.lit(0).cast("long").alias("more"), "fp"))
    filed, asked = reduce(DataFrame.unionByName, tables), reduce(DataFrame.unionByName, lookups)
    inner = [_refined([], [b for b in range(BITS) if b not in bits], DEPTH, max_bits) for bits in segments]
    key, found = ["segment", "path", "value", "more"], []
    for depth in range(DEPTH + 1):
        sizes = filed.groupBy(*key).agg(F.count(F.lit(1)).alias("members"))
        crowded = materialize(sizes.filter(F.col("members") > CROWDED).select(*key), "crowded") if depth < DEPTH else None
        if crowded is not None and crowded.isEmpty():
            crowded = None
        table_ = filed if crowded is None else filed.join(crowded, key, "left_anti")
        met = asked.join(table_.withColumnRenamed("fp", "other").hint("merge"), key)
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits
        found.append(met.filter((F.col("fp") != F.col("other")) & near)
                     .select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")))
        if crowded is None:
            break
        parts = F.array(*[F.array(*[F.struct(F.lit(path).alias("path"), F.lit(before).alias("before"), F.lit(mask).alias("mask"))
                                    for path, before, mask in inner[n][depth]]) for n in range(SEGMENTS)])

        def deeper(rows: DataFrame) -> DataFrame:
            some = rows.join(crowded, key, "left_semi")
            each = some.select("segment", "path", "value", "fp", F.explode(F.element_at(parts, F.col("segment") + 1)).alias("part"))
            return materialize(each.filter("part.before = path").select(
                "segment", "part.path", "value", F.col("fp").bitwiseAND(F.col("part.mask")).alias("more"), "fp"), "refined")

        filed, asked = deeper(filed), deeper(asked)
    return reduce(DataFrame.unionByName, found).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """Columns ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest ``doc_id`` reachable) per row.

    Equal texts share a fingerprint and are one node of the graph, so copies are never expanded into pairs. Empty and
    null texts have fingerprint zero and link like any other. Each row counts by its own text, also under a repeated id; a null
    id takes part in no minimum, but its text links like any other (a component of null ids only has a null id). Other columns are
    ignored, an empty table gives an empty one.
    """
    found = materialize(fingerprints(docs, id_column, text_column, size), "fingerprints")
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    pairs = materialize(links(nodes.select("fp"), max_bits), "links")
    # a fingerprint's name is its smallest id, so a root is the smallest id reachable; without an id it is the fingerprint, after all ids
    name = F.struct(F.col("low").isNull().alias("nameless"), F.coalesce("low", "fp").alias("id"))
    named = nodes.select("fp", name.alias("name"))
    a, b = (named.select(F.col("fp").alias(side), F.col("name").alias(f"name_{side}")) for side in "ab")
    edges = pairs.join(a, "a").join(b, "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
    roots = components(edges)
    root = F.coalesce("root", "name")
    grouped = named.join(roots, named["name"] == roots["node"], "left") \
        .select("fp", F.when(~root["nameless"], root["id"]).alias("component_id"))
    return found.join(grouped, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the documents that have a smaller id in their component; rows with a null id stay."""
    gone = near_duplicates(docs, **parameters).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


@register("op8_simhash_near_dedup")
def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
