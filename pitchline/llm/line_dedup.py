"""Operator 7: lines equal up to one character, by a join of their deletion neighbourhoods; the earliest stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchline.llm.common import WORD, table
from pitchline.llm.registry import register
from pitchline.session import materialize

#: Lines of fewer characters are only held against equal lines: among short words one character is another word.
MIN_CHARS = 10
#: Candidates are seen as this many blocks (all lines as two halves, before).
FINE = 16
_SHIFT = 1 << 32


#: Number of the first row without an id, beyond all ids.
_BEYOND = "9223372036854775808"


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__doc`` and ``__skip``, the number of each row and of the lines that stand before its own under that number.

    The number is the id. Different texts under one id follow one another in the order of their hashes; each row without
    an id has a number of its own after all ids, in the order in which rows are read.
    """
    id_, hash_ = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.filter("doc_id is not null").select(id_.alias("__i"), hash_.alias("__h"),
                                                     F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("size"))
    several = texts.groupBy("__i").agg(F.min("__h").alias("low"), F.max("__h").alias("high")).filter("low <> high").select("__i")
    before = Window.partitionBy("__i").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    skips = materialize(texts.join(several, "__i", "left_semi").distinct().select(
        "__i", "__h", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__skip")), "skips")
    named = docs.filter("doc_id is not null").withColumn("__i", id_).withColumn("__h", hash_).join(skips, ["__i", "__h"], "left") \
        .withColumn("__doc", F.col("__i").cast("decimal(20,0)")).withColumn("__skip", F.coalesce("__skip", F.lit(0).cast("long"))) \
        .select(*docs.columns, "__doc", "__skip")
    own = (F.lit(_BEYOND).cast("decimal(20,0)") + F.monotonically_increasing_id()).cast("decimal(20,0)")
    nameless = materialize(docs.filter("doc_id is null").select("*", own.alias("__doc"), F.lit(0).cast("long").alias("__skip")), "nameless")
    return named.unionByName(nameless)


def _lines(placed: DataFrame) -> DataFrame:
    """Every line with a word: its place in the corpus, its text and a 128-bit key of it."""
    rows = placed.select("__doc", "__skip", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    pos = (F.col("__doc") * F.lit(_SHIFT).cast("decimal(10,0)") + F.col("__skip") + F.col("line_no")).cast("decimal(31,0)")
    return rows.filter(F.col("line").rlike(WORD)).select(
        "__doc", "__skip", "line_no", "line", pos.alias("pos"), F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def _halves(line: str, n: str) -> list[Column]:
    """``_surroundings`` for two blocks, as plain columns: every line has them, and these compile."""
    out = []
    for base in (F.col(n), F.col(n) - 1):
        cut = F.floor(base / 2).cast("int")
        out += [F.xxhash64(base, F.lit(0), F.substr(line, F.col(n) - base + cut + 1)), F.xxhash64(base, F.lit(1), F.left(line, cut))]
    return out


def _around(line: Column, base: Column, q: Column) -> Column:
    """Hash of what surrounds block q of a line whose blocks are measured on ``base`` characters."""
    begin, end = F.floor(q * base / FINE).cast("int"), F.floor((q + 1) * base / FINE).cast("int")
    return F.xxhash64(base, q, F.left(line, begin), F.lit("\n"), F.right(line, base - end))


def _surroundings(line: Column, n: Column) -> Column:
    """One entry per block for the line's own length and for one less.

    Two lines within one edit agree outside the block that holds the edit, with both measured on the length of the
    shorter (of either, if they are equally long). So lines that share no such entry have no partner.
    """
    def entries(base: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(FINE - 1)), lambda q: F.struct(
            _around(line, base, q).alias("key"), base.alias("base"), q.alias("q")))

    return F.concat(entries(n), entries(n - 1))


def _shared(filed: DataFrame) -> DataFrame:
    """Keys under which different lines stand."""
    return filed.groupBy("key").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).filter("a <> b").select("key")


def _variants(filed: DataFrame) -> DataFrame:
    """The deletion neighbourhood of each line inside the blocks whose surroundings another line shares.

    Role 0: the block as it is; role 1: a character taken out, to meet a line that lacks it; role 2: a character
    taken out at a known place, to meet an equally long line that has another one there.
    """
    begin = F.floor(F.col("q") * F.col("base") / FINE).cast("int")
    end = F.floor((F.col("q") + 1) * F.col("base") / FINE).cast("int")
    longer = F.col("n") > F.col("base")
    middle = filed.withColumn("mid", F.substr("line", begin + 1, end - begin + longer.cast("int"))).withColumn("longer", longer)
    out = F.explode(F.sequence(F.lit(-1), F.greatest(F.length("mid") - 1, F.lit(-1))))
    spread = middle.select("k1", "k2", "pos", "key", "mid", "longer", out.alias("i")).filter("i >= 0 or not longer")
    without = F.concat(F.left("mid", F.col("i")), F.substr("mid", F.col("i") + 2, F.length("mid")))
    return spread.select("k1", "k2", "pos", F.when(F.col("i") < 0, 0).when(F.col("longer"), 1).otherwise(2).alias("role"),
                         F.when(F.col("i") < 0, F.xxhash64("key", F.lit(-1), "mid"))
                         .when(F.col("longer"), F.xxhash64("key", F.lit(-1), without))
                         .otherwise(F.xxhash64("key", "i", without)).alias("variant"))


def _earlier(cand: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``earlier``: the first place of a line that stands before this one and is one edit away."""
    filed = cand.select("*", F.inline(F.array_distinct(_surroundings(F.col("line"), F.col("n")))))
    met = filed.join(_shared(filed), "key", "left_semi")
    rows = materialize(_variants(met), "variants")
    low = lambda role: F.min(F.when(F.col("role") == role, F.col("pos")))
    groups = rows.groupBy("variant").agg(low(0).alias("m0"), low(1).alias("m1"), low(2).alias("m2"),
                                         F.min("pos").alias("a"), F.max("pos").alias("b")).filter("a < b").drop("a", "b")
    # all of role 2 in a group are one edit apart, all of role 1 are one edit from role 0: the least of each will do
    partner = F.when(F.col("role") == 0, F.col("m1")).when(F.col("role") == 1, F.col("m0")).otherwise(F.col("m2"))
    pairs = rows.join(groups, "variant").select("k1", "k2", "pos", partner.alias("earlier")).filter("earlier < pos").distinct()
    own, other = cand.select("pos", "line"), cand.select(F.col("pos").alias("earlier"), F.col("line").alias("other"))
    verified = pairs.join(own, "pos").join(other, "earlier").filter(F.levenshtein("line", "other", 1) >= 0)
    return verified.groupBy("k1", "k2").agg(F.min("earlier").alias("earlier"))


def _repeated(placed: DataFrame, min_chars: int) -> DataFrame:
    """``__doc``, ``__skip``, ``removed`` (0-based numbers) of the lines that repeat an earlier line, for rows that have any.

    A line repeats an earlier one if an equal line stands before it, or a line one inserted, deleted or replaced
    character away where both have ``min_chars`` characters or more. "Before" means a smaller place (see
    ``_placed``); every line of the input counts, whether it is itself removed or not.
    """
    lines = _lines(placed)
    names = ["h0", "h1", "h2", "h3"]
    measured = lines.select("k1", "k2", "pos", "line", F.length("line").alias("n"))
    keyed = measured.select("k1", "k2", "pos", *[F.when(F.col("n") >= min_chars, h).alias(c) for c, h in zip(names, _halves("line", "n"))])
    distinct = materialize(keyed.groupBy("k1", "k2").agg(
        F.min("pos").alias("pos"), F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in names]), "lines")
    halves = distinct.select("k1", "k2", "pos", F.explode(F.array(*names)).alias("key")).filter("key is not null")
    wanted = halves.join(_shared(halves), "key", "left_semi").select("pos").distinct()
    cand = materialize(lines.join(wanted, "pos", "left_semi").select("k1", "k2", "pos", "line", F.length("line").alias("n"))
                       .dropDuplicates(["pos"]), "candidates")
    near = materialize(_earlier(cand), "earlier")
    first = distinct.select("k1", "k2", "pos", "times").join(near, ["k1", "k2"], "left").filter("times > 1 or earlier is not null") \
        .select("k1", "k2", F.least("pos", "earlier").alias("first"))
    gone = lines.select("__doc", "__skip", "line_no", "pos", "k1", "k2").join(first, ["k1", "k2"]).filter("pos > first")
    return gone.groupBy("__doc", "__skip").agg(F.collect_set("line_no").alias("removed"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` cleared of repeated lines, ``n_lines`` (lines with a word) and ``n_removed``.

    Lines without a word stay. A null text becomes an empty one. Different texts under one id are documents of their
    own, as is every row without an id; equal texts under one id are one document. Columns of the input of the two new names are replaced.
    """
    placed = _placed(docs)
    gone = _repeated(placed.select("text", "__doc", "__skip"), min_chars).withColumnRenamed("removed", "__gone")
    joined = placed.join(gone, ["__doc", "__skip"], "left") \
        .withColumn("__l", F.split(F.coalesce("text", F.lit("")), "\n", -1)) \
        .withColumn("__r", F.coalesce("__gone", F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__l") - 1), F.col("__r"))
    text = F.array_join(F.transform(kept, lambda i: F.get(F.col("__l"), i)), "\n")
    return joined.withColumn("text", text).withColumn("n_lines", F.size(F.filter("__l", lambda x: x.rlike(WORD))).cast("long")) \
        .withColumn("n_removed", F.size("__r").cast("long")).drop("__doc", "__skip", "__gone", "__l", "__r")


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no,
                  unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
w AS (SELECT *, doc_id::HUGEINT * 4294967296 + line_no AS pos, regexp_matches(line, '[^\x20\x09-\x0D]') AS word FROM l),
f AS (SELECT line, length(line) AS n, min(pos) AS pos FROM w WHERE word GROUP BY 1),
v AS (SELECT line, n, pos, i, left(line, i) || substr(line, i + 2) AS cut FROM (SELECT *, unnest(range(n)) AS i FROM f WHERE n >= 10)),
s AS (SELECT line, min(low) AS e FROM (SELECT line, min(pos) OVER (PARTITION BY hash(cut), cut, i, n) AS low FROM v) GROUP BY 1),
x AS (SELECT DISTINCT v.line AS long_line, v.pos AS long_pos, f.line, f.pos FROM v JOIN f ON v.cut = f.line AND f.n >= 10),
a AS (SELECT long_line AS line, min(pos) AS e FROM x GROUP BY 1 UNION ALL SELECT line, min(long_pos) FROM x GROUP BY 1
      UNION ALL SELECT line, e FROM s UNION ALL SELECT line, pos FROM f),
e AS (SELECT line, min(e) AS e FROM a GROUP BY 1),
k AS (SELECT w.doc_id, w.line_no, w.line, w.word, w.word AND w.pos > e.e AS gone FROM w LEFT JOIN e ON w.line = e.line AND w.word)
SELECT doc_id, count(*) FILTER (word) AS n_lines, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text FROM k GROUP BY doc_id
"""


@register("op7_line_dedup", ORACLE)
def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
