"""Operator 5: mixing sources to target weights by budgets that flow down a tree of domain, language and source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchline.llm.common import table, words
from pitchline.llm.registry import register
from pitchline.session import materialize

LEVELS = ("domain", "lang", "source")
#: Weights of the registered query, by level and name; a name not listed has weight 1.
WEIGHTS = {"domain": {"d0": 40, "d1": 30, "d2": 20, "d3": 10}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}}
SHARE = (3, 5)
#: An epoch's order is cut into this many runs of equal key prefixes; sums of runs find where a budget ends.
PREFIX = 4


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    named = weights.get(level, {})
    if not named:
        return F.lit(1).cast("long")
    known = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.col(level)), F.lit(1)).cast("long")


def _pour(children: DataFrame, parent: list[str]) -> DataFrame:
    """Share each parent's ``poured`` tokens among its children in proportion to ``weight``, none above its ``cap``.

    What a child can't take goes to its siblings by weight. In order of cap over weight, a child is full if its cap is no
    more than its part of what is left after all full ones before it; the first that isn't sets the level of the
    rest. Weights and caps are whole numbers, so sums are exact in any order; parts are rounded down.
    """
    group = Window.partitionBy(*parent) if parent else Window.partitionBy()
    order = group.orderBy(F.col("cap") / F.col("weight"), "name").rowsBetween(Window.unboundedPreceding, -1)
    sums = children.filter("weight > 0").withColumn("before", F.coalesce(F.sum("cap").over(order), F.lit(0))) \
        .withColumn("heavy", F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(order), F.lit(0)))
    level = (F.col("poured") - F.col("before")) / F.col("heavy")
    full = F.col("cap") / F.col("weight") <= F.col("level")
    marked = sums.withColumn("level", level).withColumn("open", F.max(F.when(~full, F.col("level"))).over(group))
    return marked.withColumn("budget", F.when(full, F.col("cap")).otherwise(F.floor(F.col("weight") * F.greatest("open", F.lit(0.0)))).cast("long"))


def budgets(leaves: DataFrame, budget: int, levels=LEVELS, weights=WEIGHTS, max_epochs: int = 1) -> DataFrame:
    """``levels``, ``supply`` and ``budget`` (both in tokens) per leaf of ``leaves`` (``levels``, ``supply``).

    A node can take ``max_epochs`` times the supply below it, so what a leaf lacks goes to its siblings first and only
    what all of them together lack is shared among the siblings of its parent, and so on up to the root. If the whole
    tree lacks tokens, all leaves are full. Names of weight 0 get nothing.
    """
    capped = leaves.withColumn("cap", F.col("supply") * max_epochs)
    for d, level in reversed(list(enumerate(levels))):           # a weight of 0 closes its whole subtree
        capped = capped.withColumn("cap", F.when(_weight(level, weights) > 0, F.col("cap")).otherwise(0))
    above = None
    for d, level in enumerate(levels):
        parent, own = list(levels[:d]), list(levels[:d + 1])
        nodes = capped.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights)).withColumn("name", F.col(level))
        nodes = nodes.withColumn("poured", F.lit(budget).cast("long")) if above is None else nodes.join(above, parent)
        above = _pour(nodes, parent).select(*own, F.col("budget").alias("poured"))
    return leaves.join(above.withColumnRenamed("poured", "budget"), list(levels))


def _key(seed: int, epoch: Column, id_: Column) -> Column:
    return F.md5(F.concat_ws("/", F.lit(seed).cast("string"), epoch.cast("string"), id_.cast("string")))


def mix(docs: DataFrame, budget: int | None = None, share: tuple[int, int] = SHARE, levels=LEVELS, weights=WEIGHTS,
        max_epochs: int = 2, seed: int = 11) -> DataFrame:
    """``doc_id``, ``levels``, ``n_tokens`` and ``epoch``: a row for each time a document is taken.

    A leaf with budget b and supply s takes b div s whole epochs, then, in the seeded order of the next epoch, the
    documents up to the last whose running sum of tokens stays within b mod s. Tokens are words; ``budget`` is in
    tokens, or the fraction ``share`` of all there are. A null name of a level is the empty name. Empty texts have no
    tokens and are taken with the epoch they stand in; a leaf without a budget gives none. Rows repeated under
    one id are taken separately and stand next to each other, shorter first; a null id stands as -1.

    A leaf may hold a third of all rows: its order is never gathered. Sums of runs of the order (``PREFIX`` hex digits
    of a document's key, summed before the shuffle) show in which run the budget ends; only that run is ordered.
    """
    levels = list(levels)
    rows = docs.select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels],
                       F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
    rows = materialize(rows, "sizes")
    leaves = materialize(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("supply")), "leaves")
    if budget is None:
        budget = (leaves.agg(F.sum("supply")).first()[0] or 0) * share[0] // share[1]
    planned = budgets(leaves, budget, levels, weights, max_epochs).filter("budget > 0 and supply > 0") \
        .select(*levels, F.expr("budget div supply").alias("whole"), F.expr("budget % supply").alias("rest"))
    planned = materialize(planned, "budgets")
    keyed = rows.join(planned, levels).withColumn("key", _key(seed, F.col("whole"), F.coalesce("doc_id", F.lit(-1)))) \
        .withColumn("run", F.substring("key", 1, PREFIX))
    runs = keyed.groupBy(*levels, "run", "rest").agg(F.sum("n_tokens").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*levels).orderBy("run"))
    ends = runs.withColumn("up_to", up_to).filter("rest > 0 and up_to > rest").groupBy(*levels).agg(
        F.min("run").alias("last"), F.min_by(F.col("up_to") - F.col("n"), "run").alias("before"))
    placed = keyed.join(materialize(ends, "ends"), levels, "left")
    columns = ["doc_id", *levels, "n_tokens", "whole"]
    outside = placed.filter("last is null or run <> last").select(*columns, F.coalesce(F.col("run") < F.col("last"), F.lit(False)).alias("more"))
    sums = F.sum("n_tokens").over(Window.partitionBy(*levels).orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    inside = placed.filter("run = last").select(*columns, (F.col("before") + sums <= F.col("rest")).alias("more"))
    taken = reduce(DataFrame.unionByName, [outside, inside]).withColumn("times", F.col("whole") + F.col("more").cast("long")).filter("times > 0")
    return taken.select("doc_id", *levels, "n_tokens", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1)).alias("epoch"))


def domain(source: Column) -> Column:
    """Domain of a source: its number modulo 4 (sources without a number are in the first)."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), (F.when(number == "", 0).otherwise(F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as int)")) % 4).cast("string"))


def keep_mixed(docs: DataFrame, share: tuple[int, int] = (9, 10), **parameters) -> DataFrame:
    """Rows of ``docs`` (with its columns) that one epoch's mix takes; rows with a null id are not taken."""
    chosen = mix(docs.withColumn("domain", domain(F.col("source"))), share=share, max_epochs=1, **parameters)
    return docs.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")


_CASE = lambda level: "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {"": 1}).items()) + " ELSE 1 END"


def _oracle() -> str:
    sql = rf"""
WITH r AS (SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT), 0) % 4) AS domain,
                  coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply FROM r GROUP BY ALL),
root AS (SELECT (sum(supply) * {SHARE[0]} // {SHARE[1]})::BIGINT AS poured FROM leaf)"""
    above = "root"
    for d, level in enumerate(LEVELS):
        parent, own = ", ".join(LEVELS[:d]), ", ".join(LEVELS[:d + 1])
        by = f"PARTITION BY {parent}" if parent else ""
        join = f"JOIN {above} USING ({parent})" if parent else f", {above}"
        sql += f""",
n{d} AS (SELECT c.*, poured FROM (SELECT {own}, sum(supply * 2)::BIGINT AS cap, {_CASE(level)} AS weight FROM leaf GROUP BY {own}) c {join}),
s{d} AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS before, sum(weight) OVER ({by}) - coalesce(sum(weight) OVER w, 0) AS heavy FROM n{d}
         WINDOW w AS ({by} ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l{d} AS (SELECT *, (poured - before)::DOUBLE / heavy::DOUBLE AS level FROM s{d}),
o{d} AS (SELECT *, max(level) FILTER (cap / weight > level) OVER ({by}) AS open FROM l{d}),
b{d} AS (SELECT {own}, (CASE WHEN cap / weight <= level THEN cap ELSE floor(weight * greatest(open, 0.0)) END)::BIGINT AS poured FROM o{d})"""
        above = f"b{d}"
    return sql + f""",
p AS (SELECT leaf.*, poured // supply AS whole, poured % supply AS rest FROM leaf JOIN {above} USING ({", ".join(LEVELS)}) WHERE poured > 0 AND supply > 0),
k AS (SELECT r.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('11/' || whole || '/' || coalesce(doc_id, -1)), n_tokens
             ROWS UNBOUNDED PRECEDING) AS run FROM r JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(whole + (rest > 0 AND run <= rest)::INT))::INT AS epoch FROM k
"""


ORACLE = _oracle()


@register("op5_hierarchical_mixing", ORACLE)
def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs.withColumn("domain", domain(F.col("source"))))
