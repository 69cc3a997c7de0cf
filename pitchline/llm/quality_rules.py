"""Operator 9: quality rules whose cutoffs keep false rejections below a guaranteed rate in every stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchline.llm.common import bound, table, words
from pitchline.llm.registry import register
from pitchline.session import materialize

SYMBOLS = "#*$%&|<>"
BLANK_CHARACTERS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: A rule rejects what exceeds its cutoff. Values are whole numbers between 0 and 5000, so their counts stay a small table.
RULES = {
    "symbols": "1000 * n_symbols div nullif(word_chars, 0)",
    "dup_lines": "1000 * n_dup_lines div nullif(n_lines, 0)",
    "repeats": "1000 * n_repeat_words div nullif(n_words, 0)",
    "long_words": "100 * word_chars div nullif(n_words, 0)",
    "short_words": "5000 - 100 * word_chars div nullif(n_words, 0)",
}
STRATUM = "lang"


def _without(text: Column, characters) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text, by sorting the windows' 64-bit hashes.

    Two different windows of one text share a hash with a chance of about n * n / 2**65.
    """
    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["k"] == x["k"], F.lit(False))
                         | F.coalesce(F.get(s, i - 1)["k"] == x["k"], F.lit(False)))
        places = F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
        return F.size(F.array_distinct(places))

    def windows(h: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
        return bound(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(
            bound(F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("p")))), covered)))

    return F.when(F.size(w) < 3, 0).otherwise(bound(F.transform(w, lambda x: F.xxhash64(x)), windows))


def statistics(docs: DataFrame, stratum: str = STRATUM) -> DataFrame:
    """Per row: ``doc_id``, ``stratum``, ``n_words``, the counts of the base rules and ``n_lines`` (lines with a word).

    A null text is an empty one. Every count covers the whole text and is computed inside the row, without a shuffle.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"),
                       F.coalesce(F.col("text"), F.lit("")).alias("t"))
    t = F.col("t")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(_without(x, BLANK_CHARACTERS)) > 0)
    line_counts = bound(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    word_counts = bound(words(t), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("rep")))
    found = text.select("doc_id", "stratum", F.length(_without(t, BLANK_CHARACTERS)).alias("word_chars"),
                        (F.length(t) - F.length(_without(t, SYMBOLS))).alias("n_symbols"),
                        line_counts.alias("l"), word_counts.alias("w"))
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return found.select("doc_id", "stratum", long("w.n", "n_words"), long("word_chars", "word_chars"), long("n_symbols", "n_symbols"),
                        long("l.dup", "n_dup_lines"), long("w.rep", "n_repeat_words"), long("l.n", "n_lines"),
                        F.expr("w.n < 50 or 100 * w.rep > 50 * w.n").alias("base_failed"))


def allowed_rejections(n: Column, rate: Column | float, delta: Column) -> Column:
    """Largest k with P(Bin(n, rate) <= k) <= delta, -1 if there is none: the exact binomial test of "more than rate".

    k or fewer rejections among n good rows put the exact upper confidence bound of the rejection rate at or
    below ``rate``.
    """
    rate = F.lit(rate) if isinstance(rate, float) else rate
    n = n.cast("double")
    odds = F.log(rate / (1 - rate))

    def step(s: Column, j: Column) -> Column:
        term = F.when(j == 0, n * F.log1p(-rate)).otherwise(s["term"] + F.log((n - j + 1) / j) + odds)
        below = s["below"] + F.exp(term)
        return F.struct(term.alias("term"), below.alias("below"), F.when(below <= delta, j).otherwise(s["k"]).alias("k"))

    start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("below"), F.lit(-1).alias("k"))
    return F.aggregate(F.sequence(F.lit(0), F.ceil(n * rate).cast("int")), start, step, lambda s: s["k"])


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = 0.02, confidence: float = 0.95) -> DataFrame:
    """Columns ``stratum``, ``rule``, ``cutoff``: the strictest cutoffs that the labelled holdout allows.

    With probability ``confidence``, in every stratum at most ``risk`` of the good rows that pass the base rules are
    rejected. Each rule gets an equal part of the risk; the chance of error is divided by the number of tests
    (strata times rules, Bonferroni). Within a rule cutoffs are tried from lenient to strict until the exact test
    fails, an order fixed beforehand, so they need no further correction. A stratum with too few labelled rows gets
    no cutoff. All labelled rows count; a document labelled twice has its lowest quality.
    """
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).filter("quality = 1")
    held = stats.filter("not base_failed").join(good, "doc_id", "left_semi")
    value = F.explode(F.map_from_arrays(F.array(*[F.lit(r) for r in RULES]), F.array(*[F.expr(e) for e in RULES.values()])))
    counts = held.select("stratum", value.alias("rule", "value")).groupBy("stratum", "rule", "value").agg(F.count(F.lit(1)).alias("n"))
    by_rule = Window.partitionBy("stratum", "rule")
    above = F.coalesce(F.sum("n").over(by_rule.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = counts.select("stratum", "rule", "value", above.alias("above"), F.sum("n").over(by_rule).alias("n"))
    sizes = run.groupBy("stratum", "rule", "n").agg(F.collect_set(F.struct("value", "above")).alias("steps"))
    sizes = sizes.withColumn("tests", F.count(F.lit(1)).over(Window.partitionBy()))      # a row per stratum and rule
    k = allowed_rejections(F.col("n"), risk / len(RULES), F.lit(1 - confidence) / F.col("tests"))
    allowed = sizes.select("stratum", "rule", k.alias("k"), F.explode("steps").alias("s"))
    return allowed.filter("s.above <= k").groupBy("stratum", "rule").agg(F.min("s.value").alias("cutoff"))


def assess(docs: DataFrame, labels: DataFrame, risk: float = 0.02, confidence: float = 0.95, stratum: str = STRATUM) -> DataFrame:
    """``statistics`` and ``kept`` per row: false for rows that fail a base rule or exceed a cutoff of their stratum.

    Rows of one stratum share its cutoffs (a null stratum is one of its own); a stratum without cutoffs rejects
    nothing beyond the base rules. Repeated rows are judged alike, rows with a null id like any other.
    """
    stats = materialize(statistics(docs, stratum), "statistics")
    found = cutoffs(stats, labels, risk, confidence)
    key = F.concat_ws("/", F.col("rule"), F.coalesce(F.concat(F.lit("="), F.col("stratum")), F.lit("")))
    limits = found.agg(F.map_from_entries(F.collect_list(F.struct(key, "cutoff")))).scalar()
    own = stats.withColumn("limits", limits)
    exceeded = F.lit(False)
    for rule, value in RULES.items():
        limit = F.try_element_at("limits", F.concat_ws("/", F.lit(rule), F.coalesce(F.concat(F.lit("="), F.col("stratum")), F.lit(""))))
        exceeded = exceeded | F.coalesce(F.expr(value) > limit, F.lit(False))
    return own.withColumn("kept", ~F.col("base_failed") & ~exceeded).drop("limits")


ORACLE = r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
gg AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT p + o) AS rep FROM gg, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY 1),
s AS (SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1),
v AS (SELECT doc_id, lang, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'long_words', 'short_words']) AS rule,
             unnest([1000 * n_symbols // word_chars, 1000 * n_dup_lines // n_lines, 1000 * n_repeat_words // n_words,
                     100 * word_chars // n_words, 5000 - 100 * word_chars // n_words]) AS value FROM b),
h AS (SELECT lang, rule, value, count(*) AS n FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL),
a AS (SELECT lang, rule, value, coalesce(sum(n) OVER (PARTITION BY lang, rule ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING
             AND 1 PRECEDING), 0) AS above, sum(n) OVER (PARTITION BY lang, rule) AS n FROM h),
z AS (SELECT lang, n, count(*) AS rules FROM (SELECT DISTINCT lang, rule, n FROM a) GROUP BY ALL),
tests AS (SELECT sum(rules) AS m FROM z),
j AS (SELECT lang, n::DOUBLE AS n, unnest(range(0, ceil(n * 0.004)::BIGINT + 1)) AS j FROM z),
p AS (SELECT lang, j, sum(CASE WHEN j = 0 THEN n * ln(1 - 0.004) ELSE ln((n - j + 1) / j) + ln(0.004 / 0.996) END)
             OVER (PARTITION BY lang ORDER BY j) AS term FROM j),
k AS (SELECT lang, coalesce(max(j) FILTER (below <= (1 - 0.95) / m), -1) AS k
      FROM (SELECT lang, j, sum(exp(term)) OVER (PARTITION BY lang ORDER BY j) AS below FROM p), tests GROUP BY 1),
f AS (SELECT a.lang, a.rule, min(value) AS cutoff FROM a JOIN k ON a.lang IS NOT DISTINCT FROM k.lang WHERE above <= k GROUP BY ALL),
r AS (SELECT DISTINCT v.doc_id FROM v JOIN f ON v.rule = f.rule AND v.lang IS NOT DISTINCT FROM f.lang WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM r) AS kept FROM b
"""


@register("op9_risk_controlled_rules", ORACLE)
def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
