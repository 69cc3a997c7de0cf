"""Small building blocks: one-row totals, exact quantiles at scale, most frequent value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attach_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row as a scalar subquery (no join, no shuffle of ``df``)."""
    one = totals.select(F.struct(*[F.col(c) for c in totals.columns]).alias("t")).scalar()
    tagged = df.withColumn("__t", one)
    return tagged.select(*df.columns, *[F.col("__t")[c].alias(c) for c in totals.columns])


def attach_by(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals per group, or one-row totals when there is no group."""
    return df.join(small, list(by), "inner") if by else attach_totals(df, small)


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, count: str | None = None,
                  ignore: Sequence[str] = ("", "null")) -> DataFrame:
    """Most frequent non-empty ``value`` per key; ties go to the smallest value.

    Two aggregations: the first runs on (key, value) and is combined map-side, so a key holding most of the
    rows is already reduced to its distinct values before it meets in one place.
    """
    weight = F.sum(count) if count else F.count(F.lit(1))
    kept = df.filter(F.col(value).isNotNull() & ~F.col(value).isin(list(ignore)))
    counted = kept.groupBy(*keys, value).agg(weight.alias("__n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(value))


SKETCH_ACCURACY = 10_000


def exact_quantile(df: DataFrame, value: str, q: float, by: Sequence[str] = (), name: str = "quantile") -> DataFrame:
    """Exact linearly interpolated quantile per group without gathering a group.

    A mergeable sketch brackets the wanted ranks; its rank error is below ``1/SKETCH_ACCURACY`` of the group, and the bracket is
    four times as wide, then widened by the next value on either side, so both ranks lie inside for groups of any size.
    Only the distinct values inside the bracket are ordered; rows below it are merely counted.
    """
    keys = list(by)
    v = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    slack = 4.0 / SKETCH_ACCURACY
    sketch = F.percentile_approx("__v", [max(0.0, q - slack), min(1.0, q + slack)], SKETCH_ACCURACY)
    near = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), sketch.alias("__b"))
    below, over = F.col("__v") < F.col("__b")[0], F.col("__v") > F.col("__b")[1]
    bracket = attach_by(v, near, keys).groupBy(*keys, "__n", "__b").agg(
        F.max(F.when(below, F.col("__v"))).alias("__lo"), F.min(F.when(over, F.col("__v"))).alias("__hi"))
    bracket = bracket.select(*keys, "__n", F.coalesce("__lo", F.col("__b")[0]).alias("__lo"), F.coalesce("__hi", F.col("__b")[1]).alias("__hi"))
    counted = (
        attach_by(v, bracket, keys).filter(F.col("__v") <= F.col("__hi"))
        .withColumn("__v", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")))
        .groupBy(*keys, "__n", "__v").agg(F.count(F.lit(1)).alias("__c"))
    )
    window = Window.partitionBy(*keys, "__n").orderBy(F.col("__v").asc_nulls_first())
    position = F.lit(q) * (F.col("__n") - 1)
    ranked = (
        counted.withColumn("__last", F.sum("__c").over(window.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        .withColumn("__first", F.col("__last") - F.col("__c") + 1)
        .withColumn("__k", F.floor(position)).withColumn("__f", position - F.floor(position))
        .withColumn("__k2", F.least(F.col("__k") + 1, F.col("__n") - 1))
    )

    def at(rank: str):
        return F.max(F.when(F.col(rank).between(F.col("__first"), F.col("__last")), F.col("__v")))

    picked = ranked.groupBy(*keys).agg(at("__k").alias("__a"), at("__k2").alias("__z"), F.max("__f").alias("__f"))
    return picked.select(*keys, (F.col("__a") + F.col("__f") * (F.col("__z") - F.col("__a"))).alias(name))
