"""Matching of team names to a list of candidate names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.functions.scalars import match_name


def _substrings(text: str, shortest: int):
    """All substrings of a name, the empty one included when ``shortest`` is 0."""
    starts = F.sequence(F.lit(1), F.length(text))
    cuts = F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.length(text) - i + 1), lambda n: F.substring(F.col(text), i, n)))
    found = F.array_distinct(F.when(F.length(text) > 0, F.flatten(cuts)).otherwise(F.array().cast("array<string>")))
    return F.array_union(found, F.array(F.lit(""))) if shortest == 0 else found


def match_names(names: DataFrame, candidates: DataFrame, name: str = "name", candidate: str = "candidate",
                order: str = "position") -> DataFrame:
    """One row per distinct name: its candidate, and whether the match was ``exact``, ``contains`` or ``none``.

    Names are normalised first. An exact match wins; otherwise the first candidate (by ``order``) that contains the
    name or is contained in it. Containment is an equi-join on substrings, reduced to the first candidate per
    substring before it is joined, so no pairs of names are compared. Of several candidates with one normalised
    form the first gives the position and the last gives the result.
    """
    n = names.select(F.col(name).alias("name")).filter(F.col("name").isNotNull()).distinct().withColumn("key", match_name("name"))
    c = candidates.select(F.col(candidate).alias("candidate"), F.col(order).alias("pos")).withColumn("key", match_name("candidate"))
    c = c.filter(F.col("key") != "").groupBy("key").agg(F.min("pos").alias("pos"), F.max_by("candidate", "pos").alias("candidate"))
    exact = n.join(c.drop("pos"), "key").select("name", "candidate", F.lit("exact").alias("how"))
    rest = n.join(c.select("key"), "key", "left_anti")

    first = F.min_by("candidate", "pos").alias("candidate"), F.min("pos").alias("pos")
    inside = c.select(F.explode(_substrings("key", 0)).alias("part"), "candidate", "pos").groupBy("part").agg(*first)
    within = rest.join(inside, rest["key"] == inside["part"]).select("name", "candidate", "pos")
    around = rest.select("name", F.explode(_substrings("key", 1)).alias("part")).join(
        c.withColumnRenamed("key", "part"), "part").select("name", "candidate", "pos")
    fuzzy = within.unionByName(around).groupBy("name").agg(F.min_by("candidate", "pos").alias("candidate")).select(
        "name", "candidate", F.lit("contains").alias("how"))
    none = rest.join(fuzzy, "name", "left_anti").select("name", F.lit(None).cast("string").alias("candidate"), F.lit("none").alias("how"))
    return exact.unionByName(fuzzy).unionByName(none)
