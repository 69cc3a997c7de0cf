"""Chance quality by situation, scoreline, match period and goal difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.functions import scalars as S
from pitchline.operators.common import attach_totals
from pitchline.operators.shots import counts_by, shares_by, totals_of
from pitchline.session import materialize


def by_situation(shots: DataFrame) -> DataFrame:
    """Goal probability per situation: goal share x mean xG / shot share."""
    counts = counts_by(shots, ["situation"])
    shares = attach_totals(shares_by(counts, "situation", "situation_proportion"), totals_of(counts).select("avg_xg"))
    return shares.select("situation", "situation_proportion", "goal_proportion",
                         S.rate(F.col("goal_proportion") * F.col("avg_xg"), "situation_proportion").alias("goal_probability"))


def by_scoreline(labelled: DataFrame) -> DataFrame:
    """Share of shots, goals per shot inside the state and goal probability per scoreline of the shooter.

    Here goals are counted per shot of the state, not as a share of all goals as in the other tables.
    """
    states = labelled.groupBy(
        F.when(F.col("game_state") == "trailing", "losing").otherwise(F.col("game_state")).alias("scoreline_type")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("result_boolean").alias("g"), F.sum("xg").alias("x"), F.count("xg").alias("nx"))
    states = materialize(states, "scorelines")
    whole = states.agg(F.sum("n").alias("all_shots"), S.rate(F.sum("x"), F.sum("nx")).alias("avg_xg"))
    shares = attach_totals(states, whole).select(
        "scoreline_type", S.rate("n", "all_shots").alias("proportion"), S.rate("g", "n").alias("goal_distribution"), "avg_xg")
    return shares.select("scoreline_type", "proportion", "goal_distribution",
                         S.rate(F.col("goal_distribution") * F.col("avg_xg"), "proportion").alias("goal_probability"))


def by_period_state(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("period", "game_state").agg(F.avg("xg").alias("mean_xg"))


def by_period_goal_diff(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("period", "goal_diff").agg(F.avg("xg").alias("mean_xg"))


def by_goal_diff(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("goal_diff").agg(F.count("game_id").alias("shots"))


def period_report(labelled: DataFrame) -> DataFrame:
    """The three tables above from one scan; ``level`` tells them apart."""
    cells = labelled.groupingSets(
        [["period", "game_state"], ["period", "goal_diff"], ["goal_diff"]], "period", "game_state", "goal_diff"
    ).agg(F.avg("xg").alias("mean_xg"), F.count("game_id").alias("shots"), F.grouping_id().alias("__g"))
    level = F.when(F.col("__g") == 1, "period_state").when(F.col("__g") == 2, "period_goal_diff").otherwise("goal_diff")
    return cells.select(level.alias("level"), "period", "game_state", "goal_diff", "mean_xg", "shots")
