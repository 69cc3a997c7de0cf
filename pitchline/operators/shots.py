"""Shot labels and per-player / per-team shot aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.functions import scalars as S
from pitchline.operators.common import attach_totals
from pitchline.session import materialize

PLAYER = ("player_id", "player")


def cast_shots(raw: DataFrame) -> DataFrame:
    """Typed shots from text columns; a value that does not parse becomes NULL."""
    types = {"minute": "int", "x": "double", "y": "double", "xg": "double", "h_goals": "int", "a_goals": "int"}
    return raw.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in raw.columns})


def cast_appearances(raw: DataFrame) -> DataFrame:
    types = {"xg": "double", "minutes": "int", "goals": "int", "own_goals": "int", "shots": "int"}
    return raw.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in raw.columns})


def label_shots(shots: DataFrame) -> DataFrame:
    """Goal flag, match period, game state, goal difference and the two teams of every shot."""
    diff = S.shooter_goal_diff("h_a", "h_goals", "a_goals")
    home = F.col("h_a") == "h"
    return shots.withColumns({
        "result_boolean": F.coalesce(S.is_goal_result("result").cast("int"), F.lit(0)),
        "period": S.period_label("minute"),
        "game_state": S.game_state(diff),
        "goal_diff": S.goal_diff_label(diff),
        "kicker_team": F.when(home, F.col("h_team")).when(F.col("h_a") == "a", F.col("a_team")),
        "conceded_team": F.when(home, F.col("a_team")).when(F.col("h_a") == "a", F.col("h_team")),
    })


def shot_totals(shots: DataFrame) -> DataFrame:
    """One row: shots, goals, mean and summed xG, goals per xG."""
    one = shots.agg(F.count(F.lit(1)).alias("all_shots"), F.count_if(S.is_goal_result("result")).alias("all_goals"),
                    F.avg("xg").alias("avg_xg"), F.sum("xg").alias("sum_xg"))
    return one.withColumn("conversion_rate", S.rate("all_goals", "sum_xg"))


def _counts(shots: DataFrame, keys: Sequence[str]) -> DataFrame:
    return shots.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("result").alias("total_shots"), F.count_if(S.is_goal_result("result")).alias("total_goals"),
        F.sum("xg").alias("total_xg"), F.count("xg").alias("n_xg"))


def counts_by(shots: DataFrame, keys: Sequence[str] = PLAYER) -> DataFrame:
    """Sums per key, written once. Rows with a NULL key are kept, so that the totals of all shots are sums over this table."""
    return materialize(_counts(shots, keys), "counts")


def totals_of(counts: DataFrame) -> DataFrame:
    """The row of ``shot_totals`` from ``counts_by``, without another scan of the shots."""
    one = counts.agg(F.sum("n_rows").alias("all_shots"), F.sum("total_goals").alias("all_goals"),
                     S.rate(F.sum("total_xg"), F.sum("n_xg")).alias("avg_xg"), F.sum("total_xg").alias("sum_xg"))
    return one.withColumn("conversion_rate", S.rate("all_goals", "sum_xg"))


def known(counts: DataFrame, keys: Sequence[str] = PLAYER) -> DataFrame:
    """Shots, goals, mean and summed xG per key; rows with a NULL key are left out."""
    return counts.dropna(subset=list(keys)).select(
        *keys, "total_shots", "total_goals", S.rate("total_xg", "n_xg").alias("xg_per_shot"), "total_xg")


def shots_by(shots: DataFrame, keys: Sequence[str] = PLAYER) -> DataFrame:
    """``known`` of shots that are read for this alone."""
    return known(_counts(shots, keys), keys)


def appearances_by(appearances: DataFrame, keys: Sequence[str] = PLAYER, match: str = "game_id") -> DataFrame:
    """Distinct matches, rows, minutes and xG per key from appearance rows."""
    known = appearances.dropna(subset=list(keys))
    per_match = known.groupBy(*keys, match).agg(
        F.count(F.lit(1)).alias("r"), F.count("xg").alias("nx"), F.sum("minutes").alias("m"), F.sum("xg").alias("x"))
    return per_match.groupBy(*keys).agg(
        F.count(match).alias("matches"), F.sum("r").alias("appearances"), F.sum("m").alias("minutes"),
        F.sum("x").alias("appearance_xg"), S.rate(F.sum("x"), F.sum("nx")).alias("mean_appearance_xg"))


def teams(shots: DataFrame) -> DataFrame:
    """Team ids with one name each."""
    sides = F.array(F.struct(F.col("home_team_id").alias("team_id"), F.col("h_team").alias("team_name")),
                    F.struct(F.col("away_team_id").alias("team_id"), F.col("a_team").alias("team_name")))
    named = shots.select(F.explode(sides).alias("t")).select("t.*")
    return named.groupBy("team_id").agg(F.min("team_name").alias("team_name"))


def shares_by(counts: DataFrame, key: str, shots_share: str = "shot_proportion") -> DataFrame:
    """Share of shots and of goals per category from ``counts_by``; categories without a goal are left out."""
    rows = known(counts, [key]).select(key, "total_shots", "total_goals")
    whole = rows.agg(F.sum("total_shots").alias("__s"), F.sum("total_goals").alias("__g"))
    return attach_totals(rows.filter(F.col("total_goals") > 0), whole).select(
        key, S.rate("total_shots", "__s").alias(shots_share), S.rate("total_goals", "__g").alias("goal_proportion"))


def drill_down(shots: DataFrame, player: str, by: str) -> DataFrame:
    """Mean xG and shots of one player per value of a column, NULL values left out."""
    mine = shots.filter((F.col("player") == player) & F.col(by).isNotNull())
    return mine.groupBy(by).agg(F.avg("xg").alias("mean_xg"), F.count("xg").alias("shots"))
