"""Player shot volume: xG per shot, per game, per 90 minutes, and goals against xG."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.functions import scalars as S
from pitchline.operators.shots import PLAYER, appearances_by, shots_by


def top(df: DataFrame, metric: str, n: int | None, ascending: bool = False) -> DataFrame:
    """Ranking by a metric, ties broken by player or team key; ``n`` limits it to a report (NULLs last)."""
    keys = [c for c in ("player_id", "team_id", "team_name", "kicker_team", "conceded_team") if c in df.columns]
    first = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    ranked = df.orderBy(first, *keys)
    return ranked.limit(n) if n else ranked


def xg_per_shot_table(shots: DataFrame, appearances: DataFrame) -> DataFrame:
    """Mean xG, shots, matches, shots per game and goals of every player with shots and appearances."""
    volume = shots_by(shots).join(appearances_by(appearances).select(*PLAYER, "matches"), list(PLAYER))
    return volume.withColumn("shots_per_game", S.rate("total_shots", "matches"))


def xg_per_shot(shots: DataFrame, appearances: DataFrame, min_shots: int = 50, n: int | None = 5) -> DataFrame:
    return top(xg_per_shot_table(shots, appearances).filter(F.col("total_shots") >= min_shots), "xg_per_shot", n)


def xg_per_game(shots: DataFrame, appearances: DataFrame, min_matches: int = 20, n: int | None = 5) -> DataFrame:
    both = shots_by(shots).select(*PLAYER, "total_xg").join(
        appearances_by(appearances).select(*PLAYER, "matches"), list(PLAYER))
    table = both.withColumn("xg_per_game", S.rate("total_xg", "matches"))
    return top(table.filter((F.col("matches") >= min_matches) & (F.col("xg_per_game") > 0)), "xg_per_game", n)


def xg_per_game_by_appearance(appearances: DataFrame, min_rows: int = 20, n: int | None = 5) -> DataFrame:
    """Second route to xG per game: the mean over appearance rows."""
    table = appearances_by(appearances).select(*PLAYER, "appearances", F.col("mean_appearance_xg").alias("xg_per_game"))
    return top(table.filter((F.col("appearances") >= min_rows) & (F.col("xg_per_game") > 0)), "xg_per_game", n)


def xg_per_90(appearances: DataFrame, min_minutes: int = 1800, n: int | None = 5) -> DataFrame:
    table = appearances_by(appearances).select(
        *PLAYER, F.col("appearance_xg").alias("total_xg"), "minutes", "matches",
        S.rate("appearance_xg", F.col("minutes") / 90.0).alias("xg_per_90"),
        S.rate("minutes", "matches").alias("minutes_per_game"))
    return top(table.filter((F.col("minutes") >= min_minutes) & (F.col("xg_per_90") > 0)), "xg_per_90", n)


def goals_minus_xg(shots: DataFrame, n: int | None = None) -> DataFrame:
    table = shots_by(shots).select(*PLAYER, "total_xg", "total_goals",
                                   (F.col("total_goals") - F.col("total_xg")).alias("goals_minus_xg"))
    return top(table, "goals_minus_xg", n)
