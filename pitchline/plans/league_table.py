"""Team xG balance, match results, league points and the regression of points on team coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.functions import scalars as S
from pitchline.session import materialize


def _games(games: int | None, matches: str):
    return F.lit(float(games)) if games else F.col(matches).cast("double")


def match_team_xg(appearances: DataFrame) -> DataFrame:
    """xG, shots and appearance rows per (match, team)."""
    return appearances.groupBy("game_id", "team_id").agg(
        F.sum("xg").alias("xg"), F.sum("shots").alias("shots"), F.sum("goals").alias("goals"),
        F.count("xg").alias("appearance_rows"))


def attack(appearances: DataFrame, games: int | None = None) -> DataFrame:
    """Team attack totals, per game and per shot. ``games`` fixes the divisor; default is the matches played."""
    per_match = match_team_xg(appearances)
    totals = per_match.groupBy("team_id").agg(
        F.sum("xg").alias("total_xg"), F.sum("shots").alias("total_shots"), F.sum("goals").alias("total_goals"),
        F.count(F.lit(1)).alias("__m"))
    per = _games(games, "__m")
    return totals.select(
        "team_id", "total_xg", "total_shots", "total_goals", S.rate("total_xg", per).alias("xg_per_game"),
        S.rate("total_xg", "total_shots").alias("xg_per_shot"), S.rate("total_shots", per).alias("shots_per_game"))


def swap_opponents(match_teams: DataFrame) -> DataFrame:
    """Per (match, team) of two-team matches: the opponent's xG and shots.

    One aggregation per match; the opponent's figure is the match total minus the team's own, so no pair of rows
    is ever formed. Matches without exactly two teams keep their own figures.
    """
    whole = match_teams.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("__n"), F.min_by(F.struct("xg", "shots"), "team_id").alias("__a"),
        F.max_by(F.struct("xg", "shots"), "team_id").alias("__b"), F.min("team_id").alias("__first"))
    other = F.when(F.col("__n") != 2, F.struct("xg", "shots")).when(
        F.col("team_id") == F.col("__first"), F.col("__b")).otherwise(F.col("__a"))
    return match_teams.join(whole, "game_id").select(
        "game_id", "team_id", other["xg"].alias("xg_conceded"), other["shots"].alias("shots_conceded"))


def defence(appearances: DataFrame, games: int | None = None) -> DataFrame:
    conceded = swap_opponents(match_team_xg(appearances))
    totals = conceded.groupBy("team_id").agg(
        F.sum("xg_conceded").alias("xg_conceded"), F.sum("shots_conceded").alias("shots_conceded"),
        F.count(F.lit(1)).alias("__m"))
    per = _games(games, "__m")
    return totals.select(
        "team_id", "xg_conceded", "shots_conceded", S.rate("xg_conceded", per).alias("xg_conceded_per_game"),
        S.rate("xg_conceded", "shots_conceded").alias("xg_conceded_per_shot"),
        S.rate("shots_conceded", per).alias("shots_conceded_per_game"))


def balance(appearances: DataFrame, teams: DataFrame, games: int | None = None) -> DataFrame:
    """Attack and defence side by side with team names and net xG per game."""
    both = attack(appearances, games).join(defence(appearances, games), "team_id").join(teams, "team_id", "left")
    return both.withColumn("net_xg_per_game", F.col("xg_per_game") - F.col("xg_conceded_per_game"))


def named(table: DataFrame, teams: DataFrame, metric: str) -> DataFrame:
    return table.join(teams, "team_id").select("team_name", metric)


def match_results(appearances: DataFrame) -> DataFrame:
    """One row per match with both sides' totals; a side's score is its goals plus the other side's own goals."""
    side = lambda h: F.col("h_a") == h
    picks = []
    for h, name in (("h", "home"), ("a", "away")):
        picks.append(F.max(F.when(side(h), F.col("team_id"))).alias(f"{name}_team_id"))
        for c in ("xg", "goals", "own_goals", "shots"):
            picks.append(F.sum(F.when(side(h), F.col(c))).alias(f"{c}_{name}"))
    both = appearances.groupBy("game_id").agg(*picks).filter(
        F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull())
    return both.withColumns({"scores_home": F.col("goals_home") + F.col("own_goals_away"),
                             "scores_away": F.col("goals_away") + F.col("own_goals_home")})


def points(results: DataFrame) -> DataFrame:
    """League points 3/1/0; a team without a point stays in with 0."""
    won = lambda a, b: F.when(F.col(a) > F.col(b), 3).when(F.col(a) == F.col(b), 1).otherwise(0)
    sides = results.select(F.explode(F.array(
        F.struct(F.col("home_team_id").alias("team_id"), won("scores_home", "scores_away").alias("points")),
        F.struct(F.col("away_team_id").alias("team_id"), won("scores_away", "scores_home").alias("points")))).alias("r"))
    return sides.groupBy("r.team_id").agg(F.sum("r.points").alias("points"))


def points_table(appearances: DataFrame, teams: DataFrame) -> DataFrame:
    return points(match_results(appearances)).join(teams, "team_id").select("team_id", "team_name", "points")


def points_regression_input(finishing: DataFrame, defence_skill: DataFrame, table: DataFrame) -> DataFrame:
    both = finishing.select(F.col("kicker_team").alias("team_name"),
                            F.col("finishing_coefficient_team").alias("finishing_coefficient")).join(
        defence_skill.select(F.col("conceded_team").alias("team_name"), "defence_coefficient"), "team_name")
    return both.join(table.select("team_name", "points"), "team_name")


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Least squares with intercept: one row per term with its standard error, t and p, plus the fit's r2."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    # The solver and its summary read the data several times, so it is written once.
    narrow = materialize(df.select(*xs, F.col(y).cast("double").alias("__y")), "regression")
    data = VectorAssembler(inputCols=xs, outputCol="__x").transform(narrow)
    model = LinearRegression(featuresCol="__x", labelCol="__y", solver="normal").fit(data)
    s = model.summary
    names, coefs = [*xs, "intercept"], [*model.coefficients.toArray().tolist(), model.intercept]
    rows = [(n, float(c), float(e), float(t), float(p), float(s.r2), float(s.r2adj), int(s.numInstances))
            for n, c, e, t, p in zip(names, coefs, s.coefficientStandardErrors, s.tValues, s.pValues)]
    return df.sparkSession.createDataFrame(
        rows, "term string, coef double, std_err double, t double, p double, r2 double, r2_adj double, n bigint")
