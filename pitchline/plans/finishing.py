"""Finishing skill of players, finishing and defence of teams, and skill-adjusted ("true") xG."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.functions import scalars as S
from pitchline.operators.common import attach_totals, exact_quantile
from pitchline.operators.shots import PLAYER, counts_by, known, shots_by, totals_of
from pitchline.session import materialize

# Fixed value: the prior of the finishing coefficient is worth this many average shots.
PRIOR_SHOTS = 100.0


def skill(counts: DataFrame, keys=PLAYER, coefficient: str = "finishing_coefficient", keep_goalless: bool = False) -> DataFrame:
    """Goal and shot shares, adjusted xG and the Gamma-Poisson coefficient per player or team, from ``counts_by`` the keys.

    Entities without a goal are left out unless ``keep_goalless``.
    """
    return _skill(known(counts, keys), totals_of(counts), keys, coefficient, keep_goalless)


def _skill(per_key: DataFrame, totals: DataFrame, keys, coefficient: str, keep_goalless: bool = False) -> DataFrame:
    if not keep_goalless:
        per_key = per_key.filter(F.col("total_goals") > 0)
    prior = F.col("avg_xg") * PRIOR_SHOTS
    table = attach_totals(per_key, totals.select("all_shots", "all_goals", "avg_xg")).withColumns({
        "goal_proportion": S.rate("total_goals", "all_goals"), "shot_proportion": S.rate("total_shots", "all_shots"),
        coefficient: S.rate(prior + F.col("total_goals"), prior + F.col("total_xg"))})
    return table.select(
        *keys, "total_shots", "total_goals", "total_xg", "goal_proportion", "shot_proportion",
        S.rate(F.col("goal_proportion") * F.col("avg_xg"), "shot_proportion").alias("adjusted_xg"), coefficient)


def adjust(shots: DataFrame, coefficients: DataFrame, on: list[str], coefficient: str, out: str) -> DataFrame:
    """Shots with their odds multiplied by a coefficient and turned back into a probability."""
    joined = shots.join(coefficients.select(*on, coefficient), on)
    return joined.withColumn(out, S.from_odds(S.odds("xg") * F.col(coefficient)))


def true_xg_shots(shots: DataFrame, counts: DataFrame | None = None, keep_goalless: bool = False) -> DataFrame:
    """Shots of rated players with ``finishing_coefficient`` and ``true_xg``: one pass for ``counts_by`` players, one for the shots."""
    players = skill(counts_by(shots) if counts is None else counts, keep_goalless=keep_goalless)
    return adjust(shots, players, list(PLAYER), "finishing_coefficient", "true_xg")


def true_xg_by_player(adjusted: DataFrame) -> DataFrame:
    return adjusted.groupBy(*PLAYER).agg(F.avg("true_xg").alias("mean_true_xg"), F.sum("true_xg").alias("sum_true_xg"),
                                         F.count_if(S.is_goal_result("result")).alias("total_goals"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, r, r squared and two-sided p-value of a one-variable regression."""
    fit = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                 F.corr(x, y).alias("r"), F.regr_r2(y, x).alias("r_squared"), F.count(F.lit(1)).alias("n"), F.regr_count(y, x).alias("pairs"))
    return fit.withColumn("p", S.correlation_p(F.col("r"), F.col("pairs"))).drop("pairs")


def log_losses(adjusted: DataFrame) -> DataFrame:
    """Log loss of xG and of true xG against the shot results."""
    goal = F.coalesce(S.is_goal_result("result").cast("int"), F.lit(0))
    return adjusted.withColumn("__y", goal).agg(
        S.mean_log_loss("xg", "__y").alias("xg_log_loss"), S.mean_log_loss("true_xg", "__y").alias("true_xg_log_loss"))


TEAM_PAIR = ("kicker_team", "conceded_team")


def team_pairs(labelled: DataFrame) -> DataFrame:
    """Shots, goals and xG per (shooting team, defending team): one pass over the shots serves both coefficients."""
    return materialize(shots_by(labelled, TEAM_PAIR).drop("xg_per_shot"), "team-pairs")


def team_skill(pairs: DataFrame, totals: DataFrame, side: str = "kicker_team") -> DataFrame:
    """Finishing (``kicker_team``) or defence (``conceded_team``) coefficients per team from ``team_pairs``."""
    name = "finishing_coefficient_team" if side == "kicker_team" else "defence_coefficient"
    per_team = pairs.groupBy(side).agg(*[F.sum(c).alias(c) for c in ("total_shots", "total_goals", "total_xg")])
    return _skill(per_team, totals, [side], name)


def adjusted_pairs(labelled: DataFrame, finishing: DataFrame, defence: DataFrame, defence_key: str = "conceded_team") -> DataFrame:
    """Sums of finishing-adjusted and defence-adjusted xG per (shooting team, defending team), again in one pass.

    ``defence_key`` names the shot column the defence coefficient is looked up by; ``kicker_team`` looks it up by
    the shooting team instead of the defending one. Shots of teams without a coefficient do not count.
    """
    both = labelled.join(finishing.select("kicker_team", "finishing_coefficient_team"), "kicker_team", "left").join(
        defence.select(F.col("conceded_team").alias(defence_key), "defence_coefficient"), defence_key, "left")
    adjusted = lambda c: S.from_odds(S.odds("xg") * F.col(c))
    sums = both.withColumns({"f": adjusted("finishing_coefficient_team"), "a": adjusted("defence_coefficient")}).groupBy(*TEAM_PAIR)
    return materialize(sums.agg(F.sum("f").alias("sum_for"), F.count("f").alias("n_for"), F.sum("a").alias("sum_against"),
                                F.count("a").alias("n_against")), "adjusted-pairs")


def team_true_xg(adjusted: DataFrame) -> DataFrame:
    """Mean team-adjusted xG for and against per team, from ``adjusted_pairs``."""
    attack = adjusted.groupBy(F.col("kicker_team").alias("team_name")).agg(
        S.rate(F.sum("sum_for"), F.sum("n_for")).alias("true_xg_for"), F.sum("sum_for").alias("sum_true_xg_for"))
    against = adjusted.groupBy(F.col("conceded_team").alias("team_name")).agg(
        S.rate(F.sum("sum_against"), F.sum("n_against")).alias("true_xg_against"))
    return attack.join(against, "team_name").dropna(subset=["true_xg_for", "true_xg_against"])


def mean_true_xg_conceded(adjusted: DataFrame) -> DataFrame:
    """Mean finishing-adjusted xG faced per defending team, from ``adjusted_pairs``."""
    return adjusted.groupBy("conceded_team").agg(S.rate(F.sum("sum_for"), F.sum("n_for")).alias("true_xg_team")).dropna()


def with_quadrant(df: DataFrame, x: str, y: str) -> DataFrame:
    """Exact medians of two metrics on every row, and the quadrant they put the row in."""
    df = materialize(df, "quadrants")
    lines = exact_quantile(df, x, 0.5, name=f"median_{x}")
    lines = attach_totals(lines, exact_quantile(df, y, 0.5, name=f"median_{y}"))
    side = lambda c: F.when(F.col(c) >= F.col(f"median_{c}"), "high").otherwise("low")
    return attach_totals(df, lines).withColumn("quadrant", F.concat_ws("/", side(x), side(y)))
