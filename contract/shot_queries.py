"""Shot analyses: player volume, chance quality, finishing skill, team balance and league points."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import tables as T
from contract.registry import register, rounded
from contract.sql import cte, query
from pitchline.functions import scalars as S
from pitchline.operators import shots as shot_ops
from pitchline.operators.common import exact_quantile, most_frequent
from pitchline.plans import chance_quality, finishing, league_table, shot_volume


def labelled(spark, d):
    return shot_ops.label_shots(T.shots(spark, d))


# --- scans and labels ---------------------------------------------------------------------------------------

@register("shot_labels", query("""
SELECT period, game_state, goal_diff, kicker_team, conceded_team, count(*) AS n, sum(result_boolean)::BIGINT AS goals
FROM labelled GROUP BY ALL""", "labelled"))
def shot_labels(spark, d):
    return labelled(spark, d).groupBy("period", "game_state", "goal_diff", "kicker_team", "conceded_team").agg(
        F.count(F.lit(1)).alias("n"), F.sum("result_boolean").alias("goals"))


@register("shot_casts", query("""
SELECT game_id, count(minute) AS minutes, sum(minute)::BIGINT AS sum_minute, round(sum(xg), 6) AS xg,
  count(*) - count(try_cast(CASE WHEN minute % 10 = 3 THEN 'n/a' ELSE '1' END AS INTEGER)) AS bad
FROM shots GROUP BY game_id""", "shots"))
def shot_casts(spark, d):
    raw = T.shots(spark, d).select("game_id", F.col("minute").cast("string").alias("minute"),
                                   F.col("xg").cast("string").alias("xg"),
                                   F.when(F.col("minute") % 10 == 3, "n/a").otherwise("1").alias("h_goals"))
    typed = shot_ops.cast_shots(raw)
    return rounded(typed.groupBy("game_id").agg(
        F.count("minute").alias("minutes"), F.sum("minute").alias("sum_minute"), F.sum("xg").alias("xg"),
        (F.count(F.lit(1)) - F.count("h_goals")).alias("bad")))


@register("teams_distinct", query("""
SELECT team_id, min(team_name) AS team_name FROM (
  SELECT home_team_id AS team_id, h_team AS team_name FROM shots UNION ALL SELECT away_team_id, a_team FROM shots)
GROUP BY 1""", "shots"))
def teams_distinct(spark, d):
    return shot_ops.teams(T.shots(spark, d))


# --- player volume --------------------------------------------------------------------------------------------

cte("player_shots", """SELECT player_id, player, count(*) AS total_shots, count(*) FILTER (result = 'Goal') AS total_goals,
  avg(xg) AS xg_per_shot, sum(xg) AS total_xg FROM shots GROUP BY 1, 2""", "shots")
cte("player_apps", """SELECT player_id, player, count(DISTINCT game_id) AS matches, count(*) AS appearances,
  sum(minutes) AS minutes, sum(xg) AS appearance_xg, avg(xg) AS mean_xg FROM appearances GROUP BY 1, 2""", "appearances")
cte("volume", """SELECT *, total_shots / matches AS shots_per_game FROM player_shots JOIN player_apps USING (player_id, player)""",
    "player_shots", "player_apps")


@register("player_xg_per_shot_top", query("""
SELECT player_id, player, total_shots, total_goals, round(xg_per_shot, 6) AS xg_per_shot, round(total_xg, 6) AS total_xg,
  matches, round(shots_per_game, 6) AS shots_per_game
FROM volume WHERE total_shots >= 50 ORDER BY volume.xg_per_shot DESC, player_id LIMIT 5""", "volume"))
def player_xg_per_shot_top(spark, d):
    return rounded(shot_volume.xg_per_shot(T.shots(spark, d), T.appearances(spark, d)))


@register("player_shot_volume", query("""
SELECT player_id, player, total_shots, total_goals, round(xg_per_shot, 6) AS xg_per_shot, round(total_xg, 6) AS total_xg,
  matches, round(shots_per_game, 6) AS shots_per_game FROM volume""", "volume"))
def player_shot_volume(spark, d):
    return rounded(shot_volume.xg_per_shot_table(T.shots(spark, d), T.appearances(spark, d)))


@register("player_xg_per_game_top", query("""
SELECT player_id, player, round(total_xg, 6) AS total_xg, matches, round(total_xg / matches, 6) AS xg_per_game
FROM volume WHERE matches >= 20 AND total_xg > 0 ORDER BY volume.total_xg / matches DESC, player_id LIMIT 5""", "volume"))
def player_xg_per_game_top(spark, d):
    return rounded(shot_volume.xg_per_game(T.shots(spark, d), T.appearances(spark, d)))


@register("player_xg_per_game_by_appearance", query("""
SELECT player_id, player, appearances, round(mean_xg, 6) AS xg_per_game FROM player_apps
WHERE appearances >= 20 AND mean_xg > 0""", "player_apps"))
def player_xg_per_game_by_appearance(spark, d):
    return rounded(shot_volume.xg_per_game_by_appearance(T.appearances(spark, d), n=None))


@register("player_xg_per_90", query("""
SELECT player_id, player, round(appearance_xg, 6) AS total_xg, minutes, matches,
  round(appearance_xg / (minutes / 90), 6) AS xg_per_90, round(minutes / matches, 6) AS minutes_per_game
FROM player_apps WHERE minutes >= 1800 AND appearance_xg > 0""", "player_apps"))
def player_xg_per_90(spark, d):
    return rounded(shot_volume.xg_per_90(T.appearances(spark, d), n=None))


@register("player_goals_minus_xg", query("""
SELECT player_id, player, round(total_xg, 6) AS total_xg, total_goals, round(total_goals - total_xg, 6) AS goals_minus_xg
FROM player_shots""", "player_shots"))
def player_goals_minus_xg(spark, d):
    return rounded(shot_volume.goals_minus_xg(T.shots(spark, d)))


def p_sql(r: str, nu: str) -> str:
    """Two-sided p-value of a correlation with whole ``nu`` degrees of freedom, by the finite sums for Student's distribution."""
    term = f"(SELECT coalesce(sum(t), 0) FROM (SELECT exp(sum(ln({{ratio}})) OVER (ORDER BY j)) * pow(1 - {r} * {r}, j) AS t " \
           f"FROM (SELECT unnest(range(1, (({nu} - {{last}}) // 2 + 1)::BIGINT)) AS j)))"
    even = f"abs({r}) * (1 + {term.format(ratio='(2 * j - 1) / (2.0 * j)', last=2)})"
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * (1 + {term.format(ratio='2.0 * j / (2 * j + 1)', last=3)}))"
    return f"round(1 - CASE WHEN {nu} % 2 = 0 THEN {even} WHEN {nu} = 1 THEN 2 / pi() * asin(abs({r})) ELSE {odd} END, 6)"


@register("shot_volume_correlation", query(f"""
SELECT round(r, 6) AS r, n, {p_sql("r", "(n - 2)")} AS p FROM (SELECT corr(xg_per_shot, shots_per_game) AS r, count(*) AS n FROM volume)""", "volume"))
def shot_volume_correlation(spark, d):
    table = shot_volume.xg_per_shot_table(T.shots(spark, d), T.appearances(spark, d))
    return rounded(finishing.linear_fit(table, "xg_per_shot", "shots_per_game").select("r", "n", "p"))


# --- chance quality -------------------------------------------------------------------------------------------

cte("totals", """SELECT count(*) AS all_shots, count(*) FILTER (result = 'Goal') AS all_goals, avg(xg) AS avg_xg,
  sum(xg) AS sum_xg FROM shots""", "shots")


@register("shot_totals", query("""
SELECT all_shots, all_goals, round(avg_xg, 6) AS avg_xg, round(sum_xg, 6) AS sum_xg,
  round(all_goals / sum_xg, 6) AS conversion_rate FROM totals""", "totals"))
def shot_totals(spark, d):
    return rounded(shot_ops.shot_totals(T.shots(spark, d)))


@register("situation_probability", query("""
SELECT situation, round(n / all_shots, 6) AS situation_proportion, round(g / all_goals, 6) AS goal_proportion,
  round((g / all_goals) * avg_xg / (n / all_shots), 6) AS goal_probability
FROM (SELECT situation, count(*) AS n, count(*) FILTER (result = 'Goal') AS g FROM shots GROUP BY 1), totals
WHERE g > 0""", "totals"))
def situation_probability(spark, d):
    return rounded(chance_quality.by_situation(T.shots(spark, d)))


@register("scoreline_probability", query("""
SELECT CASE game_state WHEN 'trailing' THEN 'losing' ELSE game_state END AS scoreline_type,
  round(n / all_shots, 6) AS proportion, round(g / n, 6) AS goal_distribution,
  round((g / n) * avg_xg / (n / all_shots), 6) AS goal_probability
FROM (SELECT game_state, count(*) AS n, sum(result_boolean) AS g FROM labelled GROUP BY 1), totals""", "labelled", "totals"))
def scoreline_probability(spark, d):
    return rounded(chance_quality.by_scoreline(labelled(spark, d)))


@register("period_by_game_state", query("""
SELECT period, game_state, round(avg(xg), 6) AS mean_xg FROM labelled GROUP BY 1, 2""", "labelled"))
def period_by_game_state(spark, d):
    return rounded(chance_quality.by_period_state(labelled(spark, d)))


@register("period_by_goal_diff", query("""
SELECT period, goal_diff, round(avg(xg), 6) AS mean_xg FROM labelled GROUP BY 1, 2""", "labelled"))
def period_by_goal_diff(spark, d):
    return rounded(chance_quality.by_period_goal_diff(labelled(spark, d)))


@register("shots_by_goal_diff", query("SELECT goal_diff, count(*) AS shots FROM labelled GROUP BY 1", "labelled"))
def shots_by_goal_diff(spark, d):
    return chance_quality.by_goal_diff(labelled(spark, d))


@register("period_report", query("""
SELECT 'period_state' AS level, period, game_state, NULL AS goal_diff, round(avg(xg), 6) AS mean_xg, count(*) AS shots
FROM labelled GROUP BY 2, 3
UNION ALL SELECT 'period_goal_diff', period, NULL, goal_diff, round(avg(xg), 6), count(*) FROM labelled GROUP BY 2, 4
UNION ALL SELECT 'goal_diff', NULL, NULL, goal_diff, round(avg(xg), 6), count(*) FROM labelled GROUP BY 4""", "labelled"))
def period_report(spark, d):
    return rounded(chance_quality.period_report(labelled(spark, d)))


@register("drill_down_last_action", query("""
SELECT last_action, round(avg(xg), 6) AS mean_xg, count(xg) AS shots FROM shots
WHERE player = 'Player 1003' AND last_action IS NOT NULL GROUP BY 1""", "shots"))
def drill_down_last_action(spark, d):
    return rounded(shot_ops.drill_down(T.shots(spark, d), "Player 1003", "last_action"))


@register("drill_down_shot_type", query("""
SELECT shot_type, round(avg(xg), 6) AS mean_xg, count(xg) AS shots FROM shots
WHERE player = 'Player 1003' AND shot_type IS NOT NULL GROUP BY 1""", "shots"))
def drill_down_shot_type(spark, d):
    return rounded(shot_ops.drill_down(T.shots(spark, d), "Player 1003", "shot_type"))


# --- finishing skill ------------------------------------------------------------------------------------------

cte("player_skill", """SELECT player_id, player, total_shots, total_goals, total_xg, total_goals / all_goals AS goal_proportion,
  total_shots / all_shots AS shot_proportion,
  (total_goals / all_goals) * avg_xg / (total_shots / all_shots) AS adjusted_xg,
  (100 * avg_xg + total_goals) / (100 * avg_xg + total_xg) AS finishing_coefficient
  FROM player_shots, totals WHERE total_goals > 0""", "player_shots", "totals")
cte("true_shots", """SELECT l.*, finishing_coefficient,
  (xg / (1 - xg) * finishing_coefficient) / (1 + xg / (1 - xg) * finishing_coefficient) AS true_xg
  FROM labelled l JOIN player_skill USING (player_id, player)""", "labelled", "player_skill")


@register("player_finishing_skill", query("""
SELECT player_id, player, total_shots, total_goals, round(total_xg, 6) AS total_xg, round(goal_proportion, 6) AS goal_proportion,
  round(shot_proportion, 6) AS shot_proportion, round(adjusted_xg, 6) AS adjusted_xg,
  round(finishing_coefficient, 6) AS finishing_coefficient FROM player_skill""", "player_skill"))
def player_finishing_skill(spark, d):
    s = T.shots(spark, d)
    return rounded(finishing.skill(shot_ops.counts_by(s)))


@register("player_true_xg", query("""
SELECT player_id, player, round(avg(true_xg), 6) AS mean_true_xg, round(sum(true_xg), 6) AS sum_true_xg,
  count(*) FILTER (result = 'Goal') AS total_goals FROM true_shots GROUP BY 1, 2""", "true_shots"))
def player_true_xg(spark, d):
    return rounded(finishing.true_xg_by_player(finishing.true_xg_shots(T.shots(spark, d))))


@register("true_xg_log_loss", query("""
SELECT round(avg(-CASE WHEN result_boolean = 1 THEN ln(xg) ELSE ln(1 - xg) END), 6) AS xg_log_loss,
  round(avg(-CASE WHEN result_boolean = 1 THEN ln(true_xg) ELSE ln(1 - true_xg) END), 6) AS true_xg_log_loss
FROM true_shots""", "true_shots"))
def true_xg_log_loss(spark, d):
    return rounded(finishing.log_losses(finishing.true_xg_shots(T.shots(spark, d))))


@register("finishing_vs_goals_fit", query(f"""
SELECT * REPLACE (round(r, 6) AS r), {p_sql("r", "(n - 2)")} AS p FROM (
SELECT round(regr_slope(total_goals, finishing_coefficient), 6) AS slope,
  round(regr_intercept(total_goals, finishing_coefficient), 6) AS intercept,
  corr(finishing_coefficient, total_goals) AS r, round(regr_r2(total_goals, finishing_coefficient), 6) AS r_squared,
  count(*) AS n FROM player_skill)""", "player_skill"))
def finishing_vs_goals_fit(spark, d):
    s = T.shots(spark, d)
    return rounded(finishing.linear_fit(finishing.skill(shot_ops.counts_by(s)), "finishing_coefficient", "total_goals"))


@register("true_xg_vs_goals_fit", query(f"""
SELECT * REPLACE (round(r, 6) AS r), {p_sql("r", "(n - 2)")} AS p FROM (
SELECT round(regr_slope(g, m), 6) AS slope, round(regr_intercept(g, m), 6) AS intercept, corr(m, g) AS r,
  round(regr_r2(g, m), 6) AS r_squared, count(*) AS n
FROM (SELECT player_id, avg(true_xg) AS m, count(*) FILTER (result = 'Goal') AS g FROM true_shots GROUP BY player_id, player))""",
                                      "true_shots"))
def true_xg_vs_goals_fit(spark, d):
    table = finishing.true_xg_by_player(finishing.true_xg_shots(T.shots(spark, d)))
    return rounded(finishing.linear_fit(table, "mean_true_xg", "total_goals"))


# --- team finishing and defence -------------------------------------------------------------------------------

for side, coef in (("kicker_team", "finishing_coefficient_team"), ("conceded_team", "defence_coefficient")):
    cte(f"skill_{side}", f"""SELECT {side}, n AS total_shots, g AS total_goals, x AS total_xg, g / all_goals AS goal_proportion,
      n / all_shots AS shot_proportion, (g / all_goals) * avg_xg / (n / all_shots) AS adjusted_xg,
      (100 * avg_xg + g) / (100 * avg_xg + x) AS {coef}
      FROM (SELECT {side}, count(*) AS n, count(*) FILTER (result = 'Goal') AS g, sum(xg) AS x FROM true_shots GROUP BY 1), totals
      WHERE g > 0""", "true_shots", "totals")
    _cols = f"""SELECT {side}, total_shots, total_goals, round(total_xg, 6) AS total_xg,
      round(goal_proportion, 6) AS goal_proportion, round(shot_proportion, 6) AS shot_proportion,
      round(adjusted_xg, 6) AS adjusted_xg, round({coef}, 6) AS {coef} FROM skill_{side}"""

    @register("team_finishing_skill" if side == "kicker_team" else "team_defence_skill", query(_cols, f"skill_{side}"))
    def team_skill(spark, d, side=side):
        shots = labelled(spark, d)
        counts = shot_ops.counts_by(shots)
        pairs = finishing.team_pairs(finishing.true_xg_shots(shots, counts))
        return rounded(finishing.team_skill(pairs, shot_ops.totals_of(counts), side))


def _team_tables(spark, d):
    shots = labelled(spark, d)
    counts = shot_ops.counts_by(shots)
    totals, rated = shot_ops.totals_of(counts), finishing.true_xg_shots(shots, counts)
    pairs = finishing.team_pairs(rated)
    return rated, finishing.team_skill(pairs, totals), finishing.team_skill(pairs, totals, "conceded_team")


_ADJ = "(xg / (1 - xg) * {c}) / (1 + xg / (1 - xg) * {c})"
for key in ("conceded_team", "kicker_team"):
    @register("team_true_xg" if key == "conceded_team" else "team_true_xg_shooter_lookup", query(f"""
SELECT team_name, round(f, 6) AS true_xg_for, round(s, 6) AS sum_true_xg_for, round(a, 6) AS true_xg_against FROM
  (SELECT kicker_team AS team_name, avg({_ADJ.format(c='finishing_coefficient_team')}) AS f,
     sum({_ADJ.format(c='finishing_coefficient_team')}) AS s FROM true_shots JOIN skill_kicker_team USING (kicker_team) GROUP BY 1)
  JOIN (SELECT t.conceded_team AS team_name, avg({_ADJ.format(c='defence_coefficient')}) AS a
     FROM true_shots t JOIN skill_conceded_team k ON t.{key} = k.conceded_team GROUP BY 1) USING (team_name)""",
                   "skill_kicker_team", "skill_conceded_team"))
    def team_true_xg(spark, d, key=key):
        return rounded(finishing.team_true_xg(finishing.adjusted_pairs(*_team_tables(spark, d), defence_key=key)))


@register("team_true_xg_conceded", query(f"""
SELECT conceded_team, round(avg({_ADJ.format(c='finishing_coefficient_team')}), 6) AS true_xg_team
FROM true_shots JOIN skill_kicker_team USING (kicker_team) GROUP BY 1""", "skill_kicker_team"))
def team_true_xg_conceded(spark, d):
    return rounded(finishing.mean_true_xg_conceded(finishing.adjusted_pairs(*_team_tables(spark, d))))


# --- team balance, results, points ----------------------------------------------------------------------------

cte("match_team", """SELECT game_id, team_id, sum(xg) AS xg, sum(shots) AS shots, sum(goals) AS goals,
  count(*) AS appearance_rows FROM appearances GROUP BY 1, 2""", "appearances")
cte("swapped", """SELECT a.game_id, a.team_id, coalesce(b.xg, a.xg) AS xg_conceded, coalesce(b.shots, a.shots) AS shots_conceded
  FROM match_team a LEFT JOIN match_team b ON a.game_id = b.game_id AND a.team_id <> b.team_id""", "match_team")
cte("attack", """SELECT team_id, sum(xg) AS total_xg, sum(shots) AS total_shots, sum(goals) AS total_goals,
  sum(xg) / count(*) AS xg_per_game, sum(xg) / sum(shots) AS xg_per_shot, sum(shots) / count(*) AS shots_per_game
  FROM match_team GROUP BY 1""", "match_team")
cte("defence", """SELECT team_id, sum(xg_conceded) AS xg_conceded, sum(shots_conceded) AS shots_conceded,
  sum(xg_conceded) / count(*) AS xg_conceded_per_game, sum(xg_conceded) / sum(shots_conceded) AS xg_conceded_per_shot,
  sum(shots_conceded) / count(*) AS shots_conceded_per_game FROM swapped GROUP BY 1""", "swapped")
cte("team_names", "SELECT DISTINCT home_team_id AS team_id, h_team AS team_name FROM shots "
                  "UNION SELECT DISTINCT away_team_id, a_team FROM shots", "shots")
cte("results", """SELECT *, goals_home + own_goals_away AS scores_home, goals_away + own_goals_home AS scores_away FROM (
  SELECT game_id, max(team_id) FILTER (h_a = 'h') AS home_team_id, max(team_id) FILTER (h_a = 'a') AS away_team_id,
    sum(xg) FILTER (h_a = 'h') AS xg_home, sum(goals) FILTER (h_a = 'h') AS goals_home,
    sum(own_goals) FILTER (h_a = 'h') AS own_goals_home, sum(shots) FILTER (h_a = 'h') AS shots_home,
    sum(xg) FILTER (h_a = 'a') AS xg_away, sum(goals) FILTER (h_a = 'a') AS goals_away,
    sum(own_goals) FILTER (h_a = 'a') AS own_goals_away, sum(shots) FILTER (h_a = 'a') AS shots_away
  FROM appearances GROUP BY 1) WHERE home_team_id IS NOT NULL AND away_team_id IS NOT NULL""", "appearances")
cte("points", """SELECT team_id, CAST(sum(p) AS BIGINT) AS points FROM (
  SELECT home_team_id AS team_id, CASE WHEN scores_home > scores_away THEN 3 WHEN scores_home = scores_away THEN 1 ELSE 0 END AS p
  FROM results UNION ALL
  SELECT away_team_id, CASE WHEN scores_away > scores_home THEN 3 WHEN scores_home = scores_away THEN 1 ELSE 0 END FROM results)
  GROUP BY 1""", "results")


@register("match_team_xg", query("""SELECT game_id, team_id, round(xg, 6) AS xg, shots, goals, appearance_rows
FROM match_team""", "match_team"))
def match_team_xg(spark, d):
    return rounded(league_table.match_team_xg(T.appearances(spark, d)))


@register("opponent_swap", query("""SELECT game_id, team_id, round(xg_conceded, 6) AS xg_conceded, shots_conceded
FROM swapped""", "swapped"))
def opponent_swap(spark, d):
    return rounded(league_table.swap_opponents(league_table.match_team_xg(T.appearances(spark, d))))


@register("team_attack", query("""SELECT team_id, round(total_xg, 6) AS total_xg, total_shots, total_goals,
round(xg_per_game, 6) AS xg_per_game, round(xg_per_shot, 6) AS xg_per_shot, round(shots_per_game, 6) AS shots_per_game
FROM attack""", "attack"))
def team_attack(spark, d):
    return rounded(league_table.attack(T.appearances(spark, d)))


@register("team_attack_ranking", query("""SELECT team_name, round(total_xg / 38, 6) AS xg_per_game
FROM attack JOIN team_names USING (team_id)""", "attack", "team_names"))
def team_attack_ranking(spark, d):
    attack = league_table.attack(T.appearances(spark, d), games=38)
    return rounded(shot_volume.top(league_table.named(attack, shot_ops.teams(T.shots(spark, d)), "xg_per_game"), "xg_per_game", None))


@register("team_defence", query("""SELECT team_id, round(xg_conceded, 6) AS xg_conceded, shots_conceded,
round(xg_conceded_per_game, 6) AS xg_conceded_per_game, round(xg_conceded_per_shot, 6) AS xg_conceded_per_shot,
round(shots_conceded_per_game, 6) AS shots_conceded_per_game FROM defence""", "defence"))
def team_defence(spark, d):
    return rounded(league_table.defence(T.appearances(spark, d)))


@register("team_balance", query("""
SELECT team_id, team_name, round(xg_per_game, 6) AS xg_per_game, round(xg_conceded_per_game, 6) AS xg_conceded_per_game,
  round(xg_per_game - xg_conceded_per_game, 6) AS net_xg_per_game, points
FROM attack JOIN defence USING (team_id) LEFT JOIN team_names USING (team_id) LEFT JOIN points USING (team_id)""",
                                "attack", "defence", "team_names", "points"))
def team_balance(spark, d):
    apps, teams = T.appearances(spark, d), shot_ops.teams(T.shots(spark, d))
    table = league_table.balance(apps, teams).join(league_table.points(league_table.match_results(apps)), "team_id", "left")
    return rounded(shot_volume.top(table, "net_xg_per_game", None).select(
        "team_id", "team_name", "xg_per_game", "xg_conceded_per_game", "net_xg_per_game", "points"))


@register("team_quadrants", query("""
SELECT team_id, round(shots_per_game, 6) AS shots_per_game, round(xg_per_shot, 6) AS xg_per_shot,
  round(mx, 6) AS median_shots_per_game, round(my, 6) AS median_xg_per_shot,
  CASE WHEN shots_per_game >= mx THEN 'high' ELSE 'low' END || '/' || CASE WHEN xg_per_shot >= my THEN 'high' ELSE 'low' END AS quadrant
FROM attack, (SELECT quantile_cont(shots_per_game, 0.5) AS mx, quantile_cont(xg_per_shot, 0.5) AS my FROM attack)""", "attack"))
def team_quadrants(spark, d):
    table = league_table.attack(T.appearances(spark, d)).select("team_id", "shots_per_game", "xg_per_shot")
    return rounded(finishing.with_quadrant(table, "shots_per_game", "xg_per_shot"))


@register("match_results", query("""
SELECT game_id, home_team_id, round(xg_home, 6) AS xg_home, goals_home, own_goals_home, shots_home, away_team_id,
  round(xg_away, 6) AS xg_away, goals_away, own_goals_away, shots_away, scores_home, scores_away FROM results""", "results"))
def match_results(spark, d):
    return rounded(league_table.match_results(T.appearances(spark, d)))


@register("league_points", query("SELECT team_id, team_name, points FROM points JOIN team_names USING (team_id)",
                                 "points", "team_names"))
def league_points(spark, d):
    return league_table.points_table(T.appearances(spark, d), shot_ops.teams(T.shots(spark, d)))


cte("ols_in", """SELECT finishing_coefficient_team AS x1, defence_coefficient AS x2, CAST(points AS DOUBLE) AS y
  FROM skill_kicker_team JOIN skill_conceded_team ON kicker_team = conceded_team
  JOIN team_names ON team_name = kicker_team JOIN points USING (team_id)""",
    "skill_kicker_team", "skill_conceded_team", "team_names", "points")
cte("ols_fit", """SELECT *, my - b1 * m1 - b2 * m2 AS b0, (b1 * c1y + b2 * c2y) / vy AS r2 FROM (
  SELECT *, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS b1, (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS b2 FROM (
  SELECT var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y,
    var_pop(y) AS vy, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(*) AS n FROM ols_in))""", "ols_in")


@register("points_regression", query("""
SELECT term, round(coef, 4) AS coef, round(r2, 6) AS r2, n FROM (
  SELECT 'finishing_coefficient' AS term, b1 AS coef, r2, n FROM ols_fit UNION ALL
  SELECT 'defence_coefficient', b2, r2, n FROM ols_fit UNION ALL SELECT 'intercept', b0, r2, n FROM ols_fit)""", "ols_fit"))
def points_regression(spark, d):
    _, attack, defence = _team_tables(spark, d)
    data = league_table.points_regression_input(
        attack, defence, league_table.points_table(T.appearances(spark, d), shot_ops.teams(T.shots(spark, d))))
    fit = league_table.ols(data, "points", ["finishing_coefficient", "defence_coefficient"])
    return fit.select("term", F.round("coef", 4).alias("coef"), F.round("r2", 6).alias("r2"), "n")


# --- shared building blocks on whole tables -------------------------------------------------------------------

@register("player_mode_situation", query("""
SELECT player_id, situation FROM (
  SELECT player_id, situation, row_number() OVER (PARTITION BY player_id ORDER BY n DESC, situation) AS r
  FROM (SELECT player_id, situation, count(*) AS n FROM shots GROUP BY 1, 2)) WHERE r = 1""", "shots"))
def player_mode_situation(spark, d):
    return most_frequent(T.shots(spark, d), ["player_id"], "situation")


@register("price_quantiles_exact", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 6) AS q95 FROM lineitem GROUP BY 1""")
def price_quantiles_exact(spark, d):
    return rounded(exact_quantile(T.table(spark, d, "lineitem"), "l_extendedprice", 0.95, ["l_returnflag"], "q95"))
