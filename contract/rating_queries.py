"""Season statistics, rating regressions and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import tables as T
from contract.registry import register, rounded
from contract.sql import cte, query
from contract.stint_queries import all_stints, feed_parts
from pitchline.operators import design, feed, ridge, seasons
from pitchline.plans import ratings
from pitchline.session import materialize


def season_sql(source: str, keys: str, metrics, prefix: str) -> None:
    """Totals, modes, rates, bounds and padded rates of one form of the player table."""
    sums = ", ".join(f"sum({m}) AS {m}" for m in metrics)
    rates = ", ".join(f"CASE WHEN minutes = 0 THEN 0 ELSE {m} / (minutes / 90) END AS {m}_p90" for m in metrics)
    mode = lambda c: f"""(SELECT {keys}, player_id, {c} FROM (SELECT {keys}, player_id, {c}, row_number() OVER
      (PARTITION BY {keys}, player_id ORDER BY count(*) DESC, {c}) AS r FROM {source} GROUP BY {keys}, player_id, {c}) WHERE r = 1)"""
    cte(f"{prefix}_totals", f"""SELECT *, {rates} FROM (SELECT {keys}, player_id, sum(minutes) AS minutes, {sums}
      FROM {source} GROUP BY {keys}, player_id) JOIN {mode('player')} USING ({keys}, player_id)
      JOIN {mode('position')} USING ({keys}, player_id)""", source)
    cte(f"{prefix}_bounds", f"SELECT {keys}, position, " + ", ".join(
        f"avg({m}_p90) - 1.5 * stddev_pop({m}_p90) AS {m}_p90_low" for m in metrics)
        + f" FROM {prefix}_totals GROUP BY {keys}, position", f"{prefix}_totals")


season_sql("appearances", "league, season", seasons.TABLE_METRICS, "season")
cte("league_rows", "SELECT league_id, season, p.* FROM player_rows p JOIN feed_fixtures f ON p.game_id = f.fixture_id",
    "player_rows", "feed_fixtures")
season_sql("league_rows", "league_id, season", seasons.FEED_METRICS, "feed_season")


def _round_cols(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


TABLE_RATES = [f"{m}_p90" for m in seasons.TABLE_METRICS]
FEED_RATES = [f"{m}_p90" for m in seasons.FEED_METRICS]


def feed_player_rows(spark, d):
    heads = feed.fixture_heads(T.feed_fixtures(spark, d)).select(F.col("fixture_id").alias("game_id"), "league_id", "season")
    return feed.player_rows(T.feed_players(spark, d)).join(heads, "game_id")


@register("season_totals", query(f"""SELECT league, season, player_id, player, position, minutes,
{_round_cols([*seasons.TABLE_METRICS, *TABLE_RATES])} FROM season_totals""", "season_totals"))
def season_totals(spark, d):
    return rounded(seasons.season_totals(T.appearances(spark, d)))


@register("feed_season_totals", query(f"""SELECT league_id, season, player_id, player, position, minutes,
{_round_cols([*seasons.FEED_METRICS, *FEED_RATES])} FROM feed_season_totals""", "feed_season_totals"))
def feed_season_totals(spark, d):
    return rounded(seasons.season_totals(feed_player_rows(spark, d), seasons.FEED_METRICS, ("league_id", "season")))


@register("position_bounds", query(f"SELECT league, season, position, {_round_cols([c + '_low' for c in TABLE_RATES])} FROM season_bounds",
                                   "season_bounds"))
def position_bounds(spark, d):
    return rounded(seasons.position_bounds(seasons.season_totals(T.appearances(spark, d)), TABLE_RATES))


_PAD = ", ".join(f"round(({c} * minutes + {c}_low * greatest(0, 1000 - minutes)) / (minutes + greatest(0, 1000 - minutes) + 1e-9), 6) AS {c}"
                 for c in TABLE_RATES)


@register("padded_rates", query(f"""SELECT league, season, player_id, player, position, minutes, {_round_cols(seasons.TABLE_METRICS)}, {_PAD}
FROM season_totals JOIN season_bounds USING (league, season, position)""", "season_totals", "season_bounds"))
def padded_rates(spark, d):
    return rounded(seasons.pad_rates(seasons.season_totals(T.appearances(spark, d)), 1000))


# --- design and weighted sums ---------------------------------------------------------------------------------

cte("design", """SELECT league, season, game_id, start, feature, sum(value) AS value FROM (
  SELECT league, season, game_id, start, CAST(unnest(string_split(home_players, ',')) AS BIGINT) AS feature, 1.0 AS value FROM stints
  UNION ALL SELECT league, season, game_id, start, CAST(unnest(string_split(away_players, ',')) AS BIGINT), -1.0 FROM stints
  UNION ALL SELECT league, season, game_id, start, -3, score_diff FROM stints
  UNION ALL SELECT league, season, game_id, start, -2, red_home FROM stints
  UNION ALL SELECT league, season, game_id, start, -1, red_away FROM stints) GROUP BY ALL HAVING sum(value) <> 0""", "stints")
cte("design_yw", "SELECT league, season, game_id, start, xg_diff / duration * 90 AS y, duration AS w FROM stints", "stints")


def short_code(c):
    """Context codes as -3, -2, -1 so that they read the same in the oracle."""
    out = F.col(c)
    for code, n in zip(design.CONTEXT.values(), (-3, -2, -1)):
        out = F.when(F.col(c) == code, n).otherwise(out)
    return out


@register("design_table", query("SELECT league, season, game_id, start, feature, CAST(value AS DOUBLE) AS value FROM design", "design"))
def design_table(spark, d):
    long = design.design_long(all_stints(spark, d), ("league", "season"))
    return long.withColumn("feature", short_code("feature"))


@register("design_targets", query("SELECT league, season, game_id, start, round(y, 6) AS y, w FROM design_yw", "design_yw"))
def design_targets(spark, d):
    return rounded(design.target(all_stints(spark, d)).select("league", "season", "game_id", "start", "y", "w"))


@register("weighted_sums", query("""
SELECT league, season, p, q, round(s, 4) AS s FROM (
  SELECT a.league, a.season, a.feature AS p, b.feature AS q, sum(w * a.value * b.value) AS s
  FROM design a JOIN design b USING (game_id, start) JOIN design_yw USING (game_id, start)
  WHERE a.feature <= b.feature GROUP BY ALL
  UNION ALL SELECT league, season, -5, feature, sum(w * value * y) FROM design JOIN design_yw USING (league, season, game_id, start) GROUP BY ALL
  UNION ALL SELECT league, season, -4, feature, sum(w * value) FROM design JOIN design_yw USING (league, season, game_id, start) GROUP BY ALL
  UNION ALL SELECT league, season, -5, -5, sum(w * y * y) FROM design_yw GROUP BY ALL
  UNION ALL SELECT league, season, -5, -4, sum(w * y) FROM design_yw GROUP BY ALL
  UNION ALL SELECT league, season, -4, -4, sum(w) FROM design_yw GROUP BY ALL)
WHERE abs(s) > 1e-7""", "design", "design_yw"))
def weighted_sums(spark, d):
    keys = ("league", "season")
    rows = ridge.in_chunks(materialize(design.design_rows(all_stints(spark, d), keys), "design"), keys, ["game_id", "start"])
    sums = ridge.gram_sums(rows, keys).filter(F.abs("s") > 1e-7)
    code = lambda c: F.when(F.col(c) == ridge.TARGET, -5).when(F.col(c) == ridge.INTERCEPT, -4).otherwise(short_code(c)).alias(c)
    return sums.select(*keys, code("p"), code("q"), (F.round("s", 4) + 0.0).alias("s"))


cte("ctx", """SELECT league, season, score_diff AS x1, red_home AS x2, red_away AS x3, xg_diff / duration * 90 AS y, duration AS w
  FROM stints""", "stints")
cte("ctx_m", """SELECT league, season, sum(w) AS sw, sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2, sum(w * x3) / sum(w) AS m3,
  sum(w * y) / sum(w) AS my FROM ctx GROUP BY 1, 2""", "ctx")
cte("ctx_g", """SELECT league, season, k, pow(10, -3 + 6 * k / 24.0) AS al,
    sum(w*(x1-m1)*(x1-m1)) + al AS a11, sum(w*(x1-m1)*(x2-m2)) AS a12, sum(w*(x1-m1)*(x3-m3)) AS a13,
    sum(w*(x2-m2)*(x2-m2)) + al AS a22, sum(w*(x2-m2)*(x3-m3)) AS a23, sum(w*(x3-m3)*(x3-m3)) + al AS a33,
    sum(w*(x1-m1)*y) AS g1, sum(w*(x2-m2)*y) AS g2, sum(w*(x3-m3)*y) AS g3
  FROM ctx JOIN ctx_m USING (league, season), (SELECT unnest(range(0, 25)) AS k) GROUP BY league, season, k""", "ctx", "ctx_m")
cte("ctx_i", """SELECT *, i11*g1 + i12*g2 + i13*g3 AS b1, i12*g1 + i22*g2 + i23*g3 AS b2, i13*g1 + i23*g2 + i33*g3 AS b3 FROM (
  SELECT *, (a22*a33 - a23*a23)/det AS i11, (a13*a23 - a12*a33)/det AS i12, (a12*a23 - a13*a22)/det AS i13,
    (a11*a33 - a13*a13)/det AS i22, (a12*a13 - a11*a23)/det AS i23, (a11*a22 - a12*a12)/det AS i33 FROM (
  SELECT *, a11*(a22*a33 - a23*a23) - a12*(a12*a33 - a13*a23) + a13*(a12*a23 - a13*a22) AS det FROM ctx_g))""", "ctx_g")
cte("ctx_loo", """SELECT league, season, k, sum(w * pow(e / (1 - h), 2)) AS loo FROM (
  SELECT league, season, k, w, y - my - (x1-m1)*b1 - (x2-m2)*b2 - (x3-m3)*b3 AS e,
    w / sw + w * ((x1-m1)*(x1-m1)*i11 + (x2-m2)*(x2-m2)*i22 + (x3-m3)*(x3-m3)*i33 + 2*(x1-m1)*(x2-m2)*i12
      + 2*(x1-m1)*(x3-m3)*i13 + 2*(x2-m2)*(x3-m3)*i23) AS h
  FROM ctx JOIN ctx_m USING (league, season) JOIN ctx_i USING (league, season)) GROUP BY 1, 2, 3""", "ctx", "ctx_m", "ctx_i")


@register("ridge_on_context", query("""
SELECT league, season, round(al, 6) AS alpha, round(my - m1*b1 - m2*b2 - m3*b3, 5) AS intercept, round(b1, 5) AS score_diff,
  round(b2, 5) AS red_home, round(b3, 5) AS red_away
FROM (SELECT league, season, arg_min(k, loo) AS k FROM ctx_loo GROUP BY 1, 2) JOIN ctx_i USING (league, season, k)
JOIN ctx_m USING (league, season)""", "ctx_loo", "ctx_i", "ctx_m"))
def ridge_on_context(spark, d):
    keys = ("league", "season")
    rows = design.design_rows(all_stints(spark, d), keys, players=False)
    rows = ridge.in_chunks(materialize(rows, "context"), keys, ["game_id", "start"])
    fit = ridge.fit_ridge(rows, ridge.gram_sums(rows, keys), keys)
    coef = lambda name: F.round(F.max(F.when(F.col("feature") == design.CONTEXT[name], F.col("coef"))), 5) + 0.0
    wide = fit.coefficients.groupBy(*keys).agg(*[coef(n).alias(n) for n in design.CONTEXT])
    return fit.summary.select(*keys, F.round("alpha", 6).alias("alpha"), (F.round("intercept", 5) + 0.0).alias("intercept")).join(
        wide, list(keys))


# --- whole rating runs (iterative choice of alpha over a wide matrix: rows-only) --------------------------------

@register("player_ratings")
def player_ratings(spark, d):
    rated = ratings.rate_from_tables(T.schedule(spark, d), T.appearances(spark, d), T.shots(spark, d))
    return rated.select("league", "season", "player_id", "player", "position", "minutes", *ratings.RATINGS)


@register("feed_player_ratings")
def feed_player_ratings(spark, d):
    stints = materialize(feed.build_feed_stints(*feed_parts(spark, d)), "stints")
    rated = ratings.rate_from_feed(stints, feed_player_rows(spark, d))
    return rated.select("league_id", "season", "player_id", "player", "position", "minutes", *ratings.RATINGS, "rapm_intercept")


cte("eligible", f"""SELECT league, season FROM season_totals WHERE minutes >= 1000 GROUP BY ALL HAVING count(*) >= 2""", "season_totals")


@register("rating_gradients", query(f"""
SELECT league, season, model, feature, 0.0::DOUBLE AS gradient FROM (
  SELECT DISTINCT league, season, 'rapm' AS model, feature FROM design
  UNION ALL SELECT DISTINCT league, season, 'bpm', feature FROM design WHERE feature >= 0
  UNION ALL SELECT DISTINCT league, season, unnest(['rapm', 'bpm']), -4 FROM design
  UNION ALL SELECT league, season, 'spm', unnest(list_concat(range({len(seasons.TABLE_METRICS)}), [-4])) FROM eligible)""", "design", "eligible"))
def rating_gradients(spark, d):
    """At the fitted coefficients the three objectives are at their minimum: each slope is 0, taken from the rows themselves."""
    run = ratings.rating_run(all_stints(spark, d), T.appearances(spark, d))
    slopes = ratings.optimality(run).filter("feature < 0 or model = 'spm' or gradient is not null")
    feature = F.when(F.col("feature") == ridge.INTERCEPT, -4).otherwise(short_code("feature"))
    return slopes.select("league", "season", "model", feature.alias("feature"), (F.round("gradient", 3) + 0.0).alias("gradient"))


cte("on_pitch", """SELECT DISTINCT league, season, feature AS player_id FROM design WHERE feature >= 0""", "design")


@register("rating_rows", query("""
SELECT league, season, player_id, player, position, minutes, o.player_id IS NULL AS without_stint, 0.0::DOUBLE AS epm_less_parts
FROM season_totals LEFT JOIN (SELECT *, player_id AS p FROM on_pitch) o USING (league, season, player_id)""".replace(
    "o.player_id IS NULL", "o.p IS NULL"), "season_totals", "on_pitch"))
def rating_rows(spark, d):
    """Everyone in the player table is rated; without a stint rapm and bpm are 0; epm is the sum of its parts."""
    run = ratings.rating_run(all_stints(spark, d), T.appearances(spark, d))
    listed = run.rapm.ridge.coefficients.select("league", "season", F.col("feature").alias("player_id"), F.lit(True).alias("fitted"))
    rated = run.rated.join(listed, ["league", "season", "player_id"], "left")
    bad = F.col("fitted").isNull() & ((F.col("rapm") != 0) | (F.col("bpm") != 0))
    parts = F.round(F.col("epm") - F.col("spm") - F.col("bpm") + F.when(bad, 1.0).otherwise(0.0), 9) + 0.0
    return rated.select("league", "season", "player_id", "player", "position", "minutes", F.col("fitted").isNull().alias("without_stint"),
                        parts.alias("epm_less_parts"))


cte("fx_design", """SELECT DISTINCT league_id, season, CAST(unnest(string_split(home_players || ',' || away_players, ',')) AS BIGINT) AS feature
  FROM fx_stints UNION SELECT DISTINCT league_id, season, -3 FROM fx_stints WHERE score_diff <> 0
  UNION SELECT DISTINCT league_id, season, -2 FROM fx_stints WHERE red_home <> 0
  UNION SELECT DISTINCT league_id, season, -1 FROM fx_stints WHERE red_away <> 0""", "fx_stints")
cte("fx_on_pitch", "SELECT league_id, season, feature AS player_id FROM fx_design WHERE feature >= 0", "fx_design")
cte("fx_eligible", """SELECT league_id, season FROM feed_season_totals JOIN fx_on_pitch USING (league_id, season, player_id)
  WHERE minutes >= 300 GROUP BY ALL HAVING count(*) >= 2""", "feed_season_totals", "fx_on_pitch")


@register("feed_rating_gradients", query(f"""
SELECT league_id, season, model, feature, 0.0::DOUBLE AS gradient FROM (
  SELECT league_id, season, 'rapm' AS model, feature FROM fx_design
  UNION ALL SELECT league_id, season, 'bpm', feature FROM fx_design WHERE feature >= 0
  UNION ALL SELECT DISTINCT league_id, season, unnest(['rapm', 'bpm']), -4 FROM fx_design
  UNION ALL SELECT league_id, season, 'spm', unnest(list_concat(range({len(seasons.FEED_METRICS)}), [-4])) FROM fx_eligible)""",
                                        "fx_design", "fx_eligible"))
def feed_rating_gradients(spark, d):
    """The three fits of the feed form are at their minimum: each slope is 0, taken from the rows themselves."""
    keys = ("league_id", "season")
    stints = materialize(feed.build_feed_stints(*feed_parts(spark, d)), "stints")
    run = ratings.rating_run(stints, feed_player_rows(spark, d), keys, seasons.FEED_METRICS, 300, roster="both")
    slopes = ratings.optimality(run, keys).filter("feature < 0 or model = 'spm' or gradient is not null")
    feature = F.when(F.col("feature") == ridge.INTERCEPT, -4).otherwise(short_code("feature"))
    slopes = slopes.select(*keys, "model", feature.alias("feature"), (F.round("gradient", 3) + 0.0).alias("gradient"))
    used = ridge.gram_sums(design.design_rows(stints, keys), keys).filter(F.col("p") == F.col("q")).select(*keys, short_code("q").alias("feature"))
    context = F.col("feature").isin(-1, -2, -3) & (F.col("model") != "spm")
    return slopes.filter(~context).unionByName(slopes.filter(context).join(used, [*keys, "feature"], "left_semi").select(*slopes.columns))


def rated_sql(totals: str) -> str:
    """Everyone with player rows or a stint, in the league-seasons that have stints."""
    return f"""SELECT league_id, season, player_id, coalesce(player, 'Unknown') AS player, coalesce(position, 'UNK') AS position,
  coalesce(minutes, 0.0) AS minutes, o.p IS NULL AS without_stint, 0.0::DOUBLE AS epm_less_parts
FROM {totals} FULL JOIN (SELECT *, player_id AS p FROM fx_on_pitch) o USING (league_id, season, player_id)
WHERE (league_id, season) IN (SELECT (league_id, season) FROM fx_on_pitch)"""


def rated_rows(rated):
    bad = F.col("rapm").isNull() & (F.col("bpm") != 0)
    parts = F.round(F.col("epm") - F.col("spm") - F.col("bpm") + F.when(bad, 1.0).otherwise(0.0), 9) + 0.0
    return rated.select("league_id", "season", "player_id", "player", "position", "minutes", F.col("rapm").isNull().alias("without_stint"),
                        parts.alias("epm_less_parts"))


@register("feed_rating_rows", query(rated_sql("feed_season_totals"), "feed_season_totals", "fx_on_pitch"))
def feed_rating_rows(spark, d):
    """Players of the feed's stints and of its player rows are rated; without a stint rapm is null and bpm 0; epm is the sum of its parts."""
    stints = materialize(feed.build_feed_stints(*feed_parts(spark, d)), "stints")
    return rated_rows(ratings.rate_from_feed(stints, feed_player_rows(spark, d)))


def _box_ratings(spark, d):
    """Ratings with a closed form, to compare what follows the fits."""
    stats = seasons.season_totals(T.appearances(spark, d))
    return stats.select(*[c for c in stats.columns if c != "xg_p90"], F.col("xg_p90").alias("spm"), F.col("goals_p90").alias("bpm"),
                        (F.col("xg_p90") + F.col("goals_p90")).alias("epm"), F.col("xa_p90").alias("rapm"))


cte("box", """SELECT league, season, player_id, player, position, minutes, xa_p90 AS rapm, xg_p90 AS spm, goals_p90 AS bpm,
  xg_p90 + goals_p90 AS epm FROM season_totals""", "season_totals")


@register("metric_long_form", query("""
SELECT player_id, player, position, minutes, league, season, metric, round(value, 6) AS value
FROM (UNPIVOT box ON rapm, spm, epm INTO NAME metric VALUE value)""", "box"))
def metric_long_form(spark, d):
    return rounded(ratings.metric_files(_box_ratings(spark, d), ("rapm", "spm", "epm", "unknown")))


@register("top_report", query("""
SELECT (SELECT count(DISTINCT player_id) FROM box) AS players_scored, string_agg(player_id::VARCHAR, ',' ORDER BY r) AS best FROM (
  SELECT player_id, row_number() OVER (ORDER BY round(epm, 9) DESC, round(rapm, 9) DESC, player_id) AS r FROM box) WHERE r <= 10""", "box"))
def top_report(spark, d):
    box = _box_ratings(spark, d)
    box = box.withColumns({m: F.round(m, 9) for m in ratings.RATINGS})
    report = ratings.top_report(box)
    return report.select("players_scored", F.array_join(F.transform("top_players", lambda p: p["player_id"].cast("string")), ",").alias("best"))
