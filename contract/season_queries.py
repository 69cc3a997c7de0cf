"""League translation, tail compression, stability, name matching and feed coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import tables as T
from contract.registry import register, rounded
from contract.sql import CTES, cte, query
from pitchline.functions import scalars as S
from pitchline.operators import names
from pitchline.plans import coverage, stability, translation

cte("keyed", "SELECT *, year AS season_key FROM player_seasons", "player_seasons")
cte("samples", """SELECT player_id, league AS origin, l2 AS dest, e2 - epm AS y, least(minutes, m2) AS weight FROM (
  SELECT *, lead(league) OVER w AS l2, lead(minutes) OVER w AS m2, lead(epm) OVER w AS e2 FROM keyed
  WINDOW w AS (PARTITION BY player_id ORDER BY season_key, league))
  WHERE league <> l2 AND minutes >= 900 AND m2 >= 900""", "keyed")


@register("season_keys", """
SELECT o_orderkey, label, CASE WHEN contains(label, '_') THEN CAST(string_split(label, '_')[1] AS INTEGER)
  WHEN regexp_full_match(label, '[0-9]{4}') AND (CAST(label[1:2] AS INTEGER) + 1) % 100 = CAST(label[3:4] AS INTEGER)
    THEN 2000 + CAST(label[1:2] AS INTEGER)
  WHEN regexp_full_match(label, '[0-9]+') THEN CAST(label AS INTEGER) ELSE 0 END AS season_key
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate) || '_' || (year(o_orderdate) + 1)
  WHEN 1 THEN lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0')
  WHEN 2 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE o_orderpriority END AS label FROM orders)""")
def season_keys(spark, d):
    y = F.year("o_orderdate")
    two = lambda c: F.lpad((c % 100).cast("string"), 2, "0")
    label = F.when(F.col("o_orderkey") % 4 == 0, F.concat(y, F.lit("_"), y + 1)).when(
        F.col("o_orderkey") % 4 == 1, F.concat(two(y), two(y + 1))).when(F.col("o_orderkey") % 4 == 2, y.cast("string")).otherwise(
        F.col("o_orderpriority"))
    return T.table(spark, d, "orders").select("o_orderkey", label.alias("label")).withColumn("season_key", S.season_key("label"))


@register("transfer_samples", query("SELECT player_id, origin, dest, round(y, 6) AS y, weight FROM samples", "samples"))
def transfer_samples(spark, d):
    return rounded(translation.transfer_samples(T.player_seasons(spark, d)))


# Gauss-Jordan elimination of the regularised normal equations over the five leagues.
cte("lg", "SELECT league, row_number() OVER (ORDER BY league) AS i FROM (SELECT DISTINCT league FROM player_seasons)", "player_seasons")
cte("entries", """SELECT a.i, b.i AS j, coalesce(sum(weight * v), 0) + CASE WHEN a.i = b.i THEN 1 ELSE 0 END AS s
  FROM lg a CROSS JOIN lg b LEFT JOIN (
    SELECT dest AS p, dest AS q, weight, 1 AS v FROM samples UNION ALL SELECT origin, origin, weight, 1 FROM samples
    UNION ALL SELECT dest, origin, weight, -1 FROM samples UNION ALL SELECT origin, dest, weight, -1 FROM samples) e
  ON e.p = a.league AND e.q = b.league GROUP BY 1, 2
  UNION ALL SELECT a.i, (SELECT max(i) + 1 FROM lg), coalesce(sum(weight * y * v), 0) FROM lg a LEFT JOIN (
    SELECT dest AS p, weight, y, 1 AS v FROM samples UNION ALL SELECT origin, weight, y, -1 FROM samples) e ON e.p = a.league
  GROUP BY 1""", "lg", "samples")
cte("matrix0", """SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(CAST(s AS DOUBLE) ORDER BY j) AS r FROM entries GROUP BY i)""",
    "entries")
cte("elimination", """SELECT 1 AS k, m FROM matrix0 UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k])
    ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END) FROM elimination WHERE k <= len(m)""", "matrix0")
CTES["elimination"] = (CTES["elimination"][0], CTES["elimination"][1])
cte("league_coef", """SELECT league, c - avg(c) OVER () AS coef FROM (
  SELECT league, m[i][len(m) + 1] AS c FROM lg, (SELECT m FROM elimination ORDER BY k DESC LIMIT 1))""", "lg", "elimination")


def recursive(body: str, *needs: str) -> str:
    return query(body, *needs).replace("WITH ", "WITH RECURSIVE ", 1)


@register("league_coefficients", recursive("SELECT league, round(coef, 6) AS coef FROM league_coef", "league_coef"))
def league_coefficients(spark, d):
    return rounded(translation.league_coefficients(T.player_seasons(spark, d)))


@register("translated_ratings", recursive("""SELECT player_id, season, league, round(epm, 6) AS epm,
round(epm - coalesce(coef, 0), 6) AS epm_translated FROM player_seasons LEFT JOIN league_coef USING (league)""",
                                          "player_seasons", "league_coef"))
def translated_ratings(spark, d):
    seasons = T.player_seasons(spark, d)
    out = translation.translate(seasons, translation.league_coefficients(seasons))
    return rounded(out.select("player_id", "season", "league", "epm", "epm_translated"))


def compress_sql(by: str) -> str:
    over = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN q USING ({by})" if by else ", q"
    return query(f"""
, z AS (SELECT *, avg(epm) OVER ({over}) AS mu, stddev_pop(epm) OVER ({over}) AS sd,
    abs(epm - avg(epm) OVER ({over})) / stddev_pop(epm) OVER ({over}) AS z FROM player_seasons),
  q AS (SELECT {by + ',' if by else ''} quantile_cont(z, 0.95) AS qv FROM z {group})
SELECT player_id, season, league, round(mu + sign(epm - mu) * sd * CASE WHEN z > qv THEN qv + ln(1 + (z - qv)) ELSE z END, 6) AS gpm
FROM z {join}""", "player_seasons").replace("\n\n,", ",")


for _scope in ("", "league"):
    @register("gpm_per_league" if _scope else "gpm_global", compress_sql(_scope))
    def gpm(spark, d, scope=_scope):
        out = translation.compress_tails(T.player_seasons(spark, d), "epm", by=[scope] if scope else [])
        return rounded(out.select("player_id", "season", "league", "gpm"))


# --- stability --------------------------------------------------------------------------------------------------

cte("series", """SELECT *, row_number() OVER w AS t, lag(epm) OVER w AS prev, list(epm) OVER (PARTITION BY player_id
    ORDER BY season_key, league ROWS UNBOUNDED PRECEDING) AS xs,
    count(*) OVER (PARTITION BY player_id) AS n FROM keyed WHERE minutes >= 900
  WINDOW w AS (PARTITION BY player_id ORDER BY season_key, league)""", "keyed")
cte("smoothed", """SELECT *, list_reduce(xs, lambda e, x: 0.5 * x + 0.5 * e) AS ewma FROM series WHERE n >= 4""", "series")


def search(level: int, step: float, reach: int, centre: str | None) -> None:
    """One level of the likelihood search, straight from the rows of each series."""
    grid = f"SELECT player_id, {('c.phi + ' if centre else '')}g * {step!r}::DOUBLE AS phi FROM " + (
        f"{centre} c" if centre else "(SELECT DISTINCT player_id FROM smoothed)") + f", (SELECT unnest(range({-reach}, {reach + 1})) AS g)"
    cte(f"mu{level}", f"""SELECT player_id, phi, any_value(n) AS n,
        sum(CASE WHEN t = 1 THEN (1 - phi * phi) * epm ELSE (1 - phi) * (epm - phi * prev) END)
          / (1 - phi * phi + (any_value(n) - 1) * pow(1 - phi, 2)) AS mu
      FROM smoothed JOIN (SELECT * FROM ({grid}) WHERE abs(phi) < 1) USING (player_id) GROUP BY 1, 2""",
        "smoothed", *([centre] if centre else []))
    cte(f"ll{level}", f"""SELECT player_id, phi, n, v, -n / 2.0 * (ln(2 * pi() * v) + 1) + 0.5 * ln(1 - phi * phi) AS ll FROM (
        SELECT player_id, phi, any_value(m.n) AS n,
          sum(CASE WHEN t = 1 THEN (1 - phi * phi) * pow(epm - mu, 2) ELSE pow(epm - mu - phi * (prev - mu), 2) END) / any_value(m.n) AS v
        FROM smoothed JOIN mu{level} m USING (player_id) GROUP BY 1, 2) WHERE v > 0""", "smoothed", f"mu{level}")
    cte(f"best{level}", f"SELECT player_id, arg_max(phi, ll) AS phi, arg_max(v, ll) AS v, max(ll) AS ll FROM ll{level} GROUP BY 1", f"ll{level}")


search(0, 0.01, 99, None)
for _i in (1, 2, 3):
    search(_i, 0.01 / 20 ** _i, 20, f"best{_i - 1}")


@register("player_stability", query("""
SELECT player_id, 'Player ' || player_id AS player, CAST(n AS INTEGER) AS seasons, 'epm' AS metric, round(value_mean, 6) AS value_mean,
  round(value_std, 6) AS value_std, round(phi + 3e-7, 4) AS ar1, round(sqrt(v), 5) AS resid_std, round(6 - 2 * ll, 5) AS aic,
  round(es, 6) AS ewma_resid_std, round(-sqrt(v), 5) AS stability_score_arima, round(-es, 6) AS stability_score_ewma
FROM (SELECT player_id, count(*) AS n, avg(epm) AS value_mean, stddev_pop(epm) AS value_std, stddev_pop(epm - ewma) AS es
      FROM smoothed GROUP BY 1) LEFT JOIN best3 USING (player_id)""", "smoothed", "best3"))
def player_stability(spark, d):
    out = stability.player_stability(T.player_seasons(spark, d), "epm")
    # The search grid holds values that lie exactly between two roundings; both sides are shifted off them.
    out = out.withColumns({"ar1": F.round(F.col("ar1") + 3e-7, 4), **{c: F.round(c, 5) for c in ("resid_std", "aic", "stability_score_arima")}})
    return rounded(out)


@register("ewma_steps", query("""
SELECT player_id, season_key, league, round(epm, 6) AS x, round(prev, 6) AS prev, t,
  round(list_reduce(xs, lambda e, x: 0.5 * x + 0.5 * e), 6) AS ewma FROM series""", "series"))
def ewma_steps(spark, d):
    played = T.player_seasons(spark, d).filter("minutes >= 900")
    return rounded(stability.series_steps(played, "epm").drop("player", "first"))


# --- names ------------------------------------------------------------------------------------------------------

def _team_names(spark, d):
    return T.table(spark, d, "part").select(
        F.concat(F.initcap("p_name"), F.element_at(F.array(*map(F.lit, [" United", " Town FC", "", " City", "_Albion"])),
                                                   (F.col("p_partkey") % 5 + 1).cast("int"))).alias("name"))


def _badge_files(spark, d):
    p = T.table(spark, d, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w"), "p_type").agg(
        F.min("p_partkey").alias("position"))
    return p.select(F.concat(F.lit("afc-"), F.when(F.col("position") % 3 == 0, F.col("w")).otherwise(
        F.concat(F.col("w"), F.lit("-"), F.lower("p_type"))), F.lit("-logo")).alias("candidate"), "position")


_NORM = ("trim(regexp_replace(regexp_replace(translate(lower({c}), ' _', '--'), '\\b(" + "|".join(S.CLUB_WORDS)
         + ")\\b', '', 'g'), '-+', '-', 'g'), '-')")
cte("team_list", f"""SELECT *, {_NORM.format(c='name')} AS key FROM (SELECT DISTINCT
  upper(w1[1]) || w1[2:] || ' ' || upper(w2[1]) || w2[2:] || suffix AS name FROM (
    SELECT string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2,
      CASE p_partkey % 5 WHEN 0 THEN ' United' WHEN 1 THEN ' Town FC' WHEN 2 THEN '' WHEN 3 THEN ' City' ELSE '_Albion' END AS suffix
    FROM part))""")
cte("badges", f"""SELECT key, min(position) AS position, arg_max(candidate, position) AS candidate FROM (
  SELECT *, {_NORM.format(c='candidate')} AS key FROM (SELECT 'afc-' || CASE WHEN position % 3 = 0 THEN w ELSE w || '-' || lower(p_type) END
    || '-logo' AS candidate, position FROM (SELECT string_split(p_name, ' ')[1] AS w, p_type, min(p_partkey) AS position FROM part GROUP BY 1, 2)))
  WHERE key <> '' GROUP BY key""")


@register("name_matching", query("""
SELECT name, coalesce(e.candidate, f.candidate) AS candidate,
  CASE WHEN e.candidate IS NOT NULL THEN 'exact' WHEN f.candidate IS NOT NULL THEN 'contains' ELSE 'none' END AS how
FROM team_list t LEFT JOIN badges e USING (key) LEFT JOIN (
  SELECT t.key, arg_min(b.candidate, b.position) AS candidate FROM (SELECT DISTINCT key FROM team_list) t JOIN badges b
  ON contains(t.key, b.key) OR contains(b.key, t.key) GROUP BY 1) f USING (key)""", "team_list", "badges"))
def name_matching(spark, d):
    return names.match_names(_team_names(spark, d), _badge_files(spark, d))


# --- coverage ---------------------------------------------------------------------------------------------------

def _leagues(spark, d):
    n = T.table(spark, d, "nation")
    years = F.transform(F.sequence(F.lit(1995), F.lit(2001) - F.col("n_nationkey") % 2), lambda y: F.struct(
        y.alias("year"), ((F.col("n_nationkey") % 3 == 0) & (y == 1999)).alias("current"), (y % 2 == 0).alias("coverage")))
    return n.select(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("league"),
                    F.struct(F.col("n_name").alias("name")).alias("country"), years.alias("seasons"))


def _league_fixtures(spark, d):
    o, c = T.table(spark, d, "orders"), T.table(spark, d, "customer")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_nationkey").alias("league_id"), F.year("o_orderdate").alias("season"),
                         F.concat(F.lit("Regular Season - "), F.col("o_orderkey") % 38).alias("round"),
                         F.col("o_orderkey").alias("fixture_id"), F.col("o_orderkey").alias("position"))


cte("cur", """SELECT n_nationkey AS league_id, n_name AS league_name, n_name AS country,
  CAST(CASE WHEN n_nationkey % 3 = 0 THEN 1999 ELSE 2001 - n_nationkey % 2 END AS INTEGER) AS current_season FROM nation""")
cte("picked", """SELECT league_id, season AS season_used, fixture_id FROM (SELECT league_id, year(o_orderdate) AS season,
    o_orderkey AS fixture_id, row_number() OVER (PARTITION BY league_id ORDER BY year(o_orderdate) DESC, o_orderkey) AS r
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN cur ON league_id = c_nationkey
  WHERE o_orderkey % 38 = 1
    AND year(o_orderdate) BETWEEN current_season - 3 AND current_season) WHERE r = 1""", "cur")


@register("current_seasons", query("SELECT * FROM cur", "cur"))
def current_seasons(spark, d):
    return coverage.league_seasons(_leagues(spark, d))


@register("sample_fixture_per_league", query("SELECT *, season_used % 2 = 0 AS coverage FROM picked", "picked"))
def sample_fixture_per_league(spark, d):
    leagues = _leagues(spark, d)
    picked = coverage.pick_fixtures(coverage.league_seasons(leagues), _league_fixtures(spark, d))
    return coverage.season_coverage(leagues, picked)


cte("support", """SELECT f.fixture_id, 'League ' || league_id AS league, date, status, 'Club ' || home_team_id AS home,
    'Club ' || away_team_id AS away, n AS events, 2 AS lineups, p AS player_blocks, sides AS statistics,
    ids AS events_with_player_ids, true AS lineups_available, true AS player_match_stats_available,
    true AS team_expected_goals_available, false AS event_level_xg_available
  FROM feed_fixtures f JOIN (SELECT fixture_id, count(*) AS n, count(DISTINCT user_id) AS p, count(DISTINCT side) AS sides,
    bool_and(event_id % 29 <> 0 AND user_id <> 0) AS ids FROM feed GROUP BY 1) USING (fixture_id)""", "feed_fixtures", "feed")


def _support(spark, d):
    return coverage.feed_support(T.feed_fixtures(spark, d), T.feed_events(spark, d), T.feed_lineups(spark, d),
                                 T.feed_players(spark, d), T.feed_statistics(spark, d))


@register("feed_coverage", query("""SELECT *, events_with_player_ids AS supports_live_stint_reconstruction,
true AS supports_batch_player_evaluation, false AS supports_shot_level_ratings, true AS supports_team_xg_proxy FROM support""", "support"))
def feed_coverage(spark, d):
    return _support(spark, d)


@register("live_probe", query("""SELECT fixture_id, league, status, home, away, events, statistics, lineups,
team_expected_goals_available AS expected_goals_present FROM support WHERE status = '2H'""", "support"))
def live_probe(spark, d):
    return coverage.live_probe(_support(spark, d).filter("status = '2H'"))


@register("feed_sample_events", query("""
SELECT fixture_id, rank, least(minute, 90) AS minute, 'Club ' || (block * 2 + side) AS team,
  CASE WHEN event_id % 29 <> 0 THEN user_id END AS player_id,
  CASE event_type WHEN 'purchase' THEN 'Goal' WHEN 'error' THEN 'Card' WHEN 'signup' THEN 'subst' ELSE 'Var' END AS type,
  CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 17 = 0 THEN 'Own Goal' ELSE 'Normal Goal' END
    WHEN 'error' THEN CASE event_id % 5 WHEN 0 THEN 'Red Card' WHEN 1 THEN 'Yellow Red Card' ELSE 'Yellow Card' END
    WHEN 'signup' THEN 'Substitution 1' ELSE 'Goal cancelled' END AS detail
FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY event_id) AS rank FROM feed) WHERE rank <= 5""", "feed"))
def feed_sample_events(spark, d):
    return coverage.sample_events(T.feed_events(spark, d))


@register("feed_expected_goals_listed", query("""
SELECT fixture_id, 'Club ' || (block * 2 + side) AS team,
CASE WHEN fixture_id % 7 = 0 THEN NULL WHEN fixture_id % 11 = 0 THEN 'n/a'
     ELSE CAST(CAST(round(sum(value) / 1000, 5) AS DECIMAL(18, 5)) AS VARCHAR) END AS expected_goals
FROM feed GROUP BY fixture_id, block, side""", "feed"))
def feed_expected_goals_listed(spark, d):
    return coverage.expected_goals_by_team(T.feed_statistics(spark, d))


@register("feed_stat_fields", query("""
SELECT fixture_id, CASE WHEN arg_min(e, (side, user_id)) % 23 = 0 THEN ''
  ELSE 'cards,dribbles,duels,extra,fouls,games,goals,passes,penalty,rating,shots,tackles' END AS fields
FROM (SELECT fixture_id, side, user_id, min(event_id) AS e FROM feed GROUP BY ALL) GROUP BY 1""", "feed"))
def feed_stat_fields(spark, d):
    sent = F.replace(F.to_json("players"), F.lit('"games":'), F.lit('"rating":null,"extra":{"a":1},"games":'))
    return coverage.stat_fields(T.feed_players(spark, d).withColumn("players", F.parse_json(sent))).select(
        "fixture_id", F.array_join("player_stat_fields", ",").alias("fields"))
