"""Stints from appearances and shots, and from line-ups and events; design table and its weighted sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import tables as T
from contract.registry import register, rounded
from contract.sql import cte, query
from pitchline.operators import feed, stints
from pitchline.session import materialize

G = "league, season, game_id"

cte("by_minute", f"""SELECT {G}, team_id, minute, sum(xg) AS xg, count(*) FILTER (lower(result) = 'goal') AS goals
  FROM shots WHERE minute IS NOT NULL GROUP BY ALL""", "shots")
cte("ends", f"""SELECT s.*, greatest(90, coalesce(m, 90)) AS match_end FROM schedule s LEFT JOIN (
  SELECT {G}, max(m) AS m FROM (SELECT {G}, CAST(trunc(minutes) AS INTEGER) AS m FROM appearances
    UNION ALL SELECT {G}, minute FROM by_minute) GROUP BY ALL) USING ({G})""", "schedule", "appearances", "by_minute")
cte("intervals", f"""SELECT {G}, team_id, player_id,
    CASE WHEN team_id = home_team_id THEN 'home' WHEN team_id = away_team_id THEN 'away' END AS side,
    CAST(CASE WHEN lower(position) = 'sub' THEN greatest(0, match_end - minutes) ELSE 0 END AS INTEGER) AS start,
    CAST(CASE WHEN lower(position) = 'sub' THEN match_end ELSE least(match_end, minutes) END AS INTEGER) AS stop,
    CAST(red_cards AS INTEGER) AS red_cards
  FROM appearances JOIN ends USING ({G}) WHERE minutes > 0""", "appearances", "ends")
cte("bounds", f"""SELECT DISTINCT {G}, minute FROM (
  SELECT {G}, start AS minute FROM intervals UNION ALL SELECT {G}, stop FROM intervals
  UNION ALL SELECT {G}, minute FROM by_minute UNION ALL SELECT {G}, unnest([0, 45, match_end]) FROM ends)
  JOIN ends USING ({G}) WHERE minute BETWEEN 0 AND match_end""", "intervals", "by_minute", "ends")
cte("segments", f"""SELECT * FROM (SELECT {G}, minute AS start, lead(minute) OVER (PARTITION BY {G} ORDER BY minute) AS stop FROM bounds)
  WHERE stop - start >= 1""", "bounds")
cte("covered", f"""SELECT s.*, i.side, i.player_id FROM segments s JOIN intervals i USING ({G})
  WHERE i.start <= s.start AND i.stop >= s.stop AND i.side IS NOT NULL""", "segments", "intervals")
cte("lineups", f"""SELECT {G}, start, stop, string_agg(player_id::VARCHAR, ',' ORDER BY player_id) FILTER (side = 'home') AS home_players,
    string_agg(player_id::VARCHAR, ',' ORDER BY player_id) FILTER (side = 'away') AS away_players
  FROM covered GROUP BY ALL HAVING count(*) FILTER (side = 'home') > 0 AND count(*) FILTER (side = 'away') > 0""", "covered")
cte("seg_xg", f"""SELECT {G}, s.start, sum(CASE WHEN b.team_id = e.home_team_id THEN xg ELSE -xg END) AS xg_diff
  FROM segments s JOIN ends e USING ({G}) JOIN by_minute b USING ({G})
  WHERE b.minute >= s.start AND b.minute < s.stop AND b.team_id IN (e.home_team_id, e.away_team_id) GROUP BY ALL""",
    "segments", "ends", "by_minute")
cte("seg_score", f"""SELECT {G}, s.start, sum(CASE WHEN b.team_id = e.home_team_id THEN goals ELSE -goals END) AS score_diff
  FROM segments s JOIN ends e USING ({G}) JOIN by_minute b USING ({G})
  WHERE b.minute < s.start AND b.team_id IN (e.home_team_id, e.away_team_id) GROUP BY ALL""", "segments", "ends", "by_minute")
cte("seg_red", f"""SELECT {G}, s.start, count(*) FILTER (side = 'home') AS red_home, count(*) FILTER (side = 'away') AS red_away
  FROM segments s JOIN intervals i USING ({G}) WHERE i.red_cards > 0 AND i.stop < s.start GROUP BY ALL""", "segments", "intervals")
cte("stints", f"""SELECT {G}, start, l.stop, CAST(l.stop - start AS DOUBLE) AS duration, home_team_id, away_team_id,
    home_players, away_players, coalesce(xg_diff, 0) AS xg_diff, CAST(coalesce(score_diff, 0) AS DOUBLE) AS score_diff,
    CAST(coalesce(red_home, 0) AS DOUBLE) AS red_home, CAST(coalesce(red_away, 0) AS DOUBLE) AS red_away
  FROM lineups l JOIN ends USING ({G}) LEFT JOIN seg_xg USING ({G}, start) LEFT JOIN seg_score USING ({G}, start)
  LEFT JOIN seg_red USING ({G}, start)""", "lineups", "ends", "seg_xg", "seg_score", "seg_red")


def _parts(spark, d):
    """Written once each: several steps of a query read them."""
    apps = materialize(T.appearances(spark, d).select("league", "season", "game_id", "team_id", "player_id", "minutes", "position", "red_cards"),
                       "appearances")
    by_minute = materialize(stints.shots_by_minute(T.shots(spark, d)), "by-minute")
    ends = materialize(stints.match_ends(T.schedule(spark, d), apps, by_minute), "match-ends")
    return by_minute, ends, materialize(stints.player_intervals(apps, ends), "intervals")


def all_stints(spark, d, min_minutes=1.0):
    return stints.build_stints(T.schedule(spark, d), T.appearances(spark, d), T.shots(spark, d), min_minutes)


def readable(df):
    """Line-ups as text, for a comparison that does not depend on list types."""
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rounded(df.select(*[join(c) if c.endswith("_players") else F.col(c) for c in df.columns])
                   .withColumnRenamed("end", "stop"))


@register("shots_by_minute", query(f"SELECT {G}, team_id, minute, round(xg, 6) AS xg, goals FROM by_minute", "by_minute"))
def shots_by_minute(spark, d):
    return rounded(stints.shots_by_minute(T.shots(spark, d)))


@register("match_ends", query("SELECT * FROM ends", "ends"))
def match_ends(spark, d):
    return _parts(spark, d)[1]


@register("player_intervals", query("SELECT * FROM intervals WHERE stop > start", "intervals"))
def player_intervals(spark, d):
    return _parts(spark, d)[2].withColumnRenamed("end", "stop")


@register("red_cards_by_minute", query(f"""SELECT {G}, side, stop AS minute, count(*) AS reds FROM intervals
WHERE red_cards > 0 GROUP BY ALL""", "intervals"))
def red_cards_by_minute(spark, d):
    return stints.red_cards_by_minute(_parts(spark, d)[2])


@register("stint_boundaries", query("SELECT * FROM bounds", "bounds"))
def stint_boundaries(spark, d):
    by_minute, ends, intervals = _parts(spark, d)
    return stints.boundary_deltas(ends, intervals, by_minute).select("league", "season", "game_id", "minute")


@register("stint_players", query(f"""SELECT {G}, start, stop, player_id, CASE side WHEN 'home' THEN 1.0 ELSE -1.0 END::DOUBLE AS sign
FROM covered""", "covered"))
def stint_players(spark, d):
    by_minute, ends, intervals = _parts(spark, d)
    segments = stints.cut_stints(ends, stints.boundary_deltas(ends, intervals, by_minute))
    return stints.on_pitch(segments, intervals).select(
        "league", "season", "game_id", "start", F.col("end").alias("stop"), "player_id", "sign")


@register("stints_from_minutes", query("SELECT * REPLACE (round(xg_diff, 6) AS xg_diff) FROM stints", "stints"))
def stints_from_minutes(spark, d):
    return readable(all_stints(spark, d))


@register("stints_two_minutes", query("SELECT * REPLACE (round(xg_diff, 6) AS xg_diff) FROM stints WHERE duration >= 2", "stints"))
def stints_two_minutes(spark, d):
    return readable(all_stints(spark, d, 2.0))


@register("stint_index", query(f"""SELECT {G}, start, row_number() OVER (PARTITION BY {G} ORDER BY start) - 1 AS stint_index
FROM stints""", "stints"))
def stint_index(spark, d):
    return stints.with_stint_index(all_stints(spark, d)).select("league", "season", "game_id", "start", "stint_index")


# --- feed -----------------------------------------------------------------------------------------------------

cte("fx_ends", """SELECT f.*, CAST(greatest(90, coalesce(f.elapsed, 90), coalesce(e.m, 90), coalesce(p.m, 90)) AS INTEGER) AS match_end
  FROM feed_fixtures f LEFT JOIN (SELECT fixture_id, max(minute) AS m FROM feed_ops GROUP BY 1) e USING (fixture_id)
  LEFT JOIN (SELECT fixture_id, max(CASE WHEN has_stats THEN 20 + (e * 13) % 71 END) AS m FROM feed_players GROUP BY 1) p
    USING (fixture_id)""", "feed_fixtures", "feed_ops", "feed_players")
cte("fx_starters", """SELECT fixture_id, block * 2 + k % 2 AS team_id, block * 50 + k AS player_id
  FROM (SELECT DISTINCT fixture_id, block FROM feed), (SELECT unnest(range(0, 22)) AS k)""", "feed")
cte("fx_ops", """
  SELECT fixture_id, team_id, player_id, -1 AS minute, -1 AS event_id, 1 AS rank, true AS comes FROM fx_starters
  UNION ALL SELECT fixture_id, team_id, player_id, minute, event_id, 0, false FROM feed_ops
    WHERE kind IN ('red', 'sub') AND player_id IS NOT NULL
  UNION ALL SELECT fixture_id, team_id, assist_id, minute, event_id, 1, true FROM feed_ops WHERE kind = 'sub'""",
    "fx_starters", "feed_ops")
cte("fx_presence", """SELECT * FROM (
  SELECT fixture_id, team_id, player_id, minute AS start, comes,
    coalesce(lead(minute) OVER (PARTITION BY fixture_id, team_id, player_id ORDER BY minute, event_id, rank), 1000000) AS stop
  FROM fx_ops) WHERE comes AND stop > start""", "fx_ops")
cte("fx_bounds", """SELECT DISTINCT fixture_id, minute FROM (
  SELECT fixture_id, minute FROM feed_ops WHERE kind IS NOT NULL
  UNION ALL SELECT fixture_id, unnest([0, 45, match_end]) FROM fx_ends)""", "feed_ops", "fx_ends")
cte("fx_segments", """SELECT * FROM (SELECT fixture_id, minute AS start,
  lead(minute) OVER (PARTITION BY fixture_id ORDER BY minute) AS stop FROM fx_bounds) WHERE stop - start >= 1""", "fx_bounds")
cte("fx_state", """SELECT s.fixture_id, s.start,
    count(*) FILTER (kind = 'goal' AND (side = 0) = (NOT own_goal)) - count(*) FILTER (kind = 'goal' AND (side = 1) = (NOT own_goal))
      AS score_diff,
    count(*) FILTER (kind = 'red' AND side = 0) AS red_home, count(*) FILTER (kind = 'red' AND side = 1) AS red_away
  FROM fx_segments s LEFT JOIN feed_ops o ON o.fixture_id = s.fixture_id AND o.minute <= s.start AND kind IS NOT NULL
  GROUP BY 1, 2""", "fx_segments", "feed_ops")
cte("fx_lineups", """SELECT s.fixture_id, s.start, s.stop,
    string_agg(player_id::VARCHAR, ',' ORDER BY player_id) FILTER (p.team_id = e.home_team_id) AS home_players,
    string_agg(player_id::VARCHAR, ',' ORDER BY player_id) FILTER (p.team_id = e.away_team_id) AS away_players
  FROM fx_segments s JOIN fx_ends e USING (fixture_id) JOIN fx_presence p
    ON p.fixture_id = s.fixture_id AND p.start <= s.start AND p.stop >= s.stop GROUP BY 1, 2, 3""",
    "fx_segments", "fx_ends", "fx_presence")
cte("fx_stints", """SELECT league_id, season, fixture_id AS game_id, start, stop, CAST(stop - start AS DOUBLE) AS duration,
    home_team_id, away_team_id, home_players, away_players,
    (coalesce(h.xg, goals_home) / match_end - coalesce(a.xg, goals_away) / match_end) * (stop - start) AS xg_diff,
    CAST(score_diff AS DOUBLE) AS score_diff, CAST(red_home AS DOUBLE) AS red_home, CAST(red_away AS DOUBLE) AS red_away
  FROM fx_lineups JOIN fx_ends USING (fixture_id) JOIN fx_state USING (fixture_id, start)
  LEFT JOIN feed_xg h ON h.fixture_id = fx_ends.fixture_id AND h.team_id = home_team_id
  LEFT JOIN feed_xg a ON a.fixture_id = fx_ends.fixture_id AND a.team_id = away_team_id
  WHERE home_players IS NOT NULL AND away_players IS NOT NULL""", "fx_lineups", "fx_ends", "fx_state", "feed_xg")


def feed_parts(spark, d):
    return (T.feed_fixtures(spark, d), T.feed_statistics(spark, d), T.feed_events(spark, d), T.feed_lineups(spark, d),
            T.feed_players(spark, d))


@register("feed_stints", query("SELECT * REPLACE (round(xg_diff, 6) AS xg_diff) FROM fx_stints", "fx_stints"))
def feed_stints(spark, d):
    return readable(feed.build_feed_stints(*feed_parts(spark, d)))


@register("feed_event_kinds", query("""SELECT fixture_id, event_id AS event_pos, minute, team_id, player_id, assist_id, kind
FROM feed_ops""", "feed_ops"))
def feed_event_kinds(spark, d):
    return feed.flat_events(T.feed_events(spark, d)).drop("detail")


@register("feed_starters", query("SELECT * FROM fx_starters", "fx_starters"))
def feed_starters(spark, d):
    return feed.starters(T.feed_lineups(spark, d))


@register("feed_presence", query("""SELECT fixture_id, CASE team_id % 2 WHEN 0 THEN 'home' ELSE 'away' END AS side, player_id,
start, stop FROM fx_presence""", "fx_presence"))
def feed_presence(spark, d):
    fx, st, ev, li, pl = feed_parts(spark, d)
    flat = feed.flat_events(ev)
    ends = feed.feed_match_ends(feed.fixture_heads(fx), flat, pl)
    spans = feed.presence(feed.starters(li), flat, ends)
    return spans.withColumnRenamed("end", "stop")


@register("feed_match_ends", query("SELECT fixture_id, match_end FROM fx_ends", "fx_ends"))
def feed_match_ends(spark, d):
    fx, _, ev, _, pl = feed_parts(spark, d)
    return feed.feed_match_ends(feed.fixture_heads(fx), feed.flat_events(ev), pl).select("fixture_id", "match_end")


@register("feed_expected_goals", query("SELECT * FROM feed_xg WHERE xg IS NOT NULL", "feed_xg"))
def feed_expected_goals(spark, d):
    return feed.expected_goals(T.feed_statistics(spark, d))


@register("feed_statistics_map", query("""SELECT fixture_id, 'Club ' || (block * 2 + side) AS team_name, '50%' AS possession,
CASE WHEN fixture_id % 7 = 0 THEN NULL WHEN fixture_id % 11 = 0 THEN 'n/a'
     ELSE CAST(CAST(round(sum(value) / 1000, 5) AS DECIMAL(18, 5)) AS VARCHAR) END AS xg
FROM feed GROUP BY fixture_id, block, side""", "feed"))
def feed_statistics_map(spark, d):
    m = feed.statistics_map(T.feed_statistics(spark, d))
    return m.select("fixture_id", "team_name", F.col("statistics")["Ball Possession"].alias("possession"),
                    F.col("statistics")["expected_goals"].alias("xg"))


@register("feed_player_rows", query("SELECT * FROM player_rows", "player_rows"))
def feed_player_rows(spark, d):
    return feed.player_rows(T.feed_players(spark, d))


@register("feed_fixture_records", query("""
SELECT f.fixture_id, league_id, season, date, status, elapsed, home_team_id, away_team_id, 'Club ' || home_team_id AS home_name,
  'Club ' || away_team_id AS away_name, CAST(goals_home AS DOUBLE) AS goals_home, CAST(goals_away AS DOUBLE) AS goals_away,
  h.xg AS xg_home, a.xg AS xg_away, true AS is_live, status <> '2H' AS is_finished
FROM feed_fixtures f LEFT JOIN feed_xg h ON h.fixture_id = f.fixture_id AND h.team_id = home_team_id
LEFT JOIN feed_xg a ON a.fixture_id = f.fixture_id AND a.team_id = away_team_id""", "feed_fixtures", "feed_xg"))
def feed_fixture_records(spark, d):
    return feed.fixture_records(T.feed_fixtures(spark, d), T.feed_statistics(spark, d), True).drop("last_synced_at")


@register("feed_finished_fixtures", query("""SELECT fixture_id, date, status FROM feed_fixtures WHERE status <> '2H'""",
                                          "feed_fixtures"))
def feed_finished_fixtures(spark, d):
    ordered = feed.first_fixtures(feed.finished_fixtures(T.feed_fixtures(spark, d)), None)
    return feed.fixture_heads(ordered).select("fixture_id", "date", "status")


@register("feed_first_fixtures", query("""SELECT fixture_id, date FROM feed_fixtures WHERE status <> '2H'
ORDER BY date, fixture_id LIMIT 12""", "feed_fixtures"))
def feed_first_fixtures(spark, d):
    first = feed.first_fixtures(feed.finished_fixtures(T.feed_fixtures(spark, d)), 12)
    return feed.fixture_heads(first).select("fixture_id", "date")


@register("feed_first_fixtures_by_season", query("""SELECT league_id, season, fixture_id FROM (SELECT *, row_number() OVER (
  PARTITION BY league_id, season ORDER BY date, fixture_id) AS r FROM feed_fixtures WHERE status <> '2H') WHERE r <= 3""", "feed_fixtures"))
def feed_first_fixtures_by_season(spark, d):
    first = feed.first_fixtures(feed.finished_fixtures(T.feed_fixtures(spark, d)), 3, per_season=True)
    return feed.fixture_heads(first).select("league_id", "season", "fixture_id")


@register("feed_fixtures_used", query("""
SELECT f.fixture_id, date, 'Club ' || home_team_id AS home, 'Club ' || away_team_id AS away, status,
  coalesce(s.n, 0) AS stints, coalesce(e.n, 0) AS events, 2 AS lineups, coalesce(p.n, 0) AS player_rows
FROM feed_fixtures f LEFT JOIN (SELECT game_id, count(*) AS n FROM fx_stints GROUP BY 1) s ON s.game_id = f.fixture_id
LEFT JOIN (SELECT fixture_id, count(*) AS n FROM feed_ops GROUP BY 1) e ON e.fixture_id = f.fixture_id
LEFT JOIN (SELECT fixture_id, count(*) AS n FROM feed_players GROUP BY 1) p ON p.fixture_id = f.fixture_id""",
                                      "feed_fixtures", "fx_stints", "feed_ops", "feed_players"))
def feed_fixtures_used(spark, d):
    fx, st, ev, li, pl = feed_parts(spark, d)
    return feed.fixtures_used(fx, feed.build_feed_stints(fx, st, ev, li, pl), ev, li, pl)
