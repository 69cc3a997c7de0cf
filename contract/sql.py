"""DuckDB form of the bindings in ``contract.tables``, as named common table expressions."""

from __future__ import annotations

# name -> (names it reads, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def query(body: str, *needs: str) -> str:
    """``body`` preceded by the expressions it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    prefix = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {prefix}\n{body}" if order else body


cte("shots", """
  SELECT league, year || '_' || (year + 1) AS season, game_id, h_a, home_team_id, away_team_id, team_id,
    team_id * 1000 + slot AS player_id, 'Player ' || (team_id * 1000 + slot) AS player, minute, xg, result, situation,
    h_goals, a_goals, last_action, shot_type, 'Team ' || home_team_id AS h_team, 'Team ' || away_team_id AS a_team
  FROM (
    SELECT *, CASE WHEN h_a = 'h' THEN home_team_id ELSE away_team_id END AS team_id
    FROM (
      SELECT 'L' || ((l_orderkey // 2280) % 5) AS league, 1990 + l_orderkey // 11400 AS year, l_orderkey // 6 AS game_id,
        CASE WHEN l_linestatus = 'O' THEN 'h' ELSE 'a' END AS h_a,
        ((l_orderkey // 2280) % 5) * 20 + ((l_orderkey // 6) % 380) % 20 AS home_team_id,
        ((l_orderkey // 2280) % 5) * 20
          + (((l_orderkey // 6) % 380) + 1 + (((l_orderkey // 6) % 380) // 20) % 19) % 20 AS away_team_id,
        (l_suppkey + l_partkey) % 15 AS slot, CAST((l_partkey * 7 + l_linenumber * 5) % 96 AS INTEGER) AS minute,
        (l_discount * 8 + 0.01) * 0.987654321::DOUBLE AS xg,
        CASE WHEN l_returnflag = 'R' AND l_linenumber <= 2 THEN 'Goal' ELSE 'MissedShots' END AS result,
        'S' || (l_linenumber % 5) AS situation, CAST(l_quantity AS INTEGER) % 7 AS h_goals,
        CAST(l_partkey % 7 AS INTEGER) AS a_goals,
        CASE l_partkey % 4 WHEN 1 THEN 'Pass' WHEN 2 THEN 'Cross' WHEN 3 THEN 'Rebound' END AS last_action,
        CASE l_suppkey % 3 WHEN 0 THEN 'Head' WHEN 1 THEN 'LeftFoot' ELSE 'RightFoot' END AS shot_type
      FROM lineitem))""")

cte("labelled", """
  SELECT *, CASE WHEN result = 'Goal' THEN 1 ELSE 0 END AS result_boolean,
    CASE WHEN minute <= 15 THEN '0-15' WHEN minute <= 30 THEN '15-30' WHEN minute <= 45 THEN '30-45'
         WHEN minute <= 60 THEN '45-60' WHEN minute <= 75 THEN '60-75' ELSE '75-90+' END AS period,
    CASE WHEN d > 0 THEN 'leading' WHEN d < 0 THEN 'trailing' ELSE 'tie' END AS game_state,
    CASE WHEN d <= -4 THEN '-4-' WHEN d >= 4 THEN '4+' ELSE CAST(d AS VARCHAR) END AS goal_diff,
    CASE WHEN h_a = 'h' THEN h_team ELSE a_team END AS kicker_team,
    CASE WHEN h_a = 'h' THEN a_team ELSE h_team END AS conceded_team
  FROM (SELECT *, CASE WHEN h_a = 'h' THEN h_goals - a_goals ELSE a_goals - h_goals END AS d FROM shots)""", "shots")

cte("schedule", "SELECT DISTINCT league, season, game_id, home_team_id, away_team_id FROM shots", "shots")

cte("appearances", """
  SELECT league, season, game_id, team_id, h_a, player_id, player,
    CASE WHEN player_id % 1000 >= 11 THEN 'Sub' WHEN player_id % 4 = 0 THEN 'GK' WHEN player_id % 4 = 1 THEN 'DF'
         WHEN player_id % 4 = 2 THEN 'MF' ELSE 'FW' END AS position,
    CAST(CASE WHEN player_id % 1000 >= 11 THEN 5 + sm % 40 WHEN player_id % 1000 < 7 THEN 90 ELSE 45 + sm % 46 END AS DOUBLE)
      AS minutes,
    CAST(ng AS DOUBLE) AS goals, CASE WHEN sm % 53 = 0 THEN 1.0::DOUBLE ELSE 0 END AS own_goals,
    CAST(n AS DOUBLE) AS shots, sx AS xg, sx * 1.5::DOUBLE AS xg_chain, (sm % 10) / 10.0::DOUBLE AS xg_buildup,
    CASE WHEN sm % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END AS assists, (sm % 13) / 20.0::DOUBLE AS xa,
    CAST(sm % 5 AS DOUBLE) AS key_passes, CASE WHEN sm % 7 = 0 THEN 1.0::DOUBLE ELSE 0 END AS yellow_cards,
    CASE WHEN sm % 41 = 0 THEN 1.0::DOUBLE ELSE 0 END AS red_cards
  FROM (SELECT league, season, game_id, team_id, h_a, player_id, player, CAST(sum(minute) AS BIGINT) AS sm, count(*) AS n,
          sum(xg) AS sx, count(*) FILTER (result = 'Goal') AS ng
        FROM shots GROUP BY ALL)""", "shots")

cte("player_seasons", """
  SELECT player_id, 'Player ' || player_id AS player,
    CASE player_id % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DF' WHEN 2 THEN 'MF' ELSE 'FW' END AS position, minutes,
    'L' || ((player_id * 7 + (year - 1995) * (player_id % 3)) % 5) AS league, year || '_' || (year + 1) AS season, epm, year
  FROM (SELECT l_suppkey AS player_id, year(o_orderdate) AS year, CAST(count(*) * 20 AS DOUBLE) AS minutes,
          sum((l_discount - 0.05) * l_quantity) / 10 AS epm
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)""")

cte("feed", """
  SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + (user_id // 50) * 30 AS fixture_id, user_id // 50 AS block,
    user_id, user_id % 2 AS side,
    CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 900) AS INTEGER) AS minute,
    event_id, event_type, value
  FROM events""")

cte("feed_ops", """
  SELECT fixture_id, block, event_id, minute, side, block * 2 + side AS team_id,
    CASE WHEN event_id % 29 <> 0 THEN user_id END AS player_id,
    CASE WHEN event_type = 'signup' THEN (user_id % 50 + 30) % 50 + block * 50 END AS assist_id,
    CASE WHEN event_type = 'purchase' THEN 'goal' WHEN event_type = 'error' AND event_id % 5 <= 1 THEN 'red'
         WHEN event_type = 'signup' THEN 'sub' END AS kind,
    event_type = 'purchase' AND event_id % 17 = 0 AS own_goal
  FROM feed""", "feed")

cte("feed_players", """
  SELECT fixture_id, block, block * 2 + side AS team_id, user_id AS player_id, 'User ' || user_id AS player, e, n, g,
    e % 23 <> 0 AS has_stats
  FROM (SELECT fixture_id, block, side, user_id, CAST(count(*) AS INTEGER) AS n, min(event_id) AS e,
          CAST(count(*) FILTER (event_type = 'purchase') AS INTEGER) AS g
        FROM feed GROUP BY ALL)""", "feed")

cte("player_rows", """
  SELECT fixture_id AS game_id, team_id, player_id, player, CASE WHEN has_stats THEN CAST(20 + (e * 13) % 71 AS DOUBLE) ELSE 0 END AS minutes,
    CASE WHEN has_stats AND e % 6 > 0 THEN CASE player_id % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'D' WHEN 2 THEN 'M' ELSE 'F' END
         ELSE 'UNK' END AS position,
    s * g AS goals, s * (e % 2) AS assists, s * (n + 1) AS shots, CASE WHEN e % 2 = 0 THEN s * n ELSE 0 END AS shots_on,
    s * (e % 5) AS key_passes, s * (20 + e % 30) AS passes_total, s * (e % 6) AS tackles_total, s * (e % 3) AS interceptions,
    s * (e % 4) AS blocks, s * (e % 9) AS duels_won, s * (e % 7) AS dribbles_success, s * (e % 3) AS fouls_drawn,
    s * (e % 4) AS fouls_committed, s * (e % 2) AS yellow_cards, CASE WHEN e % 31 = 0 THEN s ELSE 0 END AS red_cards,
    s * (e % 2) AS penalties_scored, s * 0 AS penalties_missed, s * (e % 3) AS penalties_won, s * (e % 2) AS penalties_committed
  FROM (SELECT *, CASE WHEN has_stats THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM feed_players)""", "feed_players")

cte("feed_fixtures", """
  SELECT fixture_id, block, block * 2 AS home_team_id, block * 2 + 1 AS away_team_id,
    CAST(DATE '2024-01-01' + CAST(fixture_id % 30 AS INTEGER) AS VARCHAR) || 'T00:00:00+00:00' AS date,
    CASE fixture_id % 4 WHEN 0 THEN 'FT' WHEN 1 THEN 'AET' WHEN 2 THEN 'PEN' ELSE '2H' END AS status,
    CASE WHEN fixture_id % 3 = 0 THEN 90 + fixture_id % 7 END AS elapsed, block % 5 AS league_id, 2024 AS season,
    count(*) FILTER (event_type = 'purchase' AND side = 0) AS goals_home,
    count(*) FILTER (event_type = 'purchase' AND side = 1) AS goals_away
  FROM feed GROUP BY fixture_id, block""", "feed")

cte("feed_xg", """
  SELECT fixture_id, block * 2 + side AS team_id,
    CASE WHEN fixture_id % 7 = 0 OR fixture_id % 11 = 0 THEN NULL ELSE round(sum(value) / 1000, 5) END AS xg
  FROM feed GROUP BY fixture_id, block, side""", "feed")
