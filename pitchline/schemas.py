"""Declared schemas of everything that is read from files."""

from __future__ import annotations

SCHEDULE = "game_id bigint, home_team_id bigint, away_team_id bigint"
PLAYER_MATCH = (
    "game_id bigint, player_id bigint, player string, team_id bigint, position string, minutes double, goals double, "
    "own_goals double, shots double, xg double, xg_chain double, xg_buildup double, assists double, xa double, "
    "key_passes double, yellow_cards double, red_cards double")
SHOT_EVENTS = "game_id bigint, team_id bigint, minute double, xg double, result string"
RATING = "player_id bigint, player string, position string, minutes double, league string, season string"

_SHOT = ("struct<player_id: string, player: string, minute: string, X: string, Y: string, xG: string, h_goals: string, "
         "a_goals: string, result: string, situation: string, h_a: string, h_team: string, a_team: string, match_id: string, "
         "lastAction: string, shotType: string>")
_APPEARANCE = ("struct<player_id: string, player: string, team_id: string, h_a: string, xG: string, time: string, goals: string, "
               "own_goals: string, shots: string>")
MATCH_DOCUMENT = (
    f"match_id string, shotsData struct<h: array<{_SHOT}>, a: array<{_SHOT}>>, "
    f"rostersData struct<h: map<string, {_APPEARANCE}>, a: map<string, {_APPEARANCE}>>, timelineData string, _corrupt_record string")

FIXTURE = (
    "fixture struct<id: bigint, date: string, status: struct<short: string, elapsed: int>>, "
    "teams struct<home: struct<id: bigint, name: string>, away: struct<id: bigint, name: string>>, "
    "goals struct<home: double, away: double>, league struct<id: bigint, season: int, name: string, round: string>")
EVENT = (
    "struct<time: struct<elapsed: int, extra: int>, team: struct<id: bigint, name: string>, player: struct<id: bigint>, "
    "assist: struct<id: bigint>, type: string, detail: string, xg: double, expected_goals: double>")
LINEUP = "struct<team: struct<id: bigint>, startXI: array<struct<player: struct<id: bigint>>>>"
STATISTIC = "struct<team: struct<id: bigint, name: string>, statistics: array<struct<type: string, value: string>>>"
_STATS = (
    "struct<games: struct<minutes: int, position: string>, shots: struct<total: int, on: int>, goals: struct<total: int, assists: int>, "
    "passes: struct<key: int, total: int>, tackles: struct<total: int, interceptions: int, blocks: int>, duels: struct<won: int>, "
    "dribbles: struct<success: int>, fouls: struct<drawn: int, committed: int>, cards: struct<yellow: int, red: int>, "
    "penalty: struct<scored: int, missed: int, won: int, commited: int>>")
PLAYERS = f"struct<team: struct<id: bigint>, players: array<struct<player: struct<id: bigint, name: string>, statistics: array<{_STATS}>>>>"
LEAGUE = ("struct<league: struct<id: bigint, name: string>, country: struct<name: string>, "
          "seasons: array<struct<year: int, current: boolean, coverage: string>>>")
ENDPOINTS = {"events": EVENT, "lineups": LINEUP, "players": PLAYERS, "statistics": STATISTIC}

# One document per poll: the time of the poll and every fixture with its lists.
_BUNDLE = "struct<" + FIXTURE.replace("fixture struct", "fixture: struct").replace(" teams struct", " teams: struct").replace(
    " goals struct", " goals: struct").replace(" league struct", " league: struct") + (
    f", events: array<{EVENT}>, lineups: array<{LINEUP}>, players: array<{PLAYERS}>, statistics: array<{STATISTIC}>>")
POLL = f"polled_at string, response array<{_BUNDLE}>"

# Summed metrics of the feed form.
FEED_METRICS = (
    "goals", "assists", "shots", "shots_on", "key_passes", "passes_total", "tackles_total", "interceptions",
    "blocks", "duels_won", "dribbles_success", "fouls_drawn", "fouls_committed", "yellow_cards", "red_cards",
    "penalties_scored", "penalties_missed", "penalties_won", "penalties_committed",
)
STATE_FIXTURES = (
    "fixture_id bigint, date string, status string, elapsed int, home_team_id bigint, away_team_id bigint, home_name string, "
    "away_name string, goals_home double, goals_away double, xg_home double, xg_away double, is_live boolean, is_finished boolean, "
    "last_synced_at timestamp, league_id bigint, season int")
STATE_STINTS = (
    "fixture_id bigint, stint_index int, start_minute int, end_minute int, duration double, home_team_id bigint, away_team_id bigint, "
    "home_players array<bigint>, away_players array<bigint>, xg_diff double, score_diff double, red_home double, red_away double, "
    "is_live boolean, league_id bigint, season int")
STATE_PLAYERS = ("fixture_id bigint, team_id bigint, player_id bigint, player string, minutes double, position string, "
                 + ", ".join(f"{m} double" for m in FEED_METRICS) + ", league_id bigint, season int")
