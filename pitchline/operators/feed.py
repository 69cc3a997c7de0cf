"""Flat tables from the nested fixture feed, and stints from line-ups and match events.

A player's presence is last-write-wins over the substitutions and cards that name the player, so no per-match fold
is needed: the operations are reduced to one per (fixture, side, player, minute), and the next operation's minute
closes the interval the previous one opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchline.functions import scalars as S
from pitchline.operators.stints import lineups_from_squads, squads
from pitchline.session import materialize

# Output column -> field of the feed's player statistics (the feed spells the last one this way).
PLAYER_METRICS = {
    "goals": "goals.total", "assists": "goals.assists", "shots": "shots.total", "shots_on": "shots.on",
    "key_passes": "passes.key", "passes_total": "passes.total", "tackles_total": "tackles.total",
    "interceptions": "tackles.interceptions", "blocks": "tackles.blocks", "duels_won": "duels.won",
    "dribbles_success": "dribbles.success", "fouls_drawn": "fouls.drawn", "fouls_committed": "fouls.committed",
    "yellow_cards": "cards.yellow", "red_cards": "cards.red", "penalties_scored": "penalty.scored",
    "penalties_missed": "penalty.missed", "penalties_won": "penalty.won", "penalties_committed": "penalty.commited",
}
OPEN = 1_000_000


def finished_fixtures(fixtures: DataFrame) -> DataFrame:
    return fixtures.filter(S.is_finished("fixture.status.short"))


def first_fixtures(fixtures: DataFrame, limit: int | None, per_season: bool = False) -> DataFrame:
    """The first ``limit`` fixtures by date (a missing date first), of each league and season with ``per_season``; no limit when it is
    None or not positive."""
    order = [F.coalesce(F.col("fixture.date"), F.lit("")), F.col("fixture.id")]
    if not limit or limit <= 0:
        return fixtures.orderBy(*order)
    if not per_season:
        return fixtures.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy(F.col("league.id"), F.col("league.season")).orderBy(*order))
    return fixtures.withColumn("__rank", rank).filter(F.col("__rank") <= limit).drop("__rank").orderBy(*order)


def fixture_heads(fixtures: DataFrame) -> DataFrame:
    """Identity, clock and goals of each fixture, typed."""
    return fixtures.select(
        S.safe_int("fixture.id").alias("fixture_id"), S.safe_int("league.id").alias("league_id"),
        S.safe_int("league.season").cast("int").alias("season"), F.col("fixture.date").alias("date"),
        F.col("fixture.status.short").alias("status"), S.safe_int("fixture.status.elapsed").cast("int").alias("elapsed"),
        S.safe_int("teams.home.id").alias("home_team_id"), S.safe_int("teams.away.id").alias("away_team_id"),
        F.col("teams.home.name").alias("home_name"), F.col("teams.away.name").alias("away_name"),
        S.safe_float("goals.home").alias("goals_home"), S.safe_float("goals.away").alias("goals_away"),
    ).filter(F.col("fixture_id").isNotNull())


def flat_events(events: DataFrame) -> DataFrame:
    """Events with their minute (stoppage time added), kind and the ids they name."""
    return events.select(
        "fixture_id", "event_pos", S.event_minute("time.elapsed", "time.extra").alias("minute"),
        S.safe_int("team.id").alias("team_id"), S.safe_int("player.id").alias("player_id"),
        S.safe_int("assist.id").alias("assist_id"), S.feed_event_kind("type", "detail").alias("kind"), "detail")


def starters(lineups: DataFrame) -> DataFrame:
    """Distinct starting players per (fixture, team); the last line-up listed for a team counts."""
    known = lineups.withColumn("team_id", S.safe_int("team.id")).filter(F.col("team_id").isNotNull())
    last = known.groupBy("fixture_id", "team_id").agg(F.max_by("startXI", "lineup_pos").alias("xi"))
    ids = last.select("fixture_id", "team_id", F.explode("xi").alias("p")).select(
        "fixture_id", "team_id", S.safe_int("p.player.id").alias("player_id"))
    return ids.filter(F.col("player_id").isNotNull()).distinct()


def expected_goals(statistics: DataFrame) -> DataFrame:
    """Expected goals per (fixture, team) from the list of (type, value) statistics; teams without one are absent."""
    listed = F.filter("statistics", lambda s: s["type"] == "expected_goals")
    xg = S.safe_float(F.try_element_at(listed, F.lit(-1))["value"])
    known = statistics.select("fixture_id", "stat_pos", S.safe_int("team.id").alias("team_id"), xg.alias("xg")).filter(
        F.col("team_id").isNotNull() & F.col("xg").isNotNull())
    return known.groupBy("fixture_id", "team_id").agg(F.max_by("xg", "stat_pos").alias("xg"))


def statistics_map(statistics: DataFrame) -> DataFrame:
    """All statistics of each team entry as a map from type to value (the last value of a type counts)."""
    last = F.reduce("statistics", F.create_map().cast("map<string,string>"),
                    lambda acc, s: F.map_concat(F.map_filter(acc, lambda k, _: k != s["type"]),
                                                F.create_map(s["type"], s["value"])))
    return statistics.select("fixture_id", F.coalesce(F.col("team.name"), F.lit("Unknown")).alias("team_name"),
                             last.alias("statistics"))


def player_rows(players: DataFrame) -> DataFrame:
    """One row per listed player with 19 numeric metrics, 0 where missing; the first statistics entry counts."""
    listed = players.select("fixture_id", S.safe_int("team.id").alias("team_id"), F.explode("players").alias("p")).select(
        "fixture_id", "team_id", S.safe_int("p.player.id").alias("player_id"), F.col("p.player.name").alias("player"),
        F.get(F.col("p.statistics"), F.lit(0)).alias("s"))
    known = listed.filter(F.col("team_id").isNotNull() & F.col("player_id").isNotNull())
    number = lambda path: F.coalesce(S.safe_float(f"s.{path}"), F.lit(0.0))
    return known.select(
        F.col("fixture_id").alias("game_id"), "team_id", "player_id", "player", number("games.minutes").alias("minutes"),
        F.coalesce(F.nullif(F.col("s.games.position"), F.lit("")), F.lit("UNK")).alias("position"),
        *[number(path).alias(name) for name, path in PLAYER_METRICS.items()])


def feed_match_ends(heads: DataFrame, events: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """Last minute per fixture: at least 90, extended by elapsed time, event minutes and minutes played."""
    last = events.select("fixture_id", F.col("minute").cast("bigint").alias("m"))
    if players is not None:
        minutes = players.select("fixture_id", F.explode("players").alias("p")).select(
            "fixture_id", S.safe_int(F.get(F.col("p.statistics"), F.lit(0))["games"]["minutes"]).alias("m"))
        last = last.unionByName(minutes)
    last = last.groupBy("fixture_id").agg(F.max("m").alias("m"))
    return heads.join(last, "fixture_id", "left").withColumn(
        "match_end", F.greatest(F.lit(90), F.coalesce("elapsed", F.lit(90)), F.coalesce("m", F.lit(90))).cast("int")).drop("m")


def with_side_xg(heads: DataFrame, xg: DataFrame) -> DataFrame:
    """Expected goals of both sides on the fixture row (NULL where the feed gives none)."""
    sides = heads.select("fixture_id", F.explode(F.array(
        F.struct(F.lit("home").alias("side"), F.col("home_team_id").alias("team_id")),
        F.struct(F.lit("away").alias("side"), F.col("away_team_id").alias("team_id")))).alias("s")).select("fixture_id", "s.*")
    per_side = sides.join(xg, ["fixture_id", "team_id"]).groupBy("fixture_id").agg(
        F.max(F.when(F.col("side") == "home", F.col("xg"))).alias("xg_home"),
        F.max(F.when(F.col("side") == "away", F.col("xg"))).alias("xg_away"))
    return heads.join(per_side, "fixture_id", "left")


def event_deltas(events: DataFrame, ends: DataFrame, exclude_details: tuple[str, ...] = ()) -> DataFrame:
    """Goals and sendings-off per (fixture, boundary minute, side); every boundary minute has a row.

    An own goal counts for the other side. ``exclude_details`` names goal details that do not score.
    """
    e = events.filter(F.col("kind").isNotNull()).join(ends, "fixture_id").filter(
        F.col("minute").between(0, F.col("match_end")))
    home = F.col("team_id") == F.col("home_team_id")
    away = F.col("team_id") == F.col("away_team_id")
    own = F.coalesce(F.col("detail") == S.OWN_GOAL, F.lit(False))
    scores = (F.col("kind") == "goal") & ~F.coalesce(F.col("detail").isin(list(exclude_details)), F.lit(False))
    red = F.col("kind") == "red"
    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    told = e.select("fixture_id", "minute", one(scores & ((home & ~own) | (own & ~home))).alias("goals_home"),
                    one(scores & ((away & ~own) | (own & home))).alias("goals_away"),
                    one(red & home).alias("red_home"), one(red & away & ~home).alias("red_away"))
    fixed = ends.select("fixture_id", F.explode(F.array(F.lit(0), F.lit(45), F.col("match_end"))).alias("minute"),
                        *[F.lit(0.0).alias(c) for c in ("goals_home", "goals_away", "red_home", "red_away")])
    return told.unionByName(fixed).groupBy("fixture_id", "minute").agg(
        *[F.sum(c).alias(c) for c in ("goals_home", "goals_away", "red_home", "red_away")])


def presence(starting: DataFrame, events: DataFrame, ends: DataFrame) -> DataFrame:
    """On-pitch intervals per (fixture, side, player) after substitutions and sendings-off."""
    sides = ends.select("fixture_id", "home_team_id", "away_team_id", "match_end")
    side = F.when(F.col("team_id") == F.col("home_team_id"), "home").when(F.col("team_id") == F.col("away_team_id"), "away")
    op = lambda pid, comes, rank: F.struct(F.col(pid).alias("player_id"), F.lit(comes).alias("comes"), F.lit(rank).alias("rank"))
    changes = events.filter(F.col("kind").isin("red", "sub")).select(
        "fixture_id", "team_id", "minute", "event_pos",
        F.explode(F.when(F.col("kind") == "red", F.array(op("player_id", False, 0)))
                  .otherwise(F.array(op("player_id", False, 0), op("assist_id", True, 1)))).alias("o")
    ).select("fixture_id", "team_id", "minute", "event_pos", "o.*").filter(F.col("player_id").isNotNull())
    start = starting.select("fixture_id", "team_id", F.lit(-1).alias("minute"), F.lit(-1).cast("bigint").alias("event_pos"),
                            "player_id", F.lit(True).alias("comes"), F.lit(1).alias("rank"))
    ops = changes.filter(F.col("minute") >= 0).unionByName(start).join(sides, "fixture_id").withColumn("side", side).filter(
        F.col("side").isNotNull() & (F.col("minute") <= F.col("match_end")))
    last = ops.groupBy("fixture_id", "side", "player_id", "minute").agg(
        F.max_by("comes", F.struct("event_pos", "rank")).alias("comes"))
    order = Window.partitionBy("fixture_id", "side", "player_id").orderBy("minute")
    return last.withColumn("end", F.coalesce(F.lead("minute").over(order), F.lit(OPEN))).filter("comes").select(
        "fixture_id", "side", "player_id", F.col("minute").alias("start"), "end")


def build_feed_stints(fixtures: DataFrame, statistics: DataFrame, events: DataFrame, lineups: DataFrame,
                      players: DataFrame | None = None, min_minutes: float = 1.0,
                      exclude_details: tuple[str, ...] = ()) -> DataFrame:
    """Stints of all fixtures from line-ups and events; xG is spread evenly over the match.

    A fixture needs its ids and a starter on either side. ``game_id`` is the fixture id. The flat events and the match
    ends are written once, as several steps read them.
    """
    heads = fixture_heads(fixtures).filter(F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull())
    flat = materialize(flat_events(events), "flat-events")
    ends = with_side_xg(feed_match_ends(heads, flat, players), expected_goals(statistics))
    start = starters(lineups)
    counts = start.join(heads.select("fixture_id", "home_team_id", "away_team_id"), "fixture_id").groupBy("fixture_id").agg(
        F.count_if(F.col("team_id") == F.col("home_team_id")).alias("h"),
        F.count_if(F.col("team_id") == F.col("away_team_id")).alias("a"))
    ends = ends.join(counts.filter((F.col("h") > 0) & (F.col("a") > 0)).select("fixture_id"), "fixture_id", "left_semi")
    ends = materialize(ends, "feed-ends")

    order = Window.partitionBy("fixture_id").orderBy("minute")
    until_now = order.rowsBetween(Window.unboundedPreceding, 0)
    state = lambda c: F.sum(c).over(until_now)
    segments = event_deltas(flat, ends, exclude_details).select(
        "fixture_id", F.col("minute").alias("start"), F.lead("minute").over(order).alias("end"),
        (state("goals_home") - state("goals_away")).alias("score_diff"), state("red_home").alias("red_home"),
        state("red_away").alias("red_away"))
    segments = segments.withColumn("duration", (F.col("end") - F.col("start")).cast("double")).filter(
        F.col("duration") >= min_minutes)
    per_minute = lambda side: F.coalesce(F.col(f"xg_{side}"), F.col(f"goals_{side}"), F.lit(0.0)) / F.greatest(
        F.col("match_end"), F.lit(1))
    segments = segments.join(ends, "fixture_id").select(
        F.col("league_id"), "season", "fixture_id", "start", "end", "duration", "home_team_id", "away_team_id",
        ((per_minute("home") - per_minute("away")) * F.col("duration")).alias("xg_diff"), "score_diff", "red_home", "red_away")
    by_game = squads(presence(start, flat, ends), ["fixture_id"])
    return lineups_from_squads(segments, by_game, ["fixture_id"]).withColumnRenamed("fixture_id", "game_id")


def fixture_records(fixtures: DataFrame, statistics: DataFrame, is_live: bool) -> DataFrame:
    """State row of each fixture: identity, clock, goals, xG per side, live and finished flags."""
    return with_side_xg(fixture_heads(fixtures), expected_goals(statistics)).select(
        "*", F.lit(is_live).alias("is_live"), S.is_finished("status").alias("is_finished"),
        S.utc_now_second().alias("last_synced_at"))


def fixtures_used(fixtures: DataFrame, stints: DataFrame, events: DataFrame, lineups: DataFrame,
                  players: DataFrame) -> DataFrame:
    """Audit row per fixture: how many stints, events, line-ups and player rows it has."""
    heads = fixture_heads(fixtures).select(
        "fixture_id", "date", F.col("home_name").alias("home"), F.col("away_name").alias("away"), "status")
    out = heads
    parts = (("stints", stints.withColumnRenamed("game_id", "fixture_id")), ("events", events), ("lineups", lineups),
             ("player_rows", player_rows(players).withColumnRenamed("game_id", "fixture_id")))
    for name, part in parts:
        out = out.join(part.groupBy("fixture_id").agg(F.count(F.lit(1)).alias(name)), "fixture_id", "left")
    return out.fillna(0, [name for name, _ in parts])
