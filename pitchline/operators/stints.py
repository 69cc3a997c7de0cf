"""Stints from minutes played and shots: match segments with constant line-ups.

All games are cut in one plan. Every shot minute is itself a boundary, so the xG of a stint is the xG at its first
minute, and score and cards at its start are running sums over earlier boundaries. Shots and cards are summed per
(game, team, minute) before anything is ordered, so a game that holds most of the rows still enters its window as
one row per minute.

Games meet by the last key first (``narrowing``): a sort compares rows by the first bytes of its first column, and a league or
season is the same in very many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchline.functions import scalars as S
from pitchline.session import materialize, shuffles_freed

GAME = ("league", "season", "game_id")
DELTAS = ("xg_home", "xg_away", "goals_home", "goals_away", "red_home", "red_away")


def narrowing(game: Sequence[str]) -> list[str]:
    """The keys of a game in the order in which they are hashed and sorted: the one that tells most games apart first."""
    return list(game)[::-1]


def shots_by_minute(shots: DataFrame, game: Sequence[str] = GAME) -> DataFrame:
    """xG and goals per (game, team, minute); the goal test ignores case."""
    known = shots.filter(F.col("minute").isNotNull())
    summed = known.groupBy(*narrowing(game), "team_id", F.col("minute").cast("int").alias("minute")).agg(
        F.sum("xg").alias("xg"), F.count_if(S.is_goal_result("result", any_case=True)).alias("goals"))
    return summed.select(*game, "team_id", "minute", "xg", "goals")


def match_ends(schedule: DataFrame, players: DataFrame, by_minute: DataFrame, game: Sequence[str] = GAME) -> DataFrame:
    """Last minute per scheduled game: at least 90, extended by minutes played and shot minutes."""
    last = players.select(*game, F.col("minutes").cast("int").alias("m")).unionByName(
        by_minute.select(*game, F.col("minute").alias("m")))
    last = last.groupBy(*narrowing(game)).agg(F.max("m").alias("m"))
    return schedule.join(last, narrowing(game), "left").select(
        *game, "home_team_id", "away_team_id", F.greatest(F.lit(90), F.coalesce("m", F.lit(90))).alias("match_end"))


def side_of(team: Column | str = "team_id") -> Column:
    of = F.col(team) if isinstance(team, str) else team
    return F.when(of == F.col("home_team_id"), "home").when(of == F.col("away_team_id"), "away")


def player_intervals(players: DataFrame, ends: DataFrame, game: Sequence[str] = GAME) -> DataFrame:
    """On-pitch interval per appearance: substitutes play the end of the match, the others its beginning."""
    known = players.filter(F.col("minutes") > 0).join(ends, narrowing(game))
    start, stop = _from_to(F.lower("position") == "sub", F.col("minutes"))
    cut = known.select(*game, "team_id", "player_id", side_of().alias("side"), start.alias("start"), stop.alias("end"),
                       F.col("red_cards").cast("int").alias("red_cards"))
    return cut.filter(F.col("end") > F.col("start"))


def _from_to(sub: Column, minutes: Column) -> tuple[Column, Column]:
    end = F.col("match_end").cast("double")
    start = F.when(sub, F.greatest(F.lit(0.0), end - minutes)).otherwise(F.lit(0.0))
    stop = F.when(sub, end).otherwise(F.least(end, minutes))
    return F.bround(start).cast("int"), F.bround(stop).cast("int")


def squads_of_games(schedule: DataFrame, players: DataFrame, by_minute: DataFrame, game: Sequence[str] = GAME) -> DataFrame:
    """The rows of ``match_ends`` with the ``player_intervals`` of the game as an array: appearances meet by game once, and are as
    many as a squad lists."""
    keys = narrowing(game)
    listed = F.when(F.col("minutes") > 0, F.struct(
        "team_id", "player_id", "minutes", (F.lower("position") == "sub").alias("sub"), F.col("red_cards").cast("int").alias("red_cards")))
    by_game = players.groupBy(*keys).agg(F.max(F.col("minutes").cast("int")).alias("__played"), F.collect_list(listed).alias("__listed"))
    last = by_minute.groupBy(*keys).agg(F.max("minute").alias("__shot"))
    ends = schedule.join(by_game, keys, "left").join(last, keys, "left").withColumn(
        "match_end", F.greatest(F.lit(90), F.coalesce(F.greatest("__played", "__shot"), F.lit(90))))

    def cut(p: Column) -> Column:
        start, stop = _from_to(p["sub"], p["minutes"])
        return F.struct(side_of(p["team_id"]).alias("side"), p["player_id"].alias("player_id"), start.alias("start"), stop.alias("end"),
                        p["red_cards"].alias("red_cards"))

    known = F.coalesce("__listed", F.array().cast(by_game.schema["__listed"].dataType))
    return ends.select(*game, "home_team_id", "away_team_id", "match_end",
                       F.filter(F.transform(known, cut), lambda p: p["end"] > p["start"]).alias("intervals"))


def red_cards_by_minute(intervals: DataFrame, game: Sequence[str] = GAME) -> DataFrame:
    """Sent-off players per (game, side, minute): one per carded player, at the end of the player's interval."""
    counted = intervals.filter(F.col("red_cards") > 0).groupBy(*narrowing(game), "side", F.col("end").alias("minute")).agg(
        F.count(F.lit(1)).alias("reds"))
    return counted.select(*game, "side", "minute", "reds")


def _shot_deltas(ends: DataFrame, by_minute: DataFrame, game: Sequence[str]) -> DataFrame:
    at = lambda side, c: F.when(F.col("side") == side, F.col(c)).otherwise(F.lit(0)).cast("double")
    zero = F.lit(0.0)
    return by_minute.join(ends, narrowing(game)).withColumn("side", side_of()).filter(
        F.col("minute").between(0, F.col("match_end"))).select(
        *game, "minute", at("home", "xg").alias("xg_home"), at("away", "xg").alias("xg_away"),
        at("home", "goals").alias("goals_home"), at("away", "goals").alias("goals_away"),
        zero.alias("red_home"), zero.alias("red_away"))


def _summed(deltas: DataFrame, game: Sequence[str]) -> DataFrame:
    dealt = deltas.repartition(*narrowing(game))       # of a minute few rows are left: they meet where the window needs them
    summed = dealt.groupBy(*narrowing(game), "minute").agg(*[F.sum(c).alias(c) for c in DELTAS])
    return summed.select(*game, "minute", *DELTAS)


def boundary_deltas(ends: DataFrame, intervals: DataFrame, by_minute: DataFrame, game: Sequence[str] = GAME) -> DataFrame:
    """One row per (game, boundary minute) with what happens at that minute on either side."""
    at = lambda side, c: F.when(F.col("side") == side, F.col(c)).otherwise(F.lit(0)).cast("double")
    zero = F.lit(0.0)
    carded = F.col("red_cards") > 0
    marks = intervals.select(*game, "side", F.explode(F.array(
        F.struct(F.col("start").alias("minute"), zero.alias("red")),
        F.struct(F.col("end").alias("minute"), carded.cast("double").alias("red")))).alias("b"))
    marks = marks.select(*game, F.col("b.minute").alias("minute"), *[zero.alias(c) for c in DELTAS[:4]],
                         at("home", "b.red").alias("red_home"), at("away", "b.red").alias("red_away"))
    fixed = ends.select(*game, F.explode(F.array(F.lit(0), F.lit(45), F.col("match_end"))).alias("minute"),
                        *[zero.alias(c) for c in DELTAS])
    return _summed(_shot_deltas(ends, by_minute, game).unionByName(marks).unionByName(fixed), game)


def boundary_deltas_of_squads(squads: DataFrame, by_minute: DataFrame, game: Sequence[str] = GAME) -> DataFrame:
    """``boundary_deltas`` from the rows of ``squads_of_games``: a game's minutes without a card are told apart inside its row."""
    zero, red = F.lit(0.0), lambda p, side: F.when(p["side"] == side, 1.0).otherwise(0.0)
    minutes = F.array_distinct(F.concat(
        F.transform("intervals", lambda p: p["start"]), F.transform("intervals", lambda p: p["end"]), F.array(F.lit(0), F.lit(45), F.col("match_end"))))
    plain = F.transform(minutes, lambda m: F.struct(m.alias("minute"), zero.alias("home"), zero.alias("away")))
    cards = F.transform(F.filter("intervals", lambda p: p["red_cards"] > 0), lambda p: F.struct(
        p["end"].alias("minute"), red(p, "home").alias("home"), red(p, "away").alias("away")))
    marks = squads.select(*game, F.explode(F.concat(plain, cards)).alias("b")).select(
        *game, "b.minute", *[zero.alias(c) for c in DELTAS[:4]], F.col("b.home").alias("red_home"), F.col("b.away").alias("red_away"))
    return _summed(_shot_deltas(squads.drop("intervals"), by_minute, game).unionByName(marks), game)


def cut_stints(ends: DataFrame, deltas: DataFrame, min_minutes: float = 1.0, game: Sequence[str] = GAME) -> DataFrame:
    """Consecutive boundary pairs with their xG difference and the score and cards at their start.

    A segment shorter than ``min_minutes`` is dropped; the next one still starts where it ended.
    """
    order = Window.partitionBy(*narrowing(game)).orderBy("minute")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    segments = deltas.select(
        *game, F.col("minute").alias("start"), F.lead("minute").over(order).alias("end"),
        (F.col("xg_home") - F.col("xg_away")).alias("xg_diff"),
        so_far(F.col("goals_home") - F.col("goals_away")).alias("score_diff"),
        so_far("red_home").alias("red_home"), so_far("red_away").alias("red_away"))
    kept = segments.withColumn("duration", (F.col("end") - F.col("start")).cast("double")).filter(
        F.col("duration") >= min_minutes)
    sides = ends.drop("match_end")
    return kept.join(sides, narrowing(game)).select(*kept.columns, *[c for c in sides.columns if c not in game])


def on_pitch(segments: DataFrame, intervals: DataFrame, game: Sequence[str] = GAME) -> DataFrame:
    """Which players cover which segment: equi-join on the game, containment as the residual condition.

    Long form, one row per (segment, player); ``sign`` is +1 for home and -1 for away.
    """
    p = intervals.filter(F.col("side").isNotNull()).select(
        *game, "side", "player_id", F.col("start").alias("__from"), F.col("end").alias("__to"))
    covered = segments.join(p, narrowing(game)).filter((F.col("__from") <= F.col("start")) & (F.col("__to") >= F.col("end")))
    return covered.select(*segments.columns, "player_id", F.when(F.col("side") == "home", 1.0).otherwise(-1.0).alias("sign"))


def squads(intervals: DataFrame, game: Sequence[str] = GAME) -> DataFrame:
    """One row per game with the intervals of both sides as arrays ordered by player: as long as a squad list."""
    of = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("player_id", "start", "end"))))
    gathered = intervals.groupBy(*narrowing(game)).agg(of("home").alias("home_squad"), of("away").alias("away_squad"))
    return gathered.select(*game, "home_squad", "away_squad")


def lineups_from_squads(segments: DataFrame, by_game: DataFrame, game: Sequence[str] = GAME) -> DataFrame:
    """Segments with both line-ups as sorted id arrays, picked from the squads of the game inside the row; both need a player."""
    def standing(squad: str):
        inside = F.filter(squad, lambda p: (p["start"] <= F.col("start")) & (p["end"] >= F.col("end")))
        return F.transform(inside, lambda p: p["player_id"])

    both = segments.join(by_game, narrowing(game)).select(
        *segments.columns, standing("home_squad").alias("home_players"), standing("away_squad").alias("away_players"))
    return both.filter((F.size("home_players") > 0) & (F.size("away_players") > 0))


def lineup_spans(squads: DataFrame, game: Sequence[str] = GAME) -> DataFrame:
    """Spans ``from`` to ``to`` of a game between the minutes at which anyone comes or goes, with both line-ups as sorted id arrays; both
    need a player. A game has a few of them, whatever happens in between."""
    keys = narrowing(game)
    by_game = squads.groupBy(*keys).agg(F.flatten(F.collect_list("intervals")).alias("__all"))
    of = lambda side: F.sort_array(F.transform(F.filter("__all", lambda p: p["side"] == side),
                                               lambda p: F.struct(p["player_id"].alias("player_id"), p["start"].alias("start"), p["end"].alias("end"))))
    minutes = F.array_sort(F.array_distinct(F.concat(F.transform("__all", lambda p: p["start"]), F.transform("__all", lambda p: p["end"]))))
    cut = by_game.select(*game, of("home").alias("__home"), of("away").alias("__away"), minutes.alias("__at"))

    def span(start: Column, i: Column) -> Column:
        end = F.get("__at", i + 1)
        standing = lambda squad: F.transform(F.filter(squad, lambda p: (p["start"] <= start) & (p["end"] >= end)), lambda p: p["player_id"])
        return F.struct(start.alias("from"), end.alias("to"), standing("__home").alias("home"), standing("__away").alias("away"))

    spans = F.filter(F.transform("__at", span), lambda s: (F.size(s["home"]) > 0) & (F.size(s["away"]) > 0))
    return cut.select(*game, F.explode(spans).alias("s")).select(
        *game, "s.from", "s.to", F.col("s.home").alias("home_players"), F.col("s.away").alias("away_players"))


def lineups_from_spans(segments: DataFrame, spans: DataFrame, game: Sequence[str] = GAME) -> DataFrame:
    """Segments with the line-ups of the span they lie in. A segment must not go on over a minute at which anyone comes or goes, as
    those of ``cut_stints`` don't."""
    inside = segments.join(spans, narrowing(game)).filter((F.col("from") <= F.col("start")) & (F.col("to") >= F.col("end")))
    return inside.select(*segments.columns, "home_players", "away_players")


def build_stints(schedule: DataFrame, players: DataFrame, shots: DataFrame, min_minutes: float = 1.0,
                 game: Sequence[str] = GAME) -> DataFrame:
    """Stints of all games from schedule, appearances and shots.

    Narrow tables that are read by several later steps are written once (each step would prune a different set of columns
    and so scan its source again): xG per minute, and a row per game with the intervals of its squads. Shots and appearances are
    scanned once.
    """
    with shuffles_freed(shots.sparkSession):
        by_minute = materialize(shots_by_minute(shots, game), "by-minute")
        squads = materialize(squads_of_games(schedule, players, by_minute, game), "squads")
    segments = cut_stints(squads.drop("intervals"), boundary_deltas_of_squads(squads, by_minute, game), min_minutes, game)
    return lineups_from_spans(segments, lineup_spans(squads, game), game)


def with_stint_index(stints: DataFrame, game: Sequence[str] = GAME) -> DataFrame:
    order = Window.partitionBy(*narrowing(game)).orderBy("start")
    return stints.withColumn("stint_index", F.row_number().over(order) - 1)
