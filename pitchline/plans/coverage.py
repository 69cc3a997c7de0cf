"""What a fixture feed delivers, per fixture: which ratings its events, line-ups and statistics can support."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchline.functions import scalars as S
from pitchline.session import materialize

# Fixed value: the round a sample fixture is taken from.
FIRST_ROUND = "Regular Season - 1"


def league_seasons(leagues: DataFrame) -> DataFrame:
    """Current season per league: the first one flagged current, else the last listed."""
    return leagues.select(F.col("league.id").alias("league_id"), F.col("league.name").alias("league_name"),
                          F.col("country.name").alias("country"), S.current_season("seasons").alias("current_season"))


def pick_fixtures(current: DataFrame, fixtures: DataFrame, round_name: str = FIRST_ROUND, back: int = 3) -> DataFrame:
    """First fixture of the opening round in the latest of the current and the ``back`` preceding seasons that has one.

    ``fixtures`` has league_id, season, round, fixture_id and position.
    """
    opening = fixtures.filter(F.col("round") == round_name).join(current, "league_id").filter(
        F.col("season").between(F.col("current_season") - back, F.col("current_season")))
    return opening.groupBy("league_id").agg(
        F.max_by(F.struct("season", "fixture_id"), F.struct(F.col("season"), -F.col("position"))).alias("s")
    ).select("league_id", F.col("s.season").alias("season_used"), F.col("s.fixture_id").alias("fixture_id"))


def season_coverage(leagues: DataFrame, picked: DataFrame) -> DataFrame:
    """Coverage record of the season a league's sample fixture was taken from."""
    listed = leagues.select(F.col("league.id").alias("league_id"), F.explode("seasons").alias("s"))
    return picked.join(listed.select("league_id", F.col("s.year").alias("season_used"), F.col("s.coverage").alias("coverage")),
                       ["league_id", "season_used"])


def sample_events(events: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` events of every fixture in feed order (a per-fixture top-k, cut before the shuffle)."""
    order = Window.partitionBy("fixture_id").orderBy("event_pos")
    first = events.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return first.select("fixture_id", "rank", F.col("time.elapsed").alias("minute"), F.col("team.name").alias("team"),
                        F.col("player.id").alias("player_id"), "type", "detail")


def stat_fields(players: DataFrame) -> DataFrame:
    """Sorted field names of the first listed player's first statistics entry per fixture.

    With ``players`` as delivered (a VARIANT, see ``read_delivered_players``) these are the names the feed sends, those with a null
    and those no schema knows included; of typed rows they are the declared ones that hold something.
    """
    order = "block_pos" if "block_pos" in players.columns else "team.id"
    if dict(players.dtypes)["players"] == "variant":
        at = lambda path, kind: F.try_variant_get("players", f"$[0]{path}", kind)
        first = players.filter(at("", "variant").isNotNull()).select(
            "fixture_id", F.col(order).alias("__o"), at(".player.id", "bigint").alias("__id"), F.to_json(at(".statistics[0]", "variant")).alias("__s"))
    else:
        p = F.get("players", F.lit(0))
        first = players.filter(F.size("players") > 0).select(
            "fixture_id", F.col(order).alias("__o"), p["player"]["id"].alias("__id"), F.to_json(F.get(p["statistics"], F.lit(0))).alias("__s"))
    listed = first.withColumn("__k", F.coalesce(F.array_sort(F.json_object_keys("__s")), F.array().cast("array<string>")))
    return listed.groupBy("fixture_id").agg(F.min_by("__k", F.struct("__o", "__id")).alias("player_stat_fields"))


def variant_fields(payloads: DataFrame, value: str, keys: Sequence[str], depth: int = 2) -> DataFrame:
    """Which fields the VARIANT payloads of a group have: ``keys``, ``field`` (a path for members of objects) and ``kind``, all kinds met.

    Members are taken apart by a lateral join, ``depth`` levels down, and summed up before anything moves. A decimal is DECIMAL whatever its
    width; a JSON null counts as VOID only where the field never holds anything else. A payload that is null or no object has no fields.
    """
    tvf, level, parts = payloads.sparkSession.tvf, payloads.select(*keys, F.col(value).alias("v"), F.lit("").alias("path")), []
    for _ in range(depth):
        members = level.lateralJoin(tvf.variant_explode(F.col("v").outer())).filter("key is not null")
        named = members.select(*keys, F.concat("path", "key").alias("field"), F.col("value").alias("v"),
                               F.regexp_extract(F.schema_of_variant("value"), r"^[A-Z]+", 0).alias("kind"))
        parts.append(named.select(*keys, "field", "kind").distinct())
        level = named.filter("kind = 'OBJECT'").select(*keys, "v", F.concat("field", F.lit(".")).alias("path"))
    every = reduce(DataFrame.unionByName, parts)
    known = F.array_sort(F.collect_set(F.when(F.col("kind") != "VOID", F.col("kind"))))
    return every.groupBy(*keys, "field").agg(known.alias("k")).select(
        *keys, "field", F.when(F.size("k") > 0, F.array_join("k", "|")).otherwise("VOID").alias("kind"))


def schema_drift(payloads: DataFrame, value: str, by: Sequence[str], time: str, depth: int = 2) -> DataFrame:
    """Fields of VARIANT payloads per group and step of ``time`` against the step before it that the group has: ``field``, ``kind``,
    ``state`` (appeared, changed, kept, vanished; all appear at the first step) and ``earlier``, the kind before."""
    by = list(by)
    found = materialize(variant_fields(payloads, value, [*by, time], depth), "fields")
    window = Window.partitionBy(*by).orderBy(time) if by else Window.orderBy(time)
    steps = found.select(*by, time).distinct().withColumn("__before", F.lag(time).over(window))
    before = found.withColumnsRenamed({time: "__before", "kind": "earlier"})
    now = found.join(steps, [*by, time]).join(before, [*by, "__before", "field"], "left")
    state = F.when(F.col("earlier").isNull(), "appeared").when(F.col("earlier") != F.col("kind"), "changed").otherwise("kept")
    gone = before.join(steps, [*by, "__before"]).join(found.select(*by, time, "field"), [*by, time, "field"], "left_anti")
    return now.select(*by, time, "field", "kind", state.alias("state"), "earlier").unionByName(gone.select(
        *by, time, "field", F.lit(None).cast("string").alias("kind"), F.lit("vanished").alias("state"), "earlier"))


def expected_goals_by_team(statistics: DataFrame) -> DataFrame:
    """Teams whose statistics list expected goals, with the value as delivered (it may be NULL)."""
    listed = F.filter("statistics", lambda s: s["type"] == "expected_goals")
    return statistics.filter(F.size(listed) > 0).select(
        "fixture_id", F.coalesce(F.col("team.name"), F.lit("Unknown")).alias("team"),
        F.try_element_at(listed, F.lit(-1))["value"].alias("expected_goals"))


def feed_support(fixtures: DataFrame, events: DataFrame, lineups: DataFrame, players: DataFrame,
                 statistics: DataFrame) -> DataFrame:
    """Support and verdict flags per fixture; an empty list never counts as complete."""
    truth = lambda c: F.coalesce(c, F.lit(False))
    identified = truth(S.safe_int("player.id") != 0)
    xg_fields = [c for c in ("xg", "expected_goals") if c in events.columns]
    has_xg = F.lit(False)
    for c in xg_fields:
        has_xg = has_xg | F.col(c).isNotNull()
    ev = events.groupBy("fixture_id").agg(F.count(F.lit(1)).alias("events"), F.bool_and(identified).alias("ids"),
                                          F.bool_or(has_xg).alias("exg"))
    li = lineups.groupBy("fixture_id").agg(F.count(F.lit(1)).alias("lineups"), F.bool_and(truth(F.size("startXI") > 0)).alias("xi"))
    pl = players.groupBy("fixture_id").agg(F.count(F.lit(1)).alias("player_blocks"))
    st = statistics.groupBy("fixture_id").agg(
        F.count(F.lit(1)).alias("statistics"),
        F.bool_or(truth(F.exists("statistics", lambda s: s["type"] == "expected_goals"))).alias("txg"))
    base = fixtures.select(F.col("fixture.id").alias("fixture_id"), F.col("league.name").alias("league"),
                           F.col("fixture.date").alias("date"), F.col("fixture.status.short").alias("status"),
                           F.col("teams.home.name").alias("home"), F.col("teams.away.name").alias("away"))
    for part in (ev, li, pl, st):
        base = base.join(part, "fixture_id", "left")
    flags = base.select(
        "fixture_id", "league", "date", "status", "home", "away",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "lineups", "player_blocks", "statistics")],
        truth(F.col("ids")).alias("events_with_player_ids"), truth(F.col("xi")).alias("lineups_available"),
        truth(F.col("player_blocks") > 0).alias("player_match_stats_available"),
        truth(F.col("txg")).alias("team_expected_goals_available"), truth(F.col("exg")).alias("event_level_xg_available"))
    return flags.withColumns({
        "supports_live_stint_reconstruction": F.col("events_with_player_ids") & F.col("lineups_available"),
        "supports_batch_player_evaluation": F.col("player_match_stats_available"),
        "supports_shot_level_ratings": F.col("event_level_xg_available"),
        "supports_team_xg_proxy": F.col("team_expected_goals_available")})


def live_probe(support: DataFrame) -> DataFrame:
    """Counts and xG presence of fixtures in play."""
    return support.select("fixture_id", "league", "status", "home", "away", "events", "statistics", "lineups",
                          F.col("team_expected_goals_available").alias("expected_goals_present"))
