"""Live payloads of unknown shape, flattened to event rows. Stateless, so the same function serves batch and stream.

A payload is an object or a list, optionally inside ``result``; its items are the objects of every list found one
level down. An item may embed ``events``, which then inherit the item's match; otherwise the item is the event. All
access goes through VARIANT paths, typed only at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchline.functions import scalars as S

# Candidate names per field, first non-null one wins.
MATCH_KEYS = ("match_id", "matchId", "matchID", "game_id", "gameId", "fixture_id", "fixtureId", "id")
TEAM_KEYS = ("team_id", "teamId", "team", "teamID", "club_id", "clubId")
PLAYER_KEYS = ("player_id", "playerId", "player", "playerID")
TYPE_KEYS = ("event_type", "eventType", "type", "event", "action")
MINUTE_KEYS = ("minute", "time", "timer", "elapsed", "clock")
XG_KEYS = ("xg", "expected_goals", "expectedGoals", "xG")
LIST_KEYS = ("matches", "fixtures", "events", "live", "result", "data", "response")
SNAPSHOT = "match_snapshot"


def text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def members(v: Column | str) -> Column:
    """The members of an object as a map, NULL for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def typed(v: Column) -> Column:
    """Schema, text and number of a variant, looked at once."""
    return F.struct(F.schema_of_variant(v).alias("kind"), text(v).alias("text"), F.try_variant_get(v, "$", "double").alias("number"))


def is_number(t: Column) -> Column:
    return t["kind"].isin("BIGINT", "DOUBLE", "FLOAT") | t["kind"].startswith("DECIMAL")


def without_nulls(m: Column | str) -> Column:
    """The members that aren't JSON null of an object whose members have been read."""
    return F.map_filter(m, lambda _, x: ~F.is_variant_null(x))


def filled(v: Column | str) -> Column:
    """The members of an object that aren't JSON null: read once, then every name is a look-up in a small map."""
    return without_nulls(members(v))


def get(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def first(m: Column, keys) -> Column:
    """Member under the first candidate name that is present and not null, as a variant."""
    return F.coalesce(*[get(m, k) for k in keys])


def first_text(m: Column, keys) -> Column:
    return text(first(m, keys))


def first_truthy(m: Column, keys) -> Column:
    """The first candidate that is no empty text, zero, false or empty container."""
    def kept(x: Column) -> Column:
        t = text(x)
        falsy = (t == "") | (t.isin("0", "0.0", "-0.0", "false", "{}", "[]") & (F.schema_of_variant(x) != "STRING"))
        return F.when(t.isNotNull() & ~falsy, x)

    return F.coalesce(*[kept(get(m, k)) for k in keys])


def first_truthy_text(m: Column, keys) -> Column:
    return text(first_truthy(m, keys))


def whole(t: Column) -> Column:
    """Integer of a number (truncated), a flag (0/1) or digits in a text; else NULL. ``t`` is a ``typed`` struct."""
    return (F.when(is_number(t), t["number"].try_cast("bigint")).when(t["kind"] == "BOOLEAN", (t["text"] == "true").cast("bigint"))
            .otherwise(S.safe_int(t["text"])))


def parse_minute(t: Column) -> Column:
    """Number -> truncated; ``45+2`` -> 47; any other text -> its digits run together; no digits -> NULL."""
    words = F.trim(t["text"])
    parts = F.split(words, r"\+")
    worded = F.when(words.rlike(r"^\d+\+\d+$"), F.get(parts, F.lit(0)).try_cast("bigint") + F.get(parts, F.lit(1)).try_cast("bigint")
                    ).otherwise(F.regexp_replace(words, r"\D", "").try_cast("bigint"))
    return F.when(is_number(t) | (t["kind"] == "BOOLEAN"), whole(t)).otherwise(worded).try_cast("int")


def score_parts(score: Column) -> Column:
    """Home and away figures of an object with either spelling, or the two sides of ``home-away`` text, still typed."""
    words, parts = text(score), filled(score)
    visible = lambda k: F.when(text(get(parts, k)) != "", get(parts, k))
    side = lambda name: typed(F.coalesce(*[visible(k) for k in (name, f"{name}_score", f"{name}Score")]))
    worded = lambda part: F.struct(F.lit("STRING").alias("kind"), part.alias("text"), F.lit(None).cast("double").alias("number"))
    left = F.substring_index(words, "-", 1)
    split = F.struct(worded(left).alias("home"), worded(F.substr(words, F.length(left) + 2)).alias("away"))
    named = F.struct(side("home").alias("home"), side("away").alias("away"))
    return F.when(words.startswith("{") & (F.schema_of_variant(score) != "STRING"), named).when(words.contains("-"), split)


def objects(variants: Column) -> Column:
    """Array of variants as (raw, members) pairs; members are NULL for what is no object."""
    return F.transform(variants, lambda x: F.struct(x.alias("raw"), members(x).alias("m")))


def explode_items(parsed: DataFrame, repeat_known_keys: bool = False) -> DataFrame:
    """One (raw, members) pair ``__i`` per item of column ``__p``. Each list counts once; ``repeat_known_keys`` counts
    lists under well-known keys twice."""
    as_list = lambda v: objects(F.try_variant_get(v, "$", "array<variant>"))
    objects_only = lambda a: a.isNotNull() & (F.size(a) > 0) & F.forall(a, lambda x: x["m"].isNotNull())
    lists = lambda m: F.transform(F.map_values(m), as_list)
    base = parsed.withColumn("__m", members("__p")).withColumn(
        "__b", F.when(F.map_contains_key("__m", F.lit("result")), F.try_element_at("__m", F.lit("result"))).otherwise(F.col("__p")))
    base = base.withColumn("__m", members("__b"))
    found = lists(F.col("__m"))
    if repeat_known_keys:
        found = F.concat(lists(F.map_filter("__m", lambda k, _: k.isin(*LIST_KEYS))), found)
    found = F.when(F.col("__m").isNotNull(), found).otherwise(F.array(as_list(F.col("__b"))))
    return base.select("ingested_at", F.explode(F.flatten(F.filter(found, objects_only))).alias("__i"))


def normalize(payloads: DataFrame, value: str = "value", source: str = "live-feed", ingested_at: Column | None = None,
              repeat_known_keys: bool = False) -> DataFrame:
    """Flat live events from a column of JSON payload text; unreadable payloads give no rows.

    The steps are separate projections: members are read into a map once per object, which goes on with it, and every path is looked up once.
    """
    when = S.utc_now_second() if ingested_at is None else ingested_at
    parsed = payloads.select(when.alias("ingested_at"), F.try_parse_json(F.col(value).cast("string")).alias("__p"))
    items = explode_items(parsed, repeat_known_keys).select(
        "ingested_at", "__i", without_nulls("__i.m").alias("im"),
        objects(F.try_variant_get(F.try_element_at("__i.m", F.lit("events")), "$", "array<variant>")).alias("__l"))
    has_list = F.coalesce(F.size("__l"), F.lit(0)) > 0
    rows = items.select("ingested_at", "im", has_list.alias("__inner"), F.explode(
        F.when(has_list, F.filter("__l", lambda x: x["m"].isNotNull())).otherwise(F.array("__i"))).alias("__e"))
    rows = rows.select("ingested_at", "im", "__inner", F.col("__e.raw").alias("raw"),
                       F.when(F.col("__inner"), without_nulls("__e.m")).otherwise(F.col("im")).alias("em"))

    i, e = F.col("im"), F.col("em")
    found = rows.select(
        "ingested_at", "__inner", "raw", first_text(i, MATCH_KEYS).alias("match"), first(e, MINUTE_KEYS).alias("minute"),
        first(e, TYPE_KEYS).alias("kind"), first_text(e, TEAM_KEYS).alias("team"), first_text(e, PLAYER_KEYS).alias("player"),
        first(e, XG_KEYS).alias("xg"), get(e, "score").alias("score"),
        F.when(F.col("__inner"), first_truthy(i, ("score", "score_full", "full_score"))).alias("context_score"),
        first_truthy_text(i, ("home_team_id", "homeTeamId", "home_id")).alias("home"),
        first_truthy_text(i, ("away_team_id", "awayTeamId", "away_id")).alias("away"),
        first_truthy_text(e, ("player_in_id", "playerInId")).alias("player_in"),
        first_truthy_text(e, ("player_out_id", "playerOutId")).alias("player_out"),
        first_truthy(e, ("lineup_home", "home_lineup")).alias("lineup_home"),
        first_truthy(e, ("lineup_away", "away_lineup")).alias("lineup_away"))
    looked = found.withColumns({"minute": typed(F.col("minute")), "kind": typed(F.col("kind")), "xg": typed(F.col("xg")), "score": score_parts(F.col("score")),
                                "context_score": score_parts(F.col("context_score"))})
    sides = looked.withColumns({"__h": whole(F.col("score.home")).try_cast("int"), "__a": whole(F.col("score.away")).try_cast("int")})
    from_context = F.col("__h").isNull() & F.col("context_score").isNotNull()
    side = lambda own, name: F.when(from_context, whole(F.col(f"context_score.{name}")).try_cast("int")).otherwise(F.col(own))
    empty = F.col("kind.text").isin("", "0", "0.0", "false", "{}", "[]") & (
        (F.col("kind.text") == "") | (F.col("kind.kind") != "STRING"))
    return sides.select(
        "ingested_at", F.lit(source).alias("source"), F.col("match").alias("match_id"), parse_minute(F.col("minute")).alias("minute"),
        F.coalesce(F.when(~empty, F.lower("kind.text")), F.lit(SNAPSHOT)).alias("event_type"), F.col("team").alias("team_id"),
        F.col("player").alias("player_id"),
        F.when(F.col("xg.kind") == "BOOLEAN", (F.col("xg.text") == "true").cast("double")).otherwise(S.safe_float("xg.text")).alias("xg"),
        side("__h", "home").alias("score_home"), side("__a", "away").alias("score_away"), F.col("home").alias("home_team_id"),
        F.col("away").alias("away_team_id"), F.col("player_in").alias("player_in_id"), F.col("player_out").alias("player_out_id"),
        "lineup_home", "lineup_away", "raw")
