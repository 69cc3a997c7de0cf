"""Domain tables derived from the given Parquet tables. All of them grow with the data they are derived from.

A game is six consecutive orders, a season 380 games, five leagues take turns, 20 teams play in each league.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def game_columns(game: str = "game_id") -> dict[str, Column]:
    """League, season and teams of a game, all of which follow from its number."""
    g, block, year = F.expr(f"{game} % 380"), F.expr(f"{game} div 380"), F.lit(1990) + F.expr(f"{game} div 1900")
    return {"league": F.concat(F.lit("L"), (block % 5).cast("string")), "season": F.concat(year, F.lit("_"), year + 1),
            "home_team_id": (block % 5) * 20 + g % 20,
            "away_team_id": (block % 5) * 20 + (g + 1 + F.expr(f"({game} % 380) div 20") % 19) % 20}


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("game_id", F.expr("l_orderkey div 6"))
    of = game_columns()
    base = li.select(
        of["league"].alias("league"), of["season"].alias("season"), "game_id",
        F.when(F.col("l_linestatus") == "O", "h").otherwise("a").alias("h_a"),
        of["home_team_id"].alias("home_team_id"), of["away_team_id"].alias("away_team_id"),
        ((F.col("l_suppkey") + F.col("l_partkey")) % 15).alias("slot"),
        ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 5) % 96).cast("int").alias("minute"),
        ((F.col("l_discount") * 8 + 0.01) * 0.987654321).alias("xg"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") <= 2), "Goal")
        .otherwise("MissedShots").alias("result"),
        F.concat(F.lit("S"), (F.col("l_linenumber") % 5).cast("string")).alias("situation"),
        (F.col("l_quantity").cast("int") % 7).alias("h_goals"),
        (F.col("l_partkey") % 7).cast("int").alias("a_goals"),
        F.expr("case l_partkey % 4 when 1 then 'Pass' when 2 then 'Cross' when 3 then 'Rebound' end")
        .alias("last_action"),
        F.expr("case l_suppkey % 3 when 0 then 'Head' when 1 then 'LeftFoot' else 'RightFoot' end").alias("shot_type"),
    )
    team = F.when(F.col("h_a") == "h", F.col("home_team_id")).otherwise(F.col("away_team_id"))
    player = team * 1000 + F.col("slot")
    return base.select(
        "league", "season", "game_id", "h_a",
        "home_team_id", "away_team_id", team.alias("team_id"), player.alias("player_id"),
        F.concat(F.lit("Player "), player).alias("player"), "minute", "xg", "result", "situation", "h_goals",
        "a_goals", "last_action", "shot_type", F.concat(F.lit("Team "), F.col("home_team_id")).alias("h_team"),
        F.concat(F.lit("Team "), F.col("away_team_id")).alias("a_team"),
    )


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per game. A game has one league, season and pair of teams, so the rows are told apart by the game alone."""
    games = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 6").alias("game_id")).distinct()
    of = game_columns()
    return games.select(*[of[c].alias(c) for c in ("league", "season")], "game_id", *[of[c].alias(c) for c in ("home_team_id", "away_team_id")])


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per game and player; league, season, team and name follow from these and are no keys of their own."""
    by_player = shots(spark, sf_dir).groupBy("game_id", "player_id", "h_a").agg(
        F.sum("minute").alias("sm"), F.count(F.lit(1)).alias("n"), F.sum("xg").alias("sx"),
        F.count_if(F.col("result") == "Goal").alias("ng"))
    of = game_columns()
    by_player = by_player.withColumns({
        "league": of["league"], "season": of["season"], "player": F.concat(F.lit("Player "), F.col("player_id")),
        "team_id": F.when(F.col("h_a") == "h", of["home_team_id"]).otherwise(of["away_team_id"])})
    pid, sm = F.col("player_id"), F.col("sm")
    dbl = lambda c: c.cast("double")
    sub = pid % 1000 >= 11
    return by_player.select(
        "league", "season", "game_id", "team_id", "h_a", "player_id", "player",
        F.when(sub, "Sub").otherwise(F.element_at(F.array(*map(F.lit, ["GK", "DF", "MF", "FW"])), (pid % 4 + 1).cast("int")))
        .alias("position"),
        dbl(F.when(sub, 5 + sm % 40).when(pid % 1000 < 7, F.lit(90)).otherwise(45 + sm % 46)).alias("minutes"),
        dbl(F.col("ng")).alias("goals"), dbl((sm % 53 == 0).cast("int")).alias("own_goals"),
        dbl(F.col("n")).alias("shots"), F.col("sx").alias("xg"), (F.col("sx") * 1.5).alias("xg_chain"),
        dbl(sm % 10 / 10).alias("xg_buildup"), dbl((sm % 3 == 0).cast("int")).alias("assists"),
        dbl(sm % 13 / 20).alias("xa"), dbl(sm % 5).alias("key_passes"), dbl((sm % 7 == 0).cast("int")).alias("yellow_cards"),
        dbl((sm % 41 == 0).cast("int")).alias("red_cards"),
    )


def player_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    year = F.year("o_orderdate")
    sums = joined.groupBy(F.col("l_suppkey").alias("player_id"), year.alias("year")).agg(
        (F.count(F.lit(1)) * 20).cast("double").alias("minutes"),
        (F.sum((F.col("l_discount") - 0.05) * F.col("l_quantity")) / 10).alias("epm"))
    pid, y = F.col("player_id"), F.col("year")
    return sums.select(
        "player_id", F.concat(F.lit("Player "), pid).alias("player"),
        F.element_at(F.array(*map(F.lit, ["GK", "DF", "MF", "FW"])), (pid % 4 + 1).cast("int")).alias("position"),
        "minutes", F.concat(F.lit("L"), (pid * 7 + (y - 1995) * (pid % 3)) % 5).alias("league"),
        F.concat(y, F.lit("_"), y + 1).alias("season"), "epm")


# --- fixture feed, nested as landed -------------------------------------------------------------------------

def _feed_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a fixture is a day of one block of 50 users, its clock counts quarter hours."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01")) + F.expr("user_id div 50") * 30)
        .cast("bigint").alias("fixture_id"),
        F.expr("user_id div 50").alias("block"), F.col("user_id"), (F.col("user_id") % 2).alias("side"),
        F.floor((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / 900).cast("int").alias("clock"),
        "event_id", "event_type", "value")


def feed_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_fixture = _feed_base(spark, sf_dir).groupBy("fixture_id", "block").agg(
        F.count_if((F.col("event_type") == "purchase") & (F.col("side") == 0)).alias("gh"),
        F.count_if((F.col("event_type") == "purchase") & (F.col("side") == 1)).alias("ga"))
    return by_fixture.select(
        F.struct(
            F.col("fixture_id").alias("id"),
            F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("fixture_id") % 30).cast("int")).cast("string"),
                     F.lit("T00:00:00+00:00")).alias("date"),
            F.struct(F.element_at(F.array(*map(F.lit, ["FT", "AET", "PEN", "2H"])), (F.col("fixture_id") % 4 + 1).cast("int"))
                     .alias("short"),
                     F.when(F.col("fixture_id") % 3 == 0, (F.lit(90) + F.col("fixture_id") % 7)).cast("int").alias("elapsed"))
            .alias("status")).alias("fixture"),
        F.struct(F.struct((F.col("block") * 2).alias("id"), F.concat(F.lit("Club "), F.col("block") * 2).alias("name")).alias("home"),
                 F.struct((F.col("block") * 2 + 1).alias("id"), F.concat(F.lit("Club "), F.col("block") * 2 + 1).alias("name"))
                 .alias("away")).alias("teams"),
        F.struct(F.col("gh").cast("int").alias("home"), F.col("ga").cast("int").alias("away")).alias("goals"),
        F.struct((F.col("block") % 5).alias("id"), F.lit(2024).alias("season"),
                 F.concat(F.lit("League "), F.col("block") % 5).alias("name")).alias("league"))


def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _feed_base(spark, sf_dir)
    kind = F.when(F.col("event_type") == "purchase", "Goal").when(F.col("event_type") == "error", "Card") \
        .when(F.col("event_type") == "signup", "subst").otherwise("Var")
    detail = F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 17 == 0, "Own Goal").otherwise("Normal Goal")) \
        .when(F.col("event_type") == "error", F.when(F.col("event_id") % 5 == 0, "Red Card")
              .when(F.col("event_id") % 5 == 1, "Yellow Red Card").otherwise("Yellow Card")) \
        .when(F.col("event_type") == "signup", "Substitution 1").otherwise("Goal cancelled")
    partner = F.when(F.col("event_type") == "signup", (F.col("user_id") % 50 + 30) % 50 + F.col("block") * 50)
    return b.select(
        "fixture_id", F.col("event_id").alias("event_pos"),
        F.struct(F.least(F.col("clock"), F.lit(90)).alias("elapsed"),
                 F.when(F.col("clock") > 90, F.col("clock") - 90).alias("extra")).alias("time"),
        F.struct((F.col("block") * 2 + F.col("side")).alias("id"), F.concat(F.lit("Club "), F.col("block") * 2 + F.col("side"))
                 .alias("name")).alias("team"),
        F.struct(F.when(F.col("event_id") % 29 != 0, F.col("user_id")).alias("id")).alias("player"),
        F.struct(partner.alias("id")).alias("assist"), kind.alias("type"), detail.alias("detail"))


def feed_lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixtures = _feed_base(spark, sf_dir).select("fixture_id", "block").distinct()
    sides = fixtures.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    return sides.select(
        "fixture_id", F.col("side").alias("lineup_pos"),
        F.struct((F.col("block") * 2 + F.col("side")).alias("id")).alias("team"),
        F.transform(F.sequence(F.lit(0), F.lit(10)),
                    lambda i: F.struct(F.struct((F.col("block") * 50 + i * 2 + F.col("side")).cast("bigint").alias("id"))
                                       .alias("player"))).alias("startXI"))


def feed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixtures = _feed_base(spark, sf_dir).groupBy("fixture_id", "block", "side").agg(F.round(F.sum("value") / 1000, 5).alias("v"))
    xg = F.when(F.col("fixture_id") % 7 == 0, F.lit(None).cast("string")).when(F.col("fixture_id") % 11 == 0, "n/a") \
        .otherwise(F.col("v").cast("decimal(18,5)").cast("string"))
    stat = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    return fixtures.select(
        "fixture_id", F.col("side").alias("stat_pos"), F.struct((F.col("block") * 2 + F.col("side")).alias("id"),
                               F.concat(F.lit("Club "), F.col("block") * 2 + F.col("side")).alias("name")).alias("team"),
        F.array(stat("Ball Possession", F.lit("50%")), stat("expected_goals", xg)).alias("statistics"))


def feed_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_user = _feed_base(spark, sf_dir).groupBy("fixture_id", "block", "side", "user_id").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.min("event_id").alias("e"),
        F.count_if(F.col("event_type") == "purchase").cast("int").alias("g"))
    e, n = F.col("e"), F.col("n")
    i = lambda x: x.cast("int")
    s = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
    stats = s(
        games=s(minutes=i(20 + (e * 13) % 71), position=F.when(e % 6 > 0, F.element_at(
            F.array(*map(F.lit, ["G", "D", "M", "F"])), i(F.col("user_id") % 4 + 1)))),
        shots=s(total=i(n + 1), on=F.when(e % 2 == 0, n)), goals=s(total=F.col("g"), assists=i(e % 2)),
        passes=s(key=i(e % 5), total=i(20 + e % 30)), tackles=s(total=i(e % 6), interceptions=i(e % 3), blocks=i(e % 4)),
        duels=s(won=i(e % 9)), dribbles=s(success=i(e % 7)), fouls=s(drawn=i(e % 3), committed=i(e % 4)),
        cards=s(yellow=i(e % 2), red=i((e % 31 == 0).cast("int"))),
        penalty=s(scored=i(e % 2), missed=F.lit(None).cast("int"), won=i(e % 3), commited=i(e % 2)))
    return per_user.select(
        "fixture_id", F.struct((F.col("block") * 2 + F.col("side")).alias("id")).alias("team"),
        F.array(F.struct(F.struct(F.col("user_id").alias("id"), F.concat(F.lit("User "), F.col("user_id")).alias("name"))
                         .alias("player"), F.when(e % 23 != 0, F.array(stats)).alias("statistics"))).alias("players"))
