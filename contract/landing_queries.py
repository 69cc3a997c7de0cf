"""Files of uneven columns landed and read back, what reading lost, and how a feed's fields change."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from contract import tables as T
from contract.rating_queries import _box_ratings
from contract.registry import register, rounded
from contract.sql import cte, query
from pitchline import schemas
from pitchline.plans import coverage
from pitchline.session import materialize, scratch_path
from pitchline.sources import batch, quality

LEAGUES = ("L0", "L1", "L2", "L3", "L4")


def names_of(schema):
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def land(spark, d):
    """Each league's tables as files whose columns stand in another order, one league's with a foreign and one's without an optional column."""
    root = scratch_path(spark, "landed")
    sources = {"schedule": (T.schedule(spark, d), schemas.SCHEDULE), "player_match_stats": (T.appearances(spark, d), schemas.PLAYER_MATCH),
               "shot_events": (T.shots(spark, d), schemas.SHOT_EVENTS)}
    for suffix, (table, schema) in sources.items():
        table = materialize(table.select("league", *[c for c in names_of(schema) if c in table.columns]), suffix)
        for i, league in enumerate(LEAGUES):
            columns = [c for c in table.columns if c != "league" and not (i == 3 and c == "xg")]
            columns = columns[i:] + columns[:i] if i % 2 else columns[::-1]
            rows = table.filter(F.col("league") == league).select(*columns)
            rows = rows.withColumn("foreign", F.lit('a "quoted", text')) if i == 2 else rows
            rows.write.option("header", True).csv(f"{root}/{league}/all_{suffix}.csv")
    return root


cte("landed_shots", """SELECT league, count(*) AS shots, count(DISTINCT game_id) AS shot_games, sum(minute)::BIGINT AS minutes,
  round(sum(CASE WHEN league <> 'L3' THEN xg END), 5) AS xg, count(*) FILTER (result = 'Goal') AS goals FROM shots GROUP BY 1""", "shots")
cte("landed_players", """SELECT league, count(*) AS player_rows, sum(player_id)::BIGINT AS ids, round(sum(minutes), 5) AS played,
  count(DISTINCT position) AS positions FROM appearances GROUP BY 1""", "appearances")
cte("landed_games", """SELECT league, count(*) AS games, sum(home_team_id - away_team_id)::BIGINT AS ids_apart
  FROM (SELECT DISTINCT league, season, game_id, home_team_id, away_team_id FROM shots) GROUP BY 1""", "shots")


@register("landed_tables", query("""SELECT *, 'all' AS season FROM landed_games JOIN landed_players USING (league) JOIN landed_shots USING (league)""",
                                 "landed_games", "landed_players", "landed_shots"))
def landed_tables(spark, d):
    """Files of different column order and width, read by name in one scan per table."""
    schedule, players, shots = batch.read_league_seasons(spark, land(spark, d))
    by = ["league", "season"]
    n = F.count(F.lit(1))
    a = schedule.groupBy(*by).agg(n.alias("games"), F.sum(F.col("home_team_id") - F.col("away_team_id")).alias("ids_apart"))
    b = players.groupBy(*by).agg(n.alias("player_rows"), F.sum("player_id").alias("ids"), F.round(F.sum("minutes"), 5).alias("played"),
                                 F.count_distinct("position").alias("positions"))
    c = shots.groupBy(*by).agg(n.alias("shots"), F.count_distinct("game_id").alias("shot_games"), F.sum("minute").cast("long").alias("minutes"),
                               F.round(F.sum("xg"), 5).alias("xg"), F.count_if(F.col("result") == "Goal").alias("goals"))
    return a.join(b, by).join(c, by)


@register("landed_ratings", query("""SELECT player_id, CASE WHEN league = 'L4' THEN NULL ELSE player END AS player, position, minutes, league, season,
  round(epm, 6) AS epm FROM box""", "box"))
def landed_ratings(spark, d):
    """Rating files of different column order, one without names."""
    root, box = scratch_path(spark, "rated"), materialize(_box_ratings(spark, d), "box")
    columns = ["player_id", "player", "position", "minutes", "league", "season", "epm"]
    for i, league in enumerate(LEAGUES):
        order = [c for c in columns[i:] + columns[:i] if not (league == "L4" and c == "player")]
        box.filter(F.col("league") == league).select(*order).write.option("header", True).csv(f"{root}/{league}_epm.csv")
    return rounded(batch.read_epm(spark, root))


@register("landed_seasons", query("SELECT DISTINCT league, 'all' AS season FROM appearances", "appearances"))
def landed_seasons(spark, d):
    """Which league-seasons have player rows, from the names of the files."""
    return batch.list_seasons(spark, land(spark, d))


@register("read_quality", query("""
SELECT unnest(['rows', 'bad_minute', 'none_minute', 'bad_xg', 'none_xg', 'read', 'dropped']) AS figure, unnest([count(*),
  count(*) FILTER (minute % 10 = 3 AND minute % 7 <> 1), count(*) FILTER (minute % 7 = 1),
  count(*) FILTER (minute % 11 = 5), 0, count(*), count(*) FILTER (minute % 7 = 1 OR minute % 10 = 3 OR minute < 10)]) AS n FROM shots""", "shots"))
def read_quality(spark, d):
    """What casts and a filter lost, observed while the rows are written once."""
    m = F.col("minute")
    raw = T.shots(spark, d).select(
        "game_id", F.when(m % 7 == 1, F.when(m % 2 == 0, " ")).when(m % 10 == 3, F.concat(m, F.lit("'"))).otherwise(m.cast("string")).alias("minute"),
        F.when(m % 11 == 5, "n/a").otherwise(F.col("xg").cast("string")).alias("xg"))
    casts, rows = Observation("casts"), Observation("rows")
    typed = quality.counted_casts(raw, {"minute": "int", "xg": "double"}, casts)
    materialize(quality.counted_filter(typed, F.col("minute") >= 10, rows), "typed")
    return quality.figures(casts, raw).unionByName(quality.figures(rows, raw))


cte("years", "SELECT DISTINCT year(o_orderdate) AS y FROM orders")
cte("fields", """SELECT y AS year, 'order' AS field, 'BIGINT' AS kind FROM years
  UNION ALL SELECT y, 'price', CASE WHEN y < 1995 THEN 'DECIMAL' ELSE 'STRING' END FROM years
  UNION ALL SELECT y, 'old', 'BOOLEAN' FROM years WHERE y < 1996
  UNION ALL SELECT y, 'new', 'OBJECT' FROM years WHERE y >= 1994 UNION ALL SELECT y, 'new.deep', 'BIGINT' FROM years WHERE y >= 1994""", "years")


@register("feed_schema_drift", query("""
SELECT f.year, f.field, f.kind, CASE WHEN e.kind IS NULL THEN 'appeared' WHEN e.kind <> f.kind THEN 'changed' ELSE 'kept' END AS state, e.kind AS earlier
FROM fields f LEFT JOIN fields e ON e.field = f.field AND e.year = f.year - 1
UNION ALL SELECT f.year + 1, f.field, NULL, 'vanished', f.kind FROM fields f JOIN years ON y = f.year + 1
LEFT JOIN fields n ON n.field = f.field AND n.year = f.year + 1 WHERE n.field IS NULL""", "fields", "years"))
def feed_schema_drift(spark, d):
    """Fields of payloads by year: which appear, change their type or vanish from one year to the next."""
    o = T.table(spark, d, "orders")
    y = F.year("o_orderdate")
    body = F.concat(
        F.lit('{"order":'), F.col("o_orderkey"), F.lit(',"price":'),
        F.when(y < 1995, (F.col("o_orderkey") % 90 + 0.5).cast("decimal(9,1)").cast("string")).otherwise(F.concat(F.lit('"'), F.col("o_orderkey"), F.lit('"'))),
        F.when(y < 1996, ',"old":true').otherwise(""), F.when(y >= 1994, F.concat(F.lit(',"new":{"deep":'), F.col("o_orderkey"), F.lit("}"))).otherwise(""),
        F.lit("}"))
    return coverage.schema_drift(o.select(y.alias("year"), F.parse_json(body).alias("payload")), "payload", [], "year")

