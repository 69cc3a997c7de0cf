"""Live payload flattening, publication and keyed state on the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import tables as T
from contract.rating_queries import rated_rows, rated_sql, season_sql
from contract.registry import register, rounded
from contract.sql import cte, query
from contract.stint_queries import readable
from pitchline.session import scratch_path
from pitchline.sources.feed import stream_payloads
from pitchline import schemas
from pitchline.operators import seasons
from pitchline.streaming import jobs, live_state, state, windows
from pitchline.streaming import normalize as N


def pick(keys, n):
    return F.element_at(F.array(*map(F.lit, keys)), (n % len(keys) + 1).cast("int"))


def payloads(spark, d):
    """One payload per event: four envelopes, key names cycled through the candidates, five spellings of the minute."""
    b = T._feed_base(spark, d)
    e, m = F.col("event_id"), F.col("clock")
    minute = (F.when(e % 5 == 0, m.cast("string"))
              .when(e % 5 == 1, F.concat(F.lit('"'), F.least(m, F.lit(45)), F.lit("+"), m - F.least(m, F.lit(45)), F.lit('"')))
              .when(e % 5 == 2, F.concat(m, F.lit(".9"))).when(e % 5 == 3, F.concat(F.lit('"'), m, F.lit("'\""))).otherwise("null"))
    event = F.concat(
        F.lit('"'), pick(N.MINUTE_KEYS, e), F.lit('":'), minute, F.lit(',"'), pick(N.TYPE_KEYS, e), F.lit('":"'),
        F.initcap("event_type"), F.lit('","'), pick(N.TEAM_KEYS, e), F.lit('":'), F.col("block") * 2 + F.col("side"),
        F.lit(',"'), pick(N.PLAYER_KEYS, e), F.lit('":"'), F.col("user_id"), F.lit('","'), pick(N.XG_KEYS, e), F.lit('":'),
        F.round(F.col("value") / 1000, 5).cast("decimal(18,5)").cast("string"), F.lit(',"playerInId":'), e % 3, F.lit(',"playerOutId":'), e % 5,
        F.when(e % 6 == 0, F.concat(F.lit(',"home_lineup":['), e % 7, F.lit("]"))).otherwise(""),
        F.when(e % 6 == 1, F.concat(F.lit(',"lineup_away":null,"away_lineup":['), e % 7, F.lit(',"x"]'))).otherwise(""))
    match = F.concat(F.lit('"'), pick(N.MATCH_KEYS, e), F.lit('":'), F.col("fixture_id"), F.lit(',"homeTeamId":'), F.col("block") * 2,
                     F.lit(',"awayTeamId":'), F.col("block") * 2 + 1, F.lit(',"score":'), F.when(e % 4 == 3, F.concat(F.lit('{"home":0,"awayScore":'), e % 6, F.lit("}")))
                     .otherwise(F.concat(F.lit('"'), e % 4, F.lit("-"), e % 6, F.lit('"'))))
    body = (F.when(e % 4 == 0, F.concat(F.lit('{"result":{"matches":[{'), match, F.lit(',"events":[{'), event, F.lit("}]}]}}")))
            .when(e % 4 == 1, F.concat(F.lit("[{"), match, F.lit(","), event, F.lit("}]")))
            .when(e % 4 == 2, F.concat(F.lit('{"data":[{'), match, F.lit(',"events":[],'), event, F.lit('}],"total":1}')))
            .otherwise(F.concat(F.lit('{"other":[{'), match, F.lit(',"events":[{'), event, F.lit('}, 7]}],"tags":["a"]}'))))
    return b.select(body.alias("value"))


cte("live", """SELECT CAST(fixture_id AS VARCHAR) AS match_id, CAST(CASE WHEN event_id % 5 = 4 THEN NULL ELSE minute END AS INTEGER) AS minute,
  event_type, CAST(block * 2 + side AS VARCHAR) AS team_id, CAST(user_id AS VARCHAR) AS player_id, round(value / 1000, 5) AS xg,
  CAST(CASE WHEN event_id % 4 = 3 THEN 0 ELSE event_id % 4 END AS INTEGER) AS score_home, CAST(event_id % 6 AS INTEGER) AS score_away,
  CASE WHEN block = 0 THEN NULL ELSE CAST(block * 2 AS VARCHAR) END AS home_team_id,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 3 AS VARCHAR) END AS player_in_id,
  CAST(block * 2 + 1 AS VARCHAR) AS away_team_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 5 AS VARCHAR) END AS player_out_id,
  CASE WHEN event_id % 6 = 0 THEN '[' || event_id % 7 || ']' END AS lineup_home,
  CASE WHEN event_id % 6 = 1 THEN '[' || event_id % 7 || ',"x"]' END AS lineup_away, 'live-feed' AS source, true AS ingested,
  event_id % 3 AS raw_in, event_id % 4 IN (1, 2) AS raw_has_match FROM feed""", "feed")
LIVE_COLUMNS = ["match_id", "minute", "event_type", "team_id", "player_id", "xg", "score_home", "score_away", "home_team_id", "player_in_id",
                "away_team_id", "player_out_id"]


@register("live_events", query("SELECT * FROM live", "live"))
def live_events(spark, d):
    """All columns; of ``raw`` that it is the event's own object (which holds its match where the item is the event)."""
    events = N.normalize(payloads(spark, d))
    raw = lambda key: F.try_variant_get("raw", f"$.{key}", "bigint")
    return rounded(events.select(
        *LIVE_COLUMNS, F.to_json("lineup_home").alias("lineup_home"), F.to_json("lineup_away").alias("lineup_away"), "source",
        F.col("ingested_at").isNotNull().alias("ingested"), raw("playerInId").alias("raw_in"), raw("homeTeamId").isNotNull().alias("raw_has_match")))


# --- streams and state ------------------------------------------------------------------------------------------

def feed_dict(spark, d):
    return {"events": T.feed_events(spark, d), "lineups": T.feed_lineups(spark, d), "players": T.feed_players(spark, d),
            "statistics": T.feed_statistics(spark, d)}


def published(spark, d):
    """Payload files picked up by a stream that writes the raw payloads and the events in them."""
    base = scratch_path(spark, "published")
    payloads(spark, d).write.text(f"{base}/landing")
    jobs.publish(stream_payloads(spark, f"{base}/landing"), f"{base}/raw", f"{base}/events", f"{base}/checkpoint", None).awaitTermination()
    return base


@register("published_events", query("SELECT match_id, minute, event_type, team_id, player_id, xg FROM live", "live"))
def published_events(spark, d):
    schema = "match_id string, minute int, event_type string, team_id string, player_id string, xg double"
    out = spark.read.schema(schema).json(f"{published(spark, d)}/events")
    return rounded(out.select("match_id", "minute", "event_type", "team_id", "player_id", "xg"))


@register("published_raw", query("SELECT CAST(count(*) AS BIGINT) AS payloads FROM feed", "feed"))
def published_raw(spark, d):
    return spark.read.text(f"{published(spark, d)}/raw").agg(F.count(F.lit(1)).alias("payloads"))


def synced(spark, d):
    """State after finished fixtures, then two rounds of live fixtures of which the second lists fewer."""
    root, fixtures, parts = scratch_path(spark, "synced"), T.feed_fixtures(spark, d), feed_dict(spark, d)
    live = fixtures.filter("fixture.status.short = '2H'")
    jobs.sync_finished(root, fixtures, parts)
    jobs.sync_live(root, live, parts)
    jobs.sync_live(root, live.filter("fixture.id % 8 = 3"), parts)
    return root


@register("state_fixtures", query("""
SELECT f.fixture_id, league_id, season, date, status, CAST(goals_home AS DOUBLE) AS goals_home, h.xg AS xg_home,
  status = '2H' AND f.fixture_id % 8 = 3 AS is_live, status <> '2H' AS is_finished
FROM feed_fixtures f LEFT JOIN feed_xg h ON h.fixture_id = f.fixture_id AND h.team_id = home_team_id""", "feed_fixtures", "feed_xg"))
def state_fixtures(spark, d):
    return state.read_fixtures(spark, synced(spark, d)).select(
        "fixture_id", "league_id", "season", "date", "status", "goals_home", "xg_home", "is_live", "is_finished")


@register("state_player_rows", query("""SELECT p.* EXCLUDE (game_id), game_id AS fixture_id, league_id, season
FROM player_rows p JOIN feed_fixtures f ON game_id = fixture_id WHERE status <> '2H'""", "player_rows", "feed_fixtures"))
def state_player_rows(spark, d):
    return state.read_player_rows(spark, synced(spark, d))


@register("state_stints", query("""
SELECT s.league_id, s.season, game_id, row_number() OVER (PARTITION BY game_id ORDER BY start) - 1 AS stint_index, start, s.stop, duration,
  home_players, away_players, score_diff, red_home, red_away FROM fx_stints s""", "fx_stints"))
def state_stints(spark, d):
    stints = state.decode_lineups(state.encode_lineups(state.read_stints(spark, synced(spark, d))))
    return readable(stints.drop("xg_diff", "home_team_id", "away_team_id"))


@register("current_ratings_from_state")
def current_ratings_from_state(spark, d):
    return jobs.current_ratings(spark, synced(spark, d)).select(
        "league_id", "season", "player_id", "player", "position", "minutes", "rapm", "spm", "bpm", "epm")


cte("state_player_rows", "SELECT league_id, season, p.* FROM player_rows p JOIN feed_fixtures f ON p.game_id = f.fixture_id WHERE status <> '2H'",
    "player_rows", "feed_fixtures")
season_sql("state_player_rows", "league_id, season", seasons.FEED_METRICS, "state_season")


@register("state_rating_rows", query(rated_sql("state_season_totals"), "state_season_totals", "fx_on_pitch"))
def state_rating_rows(spark, d):
    """Who is rated from the stored state, with what is known of them; epm is the sum of its parts."""
    return rated_rows(jobs.current_ratings(spark, synced(spark, d)))


@register("latest_record_per_key", """
SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
  FROM orders) WHERE r = 1""")
def latest_record_per_key(spark, d):
    orders = T.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn(
        "version", F.struct("o_orderdate", "o_orderkey"))
    return state.latest(orders, "o_custkey", "version").drop("version")


def _stage(keys, stage):
    """Fixture records of one sync: the first without and with a league, the second in another league, the third twice."""
    k = F.col("fixture_id")
    rows = keys.filter({1: k % 3 != 0, 2: k % 4 == 0, 3: k % 5 == 0}[stage])
    league = {1: F.when(k % 7 != 0, k % 5), 2: (k + 1) % 5, 3: F.lit(None)}[stage]
    times = F.explode(F.array(*[F.lit(t) for t in {1: [1], 2: [2], 3: [4, 3]}[stage]]))
    rows = rows.select("fixture_id", league.cast("bigint").alias("league_id"), (2020 + k % 2).cast("int").alias("season"), times.alias("t"))
    columns = {c.strip().split(" ")[0]: c.strip().split(" ")[1] for c in schemas.STATE_FIXTURES.split(",")}
    known = {"fixture_id": k, "league_id": F.col("league_id"), "season": F.col("season"), "status": F.concat(F.lit("s"), "t"),
             "is_live": F.lit(False), "last_synced_at": F.timestamp_seconds("t")}
    return rows.select(*[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


@register("state_after_correction", """
SELECT fixture_id, league_id, season, 's' || t AS status FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY t DESC) AS r FROM (
  SELECT o_orderkey AS fixture_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 5 END AS league_id, 2020 + o_orderkey % 2 AS season, 1 AS t
  FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, (o_orderkey + 1) % 5, 2020 + o_orderkey % 2, 2 FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT o_orderkey, NULL, 2020 + o_orderkey % 2, unnest([3, 4]) FROM orders WHERE o_orderkey % 5 = 0)) WHERE r = 1""")
def state_after_correction(spark, d):
    root = scratch_path(spark, "corrected")
    keys = T.table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("fixture_id"))
    for stage in (1, 2, 3):
        state.upsert_fixtures(root, _stage(keys, stage))
    return state.read_fixtures(spark, root).select("fixture_id", "league_id", F.col("season").cast("bigint").alias("season"), "status")


def _event_stream(spark, d):
    """The landed event table as a stream in which every event arrives twice, as in two polls."""
    path, events = scratch_path(spark, "landed-events"), T.table(spark, d, "events")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    twice = stream.withColumn("poll", F.explode(F.array(F.lit(1), F.lit(2))))
    return twice.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.expr("user_id div 50")).alias("match_id"), "event_type",
                        (F.col("value") / 1000).alias("xg"), "poll")


def _drained(spark, stream, complete):
    base = scratch_path(spark, "windows")
    windows.to_table(stream, f"{base}/table", f"{base}/checkpoint", None, complete).awaitTermination()
    return spark.read.parquet(f"{base}/table")


@register("deduplicated_events", "SELECT event_id, user_id // 50 AS match_id, event_type, round(value / 1000, 6) AS xg FROM events")
def deduplicated_events(spark, d):
    unique = windows.deduplicated(_event_stream(spark, d), ("event_id",), "ts", "2 hours")
    return rounded(_drained(spark, unique, False).select("event_id", "match_id", "event_type", "xg"))


@register("windowed_xg", """
SELECT user_id // 50 AS match_id, epoch(time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k)::BIGINT AS window_start,
  round(sum(value / 1000), 5) AS xg, count(*) AS events FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL""")
def windowed_xg(spark, d):
    """Windows of an hour every half hour."""
    once_ = _event_stream(spark, d).filter("poll = 1")
    out = _drained(spark, windows.windowed_xg(once_, "60 minutes", "30 minutes", "ts"), True)
    return out.select("match_id", F.unix_timestamp("window_start").alias("window_start"), (F.round("xg", 5) + 0.0).alias("xg"), "events")


@register("session_xg", """
SELECT match_id, floor(epoch(min(ts)))::BIGINT AS first_event, round(sum(xg), 5) AS xg, count(*) AS events FROM (
  SELECT *, sum(new::INT) OVER (PARTITION BY match_id ORDER BY ts, event_id) AS s FROM (
    SELECT user_id // 50 AS match_id, event_id, ts, value / 1000 AS xg,
      coalesce(ts - lag(ts) OVER (PARTITION BY user_id // 50 ORDER BY ts, event_id) >= INTERVAL 10 MINUTE, true) AS new FROM events))
GROUP BY match_id, s""")
def session_xg(spark, d):
    once_ = _event_stream(spark, d).filter("poll = 1")
    out = _drained(spark, windows.session_xg(once_, "10 minutes", "ts"), True)
    return out.select("match_id", F.unix_timestamp("window_start").alias("first_event"), (F.round("xg", 5) + 0.0).alias("xg"), "events")


# --- several micro-batches: rows that come late, windows that close, fixtures that end --------------------------------

LAST_BLOCK = 4
cte("blocks", """SELECT *, (epoch(ts)::BIGINT // 86400 - 19723) // 6 AS block, (epoch(ts)::BIGINT // 86400 - 19723) % 6 AS day FROM events""")
# of each block's first five days some events come two blocks later, which is too late, and some one block later, which is not
cte("in_time", f"""SELECT user_id // 50 AS match_id, event_id, ts, event_type, value / 1000 AS xg, block FROM blocks
  WHERE NOT (event_id % 20 = 11 AND block + 2 <= {LAST_BLOCK} AND day < 5)""", "blocks")
cte("end_of_time", "SELECT max(ts) AS latest FROM events")


def land_blocks(spark, d, path, blocks):
    """The events of six days a file, one after the other, with those that come late in the file of a later block."""
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400) - 19723
    block, in_block = F.floor(day / 6), day % 6
    late = F.when((F.col("event_id") % 20 == 11) & (in_block < 5), 2).when((F.col("event_id") % 20 == 7) & (in_block < 5), 1).otherwise(0)
    events = T.table(spark, d, "events").withColumn("file", F.when(block + late <= LAST_BLOCK, block + late).otherwise(block))
    for k in blocks:
        events.filter(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(path)


def block_stream(spark, d, path):
    stream = spark.readStream.schema(T.table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr("user_id div 50").alias("match_id"), "event_type",
                         (F.col("value") / 1000).alias("xg"))


@register("windowed_xg_closed", query("""
SELECT match_id, epoch(time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k)::BIGINT AS window_start,
  round(sum(xg), 5) AS xg, count(*) AS events FROM in_time, (SELECT unnest([0, 1]) AS k), end_of_time
GROUP BY ALL HAVING time_bucket(INTERVAL 30 MINUTE, any_value(ts)) - INTERVAL 30 MINUTE * any_value(k) + INTERVAL 60 MINUTE
  <= any_value(latest) - INTERVAL 10 MINUTE""", "in_time", "end_of_time"))
def windowed_xg_closed(spark, d):
    """Windows that the watermark has closed, over five micro-batches; events that come after their window closed don't count."""
    path = scratch_path(spark, "blocks")
    land_blocks(spark, d, path, range(LAST_BLOCK + 1))
    out = _drained(spark, windows.windowed_xg(block_stream(spark, d, path), "60 minutes", "30 minutes", "ts"), False)
    return out.select("match_id", F.unix_timestamp("window_start").alias("window_start"), (F.round("xg", 5) + 0.0).alias("xg"), "events")


cte("spells", """SELECT *, sum(new::INT) OVER (PARTITION BY match_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY match_id ORDER BY ts, event_id) >= INTERVAL 10 MINUTE, true) AS new FROM in_time)""", "in_time")


@register("session_xg_closed", query("""
SELECT match_id, floor(epoch(min(ts)))::BIGINT AS first_event, round(sum(xg), 5) AS xg, count(*) AS events FROM spells, end_of_time
GROUP BY match_id, s HAVING max(ts) + INTERVAL 10 MINUTE <= any_value(latest) - INTERVAL 10 MINUTE""", "spells", "end_of_time"))
def session_xg_closed(spark, d):
    """Spells that the watermark has closed."""
    path = scratch_path(spark, "blocks")
    land_blocks(spark, d, path, range(LAST_BLOCK + 1))
    out = _drained(spark, windows.session_xg(block_stream(spark, d, path), "10 minutes", "ts"), False)
    return out.select("match_id", F.unix_timestamp("window_start").alias("first_event"), (F.round("xg", 5) + 0.0).alias("xg"), "events")


cte("poll_spells", """SELECT *, sum(new::INT) OVER (PARTITION BY fixture_id ORDER BY ts, event_id) AS s FROM (
  SELECT user_id AS fixture_id, event_id, ts, event_type, value / 1000 AS xg,
    coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS new FROM blocks
  WHERE event_id % 20 <> 11 AND event_id % 20 <> 7)""", "blocks")


@register("live_fixture_state", query("""
SELECT fixture_id, epoch_us(min(ts)) AS first_poll, epoch_us(max(ts)) AS last_poll, count(*) AS polls, round(sum(xg), 5) AS xg,
  (SELECT string_agg(event_type, ',' ORDER BY t, e) FROM (SELECT event_type, arg_min(i.event_id, i.ts) AS e, min(i.ts) AS t FROM poll_spells i
     WHERE i.fixture_id = o.fixture_id AND i.s = o.s GROUP BY event_type)) AS kinds
FROM poll_spells o, (SELECT max(ts) AS latest FROM poll_spells) GROUP BY fixture_id, s
HAVING max(ts) + INTERVAL 6 HOUR <= any_value(latest) - INTERVAL 10 MINUTE""", "poll_spells"))
def live_fixture_state(spark, d):
    """Spells in which a fixture was polled, as keyed state over five micro-batches with a restart after the third."""
    base = scratch_path(spark, "live-state")
    for key, value in live_state.STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        for blocks in (range(3), range(3, LAST_BLOCK + 1)):
            land_blocks(spark, d, f"{base}/landed", blocks)
            stream = spark.readStream.schema(T.table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landed")
            polls = stream.filter("event_id % 20 not in (7, 11)").select(
                F.col("user_id").alias("fixture_id"), F.col("ts").cast("timestamp").alias("polled_at"), "event_type", "event_id",
                (F.col("value") / 1000).alias("xg"))
            spells = live_state.ended_spells(polls, "6 hours", "10 minutes")
            windows.to_table(spells, f"{base}/table", f"{base}/checkpoint", None).awaitTermination()
    finally:
        for key in live_state.STATE_STORE:
            spark.conf.unset(key)
    return spark.read.parquet(f"{base}/table").select(
        "fixture_id", F.unix_micros("first_poll").alias("first_poll"), F.unix_micros("last_poll").alias("last_poll"), "polls",
        (F.round("xg", 5) + 0.0).alias("xg"), "kinds")
