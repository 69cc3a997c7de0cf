"""Batch and streaming jobs over the landed feed: sync of finished and live fixtures, recompute, publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pitchline import sinks
from pitchline.operators import feed
from pitchline.operators.ridge import ALPHA_GRID
from pitchline.plans.ratings import rate_from_feed
from pitchline.session import materialize, scratch
from pitchline.sources.feed import of_league, split_polls
from pitchline.streaming import state
from pitchline.streaming.normalize import normalize


def sync_finished(root: str, fixtures: DataFrame, parts: dict[str, DataFrame], limit: int | None = None,
                  min_stint_minutes: float = 1.0, per_season: bool = False) -> DataFrame:
    """Store finished fixtures (the first ``limit`` of all, or of each league and season) with their stints and player rows; one-row
    count of what was stored."""
    chosen = materialize(feed.first_fixtures(feed.finished_fixtures(fixtures), limit, per_season), "finished")
    records = feed.fixture_records(chosen, parts["statistics"], is_live=False)
    touched = feed.fixture_heads(chosen).select("fixture_id", *state.PARTITION)
    stints = feed.build_feed_stints(chosen, parts["statistics"], parts["events"], parts["lineups"], parts["players"], min_stint_minutes)
    rows = feed.player_rows(parts["players"].join(touched.select("fixture_id"), "fixture_id", "left_semi"))
    state.upsert_fixtures(root, records)
    state.replace_stints(root, touched, stints, is_live=False)
    state.replace_player_rows(root, touched, rows)
    return touched.agg(F.count(F.lit(1)).alias("fixtures"))


def sync_live(root: str, fixtures: DataFrame, parts: dict[str, DataFrame], league_id: int | None = None,
              min_stint_minutes: float = 1.0) -> DataFrame:
    """Store fixtures in play; stints are replaced only where there are new ones; fixtures no longer listed are unflagged.

    ``fixtures`` may carry ``is_live`` (False for one that an earlier poll of the batch listed and the last one did not).
    """
    mine = fixtures if league_id is None else of_league(fixtures, league_id)
    if "is_live" not in mine.columns:
        mine = mine.withColumn("is_live", F.lit(True))
    mine = materialize(mine, "live")
    records = feed.fixture_records(mine, parts["statistics"], is_live=True)
    live = mine.filter("is_live").select(F.col("fixture.id").cast("bigint").alias("fixture_id"))
    stints = materialize(feed.build_feed_stints(mine, parts["statistics"], parts["events"], parts["lineups"], None, min_stint_minutes),
                         "live-stints")
    touched = stints.select(F.col("game_id").alias("fixture_id"), *state.PARTITION).distinct()
    state.upsert_fixtures(root, records)
    state.replace_stints(root, touched, stints, is_live=True)
    state.mark_not_live(root, live, league_id)
    return live.agg(F.count(F.lit(1)).alias("live_fixtures"))


def current_ratings(spark: SparkSession, root: str, league_id: int | None = None, season: int | None = None, min_minutes: int = 300,
                    alphas=ALPHA_GRID) -> DataFrame:
    """Ratings from the stored state, per league and season; optionally of one of them."""
    stints, rows = state.stored_stints(spark, root), state.read_player_rows(spark, root)
    for column, wanted in (("league_id", league_id), ("season", season)):
        if wanted is not None:
            stints, rows = stints.filter(F.col(column) == wanted), rows.filter(F.col(column) == wanted)
    if stints.isEmpty():
        raise RuntimeError("no stints are stored yet; sync finished or live fixtures first")
    if rows.isEmpty():
        raise RuntimeError("no player rows are stored yet; sync finished fixtures first")
    return rate_from_feed(stints, rows, state.PARTITION, min_minutes, alphas)


def recompute(spark: SparkSession, root: str, out: str, league_id: int | None = None, season: int | None = None,
              min_minutes: int = 300, fmt: str = "csv") -> None:
    """Write the current snapshot of ratings, fixtures and summary."""
    rated = materialize(current_ratings(spark, root, league_id, season, min_minutes), "current")
    sinks.write_current(rated, state.read_fixtures(spark, root), out, fmt)


def run_live(polls: DataFrame, root: str, checkpoint: str, out: str | None = None, league_id: int | None = None,
             every: str | None = "600 seconds", backfill_first: tuple[DataFrame, dict[str, DataFrame]] | None = None) -> StreamingQuery:
    """Live cycle as a stream of polls: sync, then recompute. ``every=None`` takes what is there and ends.

    ``backfill_first`` (fixtures of a season and their lists) stores its finished fixtures before the first cycle.
    """
    if backfill_first is not None:
        with scratch(polls.sparkSession):
            sync_finished(root, *backfill_first)

    def cycle(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            parts = split_polls(materialize(batch, f"poll-{batch_id}"))
            sync_live(root, parts["fixtures"], parts, league_id)
            if out:
                recompute(batch.sparkSession, root, out, league_id)

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return polls.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def publish(payloads: DataFrame, raw_path: str, event_path: str, checkpoint: str, every: str | None = "10 seconds",
            source: str = "live-feed") -> StreamingQuery:
    """Raw payloads and the events in them to two JSON-lines folders, one folder per batch, so a replay overwrites itself.

    The batch is read from its source once and held for the second folder. Events have so many columns that their projection is a method
    that the JVM leaves uncompiled beyond 8,000 bytes; in the stream's own session Spark cuts it up instead.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        kept = batch.filter(F.col("value").isNotNull() & (F.trim("value") != "")).persist()
        try:
            kept.select("value").write.mode("overwrite").text(f"{raw_path}/batch={batch_id}")
            normalize(kept, source=source).write.mode("overwrite").json(f"{event_path}/batch={batch_id}")
        finally:
            kept.unpersist()

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def publish_to_topics(payloads: DataFrame, servers: str, checkpoint: str, raw_topic: str = "live-raw", event_topic: str = "live-events",
                      every: str = "10 seconds") -> StreamingQuery:
    """The same two streams as messages on a Kafka cluster (needs the Kafka connector on the class path)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()                         # read from its source once
        try:
            raw = kept.select(F.lit(raw_topic).alias("topic"), F.col("value").cast("string").alias("value"))
            events = sinks.as_messages(normalize(kept), event_topic)
            raw.unionByName(events).write.format("kafka").option("kafka.bootstrap.servers", servers).save()
        finally:
            kept.unpersist()

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
