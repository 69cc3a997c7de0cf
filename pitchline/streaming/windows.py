"""Event-time jobs over the live events: repeats across polls, xG per tumbling or sliding window, xG per session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ("match_id", "minute", "event_type", "team_id", "player_id")


def deduplicated(events: DataFrame, keys: Sequence[str] = KEYS, time: str = "ingested_at", delay: str = "2 hours") -> DataFrame:
    """Each event once, though every poll lists it anew. A key is forgotten ``delay`` after its event, so state stays bounded."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_xg(events: DataFrame, width: str = "15 minutes", slide: str | None = None, time: str = "ingested_at",
                match: str = "match_id", delay: str = "10 minutes") -> DataFrame:
    """xG and events per match and event-time window; tumbling, or sliding by ``slide``. Events later than ``delay`` don't count."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    sums = events.withWatermark(time, delay).groupBy(window.alias("w"), match).agg(F.sum("xg").alias("xg"), F.count(F.lit(1)).alias("events"))
    return sums.select(match, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "xg", "events")


def session_xg(events: DataFrame, gap: str = "15 minutes", time: str = "ingested_at", match: str = "match_id",
               delay: str = "10 minutes") -> DataFrame:
    """xG and events per match and spell of play: a spell ends ``gap`` after its last event."""
    sums = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), match).agg(
        F.sum("xg").alias("xg"), F.count(F.lit(1)).alias("events"))
    return sums.select(match, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "xg", "events")


def to_table(stream: DataFrame, path: str, checkpoint: str, every: str | None = "60 seconds", complete: bool = False) -> StreamingQuery:
    """Append closed windows (or events) to a Parquet folder; ``complete`` rewrites all windows, open ones too, with each batch.

    ``every=None`` takes what is there and ends.
    """
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
    if complete:
        return writer.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    return writer.outputMode("append").format("parquet").option("path", path).start()
