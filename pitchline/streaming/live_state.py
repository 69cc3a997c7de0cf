"""Fixtures in play as keyed stream state: what the polls said, until a fixture is no longer polled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: transformWithState keeps its state in this store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SPELL = "fixture_id long, first_poll timestamp, last_poll timestamp, polls long, xg double, kinds string"


class _Spells(StatefulProcessor):
    """A value per fixture (times, polls, xG so far) and the list of kinds of events in the order in which they first came."""

    def __init__(self, grace_ms: int) -> None:
        self.grace = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spell = handle.getValueState("spell", "first long, last long, polls long, xg double")
        self.kinds = handle.getListState("kinds", "kind string")

    @staticmethod
    def _frame(ended: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(ended, columns=["fixture_id", "first_poll", "last_poll", "polls", "xg", "kinds"])
        for c in ("first_poll", "last_poll"):
            out[c] = pd.to_datetime(out[c], unit="us")
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """State is read once and written once, however many polls there are: each access is a message to the executor."""
        polls = pd.concat(list(rows)).sort_values(["at", "poll_id"])
        spell, kinds, ended = self.spell.get(), [], []
        if spell is not None:
            kinds = [k[0] for k in self.kinds.get()]
            self.handle.deleteTimer(spell[1] // 1000 + self.grace)
        for at, kind, xg in zip(polls["at"].tolist(), polls["kind"].tolist(), polls["xg"].tolist()):
            if spell is not None and at - spell[1] >= 1000 * self.grace:
                ended.append((key[0], *spell, ",".join(kinds)))
                spell, kinds = None, []
            first, last, n, total = spell or (at, at, 0, 0.0)
            spell = (first, max(last, at), n + 1, total + xg)
            if kind not in kinds:
                kinds.append(kind)
        self.spell.update(spell)
        self.kinds.put([(kind,) for kind in kinds])
        self.handle.registerTimer(spell[1] // 1000 + self.grace)
        if ended:
            yield self._frame(ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spell = self.spell.get()
        if spell is not None:
            kinds = ",".join(k[0] for k in self.kinds.get())
            self.spell.clear()
            self.kinds.clear()
            yield self._frame([(key[0], *spell, kinds)])

    def close(self) -> None:
        pass


def ended_spells(polls: DataFrame, grace: str = "15 minutes", delay: str = "10 minutes", time: str = "polled_at", fixture: str = "fixture_id",
                 kind: str = "event_type", xg: str = "xg", poll_id: str = "event_id") -> DataFrame:
    """One row per spell of play of a stream of polls, put out once the fixture was not polled for ``grace``.

    The rows of one fixture in a micro-batch are put in order; a pause of ``grace`` or more between two polls ends a spell there and then, and a
    timer at the last poll plus ``grace`` ends it when the watermark, ``delay`` behind the latest poll of any fixture, has passed it. So
    the result doesn't depend on how polls fall into batches, and state holds only fixtures in play. Polls without a time or later
    than the watermark don't count; a null kind is listed as ``-``, a null xG is 0. The session needs the RocksDB state
    store (``STATE_STORE``).
    """
    grace_ms = polls.sparkSession.sql(f"SELECT cast(unix_micros(timestamp_micros(0) + INTERVAL {grace}) / 1000 AS long)").first()[0]
    rows = polls.filter(F.col(time).isNotNull()).withWatermark(time, delay).select(
        F.col(fixture).cast("long").alias("fixture_id"), F.col(time).alias("polled_at"), F.unix_micros(time).alias("at"),
        F.coalesce(F.col(kind), F.lit("-")).alias("kind"), F.coalesce(F.col(xg), F.lit(0.0)).cast("double").alias("xg"), F.col(poll_id).alias("poll_id"))
    return rows.groupBy("fixture_id").transformWithStateInPandas(_Spells(grace_ms), SPELL, "append", "EventTime")
