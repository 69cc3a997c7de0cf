"""Keyed state as Parquet tables partitioned by (league_id, season).

A change rewrites only the partitions it touches: those of the new rows and those where the changed fixtures lie now, so a
fixture whose league or season is corrected moves and leaves nothing behind, and rows without a league or season are kept
like any other. The new content of these partitions is computed by joins, written to the shared folder, and put in force by Spark's own
partitioned overwrite in dynamic mode, which leaves all other partitions alone; a job that fails before its commit leaves the old
state. One writer at a time. Replaying a batch gives the same state, also after a driver that died while the commit moved folders.

Every touched fixture leaves a marker row (no stint or player id), so that a fixture whose rows were all cleared is known, and
every rewritten partition a row without a fixture, so that one that lost its last fixture is overwritten too; readers skip both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline import schemas
from pitchline.operators.feed import PLAYER_METRICS
from pitchline.operators.stints import with_stint_index
from pitchline.session import materialize

PARTITION = ["league_id", "season"]


def _read(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    empty = spark.createDataFrame([], schema)
    try:
        stored = spark.read.schema(schema).parquet(f"{root}/{table}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    return stored.select(*empty.columns).filter(F.col("fixture_id").isNotNull())


def _within(partitions: DataFrame) -> Column:
    """Condition on the partition columns, so that only these folders are read. There are as many as leagues and seasons change at once."""
    same = [F.col("league_id").eqNullSafe(F.lit(r.league_id)) & F.col("season").eqNullSafe(F.lit(r.season)) for r in partitions.toLocalIterator()]
    return reduce(lambda a, b: a | b, same, F.lit(False))


def _swap(root: str, table: str, schema: str, partitions: DataFrame, rows: DataFrame) -> None:
    """Put ``rows`` in the place of all that the ``partitions`` held."""
    spark = rows.sparkSession
    shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema])
    whole = materialize(shaped.unionByName(partitions.select(*PARTITION).distinct(), allowMissingColumns=True), "state")
    whole.hint("rebalance", *PARTITION).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*PARTITION).parquet(f"{root}/{table}")


def _replace(root: str, table: str, schema: str, touched: DataFrame, new: DataFrame) -> None:
    """Replace all rows of the ``touched`` fixtures (fixture_id, league_id, season), wherever they lie, by ``new``."""
    touched = materialize(touched.select("fixture_id", *PARTITION).distinct(), "touched")
    stored = _read(touched.sparkSession, root, table, schema)
    ids = touched.select("fixture_id").distinct()
    lies = stored.select("fixture_id", *PARTITION).join(ids, "fixture_id", "left_semi")
    partitions = materialize(touched.select(*PARTITION).unionByName(lies.select(*PARTITION)).distinct(), "partitions")
    kept = stored.filter(_within(partitions)).join(ids, "fixture_id", "left_anti")
    _swap(root, table, schema, partitions, kept.unionByName(new.select(*kept.columns)))


def latest(records: DataFrame, key: str = "fixture_id", order: str = "last_synced_at") -> DataFrame:
    """The latest record of every key; of several with the same time the one with the largest values, column by column."""
    last = F.max_by(F.struct(*records.columns), F.struct(order, *[c for c in records.columns if c != order]))
    return records.groupBy(key).agg(last.alias("r")).select("r.*")


def upsert_fixtures(root: str, records: DataFrame) -> None:
    """Insert or fully replace fixture rows by key."""
    new = latest(records)
    _replace(root, "fixtures", schemas.STATE_FIXTURES, new.select("fixture_id", *PARTITION), new)


def replace_stints(root: str, touched: DataFrame, stints: DataFrame, is_live: bool) -> None:
    """Replace the stints of the touched fixtures; a fixture without new stints is cleared."""
    keyed = with_stint_index(stints, ["game_id"]).select(
        F.col("game_id").alias("fixture_id"), "stint_index", F.col("start").alias("start_minute"), F.col("end").alias("end_minute"),
        "duration", "home_team_id", "away_team_id", "home_players", "away_players", "xg_diff", "score_diff", "red_home", "red_away",
        F.lit(is_live).alias("is_live"), *PARTITION)
    markers = touched.select("fixture_id", *PARTITION).distinct()
    _replace(root, "stints", schemas.STATE_STINTS, touched.distinct(),
             keyed.unionByName(markers, allowMissingColumns=True))


def replace_player_rows(root: str, touched: DataFrame, rows: DataFrame) -> None:
    """Replace the player rows of the touched fixtures; of several rows of one player the one with most minutes stays."""
    keyed = rows.withColumnRenamed("game_id", "fixture_id").join(touched.select("fixture_id", *PARTITION).distinct(), "fixture_id")
    one = keyed.groupBy("fixture_id", "player_id").agg(
        F.max_by(F.struct(*keyed.columns), F.struct("minutes", "team_id")).alias("r")).select("r.*")
    markers = touched.select("fixture_id", *PARTITION).distinct()
    _replace(root, "player_match_stats", schemas.STATE_PLAYERS, touched.distinct(),
             one.unionByName(markers, allowMissingColumns=True))


def mark_not_live(root: str, live: DataFrame, league_id: int | None = None) -> None:
    """Clear the live flag of every stored fixture (of the league) that is not in ``live`` (fixture_id).

    Only partitions that still hold a wrongly flagged fixture are rewritten.
    """
    stored = _read(live.sparkSession, root, "fixtures", schemas.STATE_FIXTURES)
    gone = stored.filter("is_live")
    if league_id is not None:
        gone = gone.filter(F.col("league_id") == league_id)
    gone = materialize(gone.select("fixture_id", *PARTITION).join(live.select("fixture_id").distinct(), "fixture_id", "left_anti"), "ended")
    if gone.isEmpty():
        return
    partitions = gone.select(*PARTITION).distinct()
    flagged = gone.select("fixture_id", F.lit(True).alias("__gone")).distinct()
    rows = stored.filter(_within(partitions)).join(flagged, "fixture_id", "left")
    cleared = rows.withColumn("is_live", F.when(F.col("__gone"), F.lit(False)).otherwise(F.col("is_live")))
    _swap(root, "fixtures", schemas.STATE_FIXTURES, partitions, cleared.select(*stored.columns))


def read_fixtures(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "fixtures", schemas.STATE_FIXTURES).orderBy(F.col("date").asc_nulls_first(), "fixture_id")


def stored_stints(spark: SparkSession, root: str) -> DataFrame:
    """Stored stints in the form the ratings take, in no order."""
    rows = _read(spark, root, "stints", schemas.STATE_STINTS).filter(F.col("stint_index").isNotNull())
    return rows.withColumnsRenamed({"fixture_id": "game_id", "start_minute": "start", "end_minute": "end"}).drop("is_live")


def read_stints(spark: SparkSession, root: str) -> DataFrame:
    """``stored_stints`` ordered by fixture and index, for reports."""
    return stored_stints(spark, root).orderBy("game_id", "stint_index")


def read_player_rows(spark: SparkSession, root: str) -> DataFrame:
    rows = _read(spark, root, "player_match_stats", schemas.STATE_PLAYERS).filter(F.col("player_id").isNotNull())
    return rows.select("fixture_id", "team_id", "player_id", "player", "minutes", "position", *PLAYER_METRICS, *PARTITION)


def encode_lineups(stints: DataFrame) -> DataFrame:
    """Line-ups as JSON text, for sinks without arrays."""
    return stints.withColumns({c: F.to_json(c) for c in ("home_players", "away_players")})


def decode_lineups(stints: DataFrame) -> DataFrame:
    return stints.withColumns({c: F.from_json(c, "array<bigint>") for c in ("home_players", "away_players")})
