"""Readers of landed feed documents: season fixtures, the four per-fixture lists, leagues and polls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline import schemas
from pitchline.functions import scalars as S
from pitchline.operators.common import attach_totals
from pitchline.session import materialize

POSITION = {"events": "event_pos", "lineups": "lineup_pos", "players": "block_pos", "statistics": "stat_pos"}


def read_fixtures(spark: SparkSession, pattern: str) -> DataFrame:
    """Fixtures of landed season documents ``{"response": [...]}``."""
    fields = schemas.POLL.split("response array<", 1)[1]
    item = "struct<" + fields.split("struct<", 1)[1].split(", events:", 1)[0] + ">"
    docs = spark.read.schema(f"response array<{item}>").option("multiLine", True).json(pattern)
    return docs.select(F.explode("response").alias("f")).select("f.*")


def read_endpoint(spark: SparkSession, pattern: str, endpoint: str) -> DataFrame:
    """One per-fixture list (events, lineups, players or statistics) of landed ``{"fixture": id, "response": [...]}`` documents."""
    schema = f"fixture bigint, response array<{schemas.ENDPOINTS[endpoint]}>"
    docs = spark.read.schema(schema).option("multiLine", True).json(pattern)
    return docs.select(F.col("fixture").alias("fixture_id"), F.posexplode("response").alias(POSITION[endpoint], "r")).select(
        "fixture_id", F.col(POSITION[endpoint]).cast("bigint").alias(POSITION[endpoint]), "r.*")


def read_delivered_players(spark: SparkSession, pattern: str) -> DataFrame:
    """The player lists as the feed sends them: ``fixture_id``, ``block_pos`` and ``players``, a VARIANT with every name in it."""
    docs = spark.read.option("singleVariantColumn", "d").option("multiLine", True).json(pattern)
    blocks = F.posexplode(F.try_variant_get("d", "$.response", "array<variant>")).alias("block_pos", "b")
    rows = docs.select(F.try_variant_get("d", "$.fixture", "bigint").alias("fixture_id"), blocks)
    return rows.select("fixture_id", F.col("block_pos").cast("bigint").alias("block_pos"), F.try_variant_get("b", "$.players", "variant").alias("players"))


def read_bundles(spark: SparkSession, root: str, with_players: bool = True) -> dict[str, DataFrame]:
    """The per-fixture lists of all fixtures, each in one scan of its folder; the live form has no player list."""
    names = [n for n in schemas.ENDPOINTS if with_players or n != "players"]
    return {n: read_endpoint(spark, f"{root}/{n}/*.json", n) for n in names}


def read_leagues(spark: SparkSession, pattern: str) -> DataFrame:
    docs = spark.read.schema(f"response array<{schemas.LEAGUE}>").option("multiLine", True).json(pattern)
    return docs.select(F.explode("response").alias("l")).select("l.*")


def of_league(fixtures: DataFrame, league_id: int) -> DataFrame:
    """Fixtures of one league (for the live list, which holds every league)."""
    return fixtures.filter(S.safe_int("league.id") == league_id)


def stream_polls(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Stream of landed poll documents, one row per poll."""
    return spark.readStream.schema(schemas.POLL).option("maxFilesPerTrigger", max_files).json(path)


def stream_payloads(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Stream of raw payload text, one per line of the landed files; a Kafka source gives the same ``value`` column."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def split_polls(polls: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of the polls: every fixture once, as its latest poll showed it, and its lists.

    ``is_live`` tells whether the latest poll of all still listed the fixture.
    """
    listed = polls.select("polled_at", F.explode("response").alias("b"))
    listed = listed.withColumn("fixture_id", S.safe_int("b.fixture.id")).filter(F.col("fixture_id").isNotNull())
    latest = listed.groupBy("fixture_id").agg(F.max_by("b", "polled_at").alias("b"), F.max("polled_at").alias("polled_at"))
    last_poll = polls.agg(F.max("polled_at").alias("last_poll"))
    latest = materialize(attach_totals(latest, last_poll).withColumn("is_live", F.col("polled_at") == F.col("last_poll")), "latest")
    parts = {"fixtures": latest.select("b.fixture", "b.teams", "b.goals", "b.league", "is_live")}
    for name, position in POSITION.items():
        rows = latest.select("fixture_id", F.posexplode(f"b.{name}").alias(position, "r"))
        parts[name] = rows.select("fixture_id", F.col(position).cast("bigint").alias(position), "r.*")
    return parts
