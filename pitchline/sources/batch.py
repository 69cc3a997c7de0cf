"""Readers of the batch tables, match documents and rating files. Each reads the rows of all its files in one scan."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline import schemas
from pitchline.session import materialize


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _headers(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, header) of every file that matches: the first line of the split at a file's beginning, found where the file is read."""
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
                                            F.monotonically_increasing_id().alias("n"))
    first = lines.filter("at = 0").groupBy("path").agg(F.min_by("value", "n").alias("header"))
    return first.withColumn("header", F.regexp_replace("header", "^\ufeff", "")).filter("header <> ''")


def read_text_tables(spark: SparkSession, pattern: str, **of_file: Column) -> DataFrame:
    """CSV files as one table of text columns, joined by column name: files may differ in columns and in their order.

    Headers are found by the executors; the driver sees each distinct header line once, whatever the number of files. Rows are one scan
    by position, and a row's values take the names of its own file's header. A column that a file lacks is NULL there;
    a file without a header line gives nothing. ``file`` holds the decoded path; ``of_file`` names further columns made from ``file``. These
    are worked out once a file, not once a row.
    """
    headers = materialize(_headers(spark, pattern), "headers")
    known = [(r.header, next(csv.reader([r.header]))) for r in headers.select("header").distinct().orderBy("header").collect()]
    if not known:
        raise FileNotFoundError(f"no file with a header matches {pattern}")
    width = max(len(names) for _, names in known)
    placed = headers.withColumn("file", _decoded(F.col("path"))).withColumns(of_file)
    numbered = materialize(placed.select("path", "file", *of_file, sum((F.when(F.col("header") == line, i).otherwise(0) for i, (line, _) in enumerate(known)), F.lit(0)).alias("kind")), "files")
    rows = spark.read.schema(", ".join(f"_c{i} string" for i in range(width))).option("header", True).option("enforceSchema", True).option("escape", '"').csv(pattern) \
        .select("*", F.col("_metadata.file_path").alias("path")).join(numbered, "path")

    def column(name: str) -> Column:
        held = [F.when(F.col("kind") == i, F.col(f"_c{names.index(name)}")) for i, (_, names) in enumerate(known) if name in names]
        return F.coalesce(*held).alias(name)

    every = dict.fromkeys(name for _, names in known for name in names)
    return rows.select(*[column(name) for name in every], "file", *of_file)


def _decoded(path: Column) -> Column:
    """A path as it is written; Spark's file paths are URIs, in which a plus sign means itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_league_seasons(spark: SparkSession, root: str, leagues: str = "*", seasons: str = "*") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Schedule, player rows and shots of all matching ``<league>/<season>_<table>.csv`` files; NaN becomes NULL.

    League and season are the names of the folder and the file; a file may be a folder of part files. Read files must not change meanwhile.
    """
    def table(suffix: str, schema: str) -> DataFrame:
        columns = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
        place = rf"([^/]+)/([^/]+)_{suffix}\.csv(?:/[^/]+)?$"
        text = read_text_tables(spark, f"{root}/{leagues}/{seasons}_{suffix}.csv", __league=F.regexp_extract("file", place, 1),
                                __season=F.regexp_extract("file", place, 2))
        number = lambda c, t: F.nullif(F.col(c).try_cast("double"), F.lit(float("nan"))).try_cast(t) if t != "string" else F.col(c)
        return text.select(F.col("__league").alias("league"), F.col("__season").alias("season"),
                           *[number(c, t).alias(c) if c in text.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])
    return (table("schedule", schemas.SCHEDULE), table("player_match_stats", schemas.PLAYER_MATCH), table("shot_events", schemas.SHOT_EVENTS))


def list_seasons(spark: SparkSession, root: str, leagues: str = "*") -> DataFrame:
    """(league, season) pairs that have player rows, from file names alone."""
    files = spark.read.format("binaryFile").load(f"{root}/{leagues}/*_player_match_stats.csv").select("path")
    place = r"([^/]+)/([^/]+)_player_match_stats\.csv(?:/[^/]+)?$"
    return files.select(F.regexp_extract("path", place, 1).alias("league"), F.regexp_extract("path", place, 2).alias("season")) \
        .distinct().orderBy("league", "season")


def read_match_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per match document; documents with timeline data and unreadable files are left out."""
    docs = spark.read.schema(schemas.MATCH_DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(pattern)
    return docs.filter(F.col("timelineData").isNull() & F.col("_corrupt_record").isNull()).drop("timelineData", "_corrupt_record")


def document_shots(docs: DataFrame) -> DataFrame:
    """Shots of both sides, typed; text that is no number becomes NULL."""
    none = F.array().cast(docs.schema["shotsData"].dataType["h"].dataType)
    both = docs.select(F.explode(F.concat(F.coalesce("shotsData.h", none), F.coalesce("shotsData.a", none))).alias("s"))
    s = lambda name, kind: F.col(f"s.{name}").try_cast(kind)
    return both.select(
        F.col("s.match_id").alias("game_id"), "s.player_id", "s.player", s("minute", "int").alias("minute"), s("X", "double").alias("x"),
        s("Y", "double").alias("y"), s("xG", "double").alias("xg"), s("h_goals", "int").alias("h_goals"),
        s("a_goals", "int").alias("a_goals"), "s.result", "s.situation", "s.h_a", "s.h_team", "s.a_team",
        F.col("s.lastAction").alias("last_action"), F.col("s.shotType").alias("shot_type"))


def document_appearances(docs: DataFrame) -> DataFrame:
    """Appearances of both rosters with their match, typed."""
    side = lambda name: docs.select("match_id", F.explode(F.map_values(F.col(f"rostersData.{name}"))).alias("a"))
    a = lambda name, kind: F.col(f"a.{name}").try_cast(kind)
    return side("h").unionByName(side("a")).select(
        F.col("match_id").alias("game_id"), "a.player_id", "a.player", "a.team_id", "a.h_a", a("xG", "double").alias("xg"),
        a("time", "int").alias("minutes"), a("goals", "int").alias("goals"), a("own_goals", "int").alias("own_goals"),
        a("shots", "int").alias("shots"))


def require_columns(df: DataFrame, columns: set[str], what: str) -> DataFrame:
    missing = columns - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)} in {what}")
    return df


def _read_ratings(spark: SparkSession, pattern: str) -> DataFrame:
    """Rating files by column name; ids and figures typed, season kept as text."""
    text = read_text_tables(spark, pattern).drop("file")
    numeric = [c for c in text.columns if c not in ("player", "position", "league", "season", "player_id")]
    typed = text.withColumns({c: F.col(c).try_cast("double") for c in numeric})
    return typed.withColumn("player_id", F.col("player_id").try_cast("bigint")) if "player_id" in text.columns else typed


def read_epm(spark: SparkSession, root: str) -> DataFrame:
    """All ``*_epm.csv`` files of a folder as one table of seven columns."""
    pattern = f"{root}/*_epm.csv"
    if not _exists(spark, pattern):
        raise FileNotFoundError(f"no *_epm.csv in {root}")
    df = require_columns(_read_ratings(spark, pattern), {"player_id", "league", "season", "minutes", "epm"}, pattern)
    for c in ("player", "position"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select("player_id", "player", "position", "minutes", "league", "season", "epm")


def read_series(spark: SparkSession, root: str, metric: str = "auto", input_file: str | None = None) -> tuple[DataFrame, str]:
    """Rating series and its value column; the first source that exists wins.

    An explicit file, then gpm_translated.csv, gpm.csv, *_gpm.csv, epm_translated.csv and *_epm.csv, as far as ``metric`` allows.
    """
    if input_file and _exists(spark, input_file):
        df = _read_ratings(spark, input_file)
        column = metric if metric != "auto" else ("epm_translated" if "epm_translated" in df.columns else "epm")
        if metric != "auto" and metric not in df.columns:
            raise ValueError(f"metric {metric} not found in {input_file}")
        return df, column
    order = [("gpm_translated", "gpm_translated.csv"), ("gpm", "gpm.csv"), ("gpm", "*_gpm.csv"),
             ("epm_translated", "epm_translated.csv"), ("epm", "*_epm.csv")]
    for column, name in order:
        if metric in (column, "auto") and _exists(spark, f"{root}/{name}"):
            return _read_ratings(spark, f"{root}/{name}"), column
    raise FileNotFoundError(f"no input for metric {metric} in {root}")
