"""Writers of rating files, translation results, run outputs and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.operators.common import attach_totals
from pitchline.plans.ratings import RATINGS, metric_files, top_report


def write_metric_files(rated: DataFrame, path: str, metrics: Sequence[str] = RATINGS, fmt: str = "csv") -> None:
    """Ratings in long form under ``metric=/league=/season=`` folders, one write for all of them."""
    writer = metric_files(rated, metrics).write.mode("overwrite").partitionBy("metric", "league", "season").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    flat = df
    if fmt == "csv":
        arrays = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
        flat = df.withColumns({c: F.to_json(c) for c in arrays})
    writer = flat.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_translation(coefficients: DataFrame, translated: DataFrame, gpm: DataFrame | None, path: str,
                      with_translated: bool = False, fmt: str = "csv") -> None:
    """League coefficients always, translated ratings on request, GPM unless it is None."""
    write_table(coefficients, f"{path}/league_translation", fmt)
    if with_translated:
        write_table(translated, f"{path}/epm_translated", fmt)
    if gpm is not None:
        write_table(gpm, f"{path}/gpm", fmt)


def write_stability(table: DataFrame, path: str, fmt: str = "csv") -> None:
    write_table(table, f"{path}/player_stability", fmt)


def run_summary(rated: DataFrame, stints: DataFrame, fixtures: DataFrame, **labels) -> DataFrame:
    """One row: fixtures used, stints built, players scored, and the run's labels."""
    row = rated.agg(F.count_distinct("player_id").alias("players_scored"))
    row = attach_totals(row, stints.agg(F.count(F.lit(1)).alias("stints_built")))
    row = attach_totals(row, fixtures.agg(F.count(F.lit(1)).alias("fixtures_used")))
    note = "team-level expected goals are spread evenly over each match"
    return row.select("*", F.lit(note).alias("xg_model_note"), *[F.lit(v).alias(k) for k, v in labels.items()])


def write_run(rated: DataFrame, stints: DataFrame, player_rows: DataFrame, fixtures: DataFrame, path: str, fmt: str = "csv",
              **labels) -> None:
    """Everything a rating run over the feed leaves behind."""
    for name, df in (("metrics", rated), ("stints", stints), ("player_match_stats", player_rows), ("fixtures_used", fixtures)):
        write_table(df, f"{path}/{name}", fmt)
    run_summary(rated, stints, fixtures, **labels).write.mode("overwrite").json(f"{path}/metadata")


def current_summary(rated: DataFrame, fixtures: DataFrame) -> DataFrame:
    """One row: players scored, live fixtures, top ten, time of update."""
    live = fixtures.agg(F.count_if("is_live").alias("live_fixtures"))
    return attach_totals(top_report(rated), live).withColumn("updated_at", F.date_trunc("second", F.current_timestamp()))


def write_current(rated: DataFrame, fixtures: DataFrame, path: str, fmt: str = "csv") -> None:
    """Current snapshot of ratings, fixtures and summary."""
    write_table(rated, f"{path}/metrics_current", fmt)
    write_table(fixtures, f"{path}/fixtures_current", fmt)
    current_summary(rated, fixtures).write.mode("overwrite").json(f"{path}/summary")


def as_messages(df: DataFrame, topic: str) -> DataFrame:
    """Rows as JSON messages for a message-bus sink (``topic`` and ``value`` columns)."""
    return df.select(F.lit(topic).alias("topic"), F.to_json(F.struct(*df.columns)).alias("value"))
