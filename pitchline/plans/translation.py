"""League coefficients from players who change league, translated ratings and their tail compression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchline.functions import scalars as S
from pitchline.operators.common import attach_totals, exact_quantile
from pitchline.operators.ridge import fit_ridge, gram_sums, in_chunks
from pitchline.session import materialize


def transfer_samples(ratings: DataFrame, min_minutes: int = 900, value: str = "epm") -> DataFrame:
    """Consecutive player-seasons in different leagues with enough minutes on both ends.

    A rating table holds one row per (player, league, season), so a player's window stays within the number of
    league-seasons. Seasons may be skipped; rows of one season are ordered by league.
    """
    order = Window.partitionBy("player_id").orderBy(S.season_key("season"), "league")
    nxt = F.lead(F.struct("league", "minutes", F.col(value).alias("value"))).over(order)
    pairs = ratings.select("player_id", "league", "minutes", F.col(value).alias("value"), nxt.alias("n"))
    moved = pairs.filter((F.col("league") != F.col("n.league")) & (F.col("minutes") >= min_minutes)
                         & (F.col("n.minutes") >= min_minutes))
    return moved.select("player_id", F.col("league").alias("origin"), F.col("n.league").alias("dest"),
                        (F.col("n.value") - F.col("value")).alias("y"), F.least("minutes", "n.minutes").alias("weight"))


def league_coefficients(ratings: DataFrame, min_minutes: int = 900, alpha: float = 1.0, value: str = "epm") -> DataFrame:
    """Ridge coefficients per league without intercept, centred to mean 0; leagues without a transfer take part with 0."""
    leagues = ratings.select("league").distinct().withColumn("feature", F.xxhash64("league"))
    rows = transfer_samples(ratings, min_minutes, value).select(
        F.lit("all").alias("scope"), "player_id", F.array(F.xxhash64("dest"), F.xxhash64("origin")).alias("f"),
        F.array(F.lit(1.0), F.lit(-1.0)).alias("v"), "y", F.col("weight").cast("double").alias("w"))
    rows = in_chunks(materialize(rows, "transfers"), ["scope"], ["player_id"])
    fit = fit_ridge(rows, gram_sums(rows, ["scope"]), ["scope"], [alpha], intercept=False)
    raw = leagues.join(fit.coefficients.select("feature", "coef"), "feature", "left").select(
        "league", F.coalesce("coef", F.lit(0.0)).alias("coef"))
    raw = materialize(raw, "leagues")
    return attach_totals(raw, raw.agg(F.avg("coef").alias("__m"))).select("league", (F.col("coef") - F.col("__m")).alias("coef"))


def translate(ratings: DataFrame, coefficients: DataFrame, value: str = "epm") -> DataFrame:
    """Ratings minus their league's coefficient (0 for an unknown league)."""
    joined = ratings.join(coefficients.select("league", F.col("coef").alias("__c")), "league", "left")
    return joined.withColumn(f"{value}_translated", F.col(value) - F.coalesce("__c", F.lit(0.0))).select(
        *ratings.columns, f"{value}_translated")


def compress_tails(df: DataFrame, value: str, out: str = "gpm", q: float = 0.95, k: float = 1.0,
                   by: Sequence[str] = ()) -> DataFrame:
    """Log-compress what lies beyond the ``q`` quantile of |z|, over all rows or per group; constant values stay."""
    keys = list(by)
    add = (lambda d, t: d.join(t, keys, "left")) if keys else attach_totals
    moments = df.groupBy(*keys).agg(F.avg(value).alias("__mu"), F.stddev_pop(value).alias("__sd"))
    z = add(df, moments).withColumn("__z", S.rate(F.abs(F.col(value) - F.col("__mu")), "__sd"))
    z = materialize(z, "scores")  # the quantile passes read its one column back
    scored = add(z, exact_quantile(z, "__z", q, keys, "__q"))
    beyond = F.col("__q") + S.shrink(F.col("__z") - F.col("__q"), k)
    squeezed = F.when(F.col("__z") > F.col("__q"), beyond).otherwise(F.col("__z"))
    result = F.col("__mu") + F.signum(F.col(value) - F.col("__mu")) * squeezed * F.col("__sd")
    return scored.withColumn(out, F.when(F.col("__sd") == 0, F.col(value)).otherwise(result)).select(*df.columns, out)


def translated_ratings(ratings: DataFrame, min_minutes: int = 900, alpha: float = 1.0, q: float = 0.95, k: float = 1.0,
                       scope: str = "global") -> tuple[DataFrame, DataFrame, DataFrame]:
    """League coefficients, translated ratings and GPM."""
    coefficients = materialize(league_coefficients(ratings, min_minutes, alpha), "coefficients")
    translated = materialize(translate(ratings, coefficients), "translated")
    gpm = compress_tails(translated, "epm_translated", "gpm", q, k, ["league"] if scope == "league" else [])
    return coefficients, translated, gpm
