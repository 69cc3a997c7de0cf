"""How stable a player's rating is from season to season: AR(1) fit and deviation from a moving average."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchline.functions import scalars as S


#: Rows of a block, and blocks of a block of blocks: no row looks back further than this on any level but the last.
BLOCK = 128


def moving_average(df: DataFrame, x: str, a: float, key: str, place: str, name: str = "ewma") -> DataFrame:
    """Exponentially weighted mean e(1) = x(1), e(t) = a x(t) + (1 - a) e(t - 1) in the order of ``place`` (1, 2, ... per ``key``).

    A step is the map e -> gain * e + shift, and a run of steps is one such map. Maps are composed inside blocks of rows, blocks
    inside blocks of blocks, and these in order; each row then applies the map of its block to what came before it. This
    is exact for any length, and the work grows with the length, not with its square.
    """
    first = F.col(place) == 1
    step = df.withColumns({"__gain": F.when(first, 0.0).otherwise(1 - a), "__shift": F.when(first, F.col(x)).otherwise(a * F.col(x)),
                           "__b1": F.floor((F.col(place) - 1) / BLOCK), "__b2": F.floor((F.col(place) - 1) / (BLOCK * BLOCK))})

    def composed(frame: DataFrame, by: list[str], order: str) -> DataFrame:
        so_far = F.collect_list(F.struct("__gain", "__shift")).over(
            Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        fold = F.reduce("__maps", F.struct(F.lit(1.0).alias("g"), F.lit(0.0).alias("s")), lambda s, m: F.struct(
            (m["__gain"] * s["g"]).alias("g"), (m["__gain"] * s["s"] + m["__shift"]).alias("s")))
        return frame.withColumn("__maps", so_far).withColumn("__fold", fold).withColumns(
            {"__gain": F.col("__fold")["g"], "__shift": F.col("__fold")["s"]}).drop("__maps", "__fold")

    def before(frame: DataFrame, by: list[str], order: str) -> DataFrame:
        """The mean in front of each block, from the blocks' maps in order (the first map of a series has gain 0)."""
        return frame.withColumn("__before", F.lag("__shift").over(Window.partitionBy(*by).orderBy(order)))

    rows = composed(step, [key, "__b1"], place)
    blocks = rows.groupBy(key, "__b1", "__b2").agg(F.max_by("__gain", place).alias("__gain"), F.max_by("__shift", place).alias("__shift"))
    inner = composed(blocks, [key, "__b2"], "__b1")
    outer = inner.groupBy(key, "__b2").agg(F.max_by("__gain", "__b1").alias("__gain"), F.max_by("__shift", "__b1").alias("__shift"))
    outer = before(composed(outer, [key], "__b2"), [key], "__b2").select(
        F.col(key).alias("__k2"), F.col("__b2").alias("__n2"), F.col("__before").alias("__far"))
    ends = inner.join(outer, F.col(key).eqNullSafe(F.col("__k2")) & (F.col("__b2") == F.col("__n2"))).withColumn("__end", F.col("__gain") * F.coalesce("__far", F.lit(0.0)) + F.col("__shift"))
    ahead = ends.select(F.col(key).alias("__k1"), F.col("__b1").alias("__n1"),
                        F.lag("__end").over(Window.partitionBy(key).orderBy("__b1")).alias("__near"))
    found = rows.join(ahead, F.col(key).eqNullSafe(F.col("__k1")) & (F.col("__b1") == F.col("__n1"))).withColumn(name, F.col("__gain") * F.coalesce("__near", F.lit(0.0)) + F.col("__shift"))
    return found.select(*df.columns, name)


def series_steps(df: DataFrame, value: str, ewma_span: int = 3) -> DataFrame:
    """Each point with the player's previous value, first value and exponentially weighted mean."""
    order = Window.partitionBy("player_id").orderBy(S.season_key("season"), "league", value)
    points = df.withColumn("x", F.col(value).cast("double")).select(
        "player_id", "player", S.season_key("season").alias("season_key"), "league", "x", F.lag("x").over(order).alias("prev"),
        F.first("x").over(order).alias("first"), F.row_number().over(order).alias("t"))
    return moving_average(points, "x", 2.0 / (ewma_span + 1), "player_id", "t")


def ar1_sums(steps: DataFrame) -> DataFrame:
    """Per player: count, moments, EWMA residual spread and the lagged sums of the AR(1) likelihood (values less the first)."""
    d, e = F.col("x") - F.col("first"), F.col("prev") - F.col("first")
    later = F.col("t") > 1
    over = lambda c: F.sum(F.when(later, c))
    return steps.groupBy("player_id").agg(
        F.min_by("player", "t").alias("player"), F.count("x").alias("n"), F.avg("x").alias("value_mean"),
        F.stddev_pop("x").alias("value_std"), F.stddev_pop(F.col("x") - F.col("ewma")).alias("ewma_resid_std"),
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.min_by("x", "t").alias("first"), over(d).alias("a"), over(e).alias("b"),
        over(d * d).alias("dd"), over(e * e).alias("ee"), over(d * e).alias("de"))


def _best_phi(centre: Column, step: float, reach: int) -> Column:
    """Grid point around ``centre`` with the highest exact Gaussian AR(1) likelihood, mean and variance at their best.

    Mean, variance and likelihood are three steps over the array, so each is computed once per grid point; the centre
    goes in as an array, so that it is computed once per row.
    """
    n, m = F.col("n"), F.col("n") - 1
    grid = F.zip_with(F.array_repeat(centre, 2 * reach + 1), F.sequence(F.lit(-reach), F.lit(reach)), lambda c, i: c + i * F.lit(step))
    points = F.transform(F.filter(grid, lambda phi: F.abs(phi) < 1), lambda phi: F.struct(
        phi.alias("phi"), (1 - phi).alias("one"), (1 - phi * phi).alias("ends"), (F.col("a") - phi * F.col("b")).alias("drift")))
    points = F.transform(points, lambda p: F.struct(
        p["phi"].alias("phi"), p["one"].alias("one"), p["ends"].alias("ends"), p["drift"].alias("drift"),
        (p["one"] * p["drift"] / (p["ends"] + m * p["one"] * p["one"])).alias("mu")))
    points = F.transform(points, lambda p: F.struct(p["phi"].alias("phi"), p["ends"].alias("ends"), _variance(p, n, m).alias("var")))
    scored = F.transform(points, lambda p: F.struct(F.coalesce(F.when(
        p["var"] > 0, F.ln(p["ends"]) / 2 - n / 2 * F.ln(p["var"])), F.lit(float("-inf"))).alias("l"), p["phi"].alias("phi")))
    return F.array_max(scored)["phi"]


def _variance(p: Column, n: Column, m: Column) -> Column:
    phi, one, mu = p["phi"], p["one"], p["mu"]
    return (p["ends"] * mu * mu + F.col("dd") - 2 * phi * F.col("de") + phi * phi * F.col("ee") - 2 * one * mu * p["drift"]
            + m * one * one * mu * mu) / n


def ar1_fit(sums: DataFrame, levels: int = 3) -> DataFrame:
    """Add ``ar1``, ``resid_std`` and ``aic``: likelihood searched on a grid in (-1, 1), refined around its best point."""
    fitted, step = sums.withColumn("phi", _best_phi(F.lit(0.0), 0.01, 99)), 0.01
    for _ in range(levels):
        step /= 20
        fitted = fitted.withColumn("phi", _best_phi(F.col("phi"), step, 20))
    n, m, phi = F.col("n"), F.col("n") - 1, F.col("phi")
    fitted = fitted.withColumns({"one": 1 - phi, "ends": 1 - phi * phi, "drift": F.col("a") - phi * F.col("b")})
    fitted = fitted.withColumn("mu", F.col("one") * F.col("drift") / (F.col("ends") + m * F.col("one") * F.col("one")))
    point = {c: F.col(c) for c in ("phi", "one", "ends", "drift", "mu")}
    fitted = fitted.withColumn("var", _variance(point, n, m))
    loglik = -n / 2 * (F.ln(F.lit(2 * math.pi) * F.col("var")) + 1) + F.ln("ends") / 2
    moves = (F.col("hi") > F.col("lo")) & (F.col("var") > 0)
    return fitted.withColumns({"ar1": F.when(moves, phi), "resid_std": F.when(moves, F.sqrt("var")),
                               "aic": F.when(moves, 6 - 2 * loglik)}).drop("phi", "one", "ends", "drift", "mu", "var")


def player_stability(df: DataFrame, value: str, min_minutes: int = 900, min_points: int = 4, ewma_span: int = 3) -> DataFrame:
    """One row per player with enough seasons; a series that cannot be fitted keeps its row with NULLs."""
    missing = {"player_id", "player", "season", "minutes", value} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    if "league" not in df.columns:
        df = df.withColumn("league", F.lit(""))
    played = df.filter(F.col("minutes") >= min_minutes)
    sums = ar1_sums(series_steps(played, value, ewma_span)).filter(F.col("n") >= min_points)
    fitted = ar1_fit(sums)
    return fitted.select(
        "player_id", "player", F.col("n").cast("int").alias("seasons"), F.lit(value).alias("metric"), "value_mean", "value_std",
        "ar1", "resid_std", "aic", F.when(F.col("n") >= 2, F.col("ewma_resid_std")).alias("ewma_resid_std"),
        (-F.col("resid_std")).alias("stability_score_arima"),
        F.when(F.col("n") >= 2, -F.col("ewma_resid_std")).alias("stability_score_ewma"))
