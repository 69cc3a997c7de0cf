"""What reading lost, counted as the rows pass by."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _filled(text: Column) -> Column:
    return text.isNotNull() & (F.trim(text) != "")


def counted_casts(df: DataFrame, kinds: Mapping[str, str], seen: Observation | str) -> DataFrame:
    """``df`` with its text columns cast to ``kinds``; a text that is no value of its kind becomes NULL and is counted.

    ``seen`` gets ``rows`` and per column ``bad_<column>`` (filled texts that were lost) and ``none_<column>`` (nulls and blanks) while the rows are
    written, without a second pass; under a name (for streams) the figures stand in the progress of each batch.
    """
    cast = df.withColumns({f"__{c}": F.col(c).try_cast(kind) for c, kind in kinds.items()})
    figures = [F.count(F.lit(1)).alias("rows")]
    for c in kinds:
        figures += [F.count_if(_filled(F.col(c)) & F.col(f"__{c}").isNull()).alias(f"bad_{c}"), F.count_if(~F.coalesce(_filled(F.col(c)), F.lit(False))).alias(f"none_{c}")]
    watched = cast.observe(seen, *figures)
    return watched.select(*[F.col(f"__{c}").alias(c) if c in kinds else F.col(c) for c in df.columns])


def counted_filter(df: DataFrame, keep: Column, seen: Observation | str, name: str = "dropped") -> DataFrame:
    """The rows for which ``keep`` holds; the others (also those for which it is unknown) are counted as ``name`` among ``read``."""
    held = df.withColumn("__keep", F.coalesce(keep, F.lit(False)))
    watched = held.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(~F.col("__keep")).alias(name))
    return watched.filter("__keep").drop("__keep")


def figures(seen: Observation, df: DataFrame) -> DataFrame:
    """The observed figures as rows (``figure``, ``n``), once an action on ``df`` has run."""
    return df.sparkSession.createDataFrame([(k, int(v)) for k, v in sorted(seen.get.items())], "figure string, n long")
