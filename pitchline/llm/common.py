"""What several operators share: reading tables, small Arrow batches, words as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch between the JVM and Python. Texts can be long, so batches hold few of them.
BATCH_ROWS = 512
BLANK = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to ``BATCH_ROWS`` rows; a smaller setting is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def words(text: Column) -> Column:
    """Words of a text in order (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def bound(value: Column, then) -> Column:
    """``then(v)`` with ``value`` evaluated once: a lambda variable isn't inlined by the optimizer."""
    return F.element_at(F.transform(F.array(value), then), 1)
