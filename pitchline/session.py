"""Session settings and the one way intermediate tables are cut loose from their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# AQE measures shuffle output before it picks a broadcast or splits a hot partition, so no operator in this
# package carries a broadcast hint: a side is broadcast only when its measured size is under the threshold,
# and is joined by a (skew-split) sort-merge join otherwise.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "pitchline", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the package defaults; on a cluster leave ``master`` and partition counts to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``; a local temp folder only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not spark.conf.get("spark.pitchline.scratch", None):
        spark.conf.set("spark.pitchline.scratch", tempfile.mkdtemp(prefix="pitchline-"))
    return spark.conf.get("spark.pitchline.scratch")


_OWNED: ContextVar[tuple[list[str], ...]] = ContextVar("pitchline_scratch", default=())


def scratch_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    path = f"{shared_dir(spark)}/pitchline-{name}-{uuid.uuid4().hex}"
    blocks = _OWNED.get()[:-1] if outer else _OWNED.get()
    if blocks:
        blocks[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark reaches; nothing happens if there is none."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables written inside the block when it ends (results must be stored by then).

    A block owns what is written inside it and nothing else: blocks may nest, and jobs that run at the same time in
    other threads have blocks of their own. Without a block, tables stay until the shared folder is cleared. A table
    written as ``outer`` belongs to the block around, or to none.
    """
    owned: list[str] = []
    token = _OWNED.set((*_OWNED.get(), owned))
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path in owned:
            remove(spark, path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside the block a query's shuffle files go when it ends, not when the driver happens to collect its garbage.

    For long rows of queries that each end in a stored table; Spark would run a shuffle again if it were asked for after that.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str = "table", outer: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike a cached table this survives the loss of executors, keeps columnar pruning for later readers, and
    gives the planner a true size for its join choices. ``outer``: see ``scratch``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, outer)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
