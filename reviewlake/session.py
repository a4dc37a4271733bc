"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "reviewlake", master: str | None = None, partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """A session with adaptive execution. On a cluster the submit settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package from wherever the driver has it.

    On a cluster the package comes with --py-files or the cluster's image, as any library does.
    """
    if spark.sparkContext.master.startswith("local["):
        spark.sparkContext.addFile(os.path.dirname(os.path.abspath(__file__)), recursive=True)


@lru_cache(maxsize=1)
def _own_folder() -> tempfile.TemporaryDirectory:
    """The folder of a local session without a shared one; it goes when the process ends."""
    return tempfile.TemporaryDirectory(prefix="reviewlake-", ignore_cleanup_errors=True)


def scratch_root(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`. Only a session whose driver and executors are one process may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder().name


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under `scratch_root`."""
    return f"{scratch_root(spark)}/reviewlake-{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder once and read it back.

    For frames that several branches of one report read: the work behind them
    runs once, later reads prune columns, and a lost executor costs no rework.
    For small tables it also tells the planner their size, so that it picks a
    broadcast under its own limit and leaves the large side where it is.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
