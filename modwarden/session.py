"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, cores: int = 8, app: str = "modwarden") -> SparkSession:
    """Session with the settings the operators are tuned for.

    On a cluster leave ``master`` unset and let spark-submit decide; the adaptive settings do the
    sizing, so the same values hold from a laptop to a large cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "12g")
        )
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


@lru_cache(maxsize=1)
def _laptop_dir() -> str:
    return tempfile.mkdtemp(prefix="modwarden-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's checkpoint folder.

    Without that setting a job on a cluster fails here, before it writes where other executors cannot read.
    In local mode driver and executors are one process, so a temporary folder serves tests and laptops.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _laptop_dir()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """A result that several branches read, written once to the shared folder.

    It survives lost executors, and each branch then prunes the columns it needs at the scan.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that :func:`shared_dir` named, once nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A :func:`materialize` whose folders are deleted when the block ends. What the block hands out must not read them."""
    made: list[str] = []

    def kept(df: DataFrame, purpose: str) -> DataFrame:
        made.append(shared_dir(spark, purpose))
        df.write.parquet(made[-1])
        return spark.read.parquet(made[-1])

    try:
        yield kept
    finally:
        for path in made:
            discard(spark, path)
