"""Tables staged in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and everything runs in one process (tests, local runs), a temporary one is set, and removed at exit;
    a cluster without a shared folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()  # the former cannot be set in a running session
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="sluice-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(configured)
        return spark.sparkContext.getCheckpointDir()
    return configured


#: Paths staged inside the scratch blocks that are open, innermost last.
_made: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def noted(path: str) -> str:
    """Marks a path of the shared folder for deletion at the end of the innermost scratch block."""
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files when they are done: what was written stands for them."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, tag: str, lasting: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it: cuts the lineage and survives lost executors. A lasting table outlives scratch blocks."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    if not lasting:
        noted(path)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.staged_at = path
    return read


def delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(found, True)


def discard(*frames: DataFrame) -> None:
    """Deletes staged tables that no later step reads."""
    for df in frames:
        delete(df.sparkSession, df.staged_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end whatever was staged inside: for callers that have written the results by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            delete(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: work on a small table of few files would else leave most of them idle.

    Tables of many files are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
