"""Keeping an intermediate result that several branches of a plan read, and spreading small inputs over all cores."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where that is unset, a session that is all in one process gets a local folder; a cluster gets an error.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexispark-kept-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lexispark-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by files under ``spark.checkpoint.dir``, which go when nothing refers to them any more."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Bytes of kept rows, as written (compressed), that ``dealt`` gives to a task.
DEALT_BYTES = 4 << 20


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` kept, and dealt by ``by`` over as many partitions as its measured bytes ask for.

    What sorts, windows, groups and joins by the same columns then hold in a task does not grow with the input, whatever the number of
    shuffle partitions is, and none of them shuffles again.
    """
    out = keep(df)
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return out.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(size / DEALT_BYTES)), *by)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it has fewer partitions than these: a small file is one task, however dear its rows are.
    Inputs with as many partitions, hence all large ones, stay as they are and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or not 0 < df.rdd.getNumPartitions() < cores:
        return df
    return df.repartition(cores)
