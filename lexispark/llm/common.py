"""Helpers shared by the operators of this subpackage: shared storage, checkpoints, size checks."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when rows * row bytes stays below this; otherwise it is shuffled.
BROADCAST_BYTES = 8 << 20


#: Bytes that a task reads of a checkpoint of many small parts.
PART_BYTES = 4 << 20

#: Rows of a join's key up to which it is left whole, and the most keys that are split.
SPLIT, HOT_KEYS = 1000, 50_000

#: Rows and bytes that go to Python at once. Texts are long; the defaults of 10,000 and 64 MB would hold tens of MB on both sides.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a session that is all in
    one process (tests) gets a local one; a cluster gets an error, as its executors would not see that."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexispark-shared-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lexispark-{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by files in the shared folder; they go when nothing refers to them any more."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def gathered(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, and read again by no more tasks than its measured bytes and the cores ask for.

    What a large shuffle leaves may be little: hundreds of tasks for it would only burden the driver. Neighbouring
    partitions are read together, up to PART_BYTES in a task on average; no row moves.
    """
    out = checkpoint(df)
    rdd = out._jdf.queryExecution().logical().rdd()
    fs, path = hadoop_fs(df.sparkSession, rdd.getCheckpointFile().get())
    least = df.sparkSession.sparkContext.defaultParallelism
    n = max(least, math.ceil(fs.getContentSummary(path).getLength() / PART_BYTES))
    return out.coalesce(n) if n < rdd.getNumPartitions() else out


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is measured to be below ``limit`` bytes; counts at most the rows that can fit."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int) -> DataFrame:
    """Join that broadcasts ``right`` only after its size was counted, and shuffles it beyond the limit."""
    return left.join(F.broadcast(right) if small(right, row_bytes) else right, on, how)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores put behind it until no column of ``frames`` has it (names ignore case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Shuffled join in which a key that many rows of ``left`` share is dealt over several tasks.

    Keys with more than SPLIT rows (or a 50,000th of all rows, so that there are at most 50,000 of them to broadcast) get
    a salt by the columns ``by``; the right side's rows of these keys are repeated once for each salt. ``counts``
    (on, n): the rows of ``left`` by key, where they are known already.
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("n")) if counts is None else counts.select(*on, "n")
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    split = max(SPLIT, (total or 0) // HOT_KEYS)
    if (most or 0) <= split:
        return left.join(right, on, how)
    n, salt = fresh("_salts", left, right), fresh("_salt", left, right)
    hot = F.broadcast(counts.filter(F.col("n") > split).select(*on, F.ceil(F.col("n") / split).cast("int").alias(n)))
    salted = left.join(hot, on, "left").withColumn(salt, F.when(F.col(n).isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col(n)).cast("int"))).drop(n)
    repeated = right.join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))).drop(n)
    return salted.join(repeated, [*on, salt], how).drop(salt)


def sized_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str], row_bytes: int, counts: DataFrame) -> DataFrame:
    """``hot_join``, but ``right`` is broadcast where its counted size allows that. ``right`` should be a checkpoint, as it is counted."""
    if small(right, row_bytes):
        return left.join(F.broadcast(right), on)
    return hot_join(left, right, on, by, counts=counts)


def hadoop_fs(spark: SparkSession, path: str):
    """Hadoop's file system and Path for ``path``."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
