"""Text and label files in, results out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import truncated


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text) of trimmed lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias("text")).filter(F.length("text") > 0)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): lines with their number over all files, in order of file name and place.

    Splits of files are put in order by name and start, whichever partitions they were packed in; only their counts are
    gathered for that, lines stay where they are read.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    splits = rows.groupBy("file", "start").agg(F.min("row").alias("first"), F.count("*").alias("lines"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    return rows.join(splits, ["file", "start"]).select((F.col("before") + F.col("row") - F.col("first")).alias("n"), "value")


def read_pairs(spark: SparkSession, texts: str, labels: str) -> DataFrame:
    """(n, text, label) of two files of lines that belong together by position; they must be equally long."""
    a, b = numbered(spark, texts), numbered(spark, labels)
    if a.count() != b.count():
        raise ValueError("texts and labels differ in length")
    return a.join(b.withColumnRenamed("value", "label"), "n").select("n", F.col("value").alias("text"), "label")


def result_json(result: DataFrame) -> Column:
    """A result row as JSON; null and empty fields are left out."""
    return F.to_json(F.struct("lang", F.round("confidence", 4).alias("confidence"), "reliable", "script", "backend", F.when(F.size("candidates") > 0, F.col("candidates")).alias("candidates"), "reason"))


def jsonl(texts: DataFrame, results: DataFrame, most: int = 50, with_reason: bool = True) -> DataFrame:
    """(id, value): one JSON record per text, the text truncated."""
    fields = [F.substring("text", 1, most).alias("text"), F.col("lang"), F.round("confidence", 4).alias("confidence")] + ([F.col("reason")] if with_reason else [])
    return texts.join(results, "id").select("id", F.to_json(F.struct(*fields)).alias("value"))


def display(text: Column) -> Column:
    return truncated(text, 100, "...")


def write_jsonl(records: DataFrame, path: str) -> None:
    records.select("value").write.mode("overwrite").text(path)


def json_array(records: DataFrame) -> DataFrame:
    """All records as one JSON array in one value, for a report to a person; ``write_json_array`` writes tables of any size."""
    return records.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda x: x["value"]), ","), F.lit("]")).alias("value"))


def write_json_array(records: DataFrame, path: str, order: str = "id") -> None:
    """Writes the column ``value`` of all records, in ``order``, as one file that holds one JSON array.

    Tasks write sorted parts beside ``path``, each record with a comma before it; these are then copied one after another as
    streams, so that neither a task nor the driver holds the table. The file appears under its name when it is whole.
    """
    spark = records.sparkSession
    parts, whole = (f"{path}._{uuid.uuid4().hex}-{n}" for n in ("parts", "whole"))
    by = F.col(order).asc_nulls_first()
    rows = records.filter("value is not null").repartitionByRange(by).sortWithinPartitions(by)
    rows.select(F.concat(F.lit(","), "value").alias("value")).write.text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(conf)
    files = sorted((f.getPath() for f in fs.listStatus(place(parts)) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getName())
    out = fs.create(place(whole), True)
    out.write(bytearray(b"["))
    for i, file in enumerate(files):
        part = fs.open(file)
        if i == 0:
            part.skip(1)  # nothing is before the first record
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
        part.close()
    out.write(bytearray(b"]"))
    out.close()
    fs.delete(place(parts), True)
    fs.delete(place(path), False)
    if not fs.rename(place(whole), place(path)):
        raise OSError(f"{path} could not be written")
