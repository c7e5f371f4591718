"""Token counts of flat, unindexed token files by a separator scan.

A file is nothing but token ids (16 or 32 bits each, little-endian), with an end-of-document id after each document.
Blocks of a file are searched for that id independently and vectorised; each block reports where its separators are.
A prefix scan over the blocks of a file (documents ended so far, and the last separator before a block) stitches the
documents that cross borders. Blocks are read by position, so a file of any size is scanned by many tasks.

Defined cases: an empty file has no documents; two separators in a row enclose a document of no tokens; tokens after
the last separator are a document that is marked unterminated. Documents: a null or empty text has no tokens; rows
that repeat, and rows with a null id, are counted each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, hadoop_fs, shared_path
from .tokens import encoder
from .warc import open_fs

#: Tokens of a block.
BLOCK = 4 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer: str, eod: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Writes one token file per partition; receipts (file, ordinal, doc_id) of what was written, in order.

    Every attempt of a task writes a file of its own, under a temporary name until it is complete; its receipts name that
    file. Files that no receipt names (of attempts that were lost or repeated) are deleted at the end. A null text
    has no tokens. ``eod`` must be an id that no text has, best one outside the vocabulary; a text that has it raises an
    error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, folder = open_fs(path)
        fs.create_dir(folder, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{uuid.uuid4().hex}.tokens"
        temporary, coder, ordinal = f"{folder}/_{name}.tmp", encoder(tokenizer), 0
        end = int(eod).to_bytes(4, "little")
        with fs.open_output_stream(temporary) as out:
            for batch in batches:
                for row, coded in coder.batches(batch.column(1)):
                    ids = np.frombuffer(b"".join(x + end for x in coded), "<u4")
                    if len(ids) and int(ids.max()) >= 1 << (8 * width):
                        raise ValueError(f"token id {ids.max()} does not fit {width} bytes")
                    if int((ids == eod).sum()) != len(coded):
                        raise ValueError(f"a text's own tokens hold the separator {eod}; take an id outside the vocabulary")
                    out.write(ids.astype(f"<u{width}").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(coded)), pa.array(range(ordinal, ordinal + len(coded)), pa.int64()), batch.column(0).slice(row, len(coded))], names=["file", "ordinal", "doc_id"])
                    ordinal += len(coded)
        fs.move(temporary, f"{folder}/{name}")

    plain = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    receipts = checkpoint(plain.mapInArrow(run, "file string, ordinal long, doc_id long"))
    named = {r["file"] for r in receipts.select("file").distinct().collect()}  # one for each task
    fs, folder = hadoop_fs(docs.sparkSession, path)
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        if name not in named and name.removesuffix(".tmp").removeprefix("_").startswith("part-") and name.endswith((".tokens", ".tmp")):
            fs.delete(status.getPath(), False)
    return receipts


def separators(spark: SparkSession, path: str, eod: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, first, tokens, ends): a row for each block, with the places of its separators in the file."""
    fs, folder = hadoop_fs(spark, path)
    files = [(s.getPath().getName(), int(s.getLen())) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".tokens")] if fs.exists(folder) else []
    if any(size % width for _, size in files):
        raise ValueError("a token file ends within a token")
    listed = spark.createDataFrame(files, "file string, size long").filter("size > 0")
    blocks = listed.withColumn("block", F.explode(F.expr(f"sequence(0L, (size - 1) div {block * width})")))
    blocks = blocks.repartition(max(1, sum(-(-size // (block * width)) for _, size in files)), "file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(path)
        for batch in batches:
            for file, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with fs.open_input_file(f"{folder}/{file}") as stream:
                    data = np.frombuffer(stream.read_at(block * width, at * block * width), f"<u{width}")
                ends = np.flatnonzero(data == eod) + at * block
                listed = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at]), pa.array([at * block]), pa.array([len(data)]), listed], names=["file", "block", "first", "tokens", "ends"])

    return blocks.mapInArrow(run, "file string, block long, first long, tokens long, ends array<long>")


def count_tokens(spark: SparkSession, path: str, eod: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of each document of the files in the folder ``path``."""
    found = checkpoint(separators(spark, path, eod, width, block))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select("file", "ends", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("done"), F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1)).alias("last"))
    ended = scanned.select("file", "done", F.posexplode(F.arrays_zip(F.col("ends").alias("end"), F.concat(F.array("last"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))).alias("prior"))).alias("i", "x"))
    ended = ended.filter("x.end is not null").select("file", (F.col("done") + F.col("i")).alias("ordinal"), (F.col("x.prior") + 1).alias("start"), (F.col("x.end") - F.col("x.prior") - 1).alias("n_tokens"), F.lit(True).alias("terminated"))
    whole = found.groupBy("file").agg(F.sum("tokens").alias("tokens"), F.sum(F.size("ends")).alias("ordinal"), F.coalesce(F.max(F.array_max("ends")), F.lit(-1)).alias("last"))
    tails = whole.filter("tokens > last + 1").select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("terminated"))
    return ended.unionByName(tails)


def document_token_counts(docs: DataFrame, tokenizer: str, eod: int, path: str | None = None, width: int = 2) -> DataFrame:
    """Writes ``docs`` to flat token files, scans these, and names the documents: (doc_id, file, ordinal, start, n_tokens)."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    receipts = write_tokens(docs, path, tokenizer, eod, width=width)
    return count_tokens(spark, path, eod, width).join(receipts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
