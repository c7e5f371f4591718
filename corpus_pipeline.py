"""A corpus pipeline over ``documents``: language ID, line dedup, MinHash near-dedup, decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark import ship
from lexispark.llm import decontaminate, langid, lines, minhash, packing
from lexispark.llm.common import checkpoint, join_checked, shared_path, table

#: Similarity of near-duplicates in percent, by five-word shingles.
SIMILAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go."""
    model = langid.train(docs, usable=~langid.held_out())
    return langid.accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first; so do documents of which only white space is left.

    A near-copy of the document that keeps its lines stays whole: the next stage decides on it, which it could not do by
    the few lines that would be left.
    """
    out = lines.dedup_lines(docs, copies=SIMILAR / 100)
    out = out.filter((F.size("dropped") == 0) | F.col("text").rlike(r"(?U)\S"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays, the one with the smallest id."""
    gone = checkpoint(minhash.near_duplicates(docs, k=5, percent=SIMILAR).filter("not kept").select("doc_id"))
    return join_checked(docs, gone, ["doc_id"], "left_anti", 16).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences."""
    return packing.pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The language models are trained, which SQL does not express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
