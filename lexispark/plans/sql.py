"""Detection from SQL text: table functions for backends, and views of what the whole plan finds.

After ``register(spark)``::

    SELECT language, count(*) FROM ngram_nb(TABLE(SELECT doc_id AS id, text FROM documents)) GROUP BY language

The functions take (id, text) of any table in Arrow batches, by the partitions that it has: nothing is shuffled, and the
model is a broadcast. The whole plan (votes, ties, hints, candidates) is made of shuffles, which a function over one
partition cannot hold; ``detected`` gives its rows as a temporary view, to be joined and grouped like any table::

    detected(spark, "documents", id="doc_id")
    spark.sql("SELECT d.source, r.lang FROM documents d JOIN documents_detected r ON r.id = d.doc_id")

Defined cases: the functions give a row for each row, with its id, null and repeated ones as well; null and empty texts are
``unknown`` with confidence 0; other columns of the table are ignored, a table without ``id`` or ``text`` is an error; an empty
table gives no rows. A view asks for ids that are not null and different, as ``detect`` does. It shows the table as it was
when the view was made; make it again after a change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backends as B
from ..operators import grams as G
from .config import Config
from .detect import detect


def _function(spark: SparkSession, name: str, score: Callable, model: G.Model | DataFrame | None):
    held, languages = B.held_model(spark, model)

    class Detected:
        def __init__(self):
            self.run = G.results(name, lambda own: score(held.value, own), languages, B.RELIABLE)

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            texts = pa.RecordBatch.from_arrays([rows.column("id").cast(pa.int64()), rows.column("text").cast(pa.string())], names=["id", "text"])
            for found in self.run(iter([texts])):
                yield pa.Table.from_batches([found])

    return F.arrow_udtf(Detected, returnType=B.RESULT)


def register(spark: SparkSession, models: dict[str, G.Model | DataFrame] | None = None, profile: int = 300) -> list[str]:
    """Table functions ``ngram_nb`` and ``ngram_rank`` with the built-in model, and for each of ``models`` one of its name by
    naive Bayes; the names. A model's size is counted before it is broadcast."""
    ranked = lambda model, own: model.ranked(own, profile)
    made = {"ngram_nb": (G.Model.bayes, None), "ngram_rank": (ranked, None)} | {n: (G.Model.bayes, m) for n, m in (models or {}).items()}
    for name, (score, model) in made.items():
        spark.udtf.register(name, _function(spark, name, score, model))
    return list(made)


def detected(spark: SparkSession, of: str, view: str | None = None, id: str = "id", text: str = "text", config: Config | None = None, **options) -> DataFrame:
    """The detection of table or view ``of`` as the temporary view ``view`` (``<of>_detected``); options as those of ``detect``."""
    rows = spark.table(of).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    found = detect(rows, config, **options)
    found.createOrReplaceTempView(view or f"{of.rpartition('.')[2]}_detected")
    return found
