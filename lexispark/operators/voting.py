"""Votes over backend results: (id, backend_name, language, confidence, all_probabilities, is_reliable) to (id, lang, score).

All strategies partition by id alone, so that a vote after a vote needs no further shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .backends import RELIABILITY

UNKNOWN = "unknown"
Strategy = Callable[..., DataFrame]


def _value(values: dict[str, float], name: Column, default: float) -> Column:
    out = F.lit(None).cast("double")
    for key, value in values.items():
        out = F.when(name == key, F.lit(float(value))).otherwise(out)
    return F.coalesce(out, F.lit(float(default)))


def _finish(scores: DataFrame) -> DataFrame:
    return scores.select("id", "lang", "score")


def hard_vote(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Share of (weighted) votes among reliable results, or among all where none is reliable."""
    own = Window.partitionBy("id")
    votes = results.withColumn("any", F.max("is_reliable").over(own)).filter(F.col("is_reliable") | ~F.col("any")).filter(F.col("language") != UNKNOWN)
    votes = votes.withColumn("w", _value(weights or {}, F.col("backend_name"), 1.0))
    sums = votes.groupBy("id", F.col("language").alias("lang")).agg(F.sum("w").alias("w"))
    total = F.sum("w").over(own)
    return _finish(sums.withColumn("score", F.when(total > 0, F.col("w") / total).otherwise(0.0)))


def soft_vote(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Mean of the backends' probabilities, or their weighted mean."""
    own = Window.partitionBy("id")
    rows = results.withColumn("w", _value(weights, F.col("backend_name"), 1.0) if weights else F.lit(1.0))
    rows = rows.withColumn("all", F.sum("w").over(own)).withColumn("share", F.when(F.col("all") == 0, F.col("w")).otherwise(F.col("w") / F.col("all")))
    probs = rows.select("id", "share", F.explode("all_probabilities").alias("lang", "p")).filter(F.col("lang") != UNKNOWN)
    return _finish(probs.groupBy("id", "lang").agg(F.sum(F.col("p") * F.col("share")).alias("score")))


def weighted_vote(results: DataFrame, weights: dict[str, float] | None = None, use_reliability: bool = True, square: bool = True) -> DataFrame:
    """Confidence of the primary languages, weighted by given weights, else by reliability (squared); weights are shares of all backends that answered."""
    if weights:
        w = _value(weights, F.col("backend_name"), 1.0)
    elif use_reliability:
        w = _value({n: float(r) ** (2 if square else 1) for n, r in RELIABILITY.items()}, F.col("backend_name"), 1.0)
    else:
        w = F.lit(1.0)
    rows = results.withColumn("w", w)
    rows = rows.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("id"))).filter(F.col("language") != UNKNOWN)
    return _finish(rows.groupBy("id", F.col("language").alias("lang")).agg(F.sum(F.col("share") * F.col("confidence")).alias("score")))


def consensus_vote(results: DataFrame, weights: dict[str, float] | None = None, min_agreement: int = 2, fallback: Strategy = soft_vote) -> DataFrame:
    """Languages that at least ``min_agreement`` backends name, by share of all; ids without one fall back. ``results`` are read three times: kept ones are not worked out again."""
    rows = results.withColumn("of", F.count("*").over(Window.partitionBy("id"))).filter(F.col("language") != UNKNOWN)
    agreed = rows.groupBy("id", F.col("language").alias("lang")).agg(F.count("*").alias("n"), F.first("of").alias("of")).filter(F.col("n") >= min_agreement)
    scores = agreed.select("id", "lang", (F.col("n") / F.col("of")).alias("score"))
    rest = results.join(scores.select("id").distinct(), "id", "left_anti")
    return scores.unionByName(fallback(rest, weights))


def tie_break(results: DataFrame, script_langs: DataFrame | None = None, allowed: list[str] | None = None) -> DataFrame:
    """Six factors: agreement, mean confidence, reliable share, the best backend's reliability, script, allowed languages.

    script_langs: (id, langs array) of the languages that the text's script admits.
    """
    rows = results.withColumn("of", F.count("*").over(Window.partitionBy("id"))).filter(F.col("language") != UNKNOWN)
    rows = rows.withColumn("rel", _value({k: float(v) for k, v in RELIABILITY.items()}, F.col("backend_name"), 0.0))
    by = rows.groupBy("id", F.col("language").alias("lang")).agg(F.count("*").alias("n"), F.first("of").alias("of"), F.avg("confidence").alias("c"), F.count_if("is_reliable").alias("r"), F.max("rel").alias("rel"))
    score = F.col("n") / F.col("of") * 0.3 + F.col("c") * 0.25 + F.col("r") / F.col("n") * 0.2 + F.col("rel") / 5.0 * 0.15
    if script_langs is not None:
        by = by.join(script_langs.select("id", "langs"), "id", "left")
        score = score + F.when(F.coalesce(F.array_contains("langs", F.col("lang")), F.lit(False)), 0.05).otherwise(0.0)
    if allowed:
        score = F.when(F.col("lang").isin(allowed), score).otherwise(score * 0.1)
    return _finish(by.withColumn("score", F.least(score, F.lit(1.0))))


def tied(scores: DataFrame, margin: float = 0.01) -> DataFrame:
    """(id) of those whose first two scores are closer than ``margin``."""
    order = Window.partitionBy("id").orderBy(F.desc("score"), "lang")
    ranked = scores.withColumn("next", F.lead("score").over(order)).withColumn("rn", F.row_number().over(order))
    return ranked.filter((F.col("rn") == 1) & (F.col("score") - F.col("next") < margin)).select("id")


def break_ties(scores: DataFrame, results: DataFrame, script_langs: DataFrame | None = None, allowed: list[str] | None = None) -> DataFrame:
    """Scores of tied ids are replaced as a whole by those of the tie-breaker."""
    ids = tied(scores)
    return scores.join(ids, "id", "left_anti").unionByName(tie_break(results.join(ids, "id", "left_semi"), script_langs, allowed))


def _rows_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each text, of batches in which they stand together."""
    own: list[dict] = []
    for batch in batches:
        columns = [[None if m is None else dict(m) for m in c.to_pylist()] if pa.types.is_map(c.type) else c.to_pylist() for c in batch.columns]
        for values in zip(*columns, strict=True):
            row = dict(zip(batch.schema.names, values, strict=True))
            if own and own[0]["id"] != row["id"]:
                yield own
                own = []
            own.append(row)
    if own:
        yield own


def custom_vote(vote: Callable[[list[dict]], dict[str, float]]) -> Strategy:
    """A strategy out of a function on the result rows of one text; groups are the backends of a text, hence small.

    Texts go through Python in sorted batches, as a call of Spark's for each group costs more than the vote.
    """

    def run(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: tuple[list, list, list] = ([], [], [])

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.float64()), strict=True)], names=["id", "lang", "score"])

            for rows in _rows_of_texts(batches):
                for lang, score in vote(rows).items():
                    for column, value in zip(out, (rows[0]["id"], lang, None if score is None else float(score)), strict=True):
                        column.append(value)
                if len(out[0]) >= 10_000:
                    yield batch()
                    out = ([], [], [])
            yield batch()

        return results.repartition("id").sortWithinPartitions("id").mapInArrow(scored, "id long, lang string, score double")

    return run


STRATEGIES: dict[str, Strategy] = {"hard": hard_vote, "soft": soft_vote, "weighted": weighted_vote, "consensus": consensus_vote}


def voting_strategy(name: str | Callable) -> Strategy:
    if callable(name):
        return name
    if name not in STRATEGIES:
        raise ValueError(f"unknown voting strategy {name!r}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[name]
