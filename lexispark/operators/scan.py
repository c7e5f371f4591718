"""Detection with context for conversations of any length: a sorted scan with a state of fixed size.

The turns are range-partitioned and sorted by conversation and number, so that a long conversation lies over many tasks.
Each task goes through its turns with the context of the conversation it is in, the last ``max_turns`` results. What a
task needs from the one before is that context alone, where a conversation goes on across the border: one small state for each
partition. The tasks first run with empty contexts; each then runs again while the context that the one before hands
over differs from what it was run with. A partition in which another conversation begins hands over the same whatever it got, and
a context fades within a few turns, so that two or three runs are usual; there are never more than partitions.

The result is that of ``context.fold``, which makes one array of a conversation and is the better choice for short ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.keep import keep
from .context import BOOST_CAP, DECAY, MAX_TURNS, SHARE_BOOST, STREAK_BOOST, STREAK_CAP, UNKNOWN


def boosts(history: list[tuple[str | None, float | None]], decay: float = DECAY) -> dict[str, float]:
    """What the context adds to each of its languages."""
    weights: dict[str, float] = {}
    for age, (lang, confidence) in enumerate(reversed(history)):
        if lang and lang != UNKNOWN and confidence is not None:
            weights[lang] = weights.get(lang, 0.0) + decay**age * confidence
    total, last, run = sum(weights.values()), history[-1][0] if history else None, 0
    if total <= 0:
        return {}
    while last and run < len(history) and history[-1 - run][0] == last:
        run += 1
    bonus = min(run * STREAK_BOOST, STREAK_CAP) if run >= 2 else 0.0
    return {lang: min(w / total * SHARE_BOOST + (bonus if lang == last else 0.0), BOOST_CAP) for lang, w in weights.items()}


def decided(history: list[tuple[str | None, float | None]], scores, decay: float, weight: float, threshold: float) -> tuple[str, float]:
    """(language, confidence) of a turn with these scores."""
    added = boosts(history, decay)
    boosted = [(s["score"] + added.get(s["lang"], 0.0) * weight, s["lang"]) for s in (scores if scores is not None else ()) if s["score"] is not None]
    if not boosted:
        return "und", 0.0
    top = max(score for score, _ in boosted)
    return min(lang for score, lang in boosted if score == top) if top > threshold else "und", top


def _scan(max_turns: int, how: tuple[float, float, float], starts: dict[int, tuple[object, list]], results: bool):
    """Goes through a partition's sorted turns; yields results, or one row (part, first, last, window) of its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = conv = None
        history: list[tuple[str, float]] = []
        for batch in batches:
            langs, confidences = [], []
            parts, convs, scores = (batch.column(n).to_pylist() for n in ("part", "conv_id", "scores"))
            for at, own, scored in zip(parts, convs, scores, strict=True):
                if part is None:
                    part, first, conv = at, own, own
                    goes_on, window = starts.get(part, (None, []))
                    history = [tuple(t) for t in window] if goes_on is not None and goes_on[0] == own else []
                elif own != conv:
                    conv, history = own, []
                lang, confidence = decided(history, scored, *how)
                history = [*history, (lang, confidence)][-max_turns:]
                langs.append(lang)
                confidences.append(confidence)
            if results:
                added = [batch.column("conv_id"), batch.column("turn"), pa.array(langs, pa.string()), pa.array(confidences, pa.float64())]
                yield pa.RecordBatch.from_arrays(added, names=["conv_id", "turn", "lang", "confidence"])
        if part is not None and not results:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": [json.dumps([first])], "last": [json.dumps([conv])], "window": [json.dumps(history)]})

    return run


def fold_any_length(scored: DataFrame, max_turns: int = MAX_TURNS, decay: float = DECAY, weight: float = 0.2, threshold: float = 0.0) -> DataFrame:
    """(conv_id, turn, lang, confidence) of (conv_id, turn, scores array<struct<lang, score>>), one row per turn."""
    order = ["conv_id", F.col("turn").asc_nulls_first()]
    rows = scored.select("conv_id", F.col("turn").cast("long").alias("turn"), "scores").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = keep(rows.withColumn("part", F.spark_partition_id()))
    how, starts = (decay, weight, threshold), {}
    while True:
        borders = rows.mapInArrow(_scan(max_turns, how, starts, False), "part int, first string, last string, window string").collect()
        found, before = {}, None
        for b in sorted(borders, key=lambda b: b["part"]):
            if before is not None and before["last"] == b["first"]:
                found[b["part"]] = (json.loads(b["first"]), json.loads(before["window"]))
            before = b
        if found == starts:
            break
        starts = found
    types = {f.name: f.dataType for f in rows.schema.fields}
    out = StructType([StructField("conv_id", types["conv_id"]), *StructType.fromDDL("turn long, lang string, confidence double").fields])
    return rows.mapInArrow(_scan(max_turns, how, starts, True), out)
