"""Conversation context over a stream: one state of at most ``max_turns`` turns per session, with time to live.

Each key has a single writer, so that concurrent updates of a session cannot overwrite each other. Turns of a session
within a micro-batch are taken in the order of their numbers. A run to the end of the data (availableNow) needs
spark.sql.streaming.noDataMicroBatches.enabled off, since timeouts by processing time ask for empty batches forever.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.context import BOOST_CAP, DECAY, HISTORY_TURNS, SHARE_BOOST, STREAK_BOOST, STREAK_CAP, UNKNOWN

OUTPUT = "session_id string, turn long, lang string, dominant string, share double, streak int, boost double"
STATE = "langs array<string>, confidences array<double>"


def summary(history: list[tuple[str, float]], decay: float = DECAY) -> tuple[str | None, float, int, float]:
    """(dominant language, its share, streak of the last language, boost of the dominant language).

    As in the batch form, turns without a language or a confidence (which arrives as NaN) have age but no weight.
    """
    weights: dict[str, float] = {}
    for age, (lang, confidence) in enumerate(reversed(history)):
        if lang and lang != UNKNOWN and not math.isnan(confidence):
            weights[lang] = weights.get(lang, 0.0) + decay**age * confidence
    last = history[-1][0] if history else None
    run = 0
    for lang, _ in reversed(history):
        if not last or lang != last:
            break
        run += 1
    total = sum(weights.values())
    if total <= 0:
        return None, 0.0, run, 0.0
    top = min(weights, key=lambda k: (-weights[k], k))
    share = weights[top] / total
    bonus = min(run * STREAK_BOOST, STREAK_CAP) if top == last and run >= 2 else 0.0
    return top, share, run, min(share * SHARE_BOOST + bonus, BOOST_CAP)


def track_sessions(turns: DataFrame, max_turns: int = HISTORY_TURNS, decay: float = DECAY, ttl_ms: int = 3_600_000) -> DataFrame:
    """For each turn of a stream (session_id, turn, lang, confidence) the context that includes it.

    A column ``clear`` (boolean), where there is one, starts a session's context anew with the turn that has it set.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        history = list(zip(*state.get, strict=True)) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("turn", kind="stable")
        out = []
        clear = rows["clear"].fillna(False).astype(bool) if "clear" in rows else [False] * len(rows)
        for turn, lang, confidence, anew in zip(rows["turn"], rows["lang"], rows["confidence"], clear, strict=True):
            history = [*([] if anew else history), (lang, float(confidence))][-max_turns:]
            out.append((key[0], int(turn), lang, *summary(history, decay)))
        state.update(([h[0] for h in history], [h[1] for h in history]))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUTPUT.split(", ")])

    return turns.groupBy("session_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
