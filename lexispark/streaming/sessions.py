"""Detection with context over a stream of turns, by transformWithState: a list of the last turns for each session.

Each turn's scores gain the boosts of the context that the session's earlier results make, as in ``operators.context.fold``;
the result joins the context. The context is a list state of at most ``max_turns`` turns, so a session's length doesn't
matter. Where turns have a time (a column ``at`` with a watermark), a session that is idle for ``ttl`` of that time is
forgotten: a timer of its own goes off once the watermark has passed. Event time, unlike the clock, also lets a run over what
is there (availableNow) end by itself.

The state needs RocksDB; ``settings`` has the session's configuration for that. Turns of a session must come in the order of
their numbers from batch to batch; within a batch they are sorted. Defined cases: a turn without scores, with null ones or at most
``threshold`` is ``und`` and joins the context as such; a null session is one of its own; turns of one number keep the order in which they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.context import DECAY, MAX_TURNS
from ..operators.scan import decided

OUTPUT = "session_id string, turn long, lang string, confidence double"
STATE = "lang string, confidence double"


def settings() -> dict[str, str]:
    """What a session that runs such a stream must have set."""
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Sessions(StatefulProcessor):
    def __init__(self, max_turns: int, decay: float, weight: float, threshold: float, ttl_ms: int | None):
        self.max_turns, self.how, self.ttl_ms = max_turns, (decay, weight, threshold), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.turns = handle, handle.getListState("turns", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows)).sort_values("turn", kind="stable")
        history, out = [tuple(t) for t in self.turns.get()], []
        for turn, scores in zip(own["turn"], own["scores"], strict=True):
            lang, confidence = decided(history, scores, *self.how)
            history = [*history, (lang, confidence)][-self.max_turns :]
            out.append((key[0], int(turn), lang, confidence))
        self.turns.put(history)
        if self.ttl_ms is not None:
            last = [t for t in self.handle.listTimers()]
            until = max([int(own["at"].max().timestamp() * 1000) + self.ttl_ms, *last])
            for old in last:
                if old != until:
                    self.handle.deleteTimer(old)
            if until not in last:
                self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.turns.clear()
        return iter(())

    def close(self) -> None:
        pass


def detect_sessions(scored: DataFrame, max_turns: int = MAX_TURNS, decay: float = DECAY, weight: float = 0.2, threshold: float = 0.0, ttl_seconds: int | None = None) -> DataFrame:
    """(session_id, turn, lang, confidence) of a stream (session_id, turn, scores array<struct<lang, score>>[, at])."""
    timed = ttl_seconds is not None
    if timed and "at" not in scored.columns:
        raise ValueError("a time to live needs the turns' time, a column at with a watermark")
    rows = scored.selectExpr("cast(session_id AS string) AS session_id", "cast(turn AS long) AS turn", "scores", *(["at"] if timed else []))
    processor = Sessions(max_turns, decay, weight, threshold, 1000 * ttl_seconds if timed else None)
    return rows.groupBy("session_id").transformWithStateInPandas(processor, OUTPUT, "append", "EventTime" if timed else "None")


def run_to_end(scored: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Appends the results of all turns that are there to Parquet files under ``path``, and ends; a second run goes on after the first."""
    detect_sessions(scored, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
