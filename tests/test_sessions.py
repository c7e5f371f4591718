"""Detection with context: one array, a scan over task borders, and a stream give the same."""

import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import context, scan
from lexispark.streaming import sessions

SCORED = "conv_id long, turn long, scores array<struct<lang:string,score:double>>"


def _turns(n, conversations=1, seed=0):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(n):
            own = None if rng.random() < 0.02 else [(lang, rng.choice([0.0, 0.3, 0.31, 0.32, 0.5, rng.random()])) for lang in rng.sample(["en", "fr", "de"], rng.randrange(4))]
            rows.append((conv, turn, own))
    return rows


def _told(frame):
    return {(r["conv_id"], r["turn"]): (r["lang"], round(r["confidence"], 9)) for r in frame.collect()}


@pytest.fixture
def spread(spark):
    """Shuffles leave 16 parts, however little there is."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("max_turns", [2, 5])
def test_scan_of_a_conversation_over_many_tasks(spark, spread, max_turns):
    rows = _turns(900) + [(7, i, own) for _, i, own in _turns(5, seed=1)] + [(None, 0, None), (None, 1, [("fr", 0.4)])]
    frame = spark.createDataFrame(rows, SCORED)
    got = scan.fold_any_length(frame, max_turns)
    parts = got.filter("conv_id = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 8
    assert _told(got) == _told(context.fold(frame, max_turns))
    assert scan.fold_any_length(frame.limit(0)).count() == 0


def _stream(spark, tmp_path, name, parts, schema, **options):
    own = spark.newSession()
    for key, value in sessions.settings().items():
        own.conf.set(key, value)
    source, out, checkpoint = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "checkpoint"))
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        frame = own.readStream.schema(schema).parquet(source)
        frame = frame.withWatermark("at", "0 seconds") if "ttl_seconds" in options else frame
        sessions.run_to_end(frame, out, checkpoint, **options)
    return spark.read.parquet(out)


def test_stream_equals_the_fold_after_a_restart(spark, tmp_path):
    rows = _turns(12, 4)
    named = SCORED.replace("conv_id long", "session_id string")
    parts = [[(str(c), t, s) for c, t, s in rows if (t < 5) == first] for first in (True, False)]
    got = _stream(spark, tmp_path, "plain", parts, named, max_turns=3)
    want = _told(context.fold(spark.createDataFrame(rows, SCORED), 3))
    assert _told(got.withColumn("conv_id", F.col("session_id").cast("long"))) == want


def test_idle_sessions_are_forgotten(spark, tmp_path):
    schema = "session_id string, turn long, scores array<struct<lang:string,score:double>>, at timestamp"
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    tie = [("en", 0.5), ("fr", 0.5)]
    parts = [[("a", 0, [("fr", 0.9)], at(0)), ("b", 0, [("fr", 0.9)], at(0))], [("b", 1, tie, at(50))], [("c", 0, tie, at(120))], [("a", 1, tie, at(121)), ("b", 2, tie, at(121))]]
    got = {(r["session_id"], r["turn"]): r["lang"] for r in _stream(spark, tmp_path, "timed", parts, schema, ttl_seconds=100).collect()}
    # b was seen in between; a has lost its French turn, so that the tie goes to the first alphabetically.
    assert got == {("a", 0): "fr", ("b", 0): "fr", ("b", 1): "fr", ("c", 0): "en", ("a", 1): "en", ("b", 2): "fr"}
    with pytest.raises(ValueError, match="time"):
        sessions.detect_sessions(spark.createDataFrame([], schema).drop("at"), ttl_seconds=1)
