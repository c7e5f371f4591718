"""Interval joins and the JSON array sink."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import ranges
from lexispark.queries import all_queries
from lexispark.sources.files import write_json_array


@pytest.mark.parametrize("broadcast", [0, ranges.BROADCAST_ROWS])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join_is_complete(spark, monkeypatch, how, broadcast):
    monkeypatch.setattr(ranges, "BROADCAST_ROWS", broadcast)
    rng = random.Random(1)
    points = [None, *(rng.randrange(-50, 500) for _ in range(120))]
    intervals = [(a, a + rng.randrange(-3, 90), f"r{a}") for a in (rng.randrange(-60, 500) for _ in range(40))] + [(None, 5, "x"), (5, None, "y")]
    frame, held = spark.createDataFrame([(p,) for p in points], "p long"), spark.createDataFrame(intervals, "a long, b long, name string")
    out = ranges.interval_join(frame, "p", held, "a", "b", 16, how)
    want = []
    for p in points:
        own = [(p, *r) for r in intervals if p is not None and r[0] is not None and r[1] is not None and r[0] <= p <= r[1]]
        want += own or ([(p, None, None, None)] if how == "left" else [])
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    with pytest.raises(ValueError, match="no such join"):
        ranges.interval_join(frame, "p", held, "a", "b", 16, "full")


def test_scripts_of_letters_have_no_nested_loop(spark, sf_dir):
    plan = all_queries()["scr01_char_scripts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "HashJoin" in plan


def test_json_array_of_a_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.to_json(F.struct("doc_id", "text")).alias("value"))
    path = str(tmp_path / "all.json")
    for _ in range(2):  # a second time over the first
        write_json_array(docs.repartition(5), path)
        read = json.loads((tmp_path / "all.json").read_text())
        ids = [r["doc_id"] for r in read]
        assert ids == sorted(ids) and len(ids) == docs.count() and all(r["text"] is not None for r in read)
    write_json_array(docs.limit(0), path)
    assert json.loads((tmp_path / "all.json").read_text()) == [] and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["all.json"]
