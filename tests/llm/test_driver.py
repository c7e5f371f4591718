"""What the driver has to keep track of: jobs, stages, and tasks of little data."""

import random
import uuid

import pytest

from lexispark.llm import common, lines, minhash


@pytest.fixture
def many_parts(spark):
    """Every shuffle leaves 64 parts, however little there is in them."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _told(spark, run):
    """The result of ``run``, and the tasks, stages and jobs that it took."""
    group, context = uuid.uuid4().hex, spark.sparkContext
    context.setJobGroup(group, "tasks")
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker = context.statusTracker()
    jobs = tracker.getJobIdsForGroup(group)
    stages = [x for s in {s for j in jobs for s in tracker.getJobInfo(j).stageIds} if (x := tracker.getStageInfo(s)) and x.numCompletedTasks]
    return out, sum(x.numCompletedTasks for x in stages), len(stages), len(jobs)


def _docs(spark):
    rows = [(i, f"the same line stands in all of them\nalpha beta gamma delta number{i % 7} of these\nown words of text x{'abcdefgh'[i % 8]} and y{'ijklmno'[i % 7]} here") for i in range(60)]
    return spark.createDataFrame([*rows, (99, None)], "doc_id long, text string")


def test_line_dedup_tasks(spark, many_parts):
    got, tasks, _, _ = _told(spark, lambda: lines.dedup_lines(_docs(spark)).orderBy("doc_id").collect())
    assert [len(r.dropped) > 0 for r in got] == [False] + [True] * 59 + [False]
    assert tasks < 2000  # 2967 when every step read all parts of the one before


def test_gathered(spark, many_parts):
    little = common.gathered(spark.range(1000).repartition("id"))
    assert little.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in little.collect()) == list(range(1000))


def test_line_dedup_of_the_pipeline_tasks(spark, many_parts):
    got, tasks, _, _ = _told(spark, lambda: lines.dedup_lines(_docs(spark), copies=0.8).orderBy("doc_id").collect())
    assert len(got) == 61
    assert tasks < 3200  # 4338 when every step read all parts of the one before


def test_near_duplicates_tasks(spark, many_parts):
    base = " ".join(f"w{j}" for j in range(60))
    rows = [(i, f"{base} {i}" if i < 20 else f"{base[: 100 + i]} z{i} " + " ".join(f"v{(i * 7 + j) % 90}" for j in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, tasks, _, _ = _told(spark, lambda: minhash.near_duplicates(docs).orderBy("doc_id").collect())
    assert all((r.component_id == 0) == (r.doc_id < 20) for r in got)
    assert tasks < 4700  # 6266 when every step read all parts of the one before


def _leaf(kind, n):
    """Lines of one leaf: unlike ones that share a run of tokens, or a chain in which each is like the next alone."""
    rng = random.Random(5)
    if kind == "unlike":
        word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
        return [" ".join(["one", "leaf", "only", "with", "a", "run", *(word() for _ in range(14))]) for _ in range(n)]
    name = lambda i: "x" + "".join(chr(97 + int(c)) for c in str(i))
    return [" ".join(["one", "leaf", "only", *(name(i // 5 if p % 5 > i % 5 else i // 5 + 1) + chr(97 + p) for p in range(15))]) for i in range(n)]


@pytest.mark.parametrize(("kind", "n"), [("unlike", 5000), ("chain", 1000)])
def test_line_dedup_of_one_large_leaf(spark, kind, n):
    texts = _leaf(kind, n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, _, stages, jobs = _told(spark, lambda: {r.doc_id: r.dropped for r in lines.dedup_lines(docs).collect()})
    tokens, leads, gone = [t.split()[3:] for t in texts], [], set()
    for i, own in enumerate(tokens):  # all are in one document each, so that the smaller id comes first
        if kind == "unlike" or not any(sum(a == b for a, b in zip(own, tokens[j], strict=True)) >= 0.7 * len(own) - 1e-9 for j in leads):
            leads.append(i)
        else:
            gone.add(i)
    assert {d for d, dropped in got.items() if dropped} == gone
    assert kind == "unlike" or n / 4 < len(gone) < n
    assert jobs < 100 and stages < 100, (jobs, stages)
