"""Near-duplicates of texts and vectors, and components, against brute force."""

import random
import re
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import common, embeddings, minhash
from lexispark.llm.graph import components


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("local", [0, 1000])
def test_components(spark, local):
    rng = random.Random(1)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(500 + i, 501 + i) for i in range(20)] + [(900, 900 + i) for i in range(30)]
    out = components(spark.createDataFrame([*pairs, (None, 3), (4, 4)], "u long, v long"), local=local)
    found = {r["node"]: r["component_id"] for r in out.collect()}
    real = [p for p in pairs if p[0] != p[1]]
    assert found == union(real, {n for p in real for n in p})


def test_components_estimate_does_not_grow_by_rounds(spark, monkeypatch, tmp_path):
    """The estimated size of a join is the product of its sides'. Over checkpoints its digits doubled with each round at least (here to 5.62e591)."""
    monkeypatch.setattr(common, "SPLIT", 3)
    order = list(range(200))
    random.Random(3).shuffle(order)
    pairs = [*pairwise(order), *((1000, 1001 + i) for i in range(30))]
    path = str(tmp_path / "edges")
    spark.createDataFrame(pairs, "u long, v long").write.parquet(path)
    out = components(spark.read.parquet(path), local=0)
    assert "E+" not in out._jdf.queryExecution().optimizedPlan().stats().simpleString()
    assert {(r.node, r.component_id) for r in out.collect()} == {(i, 0) for i in range(200)} | {(1000 + i, 1000) for i in range(31)}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def near_texts():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "É", "A", "a"]
    rows = []
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.choice([3, 20, 60, 200]))
        for _ in range(rng.choice([1, 2, 12])):
            own = [w if rng.random() > rng.choice([0, 0.01, 0.03, 0.06]) else rng.choice(vocabulary) for w in words]
            rows.append((len(rows), rng.choice([" ", "\t", "\n", "  "]).join(own)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "x" * 100_000), (1007, "a b c d"), (1008, "A b c d")]
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_minhash_equals_brute_force(spark, k):
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, band string")
    sets = {i: shingles(t, k) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(pairs) > 50
    want = union(pairs, sets)
    out = {r["doc_id"]: r for r in minhash.near_duplicates(docs, k=k).collect()}
    assert {i: r["component_id"] for i, r in out.items()} == want
    assert all(out[i]["n_shingles"] == len(sets[i]) and out[i]["kept"] == (want[i] == i) for i in sets)


def test_exact_step_alone(spark, monkeypatch):
    """Links that the representatives miss are found by the exact step, also over several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    chain, rows = list(base), []
    for i in range(24):  # neighbours are alike, distant ones are not
        rows.append((i, " ".join(chain)))
        chain[rng.randrange(120)] = f"n{i}a"
        chain[rng.randrange(120)] = f"n{i}b"
    sets = {i: shingles(t, 5) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    rng.shuffle(rows)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == union(pairs, sets)


def test_exact_step_sends_a_large_group_once(spark, monkeypatch):
    """One lone text beside a component of 400: what is sent is linear in the component."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = [(7, i, 100, 0) for i in range(400)] + [(7, 1000, 100, 1000)]
    labelled = spark.createDataFrame(rows, "band long, cls long, size long, comp long")
    dealt = minhash._dealt(labelled, 80).collect()
    assert len(dealt) <= 400 + 60 and len({(r["bucket"], r["i"], r["j"]) for r in dealt}) <= 60
    assert {r["cls"] for r in dealt if r["side"] == 1} == {*range(400), 1000}
    far = spark.createDataFrame([(7, i, 100, 0) for i in range(400)] + [(7, 1000, 1000, 1000)], labelled.schema)
    assert {r["cls"] for r in minhash._dealt(far, 80).collect()} == {1000}  # no other text is of a size that may be alike


def test_hot_join(spark, monkeypatch):
    """A salted join gives what a plain one gives."""
    monkeypatch.setattr(common, "SPLIT", 5)
    left = spark.createDataFrame([(i % 3 if i < 60 else i, i, None) for i in range(80)] + [(None, 900, None)], "k long, x long, _salt long")
    right = spark.createDataFrame([(i, i * 10, i) for i in range(70)], "k long, y long, _salts long")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = common.hot_join(left, right, ["k"], ["x"], how), left.join(right, ["k"], how)
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_minhash_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    out = sorted(minhash.near_duplicates(odd).collect(), key=str)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(None, None, True), (1, 1, True), (2, 1, False)}


@pytest.mark.parametrize("cell", [4096, 16])
def test_embeddings_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", max(4, cell // 4))
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    rows = []
    for i in range(260):
        c = int(rng.integers(0, 40))
        v = centres[c] + rng.normal(size=32) * rng.choice([0, 0.02, 0.1, 0.2]) * 1.0
        rows.append((i, [float(np.float32(x)) for x in v], int(c % 2)))
    rows += [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] + [1.0] * 31, 0), (903, [None] + [1.0] * 31, 0), (904, rows[0][1], None), (905, [], 0), (906, [float("inf")] * 32, 1), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cls", F.lit(1))
    good = {i: np.array(v, float) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    label = {i: x for i, _, x in rows}
    pairs = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.98]
    degree = {i: sum(i in p for p in pairs) for i in label}
    out = {r["vec_id"]: r for r in embeddings.near_duplicates(table).collect()}
    assert len(pairs) > 100
    assert {i: r["n_links"] for i, r in out.items()} == degree
    assert {i: r["component_id"] for i, r in out.items()} == union(pairs, label)


def test_embeddings_recall_is_calibrated():
    """A pair exactly at the threshold reaches the count."""
    rng = np.random.default_rng(5)
    _, window, least = embeddings.calibrated(0.98, 64)
    directions = embeddings.directions(64)
    missed = 0
    for _ in range(2000):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (a @ b) * a
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b)
        missed += int((np.abs(directions @ (a - b)) <= window).sum() < least)
    assert missed <= 2


def test_colliding_pairs_equal_counting_all():
    rng = np.random.default_rng(6)
    left, right = rng.normal(size=(24, 70)), rng.normal(size=(24, 90))
    right[:, :70] = left + rng.normal(size=(24, 70)) * rng.choice([0.1, 0.3, 0.6], 70)
    for window, least in ((0.5, 20), (1.0, 24), (0.7, 12)):
        i, j = embeddings.colliding(left, right, window, least)
        want = np.argwhere((np.abs(left[:, :, None] - right[:, None, :]) <= window).sum(axis=0) >= least)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist())) and len(want)


@pytest.mark.parametrize("dense", [True, False])
def test_cuts_stop_where_they_do_not_divide(spark, monkeypatch, dense):
    """A dense cluster isn't multiplied by cuts; spread vectors are dealt to smaller cells. Links are exact either way."""
    monkeypatch.setattr(embeddings, "CELL", 64)
    monkeypatch.setattr(embeddings, "BLOCK", 128)
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=16) + rng.normal(size=(700, 16)) * (0.08 if dense else 1.0)
    if not dense:
        vectors[350:] = vectors[:350] + rng.normal(size=(350, 16)) * 0.12
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    seen = []
    monkeypatch.setattr(embeddings, "_cells", lambda *a, real=embeddings._cells: seen.append(real(*a)) or seen[0])
    out = {r["vec_id"]: r for r in embeddings.near_duplicates(table).collect()}
    sizes = [r["n"] for r in seen[0].groupBy("cell").agg(F.count("*").alias("n")).collect()]
    assert sizes == [700] if dense else max(sizes) < 500 and sum(sizes) < 700 * 12
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = unit @ unit.T
    assert np.abs(cosine - 0.98).min() > 1e-9
    links = (cosine >= 0.98) & ~np.eye(700, dtype=bool)
    assert links.sum() > 300 and [out[i]["n_links"] for i in range(700)] == links.sum(axis=1).tolist()
    want = union(np.argwhere(np.triu(links)).tolist(), range(700))
    assert {i: r["component_id"] for i, r in out.items()} == want


@pytest.mark.parametrize("cell", [4096, 64])
def test_a_dense_core_is_linked_without_comparing(spark, monkeypatch, cell):
    """A tight cluster with vectors around it, copies, a second label and far vectors: links are those of brute force."""
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=24)
    size = np.linalg.norm(centre)
    around = lambda n, angle: centre + rng.normal(size=(n, 24)) * angle * size / np.sqrt(24)
    vectors = np.concatenate([around(250, 0.03), around(150, 0.1), around(100, 0.2), rng.normal(size=(60, 24))])
    vectors = np.concatenate([vectors, vectors[:20], vectors[260:265], around(90, 0.05)])
    label = [1] * 585 + [2] * 90
    table = spark.createDataFrame([(i, v.tolist(), x) for i, (v, x) in enumerate(zip(vectors, label, strict=True))], "vec_id long, embedding array<double>, label int")
    compared = []
    monkeypatch.setattr(embeddings, "_dealt", lambda b, real=embeddings._dealt: compared.append(b) or real(b))
    out = {r["vec_id"]: r for r in embeddings.near_duplicates(table).collect()}
    core = {(r["label"], r["n"]) for r in compared[0].filter("core").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert len(core) == 2 and max(n for _, n in core) > 200
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = unit @ unit.T
    assert np.abs(cosine - 0.98).min() > 1e-9
    links = (cosine >= 0.98) & ~np.eye(len(unit), dtype=bool) & (np.array(label)[:, None] == np.array(label)[None, :])
    assert [out[i]["n_links"] for i in range(len(unit))] == links.sum(axis=1).tolist()
    assert {i: r["component_id"] for i, r in out.items()} == union(np.argwhere(np.triu(links)).tolist(), range(len(unit)))


def test_a_dense_cluster_is_sent_a_linear_number_of_times(spark):
    """20,000 vectors of one tight cluster and a few far ones: each goes to as many tasks as the few make blocks."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=16)
    unit = np.concatenate([centre + rng.normal(size=(20_000, 16)) * 0.02, rng.normal(size=(30, 16))])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rows = [("1", 16, i, 1, bytearray(v.tobytes()), 0, 0) for i, v in enumerate(unit)]
    cells = spark.createDataFrame(rows, "label string, dim int, cls long, copies long, unit binary, cell long, also long")
    blocked = embeddings._blocked(embeddings._cored(cells, 0.98))
    assert blocked.filter("core").count() == 20_000
    dealt = embeddings._dealt(blocked)
    assert dealt.count() < 20_000 + 30 * 30 + 1 and dealt.groupBy("i", "j").count().agg(F.max("count")).first()[0] < 4 * embeddings.BLOCK
    links = embeddings._core_links(blocked)
    assert links.filter("v is null").agg(F.count("*"), F.min("n"), F.max("n")).first()[:] == (20_000, 19_999, 19_999)
    assert links.filter("v = 0").count() == 19_999


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
