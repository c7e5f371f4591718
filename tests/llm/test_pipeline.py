"""The pipeline's stages, one after another, against plain models of each."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_near import shingles, union
from test_ops import plain_tiles

from lexispark.llm import langid, lines
from lexispark.llm.tokens import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, copies int"


def corpus():
    rng = random.Random(11)
    words = {"xx": ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 8))) for _ in range(300)], "yy": ["".join(rng.choices("nopqrstu", k=rng.randrange(3, 8))) for _ in range(300)]}
    line = lambda lang, n=9: " ".join(rng.choices(words[lang], k=n))
    shared, item = line("xx", 12), [line("xx", 30), line("yy", 25)]
    rows = []
    for i in range(100):
        lang = "xx" if i % 2 else "yy"
        own = [line(lang) for _ in range(rng.randrange(12, 25))]
        if i % 3 == 0:
            own.insert(rng.randrange(len(own)), shared)
        rows.append((lang, "\n".join(own)))
        if i < 25:  # near-copies: a line of another kind, or a word more
            own = list(own)
            at = rng.randrange(len(own))
            own[at] = line(lang) if i % 2 else own[at] + " more"
            rows.append((lang, "\n".join(own)))
        if i % 20 == 0:
            rows.append((lang, f"{line(lang)}\n{item[i % 40 // 20].upper()}\n{line(lang)}"))
    rows += [("xx", rows[0][1])] * 3 + [(None, "zzzz vvvv wwww zvwz " * 40), ("xx", None), ("xx", ""), (None, line("xx") + "\n" + shared), ("yy", shared), ("xx", " ".join(rng.choices(words["xx"], k=9000)))]
    rng.shuffle(rows)
    docs = [(i, t, lang, "s", len(t or ""), "keep", 1) for i, (lang, t) in enumerate(rows)]
    docs += [docs[3], (None, line("yy"), "yy", None, None, "keep", 1), (4, line("xx"), "xx", "other text of an id", 1, "keep", 1)]
    return docs, item


def masked(line):
    tokens = [t for t in re.sub(r"[\t\r\f\v]", " ", line).split(" ") if t]
    out = ["<*>" if any(c in "0123456789" for c in t) else t for t in tokens]
    return out if 2 * out.count("<*>") <= len(out) else tokens


def plain_line_dedup(rows):
    """(id, text) after line dedup; a near-copy of the document that keeps most of its lines stays whole."""
    found: dict = {}
    for i, text in rows:
        for pos, line in enumerate((text or "").split("\n") if i is not None and text is not None else []):
            if len(own := masked(line)) >= 4:
                found.setdefault(tuple(own), []).append((i, pos))
    groups: dict = {}
    for t in sorted(found, key=lambda t: (-len({i for i, _ in found[t]}), min(found[t]))):
        need = int(np.ceil(0.7 * len(t[3:]) - 1e-9))
        like = [x for x in groups if len(x) == len(t) and x[:3] == t[:3] and sum(a == b for a, b in zip(t[3:], x[3:], strict=True)) >= need]
        groups.setdefault(like[0] if like else t, []).append(t)
    first = {}
    for own in groups.values():
        docs = {i for t in own for i, _ in found[t]}
        first |= {t: min(docs) if len(docs) > 1 else None for t in own}
    texts: dict = {}
    for i, text in rows:
        texts.setdefault(i, set()).add(text)
    out = []
    for i, text in rows:
        if i is None or text is None:
            out.append((i, text))
            continue
        lines = [(line, tuple(masked(line))) for line in text.split("\n")]
        gone = [k for k, (_, t) in enumerate(lines) if len(t) >= 4 and first[t] not in (None, i)]
        weights: dict = {}
        for k in gone:
            weights[first[lines[k][1]]] = weights.get(first[lines[k][1]], 0) + len(lines[k][1])
        sets = shingles(text, 5)
        near = any(len(sets & other) >= 0.8 * len(sets | other) - 1e-9 for t in texts[max(weights, key=weights.get)] for other in [shingles(t, 5)]) if weights else False
        text = text if near else "\n".join(line for k, (line, _) in enumerate(lines) if k not in gone)
        if near or not gone or text.strip():
            out.append((i, text))
    return out


def test_stages_equal_plain_models(spark, tmp_path):
    docs, items = corpus()
    table = spark.createDataFrame(docs, SCHEMA).repartition(3)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = lambda frame: sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)

    one = corpus_pipeline.language_id(spark, table, str(tmp_path)).cache()
    model = langid.train(table, usable=~langid.held_out())
    rejected = model.predict([d[1] for d in docs])[3]
    assert one.columns == table.columns
    assert rows(one) == sorted(((d[0], d[1]) for d, r in zip(docs, rejected, strict=True) if not r), key=str)
    gone = {d[1] for d, r in zip(docs, rejected, strict=True) if r}
    assert {None, "", "zzzz vvvv wwww zvwz " * 40} <= gone and len(gone) <= 5

    two = corpus_pipeline.line_dedup(spark, one, str(tmp_path)).cache()
    assert two.columns == table.columns and rows(two) == sorted(plain_line_dedup(rows(one)), key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())

    three = corpus_pipeline.near_dedup(spark, two, str(tmp_path)).cache()
    ids = {i for i, _ in rows(two) if i is not None}
    sets = [(i, shingles(t, 5)) for i, t in rows(two) if i is not None]
    pairs = [(a, b) for a, s in sets for b, z in sets if a < b and s and z and 100 * len(s & z) >= 80 * len(s | z)]
    kept = {i for i, root in union(pairs, ids).items() if i == root}
    assert three.columns == table.columns and rows(three) == [(i, t) for i, t in rows(two) if i is None or i in kept]
    assert len(ids) - len(kept) >= 20  # the near-copies are caught though the stage before takes lines away

    four = corpus_pipeline.decontamination(spark, three, str(tmp_path)).cache()
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    clean = []
    for i, t in rows(three):
        hit = [sum(n for *_, n in plain_tiles(words(x), words(t), 5)) >= 0.5 * len(words(x)) for x in items] if len(words(t)) < 2000 else [False]
        clean += [] if any(hit) else [(i, t)]
    assert four.columns == table.columns and rows(four) == clean and len(clean) < len(rows(three))

    out = corpus_pipeline.best_fit_packing(spark, four, str(tmp_path)).collect()
    coder, want = encoder(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t in rows(four):
        own = np.frombuffer(coder.encode([t])[0] + (1).to_bytes(4, "little"), "<u4")
        want += [(i, k // 4096, k, len(own[k : k + 4096]), zlib.crc32(own[k : k + 4096].tobytes())) for k in range(0, len(own), 4096)]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=str) == sorted(want, key=str)
    fill: dict = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= 1 + -(-sum(w[3] for w in want) // 4096)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.createDataFrame([], SCHEMA)
    out = dict(corpus_pipeline.STAGES)[name](spark, table, str(tmp_path))
    assert out.count() == 0 and (name == "best_fit_packing" or out.columns == table.columns)


def test_run_is_the_stages_one_after_another(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
    plain = lambda f: sorted(map(tuple, f.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("offset")).collect()), key=str)
    assert plain(out) == plain(frame)


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(6)) for _ in range(n))


def test_near_copies_stay_whole_beside_a_line_of_a_third(spark):
    """A line that a third document keeps doesn't hide the one that keeps the rest; pairs that are not alike lose their lines."""
    rng = random.Random(2)
    shared, other, body = _words(rng, 14), _words(rng, 10), _words(rng, 27)
    changed = body.split()
    changed[20] = "zzzzzz"
    rows = [(0, f"{shared}\n{_words(rng, 30)}"), (1, f"{shared}\n{other}\n{body}"), (2, f"{shared}\n{other}\n{' '.join(changed)}"), (3, f"{_words(rng, 40)}\n{other}")]
    dropped = lambda own: {r["doc_id"]: r["dropped"] for r in lines.dedup_lines(spark.createDataFrame(own, "doc_id long, text string"), copies=0.8).collect()}
    assert dropped(rows) == {0: [], 1: [0], 2: [], 3: [1]}
    assert dropped(rows[1:]) == {1: [], 2: [], 3: [1]}


def test_stages_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup):
        one, two = (sorted(map(str, stage(spark, docs.repartition(n, "n_chars"), sf_dir).collect())) for n in (2, 9))
        assert one == two
