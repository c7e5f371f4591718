"""WARC, decontamination, sharding, token files, language ID, line dedup, licences, packing."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexispark.llm import decontaminate, langid, licenses, lines, packing, sharding, tokenfiles, warc
from lexispark.llm.tokens import encoder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, "http://c", None), (4, "x\r\ny", ""), (5, None, "z" * 300_000), (5, None, "z" * 300_000), (None, "n", "once")]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string")
    out = warc.round_trip(table, str(tmp_path / "w")).collect()
    assert len(out) == len(pages)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str)
    want = [(1, 9, digest("<p>é</p>"), "revisit", 2), (2, 9, digest("<p>é</p>"), "response", None), (3, 0, digest(""), "revisit", 4), (4, 0, digest(""), "response", None), (5, 300_000, digest("z" * 300_000), "response", None), (5, 300_000, digest("z" * 300_000), "response", None), (None, 4, digest("once"), "response", None)]
    assert got == sorted(want, key=str)
    full = {r["record_id"]: bytes(r["payload"]) for r in warc.read_archive(spark, str(tmp_path / "w")).filter("record_type = 'response'").collect()}
    assert full["urn:page:2"] == "<p>é</p>".encode() and full["urn:page:4"] == b""
    only = warc.read_archive(spark, str(tmp_path / "w")).filter(F.col("record_id") == "urn:page:2")
    assert only.count() == 1
    assert "= urn:page:2" not in only._jdf.queryExecution().executedPlan().toString()  # decided by the reader


@pytest.mark.parametrize("payload", ["full", "none"])
def test_warc_foreign_files(spark, tmp_path, payload):
    """Plain files, and gzip members without a recorded size."""
    records = [warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:x:{i}>"), ("Content-Type", "text/plain")], b"WARC/1.1\r\n" * i) for i in range(4)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    whole = b"".join(records)
    (tmp_path / "d.warc.gz").write_bytes(b"".join(gzip.compress(whole[i : i + 50]) for i in range(0, len(whole), 50)))
    (tmp_path / "e.warc.gz").write_bytes(warc.member(whole) + warc.member(records[0]) + gzip.compress(b"") + warc.member(records[3]))
    (tmp_path / "f.warc.gz").write_bytes(b"")
    rows = warc.read_archive(spark, str(tmp_path), payload).collect()
    assert sorted(r["record_id"] for r in rows) == sorted([f"urn:x:{i}" for i in range(4) for _ in range(5)] + ["urn:x:0", "urn:x:3"])
    one = warc.read_archive(spark, str(tmp_path), payload).filter(F.col("record_id") == "urn:x:3").collect()
    assert len(one) == 6 and (payload == "none" or all(bytes(r["payload"]) == b"WARC/1.1\r\n" * 3 for r in one))
    if payload == "full":
        assert {r["payload_bytes"] for r in rows} == {0, 10, 20, 30}


def test_warc_small_records_are_not_copied_again(tmp_path):
    """A buffer is cut once for each read, however many records it holds."""
    data = b"".join(warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:x:{i}>")], b"x" * (i % 7)) for i in range(3000))
    for gzipped in (False, True):
        source = warc._Input(io.BytesIO(gzip.compress(data) if gzipped else data), gzipped)
        cuts, add = [], source._add
        source._add = lambda more, cuts=cuts, add=add: cuts.append(1) or add(more)
        seen = 0
        while source.begin():
            headers = dict(h.split(": ", 1) for h in source.until(b"\r\n\r\n").decode().split("\r\n")[1:])
            n = int(headers["Content-Length"])
            assert headers["WARC-Record-ID"] == f"<urn:x:{seen}>" and n == seen % 7
            if seen % 2:
                source.skip(n)
            else:
                assert source.take(n) == b"x" * n
            seen += 1
        assert seen == 3000 and len(cuts) < 20


def test_warc_empty(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w")).count() == 0


def plain_tiles(item, doc, least):
    """Greedy string tiling as first published: quadratic, without hashes."""
    free_i, free_d, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best, found = least - 1, []
        for p in range(len(item)):
            for t in range(len(doc)):
                n = 0
                while p + n < len(item) and t + n < len(doc) and free_i[p + n] and free_d[t + n] and item[p + n] == doc[t + n]:
                    n += 1
                if n > best:
                    best, found = n, [(p, t)]
                elif n == best and n >= least:
                    found.append((p, t))
        if best < least:
            return tiles
        for p, t in found:
            if all(free_i[p : p + best]) and all(free_d[t : t + best]):
                for n in range(best):
                    free_i[p + n] = free_d[t + n] = False
                tiles.append((p, t, best))


def test_tiles_equal_plain_tiling():
    rng = np.random.default_rng(0)
    for _ in range(60):
        item = rng.integers(0, rng.choice([3, 12]), rng.integers(5, 40)).astype(np.uint64)
        doc = np.concatenate([item[10:], rng.integers(0, 12, 30).astype(np.uint64), item[:12]])
        a, b = decontaminate.tile(item, doc, 3), plain_tiles(item.tolist(), doc.tolist(), 3)
        assert sum(n for *_, n in a) == sum(n for *_, n in b)
        assert sorted(n for *_, n in a) == sorted(n for *_, n in b)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination(spark, limit):
    words = [f"word{i}" for i in range(40)]
    item = " ".join(words)
    other = " ".join(f"thing{i}" for i in range(30))
    half = words[20:] + ["x", "y"] + words[:20]
    docs = [(1, "Before. " + item.upper() + " after"), (2, " ".join(half)), (3, " ".join(words[:15])), (4, "clean text " * 30), (5, None), (6, ""), (None, item), (7, item), (7, item), (8, "filler " * 5000 + other + " filler" * 5000)]
    table = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, key int")
    bench = spark.createDataFrame([(10, item), (11, other), (12, "too short"), (13, None), (14, "")], "item_id long, text string")
    out = decontaminate.contaminated(table, bench, limit=limit).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in out), key=str) == sorted([(1, 10), (2, 10), (None, 10), (7, 10), (7, 10), (8, 11)], key=str)
    assert {r["doc_id"]: len(r["tiles"]) for r in out}[2] == 2
    left = decontaminate.drop_contaminated(table, bench, limit=limit)
    assert left.columns == table.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(table, bench.limit(0), limit=limit).count() == 0


def test_decontamination_of_typographic_copies_and_clashing_columns(spark):
    item = "It's a test of copies that were set again with other marks and blanks by some editor"
    again = item.replace("'", "\u2019").replace(" that", ",\u00a0that").replace(" with", "\u2014with").replace("marks", "\u00abmarks\u00bb").replace("editor", "editor\u2026\uff01\u3002") + " caf\u00e9\u2003x"
    docs = [(1, again, "k", 1), (2, "na\u00efve caf\u00e9 \u4e2d\u3005\u6587 \u00b5\u00bd", "k", 2), (3, None, "k", 3)]
    table = spark.createDataFrame(docs, "doc_id long, text string, _doc string, _KEY long")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    for limit in (1 << 20, 0):
        found = decontaminate.contaminated(table, bench, limit=limit).collect()
        assert [(r["doc_id"], r["matched"]) for r in found] == [(1, 18)]
        left = decontaminate.drop_contaminated(table, bench, limit=limit)
        assert left.columns == table.columns and sorted(map(tuple, left.collect())) == docs[1:]
        assert decontaminate.drop_contaminated(table.limit(0), bench, limit=limit).count() == 0


def test_seeds_of_a_large_benchmark(spark, monkeypatch):
    """A passage in all documents is dealt over tasks; what the benchmark has not does not travel; the result is the broadcast way's."""
    rng = random.Random(5)
    common_item, rare_item = " ".join(f"c{i}" for i in range(12)), " ".join(f"r{i}" for i in range(12))
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    docs = spark.createDataFrame([(i, f"{own(60)} {common_item} {own(60)}" + (f" {rare_item}" if i % 40 == 0 else "")) for i in range(120)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, common_item), (2, rare_item), (3, own(20))], "item_id long, text string")
    bits = np.zeros(1 << (decontaminate.FILTER_BITS - 6), np.uint64)
    seeds = np.array([0, 5, 1 << 63, (1 << 64) - 1], np.uint64)
    for s in seeds[1:].tolist():
        bits[(s >> (64 - decontaminate.FILTER_BITS)) >> 6] |= np.uint64(1 << ((s >> (64 - decontaminate.FILTER_BITS)) & 63))
    made = decontaminate._bits(spark.createDataFrame([(s,) for s in seeds[1:].view(np.int64).tolist()], "seed long"))
    assert (made == bits).all() and decontaminate._passing(np.array([5, 7 << 40, 1 << 63, (1 << 64) - 1], np.uint64), made).tolist() == [5, 1 << 63, (1 << 64) - 1]
    told = lambda limit: sorted((r["doc_id"], r["item_id"], r["matched"]) for r in decontaminate.contaminated(docs, bench, limit=limit).collect())
    want, travelled, plain = told(1 << 20), [], decontaminate.hot_join

    def watched(left, right, *rest, **named):
        travelled.append(left.count())
        return plain(left, right, *rest, **named)

    monkeypatch.setattr(decontaminate, "hot_join", watched)
    monkeypatch.setattr("lexispark.llm.common.SPLIT", 10)
    assert told(0) == want and len(want) == 123
    assert 120 * 8 <= travelled[0] <= 123 * 8 + 5  # of some 130 seeds of a document only those of the items


def test_tiles_of_repeated_words_are_found_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    rng = np.random.default_rng(1)
    for _ in range(20):
        item, doc = rng.integers(0, 2, 30).astype(np.uint64), rng.integers(0, 2, 60).astype(np.uint64)
        assert sum(n for *_, n in decontaminate.tile(item, doc, 3)) == sum(n for *_, n in plain_tiles(item.tolist(), doc.tolist(), 3))
    same = np.zeros(3000, np.uint64)
    assert decontaminate.tile(same[:300], same, 5) == [(0, 0, 300)]


def test_sharding(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20)
    with pytest.raises(FileNotFoundError):
        store.read()
    table = spark.createDataFrame([(i, "t" * (i % 7), None) for i in range(200)] + [(5, "x", None)], "doc_id long, text string, arrival int")
    for part in range(5):
        store.append(table.filter(F.col("doc_id") % 5 == part).coalesce(2))
    store.append(table.limit(0).coalesce(1).filter("false"))
    before = store.manifest()
    made = store.compact()
    assert made["version"] > before["version"] and len(made["runs"]) < len(before["runs"])
    assert store.read().exceptAll(table).count() == 0 and table.exceptAll(store.read()).count() == 0
    assert store.read(before["version"]).count() == 201  # the older version is still whole
    with pytest.raises(sharding.Conflict):
        store.commit(before, [])
    assert store.vacuum() > 0 and store.read().count() == 201
    assert store.compact()["version"] == made["version"]


def test_sharding_of_arrivals_in_one_job(spark, tmp_path):
    rows = [(i, None if i == 7 else i % 3, "b", f"text {i}", i) for i in range(60)] + [(1, 1, "b", "text 1", 1)] * 2
    table = spark.createDataFrame(rows, "doc_id long, _batch long, _BATCH_ string, text string, arrival long").repartition(3)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fan_in=2)
    made = store.append_batches(table, "_batch")
    assert made["version"] == 4 == len(made["runs"])
    assert len(store.compact()["runs"]) == 1
    assert store.read().columns == table.columns
    assert store.read().exceptAll(table).count() == 0 and table.exceptAll(store.read()).count() == 0
    out = sharding.shard_round_trip(table, "arrival")
    assert out.columns == table.columns and out.exceptAll(table).count() == 0 and out.count() == 62
    assert sharding.shard_round_trip(table.limit(0), "arrival").count() == 0


def test_compaction_that_loses_a_race_starts_again(spark, tmp_path, monkeypatch):
    store, other = (sharding.ShardStore(spark, str(tmp_path / "s"), fan_in=2) for _ in range(2))
    for i in range(4):
        store.append(spark.range(i, i + 1).coalesce(1))
    merge, lost = store._merge, []

    def slow(runs):
        out = merge(runs)
        if not lost:
            lost.append(out["name"])
            other.compact()
        return out

    monkeypatch.setattr(store, "_merge", slow)
    assert len(store.compact()["runs"]) == 1 and sorted(r["id"] for r in store.read().collect()) == [0, 1, 2, 3]
    assert not (tmp_path / "s" / "data" / lost[0]).exists()


def test_token_files(spark, tmp_path):
    docs = [(0, "hello world"), (1, ""), (2, None), (3, "x " * 700), (4, "last")]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    out = {r["doc_id"]: r["n_tokens"] for r in tokenfiles.document_token_counts(table, TOKENIZER, 49407, str(tmp_path / "t")).collect()}
    assert out == {i: len(encoder(TOKENIZER).encode([t])[0]) // 4 for i, t in docs}
    rng = np.random.default_rng(1)
    (tmp_path / "f").mkdir()
    ids = rng.integers(0, 5, 1000).astype("<u2")
    (tmp_path / "f" / "a.tokens").write_bytes(ids.tobytes())
    (tmp_path / "f" / "b.tokens").write_bytes(b"")
    for block in (1, 7, 64, 5000):
        rows = tokenfiles.count_tokens(spark, str(tmp_path / "f"), 0, block=block).orderBy("ordinal").collect()
        ends = np.flatnonzero(ids == 0)
        lengths = np.diff(np.concatenate([[-1], ends])) - 1
        tail = len(ids) - 1 - ends[-1]
        assert [r["n_tokens"] for r in rows] == [*lengths.tolist(), *([tail] if tail else [])]
        assert [r["ordinal"] for r in rows] == list(range(len(rows))) and rows[-1]["terminated"] == (tail == 0)


def test_token_files_of_lost_attempts_and_odd_rows(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-000000-lost.tokens").write_bytes(b"\x01\x00\xff\xff")
    (tmp_path / "t" / "_part-000001-lost.tokens.tmp").write_bytes(b"\x01")
    docs = [(1, "a b"), (1, "a b"), (None, "c"), (None, None), (2, "x " * 30_000)]
    table = spark.createDataFrame([(i, t, "f", 1) for i, t in docs], "doc_id long, text string, file string, ordinal int").repartition(2)
    out = tokenfiles.document_token_counts(table, TOKENIZER, 65535, str(tmp_path / "t")).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in out), key=str) == sorted([(i, len(encoder(TOKENIZER).encode([t])[0]) // 4) for i, t in docs], key=str)
    assert {p.name for p in (tmp_path / "t").iterdir() if not p.name.endswith(".crc")} == {r["file"] for r in out}
    assert tokenfiles.document_token_counts(table.limit(0), TOKENIZER, 65535, str(tmp_path / "e")).count() == 0


def plain_kneser_ney(texts, order):
    """Interpolated Kneser-Ney by dictionaries: a function (context, symbol, vocabulary size) -> probability."""
    from collections import Counter

    def read(text):
        out = []
        for c in text.lower():
            c = c if c.isalpha() else " "
            if c != " " or (out and out[-1] != " "):
                out.append(c)
        return out + [" "] * (not out or out[-1] != " ") if out else []

    raw = Counter()
    for text in texts:
        sym = read(text)
        for i in range(len(sym)):
            padded = [" "] * order + sym
            raw[tuple(padded[i + 1 : i + 1 + order])] += 1
    tables, counts = {}, raw
    for n in range(order, 0, -1):
        once, twice = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        totals, kinds = Counter(), Counter()
        for gram, c in counts.items():
            totals[gram[:-1]] += c
            kinds[gram[:-1]] += 1
        tables[n] = (counts, discount, totals, kinds)
        counts = Counter(gram[1:] for gram in counts)

    def p(context, symbol, vocabulary, n=order):
        if n == 0:
            return 1 / (vocabulary + 1)
        counts, discount, totals, kinds = tables[n]
        context = context[-(n - 1) :] if n > 1 else ()
        below = p(context[1:], symbol, vocabulary, n - 1)
        if not totals[context]:
            return below
        return max(counts[(*context, symbol)] - discount, 0) / totals[context] + discount * kinds[context] / totals[context] * below

    return read, p


@pytest.mark.parametrize("step", [1 << 18, 7, 1])
def test_kneser_ney_equals_a_plain_model(monkeypatch, step):
    monkeypatch.setattr(langid, "STEP", step)
    rng = random.Random(4)
    made = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    texts = {"a": made("abcde  ,"), "b": made("cdefgh .\n")}
    model = langid.Model(texts)
    tried = [*made("abcdefgh  "), "a", "  x1y", "zz", *texts["a"][:3]]
    ce, sizes, good = model.scores(tried)
    vocabulary = len({c for own in texts.values() for t in own for c in t.lower() if c.isalpha()}) + 1
    for i, lang in enumerate(model.langs):
        read, p = plain_kneser_ney(texts[lang], langid.ORDER)
        for j, text in enumerate(tried):
            sym = read(text)
            assert sizes[j] == len(sym) and good[j] == any(c.isalpha() for c in text)
            padded = [" "] * langid.ORDER + sym
            want = -sum(np.log(p(tuple(padded[k + 1 : k + langid.ORDER]), padded[k + langid.ORDER], vocabulary)) for k in range(len(sym)))
            assert not sym or abs(want / len(sym) - ce[j, i]) < 1e-4, (text, lang)


def test_language_id_ties_repeats_and_long_texts(spark):
    model = langid.Model({"b": ["same text here"], "a": ["same text here"]})
    docs = [(1, "same text here", "x"), (1, "same text here", "x"), (2, "same text " * 200_000, "y"), (None, "text", "z")]
    out = langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang_pred string").withColumn("out", langid.held_out()), model).collect()
    assert [r["lang_pred"] for r in out] == ["a"] * 4 and len({r["score"] for r in out if r["doc_id"] == 1}) == 1
    assert [r["out"] for r in out if r["doc_id"] is None] == [False]


def test_language_models():
    model = langid.Model({"a": ["abc abd abe abc"], "b": ["xyz xyw"]})
    assert model.predict(["abc abd"])[0] == ["a"] and model.predict(["xyz"])[0] == ["b"]
    assert model.predict([None, "", "123"])[0] == ["und"] * 3 and model.predict([None])[3].all()


def test_kneser_ney_sums_to_one():
    """The interpolated probabilities of the whole vocabulary, with one unseen symbol, add up to one after any context."""
    model = langid.Model({"a": ["abc abd abe abc cab"]})
    vocabulary = [ord(c) for c in "abcde"] + [0, ord("q")]
    for context in ([97, 98], [98, 0], [99, 97, 98], [113, 113, 113]):
        total = 0.0
        for w in vocabulary:
            sym, place = np.array([*context, w], np.uint32), np.arange(len(context) + 1)
            keys = langid.grams(sym, place)
            p, at = 0.0, len(context)
            for n in range(langid.ORDER, 0, -1):
                table, values = model.tables[n - 1]
                hit = table.find(keys[n][at : at + 1])[0]
                if hit >= 0:
                    p += values[hit, 0]
                    break
                names, weights = model.weights[n - 1]
                ctx = names.find(langid.contexts(keys[n - 1], place, n - 1)[at : at + 1])[0]
                p += (weights[ctx, 0] if ctx >= 0 else 0.0) if n > 1 else model.unseen[0]
            total += np.exp(p)
        assert abs(total - 1) < 1e-4


def test_language_id_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit("clash"))
    model = langid.train(docs, usable=~langid.held_out())
    out = langid.identify(docs.withColumn("out", langid.held_out()), model).collect()
    held = [r for r in out if r["out"]]
    assert len(out) == docs.count() and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out) and sum(r["rejected"] for r in out) <= 0.02 * len(out)
    strange = langid.identify(spark.createDataFrame([(1, "zqxj vkwq qqxz jjvk " * 30), (2, None), (3, "42!")], "doc_id long, text string"), model).collect()
    assert all(r["rejected"] for r in strange) and [r["lang_pred"] for r in strange][1:] == ["und", "und"]
    assert langid.identify(docs.limit(0), model).count() == 0
    nothing = langid.train(docs.limit(0))
    assert langid.identify(docs.limit(3), nothing).filter("lang_pred = 'und'").count() == 3


def test_a_language_that_was_not_learned_is_rejected(spark):
    """A language of the table is left out of the fit: its texts go, the others' stay (those kept out of the fit are counted)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("lang").isNotNull())
    model = langid.train(docs.filter("lang <> 'fr'"), usable=~langid.held_out())
    told = langid.identify(docs.filter(langid.held_out()), model).groupBy((F.col("lang") == "fr").alias("foreign")).agg(F.avg(F.col("rejected").cast("int")).alias("gone"))
    gone = {r["foreign"]: r["gone"] for r in told.collect()}
    assert gone[True] > 0.9 and gone[False] < 0.01


def test_line_dedup(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"{long}\nunique line of document one"), (2, f"{long}\nanother line of document two"), (3, "Order 123 was sent to you today\nx"), (4, "Order 999 was sent to you today\ny"), (5, "short\nline"), (6, "short\nline"), (7, f"{long} thirteen"), (8, None), (9, ""), (None, long), (10, long.replace("seven", "7th")), (11, "same same same same\nsame same same same"), (12, f"  {long}\t")]
    table = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, dropped int")
    out = {r["doc_id"]: r for r in lines.dedup_lines(table).collect()}
    assert out[1]["text"] == docs[0][1] and out[2]["text"] == "another line of document two" and out[2]["dropped"] == [0]
    assert out[4]["text"] == "y" and out[3]["text"] == docs[2][1]
    assert out[5]["dropped"] == out[6]["dropped"] == [] and out[7]["dropped"] == []
    assert out[8]["text"] is None and out[9]["text"] == "" and out[None]["text"] == long
    assert out[10]["text"] == "" and out[11]["dropped"] == [] and out[12]["text"] == ""
    assert lines.dedup_lines(table.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, "y" * 200_000 + " a b c"), (2, "1" * 200_000 + " a b c")], "doc_id long, text string")
    assert lines.dedup_lines(huge).filter("size(dropped) > 0").count() == 0


def test_line_dedup_compares_tokens(spark):
    words = [f"w{'abcdefghijklmnopqrst'[i]}" for i in range(20)]
    change = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(words))
    docs = [(1, " ".join(words)), (2, change(4, 10, 16)), (3, change(4, 7, 10, 13, 16)), (4, change(4, 7, 10, 13, 16, 18))]
    out = {r["doc_id"]: r["dropped"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    # 14 and 12 of 17 tokens are enough for 0.7, 11 are not.
    assert out == {1: [], 2: [0], 3: [0], 4: []}


@pytest.mark.parametrize("work", [3000, lines.WORK])
def test_line_dedup_keeps_several_groups_of_a_leaf(spark, monkeypatch, work):
    monkeypatch.setattr(lines, "WORK", work)
    rng, head = random.Random(3), "one two three "
    bases = [[rng.choice("abcdefgh") for _ in range(10)] for _ in range(12)]
    texts = [head + " ".join("z" if rng.random() < 0.15 else w for w in rng.choice(bases)) for _ in range(150)]
    out = {r["doc_id"]: r["dropped"] for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    docs: dict = {}
    for i, t in enumerate(texts):
        docs.setdefault(t, []).append(i)
    # Brute force: by falling number of documents, a template leads or belongs to leading ones that it is like.
    leads: dict = {}
    for t in sorted(docs, key=lambda t: (-len(docs[t]), docs[t][0])):
        like = [x for x in leads if sum(a == b for a, b in zip(t.split()[3:], x.split()[3:], strict=True)) >= 7]
        leads[t] = [] if not like else None
        if like:
            del leads[t]
            leads[like[0]].append(t)
    assert len(leads) > 12
    want = {i: [] for i in range(len(texts))}
    for lead, own in leads.items():
        held = sorted(i for t in [lead, *own] for i in docs[t])
        want |= {i: [0] for i in held[1:]}
    assert out == want


def test_line_dedup_lines_of_numbers_are_told_apart(spark):
    """A line is masked only if at least half of its tokens are constant."""
    rng = random.Random(8)
    rows = [(i, "\n".join(" ".join(f"word{rng.randrange(1000)}" for _ in range(12)) for _ in range(3))) for i in range(60)]
    rows += [(100, rows[0][1].split("\n")[1]), (101, "a 1 2 3 4"), (102, "a 5 6 7 8"), (103, "a b 1 2 c"), (104, "a b 3 4 c"), (105, "1 2 3 4 5"), (106, "1 2 3 4 5")]
    out = {r["doc_id"]: r["dropped"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, d in out.items() if d} == {100, 104, 106}


def test_line_dedup_clashing_columns_ties_and_short_lines(spark):
    line = "one and the same line here"
    docs = [(1, line, "keep", 1, "a"), (2, line, "keep", 2, "b"), (2, line, "keep", 2, "b"), (3, "x\n\ny\n\nx", "keep", 3, "c"), (4, "x\n\nz", "keep", 4, "d")]
    table = spark.createDataFrame(docs, "doc_id long, text string, _doc string, _KEY long, leaf string")
    out = lines.dedup_lines(table)
    assert out.columns == [*table.columns, "n_lines", "dropped"]
    assert sorted(tuple(r)[:6] for r in out.collect()) == sorted([(1, line, "keep", 1, "a", 1), (2, "", "keep", 2, "b", 1), (2, "", "keep", 2, "b", 1), (3, docs[3][1], "keep", 3, "c", 5), (4, docs[4][1], "keep", 4, "d", 3)])
    short = {r["doc_id"]: r["dropped"] for r in lines.dedup_lines(table, min_tokens=1).collect()}
    assert short == {1: [], 2: [0], 3: [], 4: [0]}  # empty lines always stay
    many = spark.createDataFrame([(i, f"{line} {'abcdef'[i]}") for i in range(6)], "doc_id long, text string")
    assert [r["dropped"] for r in lines.dedup_lines(many, min_docs=7).orderBy("doc_id").collect()] == [[]] * 6
    assert [r["dropped"] for r in lines.dedup_lines(many, min_docs=6, similarity=0.5).orderBy("doc_id").collect()] == [[]] + [[0]] * 5


@pytest.mark.parametrize("work", [3000, lines.WORK])
def test_line_dedup_of_a_template_that_is_like_several(spark, monkeypatch, work):
    """It belongs to the first of them, whenever that is found to lead."""
    monkeypatch.setattr(lines, "WORK", work)
    head = "x y z "
    texts = [head + t for t in ["a a a a a a a a a a", "a a a a a a a b b b", "a a a a b b b b b b", "a a a a a b b b b b", "c c c c c c c b b b"] for _ in range(1)]
    for seed in range(4):
        rng = random.Random(seed)
        pool = [head + " ".join(rng.choice("ab") if rng.random() < 0.5 else "a" for _ in range(10)) for _ in range(40)] + texts
        docs: dict = {}
        rows = [(i, rng.choice(pool)) for i in range(120)]
        for i, t in rows:
            docs.setdefault(t, []).append(i)
        leads: dict = {}
        for t in sorted(docs, key=lambda t: (-len(docs[t]), docs[t][0])):
            like = [x for x in leads if sum(a == b for a, b in zip(t.split()[3:], x.split()[3:], strict=True)) >= 7]
            leads.setdefault(like[0] if like else t, []).append(t)
        want = {i: [] for i, _ in rows}
        for own in leads.values():
            want |= {i: [0] for i in sorted(i for t in own for i in docs[t])[1:]}
        out = {r["doc_id"]: r["dropped"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert out == want


def test_line_dedup_leaves_near_copies_whole(spark):
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(10))
    rows, shared = [], line()
    for i in range(40):
        own = [line() for _ in range(20)]
        rows.append((i, "\n".join([*own, shared])))
        own[rng.randrange(20)] = line()
        rows.append((100 + i, "\n".join([*own, shared] if i % 2 else own)))
    rows.append((300, "\n".join([rows[0][1].split("\n")[3], *(line() for _ in range(9))])))
    out = {r["doc_id"]: r["dropped"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), copies=0.8).collect()}
    assert all(out[100 + i] == [] for i in range(40)) and out[300] == [0]
    assert all(out[i] == ([20] if i else []) for i in range(40))
    plain = {r["doc_id"]: r["dropped"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(plain[100 + i]) >= 19 for i in range(40))


@pytest.mark.parametrize("name", ["op3_sharding", "op8_line_dedup", "op1_warc", "op4_embedding_neardup", "op5_minhash"])
def test_queries_match_their_sql(spark, sf_dir, name):
    from compare import assert_same

    from lexispark.llm import queries

    assert_same(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


def test_pipeline_keeps_documents_of_short_lines(spark):
    import corpus_pipeline

    shared = "this line is shared by all"
    docs = [(1, shared), (2, f"{shared}\nshort verse"), (3, f"{shared}\n \u00a0\n"), (4, f"\u4e2d\u6587\n{shared}"), (5, "short"), (6, "")]
    table = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, table, "").collect()}
    assert out == {1: shared, 2: "short verse", 4: "\u4e2d\u6587", 5: "short", 6: ""}


def test_token_counts_of_texts_that_quote_the_end_token(spark, tmp_path):
    from lexispark.llm.queries import op6_token_counts

    docs = [(1, "a b"), (2, "the <|endoftext|> token"), (3, "<|endoftext|>"), (4, None), (5, "last one")]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    out = [(r["doc_id"], r["n_tokens"]) for r in op6_token_counts(spark, str(tmp_path)).collect()]
    coded = encoder(TOKENIZER).encode([t or "" for _, t in docs])
    assert sorted(out) == [(i, len(c) // 4) for (i, _), c in zip(docs, coded, strict=True)]
    with pytest.raises(Exception, match="hold the separator 49407"):
        tokenfiles.document_token_counts(table, TOKENIZER, 49407, str(tmp_path / "t"))


def test_licenses(spark):
    model = licenses.Classifier([])
    marks = set(licenses.characteristic())
    assert all(marks & licenses.pairs_of(licenses.words(t)) for own in licenses.TEMPLATES.values() for t in own)
    apache = "Licensed under the Apache License, Version 2.0."
    texts = [(1, "Nothing here.\nReleased under the MIT License."), (2, "All rights reserved."), (3, licenses.OTHERWISE[0]), (4, None), (5, ""), (6, " ".join(["filler"] * 900) + f" {apache} " + " ".join(["filler"] * 900)), (None, "Licensed under CC BY-NC 4.0."), (7, "of the\nin the\nto use the"), (8, "apache " * 300_000)]
    table = spark.createDataFrame([(i, t, 1, "u") for i, t in texts], "doc_id long, text string, f int, unit string")
    out = {(r["doc_id"], r["family"]) for r in licenses.scan(table, model).collect()}
    assert out == {(1, "MIT"), (2, "Proprietary"), (6, "Apache-2.0"), (None, "CC-BY-NC")}
    assert licenses.scan(table.limit(0), model).count() == 0
    for family, own in licenses.TEMPLATES.items():
        found = licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(own)], "doc_id long, text string"), model).collect()
        assert sum(r["family"] == family for r in found) >= 0.8 * len(own), family


def test_licenses_with_hard_line_breaks_and_repeated_rows(spark):
    model = licenses.Classifier([])
    notice = licenses.TEMPLATES["BSD"][2].split()
    wrapped = "\n".join(" ".join(notice[i : i + 4]) for i in range(0, len(notice), 4))
    text = f"Some title\n\n{wrapped}\n \nOther text\nof two lines\n"
    nonsense = "He lost his driving licence and the version of the story"
    table = spark.createDataFrame([(1, text), (2, text), (2, text), (3, nonsense), (3, nonsense), (3, nonsense)], "doc_id long, text string")
    out = [(r["doc_id"], r["unit"], r["paragraph"], r["family"], r["probability"], r["similarity"]) for r in licenses.scan(table, model).collect()]
    assert len(out) == 3 and {o[0] for o in out} == {1, 2} and len({o[1:] for o in out}) == 1
    assert out[0][1:4] == ("paragraph", 1, "BSD") and out[0][5] == 1.0


def test_licenses_equal_a_plain_scorer(spark):
    """Every unit of every text, with and without any word of the templates, scored one by one on the driver."""
    corpus = ["the terms of use of this file and the source code are in the list of works", "a public work of the author may not be used in the software without written notice"] * 3 + ["she may use the file if the public has permission to read it"]
    model = licenses.Classifier(corpus)
    assert 0.5 <= model.threshold <= 0.95
    rng = random.Random(3)
    templates = [t for own in licenses.TEMPLATES.values() for t in own]
    texts = []
    for i in range(120):
        lines_ = []
        for _ in range(rng.randrange(1, 6)):
            own = rng.choice([*templates, *licenses.OTHERWISE, *corpus, "plain words and nothing else", ""]).split()
            own = [w if rng.random() > 0.1 else rng.choice(["the", "x", "software"]) for w in own]
            lines_ += [" ".join(own)] if rng.random() < 0.6 else [" ".join(own[: len(own) // 2]), " ".join(own[len(own) // 2 :])]
        texts.append((i, "\n".join(lines_)))
    bsd = licenses.TEMPLATES["BSD"][2].split()
    texts.append((501, "a title\n\n" + "\n".join(" ".join(bsd[i : i + 2]) for i in range(0, len(bsd), 2)) + "\n\nand\nmore"))
    texts.append((500, " ".join(["word"] * 350 + templates[1].split() + ["word"] * 700)))
    marks = set(licenses.characteristic())
    want = set()
    for i, text in texts:
        units = [("line", k, line) for k, line in enumerate(text.split("\n"))]
        units += [("paragraph", k, own) for k, own in enumerate(re.split(r"\n[ \t\r]*\n", text)) if len([x for x in own.split("\n") if x.strip()]) > 1]
        found = []
        for unit, k, own in units:
            tokens = licenses.words(own)
            for part in range(max(0, len(tokens) - 1 - 200) // 200 + 1):
                w = tokens[part * 200 : part * 200 + 400]
                if not w:
                    continue
                p, mine = model.probabilities(w), licenses.pairs_of(w)
                family = model.families[int(p.argmax())]
                like = max(len(mine & t) / max(1, min(len(mine), len(t))) if marks & mine & t else 0 for t in (licenses.pairs_of(licenses.words(x)) for x in licenses.TEMPLATES[family]))
                if p.max() >= model.threshold and p.max() >= 1 - p.sum() and like >= licenses.SIMILAR:
                    found.append((i, unit, k, part, family, round(like, 4)))
        lines_with = {f[4] for f in found if f[1] == "line"}
        want |= {f for f in found if f[1] == "line" or f[4] not in lines_with}
    out = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    got = {(r["doc_id"], r["unit"], r["paragraph"], r["part"], r["family"], r["similarity"]) for r in out}
    assert got == want and len(want) > 60 and any(w[1] == "paragraph" for w in want)


def test_licenses_are_calibrated_on_the_corpus(spark):
    """Units that use the templates' words otherwise set the threshold, and stay unknown."""
    rng = random.Random(5)
    otherwise = [f"the {a} may use this file with the {b} of the public license office" for a in ("clerk", "judge", "driver", "hunter") for b in ("copy", "version", "source", "list")]
    docs = [(i, "\n".join(rng.choices([*otherwise, "plain words of no kind"], k=4))) for i in range(200)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    model = licenses.train(table)
    assert len(model.calibration) >= 5 and model.threshold >= max(model.calibration)
    assert licenses.scan(table, model).count() == 0


def test_tokens_equal_the_tokenizer():
    coder, rng = encoder(TOKENIZER), random.Random(0)
    letters = [chr(c) for c in [*range(0x80), *range(0xA0, 0x180), *range(0x2010, 0x2060), 0x20AC, 0x3A3, 0x4E00, 0x1F600, 0x301]]
    texts = ["".join(rng.choices(letters, k=50)) for _ in range(500)] + ["a<|endoftext|>b", "İstanbul ΑΣ", "it's I'LL don’t"]
    want = [np.array(e.ids, "<u4").tobytes() for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want


def test_packing(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gammas"], k=rng.choice([1, 5, 20, 60])))) for i in range(150)] + [(900, None), (901, ""), (902, "word " * 700), (None, "null id"), (1, "again"), (1, "again")]
    table = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, length int")
    out = packing.pack(table, TOKENIZER, capacity=64, with_ids=True).collect()
    want = []
    for i, t in docs:
        ids = np.frombuffer(encoder(TOKENIZER).encode([t])[0] + (1).to_bytes(4, "little"), "<u4")
        want += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=str) == sorted(want, key=str)
    places: dict = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= 1 + -(-sum(w[3] for w in want) // 64)
    whole = packing.sequences(packing.pack(table, TOKENIZER, capacity=64, with_ids=True)).collect()
    assert len(whole) == len(places) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)
    assert packing.pack(table.limit(0), TOKENIZER).count() == 0


def optimum(lengths, capacity):
    """Fewest sequences, by search."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def search(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= lengths[i]}):
            rooms.remove(room)
            search(i + 1, [*rooms, room - lengths[i]])
            rooms.append(room)
        search(i + 1, [*rooms, capacity - lengths[i]])

    search(0, [])
    return best


def test_reduction_keeps_the_optimum():
    """What the reduction fixes, and the best packing of the rest, together need no more sequences than the optimum."""
    rng = random.Random(6)
    for _ in range(150):
        capacity = rng.choice([10, 17])
        lengths = [rng.randrange(2, capacity + 1) for _ in range(9)]
        plan = packing.Plan.__new__(packing.Plan)
        plan.capacity, plan.counts = capacity, np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
        plan.ranks, plan.rows, plan.sequences = np.zeros(capacity + 1, np.int64), [], 0
        plan._reduce()
        rest = [x for x in range(capacity + 1) for _ in range(int(plan.counts[x]))]
        assert plan.sequences + (optimum(rest, capacity) if rest else 0) == optimum(lengths, capacity)


def test_files_are_not_local(tmp_path):
    """Paths go through pyarrow's file systems, with or without a scheme."""
    for path in (str(tmp_path), f"file://{tmp_path}"):
        fs, inner = warc.open_fs(path)
        assert fs.get_file_info(inner).path == str(Path(tmp_path))


@pytest.mark.parametrize("wide_first", [True, False])
def test_shards_of_arrivals_with_different_columns(spark, tmp_path, wide_first):
    wide = spark.createDataFrame([(2, "y", "z")], "id int, A string, b string")
    slim = spark.createDataFrame([(1, "x", 1.5)], "id long, a string, c float")
    store = sharding.ShardStore(spark, str(tmp_path / "s"), fan_in=2)
    for rows in (wide, slim) if wide_first else (slim, wide):
        store.append(rows)
    want = [(1, "x", None, 1.5), (2, "y", "z", None)]
    told = lambda: sorted(map(tuple, store.read().select("id", "a", "b", "c").collect()))
    assert told() == want
    store.compact()
    assert store.vacuum() >= 2 and len(store.manifest()["runs"]) == 1
    assert told() == want
    with pytest.raises(TypeError, match="column a"):
        store.append(spark.createDataFrame([(3, 4)], "id int, a int"))
    assert told() == want


def test_shards_give_up_under_contention(spark, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))

    def taken(base, runs):
        raise sharding.Conflict("taken")

    monkeypatch.setattr(store, "commit", taken)
    with pytest.raises(sharding.Conflict, match="in between"):
        store.append(spark.range(1))


def test_language_id_keeps_columns_named_like_its_own(spark):
    rows = [(i, "the cat sat on the mat and looked" if i % 2 else "le chat est sur le tapis et regarde", "en" if i % 2 else "fr", i * 1.5, "mine") for i in range(60)]
    docs = spark.createDataFrame([*rows, (99, "123", "en", 9.0, "mine")], "doc_id long, text string, lang string, SCORE double, Rejected string")
    model = langid.train(docs)
    out = langid.accepted(docs, model)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(rows)
    replaced = langid.identify(docs, model)
    assert replaced.columns == ["doc_id", "text", "lang", "lang_pred", "score", "cross_entropy", "rejected"]
