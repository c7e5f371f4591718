"""SentencePiece coding, conversation repair and whitening, each against the library or a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from compare import assert_same
from pyspark.sql import functions as F

from lexispark.llm import pieces, turns, whitening
from lexispark.llm.queries import oracle_sql, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(n):
    rng = random.Random(1)
    out = ["", " ", "a" * 3000, " " * 777, "ab" * 5000, "the " * 3000, "▁x ▁▁y", "<s>hi</s> <0x41>", "\x00\n\n\ty", "日本語", "\U0001f600"]
    for _ in range(n):
        letters = rng.choice(["ab", "▁ a", "abcdefgh ", "日本語中文 the", "é́ \n\t<0x41>0123", "".join(chr(rng.randrange(1, 0x3000)) for _ in range(40)), " "])
        out.append("".join(rng.choice(letters) for _ in range(rng.randrange(60))))
    return out


@pytest.mark.parametrize("limits", [{}, {"LONG": 3}, {"SLICE": 16}, {"CACHE": 5}])
def test_pieces_equal_the_library(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(pieces, name, value)
    texts, plain, own = odd_texts(800), library(), pieces.Model(MODEL)
    want = plain.encode(texts)
    ids = own.encode(texts)
    assert [i.tolist() for i in ids] == want
    decoded = own.decode(np.concatenate(ids).astype(np.int64), np.concatenate([[0], np.cumsum([len(i) for i in ids])]))
    assert decoded.to_pylist() == [plain.decode(i) for i in want]


def test_pieces_long_word_by_queue_and_by_rounds():
    rng, own = random.Random(2), pieces.model(MODEL)
    sym = own.symbols(np.array([ord(rng.choice("abcdefghijklmnopetaoin")) for _ in range(3000)], np.uint32))
    assert own.merge_rounds(sym.copy(), np.zeros(len(sym), np.int64))[0].tolist() == own.merge_queue(sym).tolist()


def test_pieces_decode_any_ids():
    rng, plain, own = random.Random(3), library(), pieces.model(MODEL)
    lists = [[rng.choice([rng.randrange(259), rng.randrange(32000), 1, 2, 0, 259, 28705]) for _ in range(rng.randrange(12))] for _ in range(500)]
    decoded = own.decode(np.array([i for x in lists for i in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])]))
    assert decoded.to_pylist() == [plain.decode(x) for x in lists]
    with pytest.raises(ValueError, match="vocabulary"):
        own.decode(np.array([32000]), np.array([0, 1]))


def test_pieces_frames(spark):
    texts, plain = [None, *odd_texts(300)], library()
    frame = spark.createDataFrame([(i if i else None, t, "kept", [0]) for i, t in enumerate(texts)], "id long, text string, Extra string, IDS array<int>").repartition(3)
    want = {(i if i else None): plain.encode(t or "") for i, t in enumerate(texts)}
    for rows in (pieces.round_trip(frame, MODEL), pieces.decode(pieces.encode(frame, MODEL), MODEL)):
        assert [c.lower() for c in rows.columns] == ["id", "text", "extra", "ids", "decoded"]
        got = rows.collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r["ids"], r["decoded"], r["Extra"]) == (want[r["id"]], plain.decode(want[r["id"]]), "kept")
    assert pieces.round_trip(frame.limit(0), MODEL).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [None, 1318])], "id long, ids array<int>")
    assert sorted(map(tuple, pieces.decode(odd, MODEL).select("id", "decoded").collect())) == [(1, ""), (2, plain.decode([1318]))]


def test_op11_query(spark, sf_dir):
    plain = library()
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries()["op11_sentencepiece"](spark, sf_dir).collect()}
    ids = {d: plain.encode(t) for d, t in texts.items()}
    assert got == {d: (len(i), sha(",".join(map(str, i))), sha(plain.decode(i))) for d, i in ids.items()}


def plain_repair(rows):
    """Rows (conversation, turn, role, text), one dictionary of states for each conversation."""
    conversations, out = {}, {}
    for conv, turn, role, text in rows:
        own = conversations.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, own in conversations.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        numbers = [t for t, _, _ in own if t is not None]
        faults, seen, states = [], set(), {0: (0, "", ())}

        def put_in(states):
            for _ in range(2):
                for s, (cost, audit, lines) in list(states.items()):
                    to, line = (3, "assistant:") if s == 2 else (2, "user:")
                    states[to] = min(states.get(to, (1 << 60, "")), (cost + 3, audit + "I", (*lines, line)), key=lambda x: x[:2])

        put_in(states)
        for _, role, text in own:
            rest = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else ""
            faults.append(fault)
            seen.add((role, text))
            after = {}
            for s, (cost, audit, lines) in states.items():
                ways = [(s, 4, "D", lines)]
                if fault not in ("blank", "duplicate"):
                    to, want = (3, "assistant") if s == 2 else (2, "user")
                    pay = 3 * (fault == "truncated")
                    ways.append((to, pay + 3, "R", (*lines, f"{want}:{text}")))
                    if role[:1] == want[0] or (role[:1] == "s" and s == 0):
                        ways.append((1 if role[:1] == "s" else to, pay, "K", (*lines, f"{role}:{text}")))
                for to, more, letter, new in ways:
                    after[to] = min(after.get(to, (1 << 60, "")), (cost + more, audit + letter, new), key=lambda x: x[:2])
            states = after
            put_in(states)
        cost, audit, lines = min((states[s] for s in (0, 3) if s in states), key=lambda x: x[:2])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"max_rows": 5}, {"max_rows": 0}, {"max_bytes": 60}])
def test_repair_of_odd_conversations(spark, monkeypatch, limits):
    monkeypatch.setattr(turns, "BLOCK", 4)
    monkeypatch.setattr(turns, "FAN", 3)
    rng, rows = random.Random(4), []
    for conv in (None, *range(40)):
        for turn in range(rng.choice([1, 3, 8, 30])):
            for _ in range(rng.choice([1, 1, 1, 2])):
                role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s"])
                rows.append((conv, rng.choice([turn, turn, turn, 2 * turn, None]), role, rng.choice(["Hi.", "What?", "no end", "  \t", "", None, "x! \n", "é…", f"t{rng.randrange(99)}."])))
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, live string").repartition(5)
    got = {r[0]: tuple(r) for r in turns.damaged_and_repaired(frame, **limits).collect()}
    assert got == plain_repair(rows)


def test_repair_of_a_long_conversation(spark):
    """One conversation with nearly all rows, most of them one text: sorted and folded in blocks, not collected."""
    rows = [(7, i // 3, ("user", "assistant", "user")[i % 3], "Same." if i % 4 else f"No. {i}.") for i in range(3000)] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Yes.")]
    got = {r[0]: tuple(r) for r in turns.damaged_and_repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == plain_repair(rows)


def test_repair_without_rows(spark):
    none = turns.damaged_and_repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert none.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"] and none.count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    only = turns.damaged_and_repaired(spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string"))
    assert [tuple(r) for r in only.collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_op12_query(spark, sf_dir):
    assert_same(spark, sf_dir, queries()["op12_conversation_repair"], oracle_sql()["op12_conversation_repair"])


def plain_whitening(vectors):
    whole = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(whole), whole.sum(0)
    moved = n * whole - sums
    centred = (moved / n).astype(float)
    values, found = np.linalg.eigh(centred.T @ centred / n)
    return n, (moved * moved).sum(1).tolist(), values[::-1], found[:, ::-1], centred


def assert_whitened(rows, ids, vectors, k):
    n, deviation, values, found, centred = plain_whitening(vectors)
    want = centred @ found[:, :k] / np.sqrt(values[:k])
    at = {v: i for i, v in enumerate(ids)}
    got = np.zeros_like(want)
    for r in rows:
        i = at[r["vec_id"]]
        got[i, r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[i] and r["identity_error"] < 1e-8
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-8)
    assert len(rows) == n * k
    signs = np.sign((got * want).sum(0))
    np.testing.assert_allclose(got * signs, want, atol=1e-7)


def test_op13_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert_whitened(queries()["op13_embedding_whitening"](spark, sf_dir).collect(), [r[0] for r in rows], [r[1] for r in rows], 32)


@pytest.mark.parametrize("fall,expanded", [(0.6, False), (0.995, True)])
def test_whitening_by_range_finder(spark, fall, expanded):
    """A spectrum that falls fast is found by passes, a flat one by all dimensions; rows that don't count are odd."""
    d, k = 60, 4
    vectors = np.random.default_rng(1).normal(size=(500, d)) * 300 * fall ** np.arange(d)
    odd = [(-1, None), (-2, [1.0, None]), (-3, [float("nan")] * d), (-4, [float("inf"), *[0.0] * (d - 1)]), (-5, []), (-6, [1.0])]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + odd, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).repartition(9)
    found = whitening.fit(frame, components=k)
    assert found.expanded == expanded and found.n == 500
    assert_whitened(whitening.whiten(frame, found).collect(), range(500), vectors.tolist(), k)


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    few = spark.createDataFrame([(None, [0.0, 1.0, 2.0]), (2, [3.0, 1.0, 0.0]), (2, [3.0, 1.0, 0.0])], schema)
    assert sorted((r["vec_id"] or 0, r["component"]) for r in whitening.whitened(few).collect()) == [(0, 1), (2, 1), (2, 1)]


def test_whitening_exact_sums():
    x = np.array([[(1 << 40) + 3, 5], [1, 7]], np.int64)
    sums = x.sum(0)
    assert whitening.deviations(x[:, 1:], 2, sums[1:]).tolist() == [4, 4]
    with pytest.raises(OverflowError):
        whitening.deviations(x, 2, sums)
