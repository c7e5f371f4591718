import pytest

from lexispark.plans.config import Builder, Config, ConfigurationError
from lexispark.plans.detect import Detector
from lexispark.sources.files import read_lines, read_pairs
from lexispark.sources.sessions import SessionStore
from lexispark.streaming.context import summary, track_sessions

SAMPLES = ["The cat was in the house and it is not there", "Le chat est dans la maison avec les enfants", "Der Hund und die Katze sind nicht im Haus", "", "ok", "12345!!!", None, "안녕하세요 여러분", "The cat was in the house and it is not there"]


def test_detector(spark):
    detector = Detector(spark, Builder().with_backends("lexicon", "script").with_proper_noun_filter(False).build())
    out = detector.detect_batch(SAMPLES, top_k=2)
    assert [r["lang"] for r in out] == ["en", "fr", "de", "und", "und", "und", "und", "ko", "en"]
    assert [r["reason"] for r in out][3:7] == ["empty_text", "too_little_text", "too_little_text", "empty_text"]
    assert out[7]["backend"] == "script" and out[7]["confidence"] == 0.99
    assert 1 <= len(out[0]["candidates"]) <= 2 and out[0]["candidates"][0]["lang"] == "en"
    only = Detector(spark, Config(backends=("lexicon",), allowed=("fr",), filter_proper_nouns=False)).detect(SAMPLES[1])
    assert only["lang"] == "fr"
    hints = spark.createDataFrame([("hola", "es")], "word string, lang string")
    assert Detector(spark, Config(mode="short")).detect("hola", hints=hints)["lang"] == "es"
    assert Detector(spark, Config(backends=(), filter_proper_nouns=False)).detect("some text here")["reason"] == "no_backend"
    with pytest.raises(ConfigurationError):
        Config(mode="x")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two \nthree\n")
    (tmp_path / "b.txt").write_text("en\nfr\nde\nes\n")
    assert [r["text"] for r in read_lines(spark, str(tmp_path / "a.txt")).collect()] == ["one", "two", "three"]
    assert {r["n"]: (r["text"], r["label"]) for r in read_pairs(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).collect()}[2] == (" two ", "de")
    (tmp_path / "c.txt").write_text("en\n")
    with pytest.raises(ValueError):
        read_pairs(spark, str(tmp_path / "a.txt"), str(tmp_path / "c.txt"))


def test_sessions(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "sessions"), max_turns=2, ttl_seconds=3600)
    turns = lambda rows: spark.createDataFrame(rows, "session_id string, turn int, lang string, confidence double")
    assert store.load("a") is None
    store.save(turns([("a", 0, "fr", 0.9), ("a", 1, "", 0.1), ("b", 0, "en", 0.5)]))
    store.save(turns([("a", 2, "en", 0.8), ("a", 3, "de", 0.7)]))
    assert store.load("a") == [("en", 0.8), ("de", 0.7)] and store.exists("b")
    store.delete("a")
    assert not store.exists("a") and store.load("b") == [("en", 0.5)]
    expired = SessionStore(spark, str(tmp_path / "sessions"), ttl_seconds=-1)
    expired.save(turns([("c", 0, "en", 0.5)]))
    assert not expired.exists("c")


def test_sessions_of_two_writers(spark, tmp_path, monkeypatch):
    """Of two writers of one bucket neither update is lost; compaction keeps what is there, and old lists and entries go."""
    from lexispark.sources import sessions

    monkeypatch.setattr(sessions, "MOST", 2)
    store, other = (SessionStore(spark, str(tmp_path / "s"), buckets=1) for _ in range(2))
    turns = lambda s, lang: spark.createDataFrame([(s, 0, lang, 0.5)], "session_id string, turn int, lang string, confidence double")
    publish, raced = store._publish, []

    def slow(path, text):
        if "/lists/" in path and not raced:
            raced.append(path)
            other.save(turns("b", "fr"))
        return publish(path, text)

    monkeypatch.setattr(store, "_publish", slow)
    store.save(turns("a", "en"))
    assert store.load("a") == [("en", 0.5)] and store.load("b") == [("fr", 0.5)]
    store.clear("a")
    store.clear("nobody")
    assert store.exists("a") and store.load("a") == [] and store.load("b") == [("fr", 0.5)] and not store.exists("nobody")
    for i in range(4):
        store.save(turns("c", "de"))
    assert len(store.load("c")) == 4 and store.sessions().count() == 3
    versions = store._versions(0)
    assert len(versions) == sessions.KEPT
    needed = {e for v in versions for e in store._list(0, v)}
    there = {p.parent.name for p in (tmp_path / "s" / "data").glob("*/bucket=0")}
    assert there == needed and len(store._list(0, versions[-1])) <= 3


def test_sessions_write_what_they_touch(spark, tmp_path):
    """A save of one session among thousands writes its bucket only, and no more than that session."""
    store = SessionStore(spark, str(tmp_path / "s"), buckets=8)
    many = spark.range(5000).selectExpr("concat('s', id) AS session_id", "0 AS turn", "'en' AS lang", "0.5D AS confidence")
    store.save(many.unionByName(spark.createDataFrame([(None, 0, "en", 0.5)], "session_id string, turn int, lang string, confidence double")))
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "s" / "data").rglob("*.parquet"))
    full, before = size(), [store._versions(b) for b in range(8)]
    store.save(many.filter("session_id = 's7'"))
    assert size() - full < full / 10
    assert sum(store._versions(b) != v for b, v in enumerate(before)) == 1
    assert store.load("s7") == [("en", 0.5)] * 2 and store.sessions().count() == 5000
    store.compact()
    assert {len(store._list(b, store._versions(b)[-1])) for b in range(8)} == {1}
    assert store.load("s7") == [("en", 0.5)] * 2 and store.sessions().count() == 5000


def test_numbered_lines_of_many_files(spark, tmp_path):
    from lexispark.sources.files import numbered

    (tmp_path / "d").mkdir()
    want = []
    for i in range(7):
        own = [f"{i} {k}" for k in range((i * 37) % 11 * 50)]
        (tmp_path / "d" / f"f{i}.txt").write_text("".join(x + "\n" for x in own))
        want += own
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
    try:
        assert [r["value"] for r in numbered(spark, str(tmp_path / "d")).orderBy("n").collect()] == want
        assert sorted(r["n"] for r in numbered(spark, str(tmp_path / "d")).collect()) == list(range(len(want)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_front_doors(spark):
    import lexispark
    from lexispark.plans.detect import Result

    lexispark.reset_default()
    one = lexispark.detect("The cat was in the house and it is not there")
    assert one == "en" and str(one) == "en" and one == Result(lang="en") and one != "fr" and {one} == {Result(lang="en")}
    assert lexispark.default_detector() is lexispark.default_detector()
    first = lexispark.default_detector()
    lexispark.reset_default()
    assert lexispark.default_detector() is not first
    assert [str(r) for r in lexispark.detect_batch(["Der Hund und die Katze sind nicht im Haus", "", None], mode="default")] == ["de", "und", "und"]
    assert lexispark.ensemble("Le chat est dans la maison avec les enfants", backends=["lexicon", "ngram_nb"], weights={"lexicon": 2.0}, strategy="soft", top_k=2)["candidates"][0]["lang"] == "fr"
    detector = Detector(spark, Config(backends=("lexicon",)))
    detector.set_languages("de")
    assert detector.detect("the house und der Hund") == "de" and detector.detect("the house und der Hund", allowed=["en"]) == "und"
    with pytest.raises(AttributeError):
        lexispark.nothing


def test_command_line(spark, tmp_path, capsys):
    from lexispark.cli import main, shown

    assert shown("x" * 120, Result_(), "table").splitlines()[0].endswith("x...")
    (tmp_path / "t.txt").write_text("The cat was in the house and it is not there\nDer Hund und die Katze sind nicht im Haus\n")
    for form, start in (("json", "{"), ("array", "[{"), ("table", "The cat")):
        main(["batch", str(tmp_path / "t.txt"), "--format", form])
        assert capsys.readouterr().out.startswith(start)
    main(["The cat was in the house and it is not there", "--format", "pretty"])
    assert '"lang": "en"' in capsys.readouterr().out


def Result_():
    from lexispark.plans.detect import Result

    return Result(lang="en", confidence=1.0, reason=None)


def test_stream_equals_batch(spark, tmp_path):
    """The stateful form gives for each turn what the window form gives."""
    from pyspark.sql import functions as F

    from lexispark.operators import context

    rows = [(s, t, ["fr", "en", "en", "und", "de"][(t * (i + 1)) % 5], 0.5 + 0.05 * t) for i, s in enumerate("abc") for t in range(6)]
    turns = spark.createDataFrame(rows, "session_id string, turn long, lang string, confidence double")
    turns.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = track_sessions(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in")), max_turns=3)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    run = stream.writeStream.format("memory").queryName("tracked").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert run.awaitTermination(120)
    got = {(r["session_id"], r["turn"]): (r["dominant"], r["streak"]) for r in spark.table("tracked").collect()}
    window = context.with_window(turns.withColumnRenamed("session_id", "conv_id"), 3)
    want = window.select("conv_id", "turn", context.dominant(context.distribution(F.col("window"))).alias("d"), context.streak(F.col("window"))["n"].alias("n")).collect()
    assert got == {(r["conv_id"], r["turn"]): (r["d"], r["n"]) for r in want}
    assert summary([]) == (None, 0.0, 0, 0.0)
