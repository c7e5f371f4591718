"""Results that outlive a call."""

import pytest
from pyspark.sql import functions as F

from lexispark.operators import backends, fusion
from lexispark.plans import cache as C
from lexispark.plans.cache import ResultCache, fingerprint
from lexispark.plans.config import Config, ConfigurationError
from lexispark.plans.detect import detect

PLAIN = Config(backends=("lexicon",), filter_proper_nouns=False)
TEXTS = ["The cat was in the house and it is not there", "Le chat est dans la maison avec les enfants", "", None, "Der Hund und die Katze sind nicht im Haus", "12345!!!", "안녕하세요 여러분"]


def rows(frame, *columns):
    return sorted(map(tuple, frame.select("id", *columns).collect()))


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(40)], "id long, text string")


def test_second_run_detects_new_texts_only(spark, tmp_path, texts, monkeypatch):
    asked = []

    def counted(chosen, *args, **options):
        asked.append(sorted(r["id"] for r in chosen.select("id").collect()))
        return detect(chosen, *args, **options)

    monkeypatch.setattr(C, "detect", counted)
    cache = ResultCache(spark, str(tmp_path / "c"))
    fields = ["lang", "confidence", "raw_score", "reliable", "script", "backend", "reason", "candidates"]
    first = cache.detect(texts, PLAIN)
    assert rows(first, *fields) == rows(detect(texts, PLAIN), *fields) and not any(r["cached"] for r in first.collect())
    more = texts.unionByName(spark.createDataFrame([(100, "El perro que está en la casa no es de mi hermano"), (101, TEXTS[0]), (102, "el perro que no")], "id long, text string"))
    second = cache.detect(more, PLAIN)
    assert rows(second, *fields) == rows(detect(more, PLAIN), *fields)
    assert {r["id"] for r in second.filter("not cached").collect()} == {100, 102}
    assert asked == [list(range(7)), [100, 102]]
    assert rows(ResultCache(spark, str(tmp_path / "c")).detect(more, PLAIN), "cached") == [(r[0], True) for r in rows(more)]
    assert len(asked) == 2 and cache.size(PLAIN) == 9
    cache.clear()
    assert cache.size(PLAIN) == 0


def test_configurations_are_kept_apart(spark, tmp_path, texts):
    cache = ResultCache(spark, str(tmp_path / "c"))
    cache.detect(texts, PLAIN)
    only = Config(backends=("lexicon",), filter_proper_nouns=False, allowed=("fr",))
    assert cache.size(only) == 0
    assert rows(cache.detect(texts, only), "lang") == rows(detect(texts, only), "lang")
    assert cache.size(PLAIN) == cache.size(only) == 7
    hints = lambda *r: spark.createDataFrame(list(r), "word string, lang string")
    keys = [fingerprint(PLAIN), fingerprint(only), fingerprint(PLAIN, top_k=2), fingerprint(PLAIN, version="2"), fingerprint(PLAIN, hints=hints(("a", "fr"))), fingerprint(PLAIN, hints=hints(("fr", "a")))]
    assert len(set(keys)) == len(keys)
    assert fingerprint(PLAIN, hints=hints(("a", "fr"), ("b", "de"))) == fingerprint(PLAIN, hints=hints(("b", "de"), ("a", "fr"), ("a", "fr")))
    assert fingerprint(Config(once_per_text=True)) == fingerprint(Config())
    assert fingerprint(Config(backends=(backends.lexicon,))) != fingerprint(Config(backends=(backends.script,)))
    with pytest.raises(ConfigurationError):
        fingerprint(Config(backends=(lambda t: t,)))


def test_age_compaction_and_failed_writers(spark, tmp_path, texts):
    now = [1000.0]
    cache = ResultCache(spark, str(tmp_path / "c"), max_age_seconds=100, max_rows=8, clock=lambda: now[0])
    cache.detect(texts, PLAIN)
    now[0] = 1060.0
    late = spark.createDataFrame([(i, f"the house and the {'x' * i} cat") for i in range(5)], "id long, text string")
    cache.detect(late, PLAIN)
    assert cache.size(PLAIN) == 12
    folder = tmp_path / "c" / f"config={fingerprint(PLAIN)}"
    (folder / "batch-0").mkdir()
    (folder / "batch-0" / "part-0.parquet").write_text("what a failed writer left")
    assert cache.size(PLAIN) == 12
    cache.compact()
    assert cache.size(PLAIN) == 5 and len([b for b in folder.iterdir() if (b / "_SUCCESS").exists()]) == 1  # both calls are over 8
    assert (folder / "batch-0").exists()  # it may be a writer's that is still at work
    again = cache.detect(texts.unionByName(late.withColumn("id", F.col("id") + 100)), PLAIN)
    assert {r["id"] for r in again.filter("cached").collect()} == {100, 101, 102, 103, 104} and again.count() == 45
    now[0] = 1161.0
    assert cache.size(PLAIN) == 0
    assert not any(r["cached"] for r in cache.detect(late, PLAIN).collect())


def test_one_text_in_many_rows(spark, tmp_path, monkeypatch):
    """The rows of a frequent text are dealt over tasks; none is lost, none is given twice."""
    monkeypatch.setattr(fusion, "COPIES", 10)
    many = spark.range(500).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'the house and the cat' WHEN id % 3 = 1 THEN NULL ELSE concat('der Hund und die Katze ', repeat('x', cast(id AS int))) END AS text")
    cache = ResultCache(spark, str(tmp_path / "c"))
    for cached in (False, True):
        out = cache.detect(many, PLAIN)
        assert rows(out, "lang", "cached") == [(r[0], r[1], cached) for r in rows(detect(many, PLAIN), "lang")]
    empty = spark.createDataFrame([], "id long, text string")
    assert cache.detect(empty, PLAIN).count() == 0
    assert ResultCache(spark, str(tmp_path / "d")).detect(empty, PLAIN).count() == 0
