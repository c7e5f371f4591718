"""Votes that a plan reads several times are cast once and dealt by their size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexispark.operators import backends as B
from lexispark.operators import voting as V
from lexispark.plans import keep


@pytest.mark.parametrize("name", ["vot07_08_consensus", "fus01_break_ties", "fus07_08_candidates"])
def test_votes_are_cast_once(spark, sf_dir, name):
    plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "documents.parquet" not in plan


def test_dealt_grows_with_the_bytes(spark, monkeypatch):
    rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    least = spark.sparkContext.defaultParallelism
    assert keep.dealt(rows, "id").rdd.getNumPartitions() == least
    monkeypatch.setattr(keep, "DEALT_BYTES", 4000)
    out = keep.dealt(rows, "id")
    assert out.rdd.getNumPartitions() > 10 * least and out.count() == 4000


def test_the_default_plan_reads_a_text_once(spark, sf_dir):
    """All built-in backends and the words of hints are found in the pass that is kept."""
    for name in ("src05_ensemble", "evl01_default_accuracy"):
        plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "regexp_extract_all" not in plan


def test_custom_vote_goes_by_batches(spark, monkeypatch):
    """One call of Spark's for many texts, whose rows stay together over the borders of batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = [(i, f"b{j}", "en", j / 4, {"en": j / 4}, True) for j in range(4) for i in range(50)]
        results = spark.createDataFrame(rows, B.RESULT)
        out = V.custom_vote(lambda own: {"en": sum(r["all_probabilities"]["en"] for r in own), "n": len(own)})(results)
        assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, out.collect())) == sorted([(i, "en", 1.5) for i in range(50)] + [(i, "n", 4.0) for i in range(50)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_single_blanks_are_left_alone(spark):
    """Only what is not a single blank is replaced; the result is that of the plain rule."""
    from lexispark.functions import text as T

    odd = ["a b c", "a  b", " a\t b\u00a0\u2003c \n", "\x1c\x85x", "", "   ", "see http://x.y z", "www. a", "@me hi  #tag x", "a@b.cd  e", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "id long, text string")
    plain = lambda c: F.regexp_replace(c, T.SPACE, " ")
    old = F.coalesce(F.trim(plain(T.strip_mentions(T.strip_emails(T.strip_urls(plain(F.col("text"))))))), F.lit(""))
    assert rows.filter(~T.normalize_text(F.col("text")).eqNullSafe(old)).count() == 0
    assert rows.select(F.lit("a b c").rlike(T.UNEVEN)).first()[0] is False


def test_ratio_leaves_few_candidates(spark):
    """Letters leave candidates out before they are made distinct and go to Python; letters that share a bit, or are beyond 16 bits, lose none."""
    from lexispark.operators import hints as H

    words = ["straße", "strasse", "\U0001f600\U0001f601\U0001f602abc", "\U0001f600\U0001f601\U0001f602abd", "aaaaab", "bbbbba", "a!aaa", "zzzzz"]
    found = spark.createDataFrame([(w,) for w in words], "word string")
    out = H.ratio_matches(found, found.withColumn("lang", F.lit("x")), 80)
    assert "bit_count" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.word: (r.hint, r.ratio) for r in out.collect()} == {w: (w, 100.0) for w in words}
    others = found.filter(F.col("word").isin(words[1], words[3])).withColumn("lang", F.lit("x"))
    got = {r.word: round(r.ratio, 4) for r in H.ratio_matches(found, others, 80).collect()}
    assert got == {words[1]: 100.0, words[3]: 100.0, words[2]: round(1000 / 12, 4)}


ODD = ["", None, " ", "a", "µ ª º", "Ελλάδα and the rest", "Привет, как дела", "日本語 の文 x", "été № 5", "ǅungla the Of", "\U00010400\U00010428 x", "A  b\tC D", "x. The End Of Berta's I R2D2 NASA É\U0001f600 Paris \U0001f600 Rome"]


def test_default_plan_is_cheap_before_backends(spark):
    """Letters are counted in runs and once for gate, scripts and backend; nouns are looked for at capitals behind blanks; results are those of the plain rules."""
    from lexispark.functions import nouns, stats
    from lexispark.functions.text import WORD
    from lexispark.plans.config import Config
    from lexispark.plans.detect import prepared

    rows = spark.createDataFrame(list(enumerate(ODD)), "id long, text string")
    plan = prepared(rows, Config())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ]+") == 2  # of the text, and where nouns went from it
    assert nouns._noun().startswith(" (?=[") and "[\\s\\p{Z}]+" not in plan

    text = F.col("text")
    letters = F.regexp_replace(text, r"\P{L}", "")
    plain = F.struct(F.char_length(letters).alias("n"), F.regexp_replace(letters, r"\p{IsLatin}", "").alias("others"))
    assert rows.filter(text.isNotNull() & ~stats.letters_of(text).eqNullSafe(plain)).count() == 0
    common = "|".join(f"[^{WORD} ]*".join(w) for w in sorted(set(nouns.COMMON)))
    noun = rf"(?<=[^.!? ]) (?!(?i:[^{WORD} ]*(?:{common})[^{WORD} ]*(?![^ ])))(?:[\p{{Lu}}\p{{Lt}}](?![^ ])|(?=[^ ]*[\p{{Ll}}\p{{Lt}}])[\p{{Lu}}\p{{Lt}}][^ \p{{Nd}}]*(?![^ ]))"
    assert rows.filter(~F.regexp_replace(text, nouns._noun(), "").eqNullSafe(F.regexp_replace(text, noun, ""))).count() == 0


def test_ngrams_are_scored_by_kind():
    """Each different n-gram of a text is sought in the model once, with its number, for all backends of a pass."""
    from lexispark.operators import grams as G

    texts = ["the of the of and", "", "1 2", "\U00010400\U00010428 der die der", *("".join(chr(97 + i * j % 26) for j in range(900)) for i in range(1, 9))]
    keys, owner = G.grams(texts)
    found, sought = G.kinds(texts), []
    for i in range(len(texts)):
        own, n = np.unique(keys[owner == i], return_counts=True)
        assert found.keys[found.owner == i].tolist() == own.tolist() and found.n[found.owner == i].tolist() == n.tolist()
        assert G._most(n, 300).tolist() == np.lexsort((own, -n))[:300].tolist()
    model = B.word_model()
    model.find, find = lambda keys: sought.append(len(keys)) or find(keys), model.find
    model.bayes(texts, found), model.ranked(texts, found=found)
    assert sought == [len(found.keys)]
