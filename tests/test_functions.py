from pyspark.sql import functions as F

from lexispark.functions import nouns, stats, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_normalize(spark):
    noisy = "See  https://a.b/c?d and www.x.org,\n mail me.you@mail.example.com @you #tag ok now"
    assert one(spark, noisy, text.normalize_text) == "See and mail ok now"
    assert one(spark, noisy, lambda t: text.normalize_text(t, strip_noise=False)).startswith("See https://a.b/c?d and")
    assert one(spark, None, text.normalize_text) == ""
    assert one(spark, "é", text.nfc) == "é"
    assert one(spark, None, text.nfc) is None


def test_tags(spark):
    for tag, lang in (("zh-CN", "zh-Hans"), ("zh-Hant-HK", "zh-Hant"), ("yue", "zh-Yue"), ("POR", "pt"), ("ceb", "ce"), ("x", "und"), ("", "und"), (None, "und"), ("und", "un")):
        assert one(spark, tag, text.normalize_tag) == lang


def test_stats(spark):
    row = one(spark, "Añb1 \U00010400", stats.text_stats)
    assert (row["n_chars"], row["n_letters"], row["unique_letters"]) == (6, 4, 4)
    assert row["script"] == "Latin" and not row["has_cjk"]
    empty = one(spark, "", stats.text_stats)
    assert empty["letter_ratio"] == 0 and empty["script"] is None and empty["is_mostly_ascii"]


def test_scripts(spark):
    for sample, script in (("Привет мир", "Cyrillic"), ("שלום", "Hebrew"), ("안녕", "Hangul"), ("日本語", "Han"), ("hello", "Latin"), ("αβγ", "Greek"), ("สวัสดี", "Thai"), ("ab дежз", "Mixed"), ("", "Unknown")):
        assert one(spark, sample, stats.detect_script)["script"] == script
    assert one(spark, "日本語", stats.dominant_script) == "CJK"
    assert one(spark, "ひらがな", stats.is_japanese) and not one(spark, "ひらがな", stats.is_chinese)
    assert one(spark, "你好", stats.is_chinese) and one(spark, "안녕", stats.is_korean)
    assert sorted(one(spark, "привет", lambda t: stats.filter_languages(t, F.array(F.lit("ru"), F.lit("en"))))) == ["ru"]
    assert one(spark, "hello", lambda t: stats.filter_languages(t)) is None
    assert one(spark, "Тамил", lambda t: stats.short_circuit(stats.dominant_script(t))) is None
    assert one(spark, "தமிழ்", lambda t: stats.short_circuit(stats.dominant_script(t))) == "ta"
    assert one(spark, "தமிழ்", lambda t: stats.short_circuit(stats.dominant_script(t), strict=True)) is None


def test_gates(spark):
    assert one(spark, "", stats.gate) == "empty_text"
    assert one(spark, "ok", stats.gate) == "too_little_text"
    assert one(spark, "ok", lambda t: stats.gate(t, "short")) is None
    assert one(spark, "12345", stats.gate) == "too_little_text"
    assert one(spark, "ab 123456789", stats.gate) == "non_linguistic"
    assert one(spark, "hello", stats.gate) is None


def test_nouns(spark):
    sample = "Yesterday John Smith met NASA people. The end came for Paris 2024X."
    assert one(spark, sample, nouns.filter_nouns) == "Yesterday met NASA people. The end came for 2024X."
    assert "[NAME] [NAME]" in one(spark, sample, lambda t: nouns.filter_nouns(t, "mask"))
    assert one(spark, sample, lambda t: nouns.filter_nouns(t, "none")) == sample
    assert one(spark, "", nouns.filter_nouns) == ""
    assert one(spark, "Yes it was Anna Lee. Bob ran.", nouns.identify_nouns) == ["Anna Lee"]
    assert one(spark, "Anna Lee", nouns.is_likely_name) and not one(spark, "the Anna", nouns.is_likely_name)


def test_labels(spark):
    rows = spark.createDataFrame([("eng",), ("xyz",)], "label string")
    assert {r["label"]: r["lang"] for r in text.label_codes(rows, {"xyz": "xx"}).collect()} == {"eng": "en", "xyz": "xx"}
