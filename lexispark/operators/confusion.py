"""Languages that are easily confused: discriminating features, families, similarity."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAP, BOOST = 0.15, 0.2

# Groups of confused languages and what tells them apart; a feature that is listed
# twice counts twice.
GROUPS: list[dict[str, list[str]]] = [
    {
        "es": [
            "pero", "porque", "cuando", "donde", "como", "este", "esta", "tiene", "puede", "hace", "muy", "siempre", "nunca", "también", "ahora",
            "después", "antes", "sobre", "bajo", "entre", "ñ", "ll",
        ],
        "pt": [
            "mas", "porque", "quando", "onde", "como", "este", "esta", "tem", "pode", "faz", "muito", "sempre", "nunca", "também", "agora", "depois",
            "antes", "sobre", "baixo", "entre", "ão", "ões", "ção", "lh", "nh", "você", "vocês", "é", "são",
        ],
    },
    {
        "no": [
            "jeg", "ikke", "det", "og", "på", "er", "en", "av", "å", "være", "har", "kan", "vil", "skal", "må", "hva", "hvor", "når", "hvorfor",
            "hvem", "også", "bare", "aldri", "alltid",
        ],
        "da": [
            "jeg", "ikke", "det", "og", "på", "er", "en", "af", "at", "være", "har", "kan", "vil", "skal", "må", "hvad", "hvor", "hvornår", "hvorfor",
            "hvem", "også", "bare", "aldrig", "altid", "ø", "æ",
        ],
        "sv": [
            "jag", "inte", "det", "och", "på", "är", "en", "av", "att", "vara", "har", "kan", "vill", "ska", "måste", "vad", "var", "när", "varför",
            "vem", "också", "bara", "aldrig", "alltid", "ä", "ö",
        ],
    },
    {
        "cs": [
            "být", "mít", "dělat", "říct", "jít", "vědět", "chtít", "já", "ty", "on", "ona", "my", "vy", "oni", "ano", "ne", "proč", "jak", "kdy",
            "kde", "ř", "ě", "ů",
        ],
        "sk": [
            "byť", "mať", "robiť", "povedať", "ísť", "vedieť", "chcieť", "ja", "ty", "on", "ona", "my", "vy", "oni", "áno", "nie", "prečo", "ako",
            "kedy", "kde", "ä", "ô", "ĺ", "ŕ",
        ],
    },
    {
        "hr": [
            "tko", "što", "zašto", "gdje", "kako", "kada", "samo", "već", "još", "sada", "ovdje", "tamo", "trebati", "moći", "htjeti", "znati",
        ],
        "sr": [
            "ко", "шта", "зашто", "где", "како", "када", "ko", "šta", "zašto", "gde", "kako", "kada", "само", "већ", "још", "сада", "овде", "тамо",
        ],
        "bs": [
            "ko", "šta", "zašto", "gdje", "kako", "kada", "samo", "već", "još", "sada", "ovdje", "tamo",
        ],
    },
    {
        "id": [
            "tidak", "bukan", "dengan", "yang", "untuk", "dari", "adalah", "akan", "telah", "sedang", "sudah", "saya", "anda", "mereka", "kami",
            "kita", "apa", "siapa", "mengapa", "bagaimana", "dimana",
        ],
        "ms": [
            "tidak", "bukan", "dengan", "yang", "untuk", "dari", "ialah", "akan", "telah", "sedang", "sudah", "saya", "anda", "mereka", "kami",
            "kita", "apa", "siapa", "kenapa", "macam mana", "di mana",
        ],
    },
    {
        "ru": [
            "что", "как", "это", "он", "она", "они", "мы", "вы", "быть", "есть", "был", "была", "были", "будет", "и", "в", "не", "на", "с", "по",
            "для", "от",
        ],
        "uk": [
            "що", "як", "це", "він", "вона", "вони", "ми", "ви", "бути", "є", "був", "була", "були", "буде", "і", "в", "не", "на", "з", "по", "для",
            "від", "ї", "і", "є",
        ],
        "be": [
            "што", "як", "гэта", "ён", "яна", "яны", "мы", "вы", "быць", "ёсць", "быў", "была", "былі", "будзе", "і", "у", "не", "на", "з", "па",
            "для", "ад", "ў", "і",
        ],
    },
    {
        "hi": [
            "है", "हैं", "था", "थे", "और", "का", "की", "के", "को", "में", "से", "पर", "यह", "वह", "क्या",
        ],
        "ur": [
            "ہے", "ہیں", "تھا", "تھے", "اور", "کا", "کی", "کے", "کو", "میں", "سے", "پر", "یہ", "وہ", "کیا",
        ],
    },
]
# Language families, in order.
FAMILIES = {
    "romance": ["es", "pt", "fr", "it", "ro", "ca", "gl"],
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "hr", "sr", "bs", "bg", "sl"],
    "scandinavian": ["sv", "da", "no", "is"],
    "south_slavic": ["hr", "sr", "bs", "bg", "sl", "mk"],
    "east_slavic": ["ru", "uk", "be"],
    "west_slavic": ["pl", "cs", "sk"],
    "cjk": ["zh", "ja", "ko"],
    "semitic": ["ar", "he"],
    "indic": ["hi", "ur", "bn", "pa", "mr", "gu"],
    "austronesian": ["id", "ms", "tl"],
}


def features(spark: SparkSession) -> DataFrame:
    """(group_id, lang, feature, weight): weight is how often it is listed."""
    rows = [(i, lang, f) for i, group in enumerate(GROUPS) for lang, own in group.items() for f in own]
    return spark.createDataFrame(rows, "group_id int, lang string, feature string").groupBy("group_id", "lang", "feature").agg(F.count("*").cast("int").alias("weight"))


def families(spark: SparkSession) -> DataFrame:
    """(ord, family, lang)."""
    return spark.createDataFrame([(i, f, lang) for i, (f, own) in enumerate(FAMILIES.items()) for lang in own], "ord int, family string, lang string")


def confused_group(langs: Column) -> Column:
    """The first group that holds all languages of the array, or null."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(GROUPS))):
        out = F.when(F.size(F.array_except(langs, F.array(*map(F.lit, GROUPS[i])))) == 0, i).otherwise(out)
    return out


def discriminating_features(a: str, b: str) -> tuple[list[str], list[str]] | None:
    """Only for two languages that are a group by themselves."""
    group = next((g for g in GROUPS if set(g) == {a, b}), None)
    return group and (group[a], group[b])


@functools.cache
def _automaton(group: int):
    """All features of a group as one automaton; its values are the features' numbers in ``_weights``."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, feature in enumerate(_weights(group)):
        out.add_word(feature, i)
    out.make_automaton()
    return out


@functools.cache
def _weights(group: int) -> dict[str, dict[str, int]]:
    """For each feature of a group how often each language lists it."""
    out: dict[str, dict[str, int]] = {}
    for lang, own in GROUPS[group].items():
        for feature in own:
            out.setdefault(feature, {}).setdefault(lang, 0)
            out[feature][lang] += 1
    return out


def feature_hits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """For (lower-cased text, group) the weight of the features that the text holds, by language; each text is gone through once."""
    for texts, groups in batches:
        out = []
        for text, group in zip(texts, groups, strict=True):
            weights = list(_weights(int(group)).values())
            hits = dict.fromkeys(GROUPS[int(group)], 0)
            for i in {i for _, i in _automaton(int(group)).iter(text)} if text else ():
                for lang, weight in weights[i].items():
                    hits[lang] += weight
            out.append([{"lang": lang, "hits": n} for lang, n in hits.items()])
        yield pd.Series(out)


def resolve(scores: DataFrame, texts: DataFrame, top_n: int = 2, gap: float = GAP, factor: float = BOOST) -> DataFrame:
    """(id, lang, score): where the first languages are one confused group and close, features of the text add to the scores.

    Features are matched as substrings of the lower-cased text, only for texts that need it: all features of the group in
    one pass. A null text holds none.
    """
    order = Window.partitionBy("id").orderBy(F.desc("score"), "lang")
    ranked = scores.withColumn("rn", F.row_number().over(order))
    tops = ranked.groupBy("id").agg(F.collect_set(F.when(F.col("rn") <= top_n, F.col("lang"))).alias("langs"), F.count("*").alias("n"), F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("s2"))
    close = tops.filter((F.col("n") >= 2) & (F.col("s1") - F.col("s2") <= gap)).select("id", confused_group(F.col("langs")).alias("group_id")).filter("group_id is not null")
    found = F.pandas_udf("array<struct<lang:string,hits:bigint>>")(feature_hits)
    asked = texts.select("id", F.lower("text").alias("t")).join(close, "id").select("id", F.explode(found("t", "group_id")).alias("x"))
    asked = asked.select("id", "x.lang", "x.hits").join(scores.select("id", "lang"), ["id", "lang"])
    hits = asked.groupBy("id", "lang").agg(F.sum("hits").alias("hits"))
    boosts = hits.withColumn("all", F.sum("hits").over(Window.partitionBy("id"))).filter("all > 0").select("id", "lang", (F.col("hits") / F.col("all") * factor).alias("boost"))
    out = scores.join(boosts, ["id", "lang"], "left")
    return out.select("id", "lang", F.when(F.col("boost").isNull(), F.col("score")).otherwise(F.least(F.col("score") + F.col("boost"), F.lit(1.0))).alias("score"))


def family(lang: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, own in reversed(list(FAMILIES.items())):
        out = F.when(lang.isin(own), name).otherwise(out)
    return out


def are_related(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for own in FAMILIES.values():
        out = out | (a.isin(own) & b.isin(own))
    return out


def related_languages(langs: DataFrame) -> DataFrame:
    """(lang, related): every other language of its families. langs: (lang)."""
    dim = families(langs.sparkSession)
    other = dim.select("family", F.col("lang").alias("related"))
    return langs.select("lang").distinct().join(F.broadcast(dim), "lang").join(F.broadcast(other), "family").filter("related <> lang").select("lang", "related").distinct()


def similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.9 if a confused pair by themselves, 0.6 if of one family, else 0."""
    pair = F.lit(False)
    for group in GROUPS:
        if len(group) == 2:
            pair = pair | (a.isin(*group) & b.isin(*group))
    return F.when(a == b, 1.0).when(pair, 0.9).when(are_related(a, b), 0.6).otherwise(0.0)
