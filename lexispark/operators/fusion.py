"""From scores to ranked results: hint and context boosts, allowed languages, normalisation, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import DISAGREEMENT, LOW_CONFIDENCE
from ..functions.text import normalize_tag

HINT_WEIGHT, CONTEXT_WEIGHT, SHORT_TEXT = 0.3, 0.2, 5
#: Rows of one text that go to one task, and the texts with most rows that are dealt over several.
COPIES, MOST_COPIED = 10_000, 10_000


def hint_factor(text: Column, mode: str | None, weight: float = HINT_WEIGHT) -> Column:
    """Hints dominate raw texts of at most 5 characters in short mode; elsewhere they are weighted."""
    if mode == "short":
        return F.when(F.char_length(F.trim(text)) <= SHORT_TEXT, F.lit(2.0)).otherwise(F.lit(weight * 1.5))
    return F.lit(float(weight))


def boost_hints(scores: DataFrame, hints: DataFrame, texts: DataFrame, mode: str | None = None, weight: float = HINT_WEIGHT) -> DataFrame:
    """Outer merge: languages that only hints name are added. hints: (id, lang, score); texts: (id, text)."""
    factor = texts.select("id", hint_factor(F.col("text"), mode, weight).alias("k"))
    weighted = hints.join(factor, "id").select("id", "lang", (F.col("score") * F.col("k")).alias("h"))
    both = scores.join(weighted, ["id", "lang"], "full_outer")
    return both.select("id", "lang", (F.coalesce("score", F.lit(0.0)) + F.coalesce("h", F.lit(0.0))).alias("score"))


def boost_context(scores: DataFrame, boosts: DataFrame, weight: float = CONTEXT_WEIGHT) -> DataFrame:
    """boosts: (id, lang, boost); only languages that are scored already gain."""
    both = scores.join(boosts, ["id", "lang"], "left")
    return both.select("id", "lang", (F.col("score") + F.coalesce("boost", F.lit(0.0)) * weight).alias("score"))


def allow(scores: DataFrame, allowed: list[str] | None) -> DataFrame:
    return scores.filter(F.col("lang").isin(allowed)) if allowed else scores


def normalize(scores: DataFrame, how: str = "max") -> DataFrame:
    """Scores divided by the greatest (or by the sum) of their text, where that is positive; raw_score keeps them."""
    own = Window.partitionBy("id")
    base = (F.max if how == "max" else F.sum)("score").over(own)
    return scores.withColumn("raw_score", F.col("score")).withColumn("score", F.when(base > 0, F.least(F.col("score") / base, F.lit(1.0))).otherwise(F.col("score")))


def rank(scores: DataFrame) -> DataFrame:
    """rn by falling score, then by language; next is the second score beside the first."""
    order = Window.partitionBy("id").orderBy(F.desc("score"), "lang")
    return scores.withColumn("rn", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))


def candidates(ranked: DataFrame, results: DataFrame | None = None, top_k: int = 1) -> DataFrame:
    """(id, candidates array<struct<lang, confidence, backend_votes>>) of the first ``top_k``."""
    top = ranked.filter(F.col("rn") <= top_k)
    if results is not None:
        votes = results.groupBy("id", F.col("language").alias("lang")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("backend_name", F.round("confidence", 4).alias("c"))))).alias("votes"))
        top = top.join(votes, ["id", "lang"], "left")
    else:
        top = top.withColumn("votes", F.lit(None).cast("map<string,double>"))
    item = F.struct("rn", normalize_tag(F.col("lang")).alias("lang"), F.round("score", 4).alias("confidence"), F.coalesce("votes", F.create_map().cast("map<string,double>")).alias("backend_votes"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col("rn").alias("o"), F.to_json(item).alias("j")))), lambda x: F.from_json(x["j"], "lang string, confidence double, backend_votes map<string,double>"))
    return top.groupBy("id").agg(listed.alias("candidates"))


def decide(ranked: DataFrame, threshold: Column | float, allow_unknown: bool = True, label: str = "und") -> DataFrame:
    """(id, lang, confidence, raw_score, reliable, reason) of each scored text."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    top = ranked.filter(F.col("rn") == 1)
    clash = F.col("next").isNotNull() & (F.col("score") - F.col("next") < 0.1) & (F.col("score") < limit)
    weak = (F.col("score") < limit) & F.lit(allow_unknown)
    reason = F.when(clash, DISAGREEMENT).when(weak, LOW_CONFIDENCE)
    lang = F.when(reason.isNotNull(), label).otherwise(normalize_tag(F.col("lang")))
    return top.select("id", lang.alias("lang"), F.round("score", 4).alias("confidence"), "raw_score", (reason.isNull() & (F.col("score") >= limit)).alias("reliable"), reason.alias("reason"))


def with_missing(texts: DataFrame, decided: DataFrame, label: str = "und") -> DataFrame:
    """A row for every id of ``texts``; those without any score abstain."""
    out = texts.select("id").join(decided, "id", "left")
    none = F.col("lang").isNull()
    return out.select("id", F.coalesce("lang", F.lit(label)).alias("lang"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("raw_score", F.lit(0.0)).alias("raw_score"), F.coalesce("reliable", F.lit(False)).alias("reliable"), F.when(none, LOW_CONFIDENCE).otherwise(F.col("reason")).alias("reason"))


def text_hash(text: Column) -> Column:
    """128 bits by which texts are told apart."""
    return F.coalesce(F.md5(text), F.lit("null"))


def to_copies(named: DataFrame, held: DataFrame) -> DataFrame:
    """named (id, hash) with the other columns of ``held`` (hash, n, ...), n being how many rows of ``named`` have the hash.

    Most hashes are of one row; the rows of others are dealt by hash and a salt, so that no text's copies meet in one task.
    """
    salts = F.ceil(F.col("n") / COPIES).cast("int")
    often = held.filter(F.col("n") > COPIES).orderBy(F.desc("n")).limit(MOST_COPIED).select("hash", salts.alias("k"))
    dealt = held.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    salted = named.select("id", "hash").join(F.broadcast(often), "hash", "left")
    salted = salted.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("k")), F.lit(0)).cast("int"))
    return salted.select("id", "hash", "salt").join(dealt, ["hash", "salt"]).drop("hash", "salt")


def once_per_text(texts: DataFrame, detect, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Detects each distinct text once, by the row with the smallest id, and gives its result to all rows with that text (what a result
    cache saves). Texts are told apart by 128 bits of hash; they travel once, to be dropped where another row stands for them."""
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = rows.select("id", text_hash(F.col("text")).alias("hash"))
    first = named.groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    distinct = rows.join(first.select(F.col("first").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    found = detect(distinct).withColumnRenamed("id", "first")
    return to_copies(named, first).join(found, "first").drop("first")
