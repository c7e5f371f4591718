"""Code switching: spans of words or segments, their languages, and what a text is mixed of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD
from .backends import BUILT_IN, COLUMNS, Scorer, create_backend

MIN_LENGTH, MIN_CONFIDENCE, MIXED, SALTS = 3, 0.6, 0.15, 16
SEGMENTS = r"[.!?;,][\s\p{Z}]*|[\s\p{Z}]+(?:and|but|or|y|et|und|e)[\s\p{Z}]+"

# Patterns of mixed speech by pair of languages, in order; matched without regard to case. The borders
# of words are added in front (pattern()).
PATTERNS: list[tuple[str, str, list[str]]] = [
    ("en", "es", [r"(very|so|really)\s+(bueno|malo|loco|rico)", r"(muy|tan)\s+(cool|nice|good|bad)", r"(I|you|we|they)\s+(tengo|tienes|quiero|necesito)", r"(el|la|los|las)\s+\w+\s+(is|are|was|were)"]),
    ("en", "fr", [r"(très|trop|si)\s+(cool|nice|good)", r"(c'est|il est|elle est)\s+(so|very|really)", r"(I|you|we)\s+(suis|es|sommes|êtes)"]),
    ("en", "hi", [r"(main|tu|hum)\s+\w+\s+(will|can|must)", r"(I|you|we)\s+(karna|chahta|jata)"]),
    ("en", "de", [r"(das|es|ich)\s+(ist|bin)\s+(so|very|really)", r"(sehr|total|echt)\s+(cool|nice|good)"]),
]


def pattern(alternatives: list[str]) -> str:
    """One pattern that Java and RE2 read alike."""
    plain = [p.replace(r"\s", r"[\s\p{Z}]").replace(r"\w", f"[{WORD}]") for p in alternatives]
    return rf"(?i)(?:^|[^{WORD}])(?:" + "|".join(plain) + ")"


def switching_pattern(text: Column) -> Column:
    """struct<a, b>: the first pair of languages a pattern of which occurs, or null."""
    out = F.lit(None).cast("struct<a:string,b:string>")
    for a, b, own in reversed(PATTERNS):
        out = F.when(F.lower(text).rlike(pattern(own)), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))).otherwise(out)
    return out


def word_spans(texts: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, i, text, start, end) of words; places are sums of the lengths of the words and gaps before."""
    parts = F.regexp_extract_all("text", F.lit(rf"[{WORD}]+|[^{WORD}]+"), F.lit(0))
    rows = texts.select("id", F.posexplode(parts).alias("i", "text"))
    before = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.char_length("text")).over(before), F.lit(0)).cast("int"))
    return rows.filter(F.col("text").rlike(rf"^[{WORD}]") & (F.char_length("text") >= min_length)).select("id", "i", "text", "start", (F.col("start") + F.char_length("text")).cast("int").alias("end"))


def segments(texts: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, i, text, start, end) of trimmed segments between punctuation or conjunctions."""
    marked = F.split(F.regexp_replace("text", rf"({SEGMENTS})", "\x01$1\x01"), "\x01")
    rows = texts.select("id", F.posexplode(marked).alias("i", "raw"))
    before = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length("raw")).over(before), F.lit(0))).filter(F.col("i") % 2 == 0)
    text = F.regexp_replace("raw", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    lead = F.char_length("raw") - F.char_length(F.regexp_replace("raw", r"^[\s\p{Z}]+", ""))
    rows = rows.select("id", "i", text.alias("text"), (F.col("at") + lead).cast("int").alias("start")).filter(F.char_length("text") >= min_length)
    return rows.withColumn("end", (F.col("start") + F.char_length("text")).cast("int"))


def detect_spans(spans: DataFrame, scorer: Scorer | str, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Spans with language and confidence. A backend that is a Column reads each span where it is; others detect each
    distinct text once, and the spans of frequent texts are dealt over SALTS tasks when they meet their result."""
    name = scorer if isinstance(scorer, str) else next((n for n, f in BUILT_IN.items() if f is scorer), None)
    if name in COLUMNS:
        found = spans.withColumn("r", COLUMNS[name](F.col("text")))
        found = found.select("id", "i", "text", "r.language", "r.confidence", "start", "end")
        return found.filter((F.col("confidence") >= min_confidence) & (F.col("language") != "unknown"))
    run = create_backend(scorer) if isinstance(scorer, str) else scorer
    distinct = spans.select("text").distinct().withColumn("id", F.xxhash64("text"))
    found = run(distinct).filter((F.col("confidence") >= min_confidence) & (F.col("language") != "unknown"))
    named = distinct.join(found.select("id", "language", "confidence"), "id").drop("id")
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = spans.withColumn("salt", F.pmod(F.xxhash64("id", "i"), F.lit(SALTS)).cast("int"))
    return salted.join(named, ["text", "salt"]).select("id", "i", "text", "language", "confidence", "start", "end")


def language_spans(texts: DataFrame, scorer: Scorer | str, level: str = "word", min_length: int = MIN_LENGTH, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(id, start, end, text, language, confidence) in order of place."""
    spans = word_spans(texts, min_length) if level == "word" else segments(texts, min_length)
    return detect_spans(spans, scorer, min_confidence).select("id", "start", "end", "text", "language", "confidence")


def languages(summary: DataFrame) -> DataFrame:
    """``summary`` with languages: the primary one and then the others; none of an undetermined text."""
    primary = F.when(F.col("primary_language") != "und", F.array("primary_language")).otherwise(F.array().cast("array<string>"))
    return summary.withColumn("languages", F.concat(primary, "secondary_languages"))


def is_code_switched(texts: DataFrame, scorer: Scorer | str, **options) -> DataFrame:
    """(id, is_mixed)."""
    return detect(texts, scorer, **options).select("id", "is_mixed")


def summarize(texts: DataFrame, spans: DataFrame, by_length: bool = False) -> DataFrame:
    """(id, is_mixed, primary_language, secondary_languages, language_distribution, confidence), a row for every text."""
    size = F.sum(F.char_length("text")) if by_length else F.count("*")
    own = Window.partitionBy("id")
    counts = spans.groupBy("id", "language").agg(size.alias("n"), F.sum("confidence").alias("c"), F.count("*").alias("k"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(own)).withColumn("rn", F.row_number().over(own.orderBy(F.desc("n"), "language")))
    listed = F.array_sort(F.collect_list(F.struct("rn", "language", "share")))
    rows = shares.groupBy("id").agg(listed.alias("x"), (F.sum("c") / F.sum("k")).alias("confidence"))
    none = F.col("x").isNull()
    out = texts.select("id").join(rows, "id", "left")
    return out.select(
        "id",
        F.coalesce(F.get("x", F.lit(1))["share"] >= MIXED, F.lit(False)).alias("is_mixed"),
        F.when(none, "und").otherwise(F.get("x", F.lit(0))["language"]).alias("primary_language"),
        F.when(none, F.array().cast("array<string>")).otherwise(F.transform(F.slice("x", 2, 1 << 20), lambda e: e["language"])).alias("secondary_languages"),
        F.when(none, F.create_map().cast("map<string,double>")).otherwise(F.map_from_entries(F.transform("x", lambda e: F.struct(e["language"], e["share"])))).alias("language_distribution"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def detect(texts: DataFrame, scorer: Scorer | str, level: str = "word", min_length: int = MIN_LENGTH, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    spans = word_spans(texts, min_length) if level == "word" else segments(texts, min_length)
    return summarize(texts, detect_spans(spans, scorer, min_confidence), by_length=level != "word")
