"""The detection plan: normalise, gate, scripts, nouns, backends, vote, boosts, ranking, abstention.

Texts that a gate or their script decides have no backend results: the plan splits them off and unites the
results. What is known of a text (reason, script, results of backends that are Columns) is found in one pass over it
and kept without the text, so that no text is shuffled or stored. Every input row gives one output row; an id is a row's.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nouns, stats
from ..functions.text import normalize_text
from ..operators import confusion, fusion
from ..operators import hints as hinting
from ..operators.backends import COLUMNS, GRAMS, RELIABLE, create_backend, list_backends, run_backends, with_grams, written_result
from ..operators.voting import break_ties, voting_strategy
from .config import Config
from .keep import keep, spread

RESULT = ["id", "lang", "confidence", "raw_score", "reliable", "script", "backend", "reason", "candidates"]
SHORT_CIRCUIT = 0.99


def prepared(texts: DataFrame, config: Config) -> DataFrame:
    """(id, text, plain, detection_text, script, reason, decided, written): what is known before any backend.

    All in one expression, in which each step is evaluated once; as columns of their own, a filter on them would be pushed
    down together with copies of what they are made of. Letters are counted once, for all that is asked of them.
    """
    strategy = config.noun_strategy if config.filter_proper_nouns else "none"
    allowed = list(config.allowed) or None

    def lettered(plain: Column) -> Column:
        return _let(stats.letters_of(plain), lambda letters: gated(plain, letters))

    def gated(plain: Column, letters: Column) -> Column:
        def searched(reason: Column) -> Column:
            return _let(F.when(reason.isNull(), nouns.filter_nouns(plain, strategy, spaced=True)), lambda text: left(text, reason))

        def left(text: Column, reason: Column) -> Column:
            own = letters if strategy == "none" else F.when(text == plain, letters).otherwise(stats.letters_of(text))
            return _let(F.when(reason.isNull(), own), lambda own: scripted(text, reason, own))

        def scripted(text: Column, reason: Column, own: Column) -> Column:
            written = F.when(reason.isNull(), stats.written_of(own))
            return _let(F.when(reason.isNull(), stats.dominant_of(text, own)), lambda script: known(text, reason, script, written))

        def known(text: Column, reason: Column, script: Column, written: Column) -> Column:
            decided = stats.short_circuit(script, allowed, config.strict_scripts) if config.short_circuit else F.lit(None).cast("string")
            return F.struct(plain.alias("plain"), text.alias("detection_text"), script.alias("script"), reason.alias("reason"), decided.alias("decided"), written.alias("written"))

        return _let(stats.gate(plain, config.mode, letters), searched)

    return texts.select("id", "text", _let(normalize_text(F.col("text"), compose=config.compose), lettered).alias("s")).select("id", "text", "s.*")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def detect(texts: DataFrame, config: Config | None = None, hints: DataFrame | None = None, boosts: DataFrame | None = None, top_k: int = 1) -> DataFrame:
    """(id, lang, confidence, raw_score, reliable, script, backend, reason, candidates) for texts (id, text).

    hints: (word, lang). boosts: (id, lang, boost) of a conversation's context.
    """
    config = config or Config()
    if config.once_per_text and boosts is None:
        return fusion.once_per_text(texts, lambda t: _detect(t, config, hints, None, top_k)).select(*RESULT)
    return _detect(texts, config, hints, boosts, top_k)


def _detect(texts: DataFrame, config: Config, hints: DataFrame | None, boosts: DataFrame | None, top_k: int) -> DataFrame:
    rows = prepared(spread(texts.select("id", "text")), config)
    open_ = F.col("reason").isNull() & F.col("decided").isNull()
    inline = [b for b in config.backends if isinstance(b, str) and b in COLUMNS]
    counted = [b for b in config.backends if isinstance(b, str) and b in GRAMS]
    others = [b for b in config.backends if b not in inline and b not in counted]
    few = hinting.few_words(hints) if hints is not None and config.backends else None
    found = [F.struct(F.lit(b).alias("backend_name"), (written_result(F.col("written")) if b == "script" else COLUMNS[b](F.col("detection_text"))).alias("r")) for b in inline]
    none = F.lit(None).cast("array<struct<backend_name:string,r:struct<language:string,confidence:double,all_probabilities:map<string,double>>>>")
    head = F.substring(F.trim("text"), 1, fusion.SHORT_TEXT + 1).alias("text")  # all that a hint's weight asks of the raw text
    words = F.when(open_, hinting.hit_words(F.col("detection_text"), few)) if few else F.lit(None).cast("array<string>")
    info = rows.select("id", head, "script", "reason", "decided", F.when(open_, stats.languages_of(F.col("written"))).alias("langs"), (F.when(open_, F.array(*found)) if found else none).alias("found"), words.alias("words"), F.when(open_, F.col("detection_text")).alias("seen"))
    if counted:
        info = with_grams(info, counted)
        info = info.withColumn("found", F.when(open_, F.concat("found", "grams") if found else F.col("grams"))).drop("grams")
    info = keep(info.drop("seen"))

    empty = F.lit(None).cast("array<struct<lang:string,confidence:double,backend_votes:map<string,double>>>")
    name = config.backends[0] if len(config.backends) == 1 and isinstance(config.backends[0], str) else "ensemble"
    gated = info.filter("reason is not null").select("id", F.lit(config.unknown_label).alias("lang"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("raw_score"), F.lit(False).alias("reliable"), F.lit(None).cast("string").alias("script"), F.lit(None).cast("string").alias("backend"), "reason", empty.alias("candidates"))
    by_script = info.filter("reason is null and decided is not null").select("id", F.col("decided").alias("lang"), F.lit(SHORT_CIRCUIT).alias("confidence"), F.lit(SHORT_CIRCUIT).alias("raw_score"), F.lit(True).alias("reliable"), "script", F.lit("script").alias("backend"), "reason", empty.alias("candidates"))
    todo = info.filter(open_)
    if not config.backends:
        none = todo.select("id", F.lit(config.unknown_label).alias("lang"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("raw_score"), F.lit(False).alias("reliable"), "script", F.lit(None).cast("string").alias("backend"), F.lit(stats.NO_BACKEND).alias("reason"), empty.alias("candidates"))
        return gated.unionByName(by_script).unionByName(none)

    seen = rows.filter(open_).select("id", F.col("detection_text").alias("text"))
    answers = todo.select("id", F.explode("found").alias("x")).select("id", "x.backend_name", "x.r.language", "x.r.confidence", "x.r.all_probabilities", (F.col("x.r.confidence") > RELIABLE).alias("is_reliable"))
    results = answers.unionByName(keep(run_backends(seen, others))) if others else answers
    scores = voting_strategy(config.voting)(results, config.backend_weights or None)
    script_langs = todo.select("id", "langs").filter("langs is not null")
    scores = break_ties(scores, results, script_langs, list(config.allowed) or None)
    if hints is not None:
        own = todo.select("id", F.explode("words").alias("word")) if few is not None else None
        hits = hinting.lookup_all(seen, hints, config.hint_confidence) if own is None else hinting.shares(own, hints, config.hint_confidence)
        scores = fusion.boost_hints(scores, hits, todo.select("id", "text"), config.mode, config.hint_weight)
    if boosts is not None:
        scores = fusion.boost_context(scores, boosts, config.context_weight)
    if config.resolve_confusion:
        scores = confusion.resolve(scores, seen)
    ranked = fusion.rank(fusion.normalize(fusion.allow(scores, list(config.allowed)), config.normalize))
    decided = fusion.with_missing(todo, fusion.decide(ranked, config.thresholds[config.mode], config.allow_unknown, config.unknown_label), config.unknown_label)
    answered = results.groupBy("id").agg(F.count("*").alias("n"))
    out = decided.join(answered, "id", "left").join(todo.select("id", "script"), "id")
    out = out.withColumn("reason", F.when(F.col("n").isNull(), stats.NO_BACKEND).otherwise(F.col("reason"))).withColumn("backend", F.when(F.col("n").isNotNull(), name))
    out = out.join(fusion.candidates(ranked, results, top_k), "id", "left") if top_k > 1 else out.withColumn("candidates", empty)
    return gated.unionByName(by_script).unionByName(out.select(*RESULT))


class Result(dict):
    """A result row; equal to another result, or to a tag, of the same language, and shown as that."""

    def __eq__(self, other: object) -> bool:
        return self["lang"] == (other["lang"] if isinstance(other, Result) else other)

    def __ne__(self, other: object) -> bool:
        return not self == other

    def __hash__(self) -> int:
        return hash(self["lang"])

    def __str__(self) -> str:
        return self["lang"]


class Detector:
    """Driver-side front: single texts, lists and tables go through the same plan."""

    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        for name in self.config.backends:
            if isinstance(name, str):
                create_backend(name)

    @staticmethod
    def backends() -> list[str]:
        return list_backends()

    def set_languages(self, *langs: str) -> None:
        """Languages that are named when a call names none."""
        self.config = replace(self.config, allowed=langs)

    def detect_table(self, texts: DataFrame, id_col: str = "id", text_col: str = "text", **options) -> DataFrame:
        return detect(texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), self.config, **options)

    def detect_batch(self, texts: list[str | None], allowed: list[str] | None = None, **options) -> list[Result]:
        """Results in the order of the input."""
        rows = self.spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        config = self.config if allowed is None else replace(self.config, allowed=tuple(allowed))
        return [Result(r.asDict(recursive=True)) for r in detect(rows, config, **options).orderBy("id").collect()]

    def detect(self, text: str | None, **options) -> Result:
        return self.detect_batch([text], **options)[0]
