"""Conversation context: the last turns of a conversation, their languages with decay, streaks and boosts.

turns: (conv_id, turn, lang, confidence). State "at" a turn covers it and the ``max_turns - 1`` before it; with
``before=True`` only turns before it. Everything partitions by conversation. The recursive form, in which a
turn's result depends on the context that earlier results made, folds each conversation's ordered turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TURNS, HISTORY_TURNS, DECAY = 2, 5, 0.9
SHARE_BOOST, STREAK_BOOST, STREAK_CAP, BOOST_CAP = 0.15, 0.02, 0.1, 0.3
UNKNOWN = "unknown"
TURN = "lang string, confidence double"


def with_window(turns: DataFrame, max_turns: int = MAX_TURNS, before: bool = False) -> DataFrame:
    """``turns`` with window: array of the turns (lang, confidence) that the context holds, oldest first."""
    first, last = (-max_turns, -1) if before else (1 - max_turns, 0)
    frame = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(first, last)
    return turns.withColumn("window", F.collect_list(F.struct("lang", "confidence")).over(frame))


def weights(window: Column, decay: float = DECAY) -> Column:
    """array<struct<lang, w>>: confidences with decay by age; turns without a language or a confidence (null, NaN) have age but no weight."""
    n = F.size(window)
    weighed = F.transform(window, lambda t, i: F.struct(t["lang"].alias("lang"), (F.pow(F.lit(float(decay)), n - 1 - i) * t["confidence"]).alias("w")))
    return F.filter(weighed, lambda x: x["lang"].isNotNull() & (x["lang"] != "") & (x["lang"] != UNKNOWN) & x["w"].isNotNull() & ~F.isnan(x["w"]))


def distribution(window: Column, decay: float = DECAY) -> Column:
    """array<struct<lang, share>> in alphabetical order; shares add up to 1; empty where nothing has weight."""
    return _let(weights(window, decay), _shares)


def _shares(own: Column) -> Column:
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x["w"])
    langs = F.array_sort(F.array_distinct(F.transform(own, lambda x: x["lang"])))
    share = lambda lang: F.aggregate(F.filter(own, lambda x: x["lang"] == lang), F.lit(0.0), lambda a, x: a + x["w"]) / total
    return F.when(total > 0, F.transform(langs, lambda lang: F.struct(lang.alias("lang"), share(lang).alias("share")))).otherwise(F.array().cast("array<struct<lang:string,share:double>>"))


def dominant(dist: Column) -> Column:
    """The language with the greatest share, ties to the first alphabetically; null without any."""
    top = F.array_max(F.transform(dist, lambda x: x["share"]))
    return F.get(F.filter(dist, lambda x: x["share"] == top), F.lit(0))["lang"]


def streak(window: Column) -> Column:
    """struct<lang, n>: how many of the last turns running have the last one's language."""
    last = F.get(window, F.size(window) - 1)["lang"]
    none = last.isNull() | (last == "")
    run = F.aggregate(F.reverse(window), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, t: F.struct((a["n"] + F.when(a["on"] & (t["lang"] == last), 1).otherwise(0)).alias("n"), (a["on"] & F.coalesce(t["lang"] == last, F.lit(False))).alias("on")))["n"]
    return F.struct(F.when(~none, last).alias("lang"), F.when(none, 0).otherwise(run).alias("n"))


def boost(window: Column, lang: Column, decay: float = DECAY) -> Column:
    """What the context adds to a language: its share, and a bonus while it is on a streak; 0 to 0.3."""
    return _boost(distribution(window, decay), streak(window), lang)


def _boost(dist: Column, run: Column, lang: Column) -> Column:
    share = F.get(F.filter(dist, lambda x: x["lang"] == lang), F.lit(0))["share"]
    bonus = F.when((run["lang"] == lang) & (run["n"] >= 2), F.least(run["n"] * STREAK_BOOST, F.lit(STREAK_CAP))).otherwise(0.0)
    return F.when(share.isNull(), 0.0).otherwise(F.least(share * SHARE_BOOST + F.coalesce(bonus, F.lit(0.0)), F.lit(BOOST_CAP)))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def context_table(turns: DataFrame, max_turns: int = MAX_TURNS, decay: float = DECAY, before: bool = False) -> DataFrame:
    """(conv_id, turn, lang, share, streak, boost) for each language of the context at each turn."""
    rows = with_window(turns, max_turns, before)
    rows = rows.select("conv_id", "turn", "window", streak(F.col("window")).alias("run"), F.explode(distribution(F.col("window"), decay)).alias("d"))
    return rows.select("conv_id", "turn", F.col("d.lang").alias("lang"), F.col("d.share").alias("share"), F.when(F.col("run.lang") == F.col("d.lang"), F.col("run.n")).otherwise(0).alias("streak"), boost(F.col("window"), F.col("d.lang"), decay).alias("boost"))


def from_history(history: Column, max_turns: int = HISTORY_TURNS) -> Column:
    """A window out of array<struct<lang, confidence>>: empty languages skipped, confidence 1 where missing, the last turns kept."""
    kept = F.filter(history, lambda t: t["lang"].isNotNull() & (t["lang"] != ""))
    kept = F.transform(kept, lambda t: F.struct(t["lang"].alias("lang"), F.coalesce(t["confidence"], F.lit(1.0)).alias("confidence")))
    return F.slice(kept, F.greatest(F.size(kept) - (max_turns - 1), F.lit(1)), max_turns)


STATE = "max_turns int, decay_factor double, turns array<struct<text:string,detected_language:string,confidence:double,timestamp:double>>"


def to_state(window: Column, max_turns: int = MAX_TURNS, decay: float = DECAY) -> Column:
    """The context as JSON."""
    turns = F.transform(window, lambda t: F.struct(F.lit("").alias("text"), t["lang"].alias("detected_language"), t["confidence"].alias("confidence"), F.lit(0.0).alias("timestamp")))
    return F.to_json(F.struct(F.lit(max_turns).alias("max_turns"), F.lit(float(decay)).alias("decay_factor"), turns.alias("turns")))


def from_state(state: Column) -> Column:
    """struct<max_turns, decay_factor, window> out of JSON, with defaults where fields are missing."""
    read = F.from_json(state, STATE)
    n = F.coalesce(read["max_turns"], F.lit(MAX_TURNS))
    turns = F.coalesce(read["turns"], F.array().cast("array<struct<text:string,detected_language:string,confidence:double,timestamp:double>>"))
    window = F.transform(turns, lambda t: F.struct(t["detected_language"].alias("lang"), F.coalesce(t["confidence"], F.lit(0.0)).alias("confidence")))
    kept = F.slice(window, F.greatest(F.size(window) - n + 1, F.lit(1)), F.greatest(n, F.lit(1)))
    return F.struct(n.alias("max_turns"), F.coalesce(read["decay_factor"], F.lit(DECAY)).alias("decay_factor"), kept.alias("window"))


def fold(scored: DataFrame, max_turns: int = MAX_TURNS, decay: float = DECAY, weight: float = 0.2, threshold: float = 0.0) -> DataFrame:
    """Detection with context, turn by turn: (conv_id, turn, lang, confidence).

    scored: (conv_id, turn, scores array<struct<lang, score>>), one row per turn. Each turn's scores gain the boosts of
    the context that the results so far make; the best (ties alphabetically) joins the context. A turn
    without scores, or below ``threshold``, is ``und`` and joins it as such. A conversation is one array, so its
    length bounds a row; for unbounded sessions there is the stateful form in ``streaming``.
    """
    turn_type = "struct<lang:string,confidence:double>"
    turns = F.array_sort(F.collect_list(F.struct("turn", "scores")))
    start = F.struct(F.array().cast(f"array<{turn_type}>").alias("window"), F.array().cast("array<struct<turn:bigint,lang:string,confidence:double>>").alias("out"))

    def step(state: Column, turn: Column) -> Column:
        def scored_by(context: Column) -> Column:
            return F.transform(turn["scores"], lambda s: F.struct((s["score"] + _boost(context["dist"], context["run"], s["lang"]) * weight).alias("score"), s["lang"].alias("lang")))

        def chosen(boosted: Column) -> Column:
            top = F.array_max(F.transform(boosted, lambda s: s["score"]))
            lang = F.array_min(F.transform(F.filter(boosted, lambda s: s["score"] == top), lambda s: s["lang"]))
            good = F.coalesce(top > F.lit(float(threshold)), F.lit(False))
            return F.struct(F.when(good, lang).otherwise("und").alias("lang"), F.coalesce(top, F.lit(0.0)).alias("confidence"))

        def appended(result: Column) -> Column:
            longer = F.concat(state["window"], F.array(result))
            kept = F.slice(longer, F.greatest(F.size(longer) - (max_turns - 1), F.lit(1)), max_turns)
            return F.struct(kept.alias("window"), F.concat(state["out"], F.array(F.struct(turn["turn"].cast("long").alias("turn"), result["lang"].alias("lang"), result["confidence"].alias("confidence")))).alias("out"))

        # The context is looked at once for each turn, and not for each language of it.
        context = F.struct(distribution(state["window"], decay).alias("dist"), streak(state["window"]).alias("run"))
        return _let(context, lambda c: _let(scored_by(c), lambda boosted: _let(chosen(boosted), appended)))

    folded = scored.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.explode(F.aggregate("turns", start, step)["out"]).alias("x"))
    return folded.select("conv_id", "x.turn", "x.lang", "x.confidence")


def switches(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, switches, longest_streak): gaps and islands over whole conversations."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    marked = turns.withColumn("new", F.coalesce((F.col("lang") != F.lag("lang").over(order)).cast("int"), F.lit(0)))
    marked = marked.withColumn("island", F.sum("new").over(order))
    runs = marked.groupBy("conv_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("conv_id").agg(F.sum("n").alias("turns"), (F.count("*") - 1).alias("switches"), F.max("n").alias("longest_streak"))
