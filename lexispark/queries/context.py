"""Queries on conversation context. A turn's language is the one its function words name (lexicon)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import backends as B
from ..operators import context as X
from ..operators import scan
from ..plans.keep import keep, shared_path
from ..streaming import sessions
from . import query, table
from .scalars import W
from .votes import LEX

_TURNS = rf"""WITH tk AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[{W}]+')) AS word FROM conversations),
hi AS (SELECT conv_id, turn, language, count(*) AS n FROM tk JOIN {LEX} ON lex.word = tk.word GROUP BY ALL),
pr AS (SELECT conv_id, turn, language, n / sum(n) OVER (PARTITION BY conv_id, turn) AS p FROM hi),
be AS (SELECT conv_id, turn, language, p FROM pr QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY p DESC, language) = 1),
tu AS (SELECT c.conv_id, c.turn, coalesce(be.language, 'unknown') AS lang, coalesce(be.p, 0) AS confidence FROM conversations c LEFT JOIN be ON be.conv_id = c.conv_id AND be.turn = c.turn)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    lexicon = spark.createDataFrame(sorted({(w, lang) for lang, own in B.LEXICON.items() for w in own.split()}), "word string, language string")
    hits = turns.select("conv_id", "turn", F.explode(B.words(F.col("text"))).alias("word")).join(F.broadcast(lexicon), "word").groupBy("conv_id", "turn", "language").agg(F.count("*").alias("n"))
    return hits.select("conv_id", "turn", "language", (F.col("n") / F.sum("n").over(Window.partitionBy("conv_id", "turn"))).alias("p"))


def turns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _scored(spark, sf_dir).groupBy("conv_id", "turn").agg(F.max_by("language", F.struct("p", B._descending("language"))).alias("lang"), F.max("p").alias("confidence"))
    out = table(spark, sf_dir, "conversations").select("conv_id", "turn").join(best, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@query(_TURNS + " SELECT conv_id, turn, lang, round(confidence, 6) AS confidence FROM tu")
def ctx_turns(spark, sf_dir):
    return turns_of(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@query(_TURNS + ", w AS (SELECT conv_id, turn, list(lang) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS ls FROM tu) SELECT conv_id, turn, array_to_string(ls, ' ') AS langs, len(ls) AS n, ls[-1] AS last FROM w")
def ctx01_02_window(spark, sf_dir):
    rows = X.with_window(turns_of(spark, sf_dir))
    langs = F.transform("window", lambda t: t["lang"])
    return rows.select("conv_id", "turn", F.array_join(langs, " ").alias("langs"), F.size("window").alias("n"), F.element_at(langs, -1).alias("last"))


_AGED = _TURNS + """, nm AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM tu),
ag AS (SELECT a.conv_id, a.turn, b.lang, pow(0.9, a.i - b.i) * b.confidence AS w FROM nm a JOIN nm b ON a.conv_id = b.conv_id AND b.i BETWEEN a.i - 4 AND a.i WHERE b.lang <> 'unknown'),
di AS (SELECT conv_id, turn, lang, sum(w) / sum(sum(w)) OVER (PARTITION BY conv_id, turn) AS share FROM ag GROUP BY conv_id, turn, lang),
br AS (SELECT *, CASE WHEN lag(lang) OVER (PARTITION BY conv_id ORDER BY turn) = lang THEN 0 ELSE 1 END AS fresh FROM nm),
la AS (SELECT conv_id, turn, i, lang, max(CASE WHEN fresh = 1 THEN i END) OVER (PARTITION BY conv_id ORDER BY turn) AS since FROM br),
ru AS (SELECT conv_id, turn, lang, least(i - since + 1, 5) AS n FROM la),
bo AS (SELECT di.conv_id, di.turn, di.lang, share, CASE WHEN ru.lang = di.lang THEN ru.n ELSE 0 END AS streak FROM di JOIN ru ON ru.conv_id = di.conv_id AND ru.turn = di.turn)"""


@query(_AGED + " SELECT conv_id, turn, lang, round(share, 6) AS share, streak, round(least(share * 0.15 + CASE WHEN streak >= 2 THEN least(streak * 0.02, 0.1) ELSE 0 END, 0.3), 6) AS boost FROM bo")
def ctx03_06_boosts(spark, sf_dir):
    rows = X.context_table(turns_of(spark, sf_dir), max_turns=5)
    return rows.select("conv_id", "turn", "lang", F.round("share", 6).alias("share"), F.col("streak").cast("long").alias("streak"), F.round("boost", 6).alias("boost"))


@query(_AGED + " SELECT conv_id, turn, lang AS dominant FROM di QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(share, 9) DESC, lang) = 1")
def ctx04_dominant(spark, sf_dir):
    rows = X.with_window(turns_of(spark, sf_dir), 5)
    rounded = F.transform(X.distribution(F.col("window")), lambda d: F.struct(d["lang"].alias("lang"), F.round(d["share"], 9).alias("share")))
    return rows.select("conv_id", "turn", X.dominant(rounded).alias("dominant")).filter("dominant is not null")


@query(_AGED + ", li AS (SELECT conv_id, i, turn, lang, CASE WHEN fresh = 1 AND i > 1 THEN 1 ELSE 0 END AS s FROM br), isl AS (SELECT conv_id, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM li), rn AS (SELECT conv_id, g, count(*) AS n FROM isl GROUP BY ALL) SELECT conv_id, sum(n)::BIGINT AS turns, count(*) - 1 AS switches, max(n) AS longest_streak FROM rn GROUP BY conv_id")
def ctx10_switches(spark, sf_dir):
    return X.switches(turns_of(spark, sf_dir))


@query(_TURNS + ", h AS (SELECT conv_id, list(lang ORDER BY turn) FILTER (lang <> 'unknown') AS ls FROM tu GROUP BY conv_id) SELECT conv_id, coalesce(len(ls[-5:]), 0) AS n, coalesce(array_to_string(ls[-5:], ' '), '') AS langs FROM h")
def src13_history(spark, sf_dir):
    named = F.struct(F.when(F.col("lang") != "unknown", F.col("lang")).alias("lang"), "confidence")
    rows = turns_of(spark, sf_dir).withColumn("t", F.struct("turn", named.alias("x"))).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["x"]).alias("history"))
    kept = X.from_history(F.col("history"))
    return rows.select("conv_id", F.size(kept).alias("n"), F.array_join(F.transform(kept, lambda t: t["lang"]), " ").alias("langs"))


@query(_TURNS + ", w AS (SELECT conv_id, turn, list(lang) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS ls FROM tu) SELECT conv_id, turn, 2 AS max_turns, 0.9::DOUBLE AS decay_factor, array_to_string(ls, ' ') AS langs FROM w")
def src14_snk07_state(spark, sf_dir):
    """Contexts written as JSON and read back."""
    rows = X.with_window(turns_of(spark, sf_dir))
    read = rows.select("conv_id", "turn", X.from_state(X.to_state(F.col("window"))).alias("s"))
    return read.select("conv_id", "turn", "s.max_turns", "s.decay_factor", F.array_join(F.transform("s.window", lambda t: t["lang"]), " ").alias("langs"))




_FOLD = _TURNS.replace("WITH tk", "WITH RECURSIVE tk", 1) + """, nm AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
sc AS (SELECT nm.conv_id, nm.turn, nm.i, coalesce(list({'l': pr.language, 'p': pr.p}) FILTER (pr.language IS NOT NULL), []) AS s FROM nm LEFT JOIN pr ON pr.conv_id = nm.conv_id AND pr.turn = nm.turn GROUP BY ALL),
fo AS (SELECT conv_id, 0::BIGINT AS i, NULL::BIGINT AS turn, NULL::VARCHAR AS l1, NULL::DOUBLE AS c1, NULL::VARCHAR AS l2, NULL::DOUBLE AS c2 FROM (SELECT DISTINCT conv_id FROM conversations)
 UNION ALL SELECT z.conv_id, z.i, z.turn, z.l2, z.c2, CASE WHEN len(z.b) = 0 OR round(z.b[1].s, 9) <= 0 THEN 'und' ELSE z.b[1].l END, CASE WHEN len(z.b) = 0 THEN 0 ELSE -z.b[1].k END FROM (
  SELECT sc.conv_id, sc.i, sc.turn, fo.l2, fo.c2, list_sort(list_transform(list_transform(sc.s, lambda x: {'l': x.l, 's': x.p + 0.2 * coalesce(least(
    CASE WHEN (CASE WHEN fo.l1 = x.l OR fo.l2 = x.l THEN 1 END) IS NULL OR coalesce(0.9 * fo.c1, 0) + coalesce(fo.c2, 0) <= 0 THEN 0
    ELSE (CASE WHEN fo.l1 = x.l THEN 0.9 * fo.c1 ELSE 0 END + CASE WHEN fo.l2 = x.l THEN fo.c2 ELSE 0 END) / (coalesce(0.9 * fo.c1, 0) + coalesce(fo.c2, 0)) * 0.15 + CASE WHEN fo.l1 = fo.l2 AND fo.l2 = x.l THEN 0.04 ELSE 0 END END, 0.3), 0)}), lambda y: {'k': -y.s, 'l': y.l, 's': y.s})) AS b
  FROM fo JOIN sc ON sc.conv_id = fo.conv_id AND sc.i = fo.i + 1) z)
SELECT conv_id, turn, l2 AS lang, round(c2, 6) AS confidence FROM fo WHERE turn IS NOT NULL"""


def _scores_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scored(spark, sf_dir).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct(F.col("language").alias("lang"), F.col("p").alias("score")))).alias("scores"))
    none = F.array().cast("array<struct<lang:string,score:double>>")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn").join(scores, ["conv_id", "turn"], "left").withColumn("scores", F.coalesce("scores", none))


@query(_FOLD)
def ctx08_fold(spark, sf_dir):
    """Detection in which each result feeds the context of the next turn."""
    return X.fold(_scores_of(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(_FOLD)
def ctx08_scan(spark, sf_dir):
    """The same by a sorted scan that carries the context over the borders of tasks."""
    return scan.fold_any_length(_scores_of(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(_FOLD)
def ctx09_sessions(spark, sf_dir):
    """The same as a stream: the first turns of all conversations, a stop, and the rest from the checkpoint."""
    source, out, checkpoint = (shared_path(spark, f"ctx09-{n}") for n in ("source", "out", "checkpoint"))
    scored = keep(_scores_of(spark, sf_dir).withColumnRenamed("conv_id", "session_id"))
    own = spark.newSession()
    for name, value in sessions.settings().items():
        own.conf.set(name, value)
    for part in (scored.filter("turn < 3"), scored.filter("turn >= 3 OR turn IS NULL")):
        part.write.mode("append").parquet(source)
        sessions.run_to_end(own.readStream.schema(scored.schema).parquet(source), out, checkpoint)
    return spark.read.parquet(out).select(F.col("session_id").cast("long").alias("conv_id"), "turn", "lang", F.round("confidence", 6).alias("confidence"))
