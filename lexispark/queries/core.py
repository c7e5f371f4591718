"""Queries on whole detection, hints, confusion, code switching, evaluation, sources and sinks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backends as B
from ..operators import codeswitch as CS
from ..operators import confusion as C
from ..operators import evaluate as E
from ..operators import hints as H
from ..plans.cache import ResultCache
from ..plans.config import Config
from ..plans.detect import detect
from ..plans.keep import shared_path
from ..plans.sql import detected
from ..sources import files
from . import query, quoted, table, values
from .scalars import W, _gate_sql, normal_sql
from .votes import _HINTS, HINTS, LEX, _SOFT, VOTES, _rounded, votes
from ..operators import voting as V

PLAIN = Config(backends=("lexicon",), filter_proper_nouns=False)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")


#: Detection with the lexicon alone: normalise, gate, share of function words, threshold after normalising by the greatest.
_DETECT = rf"""WITH t AS (SELECT doc_id AS id, lang AS expected, source, {normal_sql('text')} AS p FROM documents), n AS (SELECT *, length(regexp_replace(p, '\P{{L}}', '', 'g')) AS n FROM t),
g AS (SELECT id, expected, source, p, {_gate_sql('default')} AS reason FROM n),
tok AS (SELECT id, unnest(regexp_extract_all(lower(p), '[{W}]+')) AS word FROM g WHERE reason IS NULL),
hit AS (SELECT id, language, count(*) AS n FROM tok JOIN {LEX} ON lex.word = tok.word GROUP BY ALL),
top AS (SELECT id, language, n / sum(n) OVER (PARTITION BY id) AS raw FROM hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, language) = 1),
det AS (SELECT g.id, g.expected, g.source, CASE WHEN top.id IS NULL THEN 'und' ELSE top.language END AS lang, CASE WHEN top.id IS NULL THEN 0 ELSE 1 END::DOUBLE AS confidence, top.id IS NOT NULL AS reliable,
  CASE WHEN g.reason IS NOT NULL THEN g.reason WHEN top.id IS NULL THEN 'low_confidence' END AS reason FROM g LEFT JOIN top ON top.id = g.id)"""


@query(_DETECT + " SELECT id, lang, confidence, reliable, reason FROM det")
def src01_detect(spark, sf_dir):
    """The whole plan with the lexicon as its one backend."""
    return detect(_docs(spark, sf_dir), PLAIN).select("id", "lang", "confidence", "reliable", "reason")


@query(_DETECT + " SELECT id, lang, confidence, reliable, reason FROM det")
def fus13_once_per_text(spark, sf_dir):
    """The same with each distinct text detected once."""
    return detect(_docs(spark, sf_dir), replace(PLAIN, once_per_text=True)).select("id", "lang", "confidence", "reliable", "reason")


_BOTH = "(SELECT doc_id, text, lang, source FROM documents UNION ALL SELECT -1 - item_id, text, NULL, NULL FROM benchmark)"


@query(_DETECT.replace("FROM documents)", f"FROM {_BOTH})", 1) + f" SELECT det.id, det.lang, confidence, reliable, reason, b.text IN (SELECT text FROM documents) AS cached FROM det JOIN {_BOTH} b ON b.doc_id = det.id")
def fus13_result_cache(spark, sf_dir):
    """A second run over documents and benchmark texts detects only those that no document is; the first has kept the others' results."""
    docs = _docs(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark", "item_id", "text").select((-1 - F.col("item_id")).alias("id"), "text")
    cache = ResultCache(spark, shared_path(spark, "results"))
    cache.detect(docs, PLAIN)
    return cache.detect(docs.unionByName(items), PLAIN).select("id", "lang", "confidence", "reliable", "reason", "cached")


@query(_DETECT + " SELECT source, lang, reason, count(*) AS n, round(avg(confidence), 6) AS confidence FROM det GROUP BY source, lang, reason")
def sql_detected(spark, sf_dir):
    """The same plan from SQL text: a view of the detection, joined with the table and grouped."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("sql_documents")
    detected(spark, "sql_documents", id="doc_id", config=PLAIN)
    return spark.sql(
        """SELECT d.source, r.lang, r.reason, count(*) AS n, round(avg(r.confidence), 6) AS confidence
        FROM sql_documents d JOIN sql_documents_detected r ON r.id = d.doc_id GROUP BY d.source, r.lang, r.reason"""
    )


@query()
def src05_ensemble(spark, sf_dir):
    """The whole plan with defaults: nouns filtered, all built-in backends, weighted vote, three candidates."""
    out = detect(_docs(spark, sf_dir), Config(), hints=spark.createDataFrame(HINTS, "word string, lang string"), top_k=3)
    return out.select("id", "lang", "confidence", "reliable", "script", "backend", "reason", F.size("candidates").alias("n_candidates"))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("expected"), "source")
    return detect(_docs(spark, sf_dir), PLAIN).select("id", "lang").join(docs, "id")


_RIGHT = "count(*) FILTER (lang = expected AND lang <> 'und')"


@query(_DETECT + f" SELECT count(*) AS samples, count(*) FILTER (lang <> 'und') AS evaluated, count(*) FILTER (lang = 'und') AS unknown_count, {_RIGHT} AS correct, round({_RIGHT} / count(*) FILTER (lang <> 'und') * 100, 4) AS accuracy FROM det")
def evl02_accuracy(spark, sf_dir):
    return E.accuracy(_evaluated(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 4))


@query(_DETECT + f" SELECT expected, count(*) AS total, {_RIGHT} AS correct, round({_RIGHT} / count(*) * 100, 4) AS accuracy FROM det GROUP BY expected HAVING count(*) >= 5 ORDER BY accuracy DESC, expected LIMIT 10")
def evl03_per_language(spark, sf_dir):
    return E.per_language(_evaluated(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 4))


@query(_DETECT + f" SELECT source, count(*) AS samples, count(*) FILTER (lang <> 'und') AS evaluated, count(*) FILTER (lang = 'und') AS unknown_count, {_RIGHT} AS correct, round(coalesce({_RIGHT} / nullif(count(*) FILTER (lang <> 'und'), 0) * 100, 0), 4) AS accuracy FROM det GROUP BY source")
def evl05_by_category(spark, sf_dir):
    return E.accuracy(_evaluated(spark, sf_dir), "source").withColumn("accuracy", F.round("accuracy", 4))


@query(_DETECT + " SELECT source, lang, count(*) AS n FROM det GROUP BY ROLLUP (source, lang)")
def evl07_histogram(spark, sf_dir):
    return E.histogram(_evaluated(spark, sf_dir), "source")


@query()
def evl01_default_accuracy(spark, sf_dir):
    """The default plan (all built-in backends, nouns filtered, weighted vote) against the labels, by language."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("expected"))
    found = detect(_docs(spark, sf_dir), Config()).select("id", "lang").join(docs, "id")
    return E.accuracy(found, "expected").withColumn("accuracy", F.round("accuracy", 4))


@query("SELECT event_type, count(value) AS texts, round(avg(value), 4) AS avg_ms, true AS p50_ok, true AS p90_ok, true AS p99_ok FROM events GROUP BY event_type")
def evl06_latency(spark, sf_dir):
    """Percentiles of the events' values by type, from sketches kept of each day; whether each has its rank, within the stated error."""
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), F.col("value").alias("ms"))
    told = E.sketched_latency(E.merged_sketches(E.latency_sketches(events, "event_type", "day"), "event_type"), "event_type")
    at = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    ms = F.col("ms")
    ranks = [agg.alias(f"{p}_{n}") for p in at for n, agg in (("lo", F.count_if(ms < F.col(f"{p}_ms"))), ("hi", F.count_if(ms <= F.col(f"{p}_ms"))))]
    out = events.join(told, "event_type").groupBy("event_type", "texts", "avg_ms").agg(*ranks)
    ok = lambda p, q: (F.col(f"{p}_lo") <= (q + E.RANK_ERROR) * F.col("texts") + 1) & (F.col(f"{p}_hi") >= (q - E.RANK_ERROR) * F.col("texts") - 1)
    return out.select("event_type", "texts", F.round("avg_ms", 4).alias("avg_ms"), *(ok(p, q).alias(f"{p}_ok") for p, q in at.items()))


@query(_DETECT + " SELECT expected, lang, count(*) AS n FROM det GROUP BY ALL")
def evl_confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(_evaluated(spark, sf_dir))


@query(_DETECT + " SELECT det.lang, l.quality, l.toxic, count(*) AS n FROM det JOIN labels l ON l.doc_id = det.id GROUP BY ALL")
def evl_quality_by_language(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    return detect(_docs(spark, sf_dir), PLAIN).select("id", "lang").join(labels, "id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de') ORDER BY doc_id LIMIT 20")
def evl04_sample(spark, sf_dir):
    """A sample of allowed labels; its limit is the feature."""
    return table(spark, sf_dir, "documents").filter(F.col("lang").isin("fr", "de")).select("doc_id", "lang").orderBy("doc_id").limit(20)


_TOKENS = rf"ht AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[{W}]+')) AS token FROM documents)"


@query(f"WITH {_TOKENS} SELECT lower(token) AS word, count(*) AS n, count(DISTINCT id) AS docs FROM ht GROUP BY lower(token)")
def hnt03_tokens(spark, sf_dir):
    return H.tokens(_docs(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"))


_HITS = f"WITH {_TOKENS}, hh AS (SELECT id, lang, count(*) AS n FROM ht JOIN {_HINTS} ON h.word = lower(token) GROUP BY ALL)"


@query(_HITS + " SELECT id, lang, round(n / sum(n) OVER (PARTITION BY id) * 0.8, 6) AS score FROM hh")
def hnt04_lookup_all(spark, sf_dir):
    return _rounded(H.lookup_all(_docs(spark, sf_dir), spark.createDataFrame(HINTS, "word string, lang string")))


#: The SQL function counts bytes; accented letters of the corpus become single ones first.
_SINGLE = "translate(%s, 'áéíóúüñçàèìòùâêîôûäößëïœæ', 'ABCDEFGHIJKLMNOPQRSTUVWXY')"


@query(_HITS + f""", ex AS (SELECT id, lang, n FROM hh QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, lang) = 1),
ws AS (SELECT DISTINCT lower(token) AS word FROM ht WHERE id NOT IN (SELECT id FROM ex) AND length(token) >= 3),
fz AS (SELECT ws.word, arg_min(h.lang, h.word) AS lang FROM ws, {_HINTS} WHERE length(h.word) >= 3 AND levenshtein({_SINGLE % 'ws.word'}, {_SINGLE % 'h.word'}) <= 1 GROUP BY ws.word),
fc AS (SELECT id, lang, count(*) AS n FROM ht JOIN fz ON fz.word = lower(token) WHERE id NOT IN (SELECT id FROM ex) GROUP BY ALL)
SELECT id, lang, round(least(0.8 + least(n * 0.05, 0.15), 1), 6)::DOUBLE AS confidence, 'exact' AS kind FROM ex
UNION ALL SELECT id, lang, round(0.8 * 0.7, 6)::DOUBLE, 'fuzzy' FROM fc QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, lang) = 1""")
def hnt05_08_lookup(spark, sf_dir):
    out = H.lookup(_docs(spark, sf_dir), spark.createDataFrame(HINTS, "word string, lang string"))
    return out.select("id", "lang", F.round("confidence", 6).alias("confidence"), "kind")


#: Common letters bit by bit: bits of the first word that no letter of the second has used yet stay set.
@query(rf"""WITH wd AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[{W}]+')) AS word FROM conversations),
hd AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[{W}]+')) AS hint FROM benchmark),
ws AS (SELECT word, length(word) AS a, list_transform(string_split(word, ''), lambda c, i: {{'c': c, 'i': i}}) AS cs FROM wd WHERE length(word) >= 3),
wm AS (SELECT word, a, (1::HUGEINT << a) - 1 AS every, map_from_entries(list_transform(list_distinct(list_transform(cs, lambda x: x.c)),
  lambda c: {{'k': c, 'v': list_sum(list_transform(cs, lambda x: CASE WHEN x.c = c THEN 1::HUGEINT << (x.i - 1) ELSE 0 END))::HUGEINT}})) AS masks FROM ws),
pr AS (SELECT word, hint, a, length(hint) AS b, every, list_prepend(every, list_transform(string_split(hint, ''), lambda c: coalesce(masks[c], 0::HUGEINT))) AS steps
  FROM wm, hd WHERE 5 * least(a, length(hint)) >= 2 * (a + length(hint))),
sc AS (SELECT word, hint, a, b, a - bit_count(list_reduce(steps, lambda v, m: ((v + (v & m)) | (v & (every - m))) & every)) AS common FROM pr)
SELECT word, hint, round(200 * common / (a + b), 6) AS ratio FROM sc WHERE 5 * common >= 2 * (a + b) QUALIFY row_number() OVER (PARTITION BY word ORDER BY common / (a + b) DESC, hint) = 1""")
def hnt07_ratio(spark, sf_dir):
    """The words of conversations, each with the word of benchmark texts that is most like it."""
    distinct = lambda name: table(spark, sf_dir, name, "text").select(F.explode(B.words(F.col("text"))).alias("word")).distinct()
    found = H.ratio_matches(distinct("conversations"), distinct("benchmark").withColumn("lang", F.lit("en")))
    return found.select("word", "hint", F.round("ratio", 6).alias("ratio"))


_WORDS = "unnest(regexp_extract_all(lower(text), '[" + W + "]+'))"


@query(f"""WITH c AS (SELECT word, lang, count(*) AS n FROM (SELECT lang, {_WORDS} AS word FROM documents WHERE lang IS NOT NULL) GROUP BY ALL),
a AS (SELECT word, lang FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, lang) = 1), b AS (SELECT DISTINCT {_WORDS} AS word, 'en' AS lang FROM benchmark)
SELECT word, lang FROM b UNION ALL SELECT word, lang FROM a WHERE word NOT IN (SELECT word FROM b)""")
def hnt09_merge(spark, sf_dir):
    """The words of documents, each with the language in whose documents it is most frequent, and those of the benchmark, which win."""
    docs = table(spark, sf_dir, "documents", "lang", "text").filter("lang is not null")
    counted = docs.select("lang", F.explode(B.words(F.col("text"))).alias("word")).groupBy("word", "lang").agg(F.count("*").alias("n"))
    learned = counted.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang"))["lang"].alias("lang"))
    more = table(spark, sf_dir, "benchmark", "text").select(F.explode(B.words(F.col("text"))).alias("word")).distinct().withColumn("lang", F.lit("en"))
    return H.merge_tables(learned, more).select("word", "lang")


@query(f"SELECT lang, count(*) AS n, string_agg(word, ' ' ORDER BY word) AS words FROM {_HINTS} WHERE word IN (SELECT {_WORDS} FROM documents) GROUP BY lang")
def hnt10_items(spark, sf_dir):
    """The hints whose words occur in documents, by language."""
    there = _docs(spark, sf_dir).select(F.explode(B.words(F.col("text"))).alias("word")).distinct()
    hints = H.Hints(dict(HINTS)).dataframe(spark).join(there, "word", "left_semi")
    return hints.groupBy("lang").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("word")), " ").alias("words"))


_PAIRS = sorted({lang for own in C.FAMILIES.values() for lang in own} | {"hu", "en"})
_FAM = values([(i, f, lang) for i, (f, own) in enumerate(C.FAMILIES.items()) for lang in own], "f(ord, family, lang)")
_KNOWN = values(list(enumerate(_PAIRS)), "k(i, known)")
_GROUP = values([(i, lang) for i, g in enumerate(C.GROUPS) for lang in g], "g(group_id, lang)")
#: Two languages of each document: its label, or one of all known ones if its id is odd, and another of all known ones.
_TWO = f"""tw AS (SELECT CASE WHEN doc_id % 2 = 0 THEN lang ELSE x.known END AS a, y.known AS b FROM documents JOIN {_KNOWN.replace('k(', 'x(')} ON x.i = (doc_id // {len(_PAIRS)}) % {len(_PAIRS)} JOIN {_KNOWN.replace('k(', 'y(')} ON y.i = doc_id % {len(_PAIRS)}),
p AS (SELECT a, b, count(*) AS n FROM tw WHERE a IS NOT NULL GROUP BY a, b)"""


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, n): the pairs of languages of documents and how many documents have them."""
    known, size, key = F.array(*map(F.lit, _PAIRS)), len(_PAIRS), F.col("doc_id")
    other = F.get(known, (F.floor(key / size) % size).cast("int"))
    pairs = table(spark, sf_dir, "documents").select(F.when(key % 2 == 0, F.col("lang")).otherwise(other).alias("a"), F.get(known, (key % size).cast("int")).alias("b"))
    return pairs.filter("a is not null").groupBy("a", "b").agg(F.count("*").alias("n"))


@query(f"WITH {_TWO}, l AS (SELECT b AS lang, sum(n)::BIGINT AS n FROM p GROUP BY b) SELECT l.lang, l.n, arg_min(f.family, f.ord) AS family FROM l LEFT JOIN {_FAM} ON f.lang = l.lang GROUP BY l.lang, l.n")
def cnf04_family(spark, sf_dir):
    langs = _two(spark, sf_dir).groupBy(F.col("b").alias("lang")).agg(F.sum("n").alias("n"))
    return langs.select("lang", "n", C.family(F.col("lang")).alias("family"))


@query(f"WITH {_TWO} SELECT DISTINCT a.lang, b.lang AS related FROM {_FAM.replace('f(', 'a(')} JOIN {_FAM.replace('f(', 'b(')} ON a.family = b.family AND a.lang <> b.lang WHERE a.lang IN (SELECT b FROM p)")
def cnf06_related(spark, sf_dir):
    return C.related_languages(_two(spark, sf_dir).select(F.col("b").alias("lang")))


@query(f"""WITH {_TWO}, r AS (SELECT DISTINCT x.lang AS a, y.lang AS b FROM {_FAM.replace('f(', 'x(')} JOIN {_FAM.replace('f(', 'y(')} ON x.family = y.family),
k AS (SELECT x.lang AS a, y.lang AS b FROM {_GROUP.replace('g(', 'x(')} JOIN {_GROUP.replace('g(', 'y(')} ON x.group_id = y.group_id AND x.lang <> y.lang WHERE x.group_id IN (SELECT group_id FROM {_GROUP} GROUP BY group_id HAVING count(*) = 2))
SELECT p.a, p.b, p.n, r.a IS NOT NULL AS related, (CASE WHEN p.a = p.b THEN 1.0 WHEN k.a IS NOT NULL THEN 0.9 WHEN r.a IS NOT NULL THEN 0.6 ELSE 0.0 END)::DOUBLE AS similarity
FROM p LEFT JOIN r ON r.a = p.a AND r.b = p.b LEFT JOIN k ON k.a = p.a AND k.b = p.b""")
def cnf05_07_similarity(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _two(spark, sf_dir).select("a", "b", "n", C.are_related(a, b).alias("related"), C.similarity(a, b).alias("similarity"))


_ALL = values([(i, lang, f) for i, g in enumerate(C.GROUPS) for lang, own in g.items() for f in own], 'x(group_id, lang, feature)')


@query(f"""WITH {_TWO}, g AS (SELECT * FROM {_GROUP}), two AS (SELECT group_id FROM g GROUP BY group_id HAVING count(*) = 2),
n AS (SELECT group_id, lang, count(*) AS n FROM {_ALL} GROUP BY group_id, lang), k AS (SELECT p.a, p.b, min(x.group_id) AS group_id FROM p JOIN g x ON x.lang = p.a JOIN g y ON y.lang = p.b AND y.group_id = x.group_id GROUP BY p.a, p.b)
SELECT p.a, p.b, k.group_id, CASE WHEN p.a <> p.b AND two.group_id IS NOT NULL THEN na.n END AS features_a, CASE WHEN p.a <> p.b AND two.group_id IS NOT NULL THEN nb.n END AS features_b
FROM p LEFT JOIN k ON k.a = p.a AND k.b = p.b LEFT JOIN two ON two.group_id = k.group_id LEFT JOIN n na ON na.group_id = k.group_id AND na.lang = p.a LEFT JOIN n nb ON nb.group_id = k.group_id AND nb.lang = p.b""")
def cnf01_03_features(spark, sf_dir):
    """The confused group of each pair of languages, and how many features tell the two apart where they are a group by themselves."""
    told = [(a, b, *map(len, C.discriminating_features(a, b))) for g in C.GROUPS if len(g) == 2 for a in g for b in g if a != b]
    told = spark.createDataFrame(told, "a string, b string, features_a long, features_b long")
    pairs = _two(spark, sf_dir).join(F.broadcast(told), ["a", "b"], "left")
    return pairs.select("a", "b", C.confused_group(F.array("a", "b")).alias("group_id"), "features_a", "features_b")


@query(f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT {_WORDS} AS word FROM documents) GROUP BY word), f AS (SELECT group_id, lang, feature, count(*) AS w FROM {_ALL} GROUP BY ALL)
SELECT group_id, lang, count(*) AS features, sum(w)::BIGINT AS listed, coalesce(sum(w.n), 0)::BIGINT AS found FROM f LEFT JOIN w ON w.word = f.feature GROUP BY group_id, lang""")
def cnf_feature_table(spark, sf_dir):
    """The features of each language of the confused groups, and how many words of documents are one of them."""
    words = _docs(spark, sf_dir).select(F.explode(B.words(F.col("text"))).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    rows = C.features(spark)
    found = words.join(F.broadcast(rows), "feature").groupBy("group_id", "lang", "feature").agg(F.sum("n").alias("n"))
    rows = rows.join(found, ["group_id", "lang", "feature"], "left")
    return rows.groupBy("group_id", "lang").agg(F.count("*").alias("features"), F.sum("weight").alias("listed"), F.coalesce(F.sum("n"), F.lit(0)).alias("found"))


_FEATURES = values([(lang, f) for lang, own in C.GROUPS[0].items() for f in own], "x(lang, feature)")
#: Scores of Spanish and Portuguese that are close together for two thirds of the documents.
_CLOSE = "cs AS (SELECT doc_id AS id, 'es' AS lang, 0.45 AS score FROM documents UNION ALL SELECT doc_id, 'pt', 0.45 - (doc_id % 3) * 0.1 FROM documents)"


@query(f"""WITH {_CLOSE}, ok AS (SELECT id FROM cs GROUP BY id HAVING round(max(score) - min(score), 9) <= 0.15),
hi AS (SELECT d.doc_id AS id, x.lang, count(*) AS n FROM documents d JOIN ok ON ok.id = d.doc_id, {_FEATURES} WHERE contains(lower(d.text), x.feature) GROUP BY ALL),
bo AS (SELECT id, lang, n / sum(n) OVER (PARTITION BY id) * 0.2 AS b FROM hi)
SELECT cs.id, cs.lang, round(least(cs.score + coalesce(bo.b, 0), 1), 6)::DOUBLE AS score FROM cs LEFT JOIN bo ON bo.id = cs.id AND bo.lang = cs.lang""")
def cnf02_resolve(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    scores = docs.select("id", F.explode(F.array(F.struct(F.lit("es").alias("lang"), F.lit(0.45).alias("score")), F.struct(F.lit("pt").alias("lang"), (F.lit(0.45) - (F.col("id") % 3) * 0.1).alias("score")))).alias("x")).select("id", "x.*")
    return _rounded(C.resolve(scores, docs))


_SPANS = rf"""sp AS (SELECT conv_id * 1000 + turn AS id, text, regexp_extract_all(text, '[{W}]+|[^{W}]+') AS parts FROM conversations),
un AS (SELECT id, unnest(parts) AS text, unnest(range(0, len(parts))) AS i FROM sp),
pl AS (SELECT id, i, text, coalesce(sum(length(text)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM un),
ws AS (SELECT id, i, text, start::INT AS start, (start + length(text))::INT AS stop FROM pl WHERE regexp_matches(text, '^[{W}]') AND length(text) >= 3)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


@query(f"WITH {_SPANS} SELECT id, text, start, stop AS \"end\" FROM ws")
def csw01_word_spans(spark, sf_dir):
    return CS.word_spans(_turns(spark, sf_dir)).select("id", "text", "start", "end")


_SEGMENTED = rf"""sg AS (SELECT conv_id * 1000 + turn AS id, string_split(regexp_replace(text, '({CS.SEGMENTS})', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM conversations),
un AS (SELECT id, unnest(parts) AS raw, unnest(range(0, len(parts))) AS i FROM sg),
pl AS (SELECT id, i, raw, coalesce(sum(length(raw)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM un),
ws AS (SELECT id, i, regexp_replace(raw, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS text, (place + length(raw) - length(regexp_replace(raw, '^[\s\p{{Z}}]+', '')))::INT AS start FROM pl WHERE i % 2 = 0)"""


@query(f"WITH {_SEGMENTED} SELECT id, text, start, (start + length(text))::INT AS \"end\" FROM ws WHERE length(text) >= 3")
def csw02_segments(spark, sf_dir):
    return CS.segments(_turns(spark, sf_dir)).select("id", "text", "start", "end")


_SUMMED = rf"""dt AS (SELECT DISTINCT text FROM ws WHERE length(text) >= 3), tk AS (SELECT text, unnest(regexp_extract_all(lower(text), '[{W}]+')) AS word FROM dt),
hi AS (SELECT text, language, count(*) AS n FROM tk JOIN {LEX} ON lex.word = tk.word GROUP BY ALL),
de AS (SELECT text, language, n / sum(n) OVER (PARTITION BY text) AS c FROM hi QUALIFY row_number() OVER (PARTITION BY text ORDER BY n DESC, language) = 1),
fo AS (SELECT ws.id, ws.text, de.language, de.c FROM ws JOIN de ON de.text = ws.text WHERE c >= 0.6),
co AS (SELECT id, language, {{size}} AS n, sum(c) AS c, count(*) AS k FROM fo GROUP BY ALL),
sh AS (SELECT *, n / sum(n) OVER (PARTITION BY id) AS share, row_number() OVER (PARTITION BY id ORDER BY n DESC, language) AS rn FROM co),
su AS (SELECT id, bool_or(rn = 2 AND share >= 0.15) AS is_mixed, max(language) FILTER (rn = 1) AS p, string_agg(language, ' ' ORDER BY rn) FILTER (rn > 1) AS s, sum(c) / sum(k) AS c FROM sh GROUP BY id)
SELECT conv_id * 1000 + turn AS id, coalesce(is_mixed, false) AS is_mixed, coalesce(p, 'und') AS primary_language, coalesce(s, '') AS secondary, round(coalesce(su.c, 0), 6) AS confidence
FROM conversations LEFT JOIN su ON su.id = conv_id * 1000 + turn"""


def _summary(out: DataFrame) -> DataFrame:
    return out.select("id", "is_mixed", "primary_language", F.array_join("secondary_languages", " ").alias("secondary"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_SPANS}, " + _SUMMED.replace("{size}", "count(*)"))
def csw03_05_words(spark, sf_dir):
    return _summary(CS.detect(_turns(spark, sf_dir), B.lexicon))


@query(f"WITH {_SEGMENTED}, " + _SUMMED.replace("{size}", "sum(length(text))"))
def csw04_segments(spark, sf_dir):
    return _summary(CS.detect(_turns(spark, sf_dir), B.lexicon, level="segment"))


_MIXED = [(-1, "this is so loco today"), (-2, "c'est very nice"), (-3, "das ist so nice"), (-4, "I tengo hunger"), (-5, "tu kal will come"), (-6, "plain text"), (-7, "SEHR COOL man"), (-8, "la casa is big")]
_PATTERN = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), {quoted(CS.pattern(own))}) THEN '{a}-{b}'" for a, b, own in CS.PATTERNS) + " END"


@query(f"SELECT id, {_PATTERN} AS pair FROM (SELECT conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT id, text FROM {values(_MIXED, 'm(id, text)')})")
def csw07_patterns(spark, sf_dir):
    texts = _turns(spark, sf_dir).unionByName(spark.createDataFrame(_MIXED, "id long, text string"))
    pair = CS.switching_pattern(F.col("text"))
    return texts.select("id", F.when(pair.isNotNull(), F.concat_ws("-", pair["a"], pair["b"])).alias("pair"))


@query(_DETECT + """ SELECT id, '{"text":' || to_json(substr(d.text, 1, 50)) || ',"lang":"' || det.lang || '","confidence":' || CASE WHEN confidence = 1 THEN '1.0' ELSE '0.0' END || coalesce(',"reason":"' || reason || '"', '') || '}' AS value FROM det JOIN documents d ON d.doc_id = det.id""")
def snk03_jsonl(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return files.jsonl(docs, detect(docs, PLAIN))


@query(_DETECT + """ SELECT id, '{"lang":"' || lang || '","confidence":' || CASE WHEN confidence = 1 THEN '1.0' ELSE '0.0' END || ',"reliable":' || reliable || coalesce(',"reason":"' || reason || '"', '') || '}' AS value FROM det""")
def snk01_to_dict(spark, sf_dir):
    out = detect(_docs(spark, sf_dir), PLAIN).withColumns({"script": F.lit(None).cast("string"), "backend": F.lit(None).cast("string")})
    return out.select("id", files.result_json(out).alias("value"))


@query(VOTES + f", {_SOFT} SELECT d.lang AS expected, sc.lang, count(*) AS n, round(sum(score), 4) AS mass FROM sc JOIN documents d ON d.doc_id = sc.id GROUP BY ALL")
def evl_soft_mass(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("expected"))
    return V.soft_vote(votes(spark, sf_dir)).join(docs, "id").groupBy("expected", "lang").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("mass"))


@query(_DETECT.replace("FROM documents)", "FROM pages)", 1).replace("doc_id AS id, lang AS expected, source, ", "page_id AS id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS expected, '' AS source, ").replace(normal_sql("text"), normal_sql("regexp_replace(html, '<[^>]*>', ' ', 'g')")) + " SELECT id, expected, lang, reason FROM det")
def nrm_page_language(spark, sf_dir):
    """Pages without their markup, against the language that they declare."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("expected"))
    return detect(pages, PLAIN).select("id", "lang", "reason").join(pages.select("id", "expected"), "id")


