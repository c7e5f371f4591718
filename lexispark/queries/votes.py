"""Queries on backends, voting, tie-breaking and fusion. The votes are cast by the built-in backends on whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backends as B
from ..operators import fusion
from ..operators import voting as V
from ..plans import sql
from ..plans.keep import dealt
from . import query, table, values
from .scalars import _LANGS, W, scripted_sql

NAMES = ["lexicon", "ngram_nb", "ngram_rank", "script"]
_LEX = sorted({(w, lang) for lang, own in B.LEXICON.items() for w in own.split()})
LEX = values(_LEX, "lex(word, language)")
REL = values(sorted(B.RELIABILITY.items()), "rel(backend_name, r)")


def _cut(text: str) -> str:
    """The trigrams of a text that has a blank at either end."""
    return f"unnest(list_transform(range(1, greatest(length({text}) - 2, 1) + 1), lambda i: substr({text}, i, 3)))"


#: Words of the lexicon give the n-gram backends' model (mo); gr are the documents' trigrams.
_MODEL = f"""mw AS (SELECT language, ' ' || word || ' ' AS p FROM (SELECT DISTINCT language, word, rep FROM {values(sorted((w, lang, i) for lang, own in B.LEXICON.items() for i, w in enumerate(own.split())), "lw(word, language, rep)")})),
mo AS (SELECT language, gram, count(*) AS n, row_number() OVER (PARTITION BY language ORDER BY count(*) DESC, gram) AS rank FROM (SELECT language, {_cut('p')} AS gram FROM mw) GROUP BY language, gram)"""
_GRAMS = rf"gp AS (SELECT doc_id AS id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '\P{{L}}+', ' ', 'g')) || ' ' AS p FROM documents), gr AS (SELECT id, {_cut('p')} AS gram FROM gp)"


def _bayes_sql(p: str) -> str:
    """{p}pr (id, lang, p, rn) by naive Bayes over gr with the model mo."""
    return f"""{p}t AS (SELECT v.gram, t.language, ln((coalesce(mo.n, 0) + 1) / (t.total + (SELECT count(DISTINCT gram) FROM mo))) AS lp FROM (SELECT DISTINCT gram FROM mo) v CROSS JOIN (SELECT language, sum(n) AS total FROM mo GROUP BY language) t LEFT JOIN mo ON mo.gram = v.gram AND mo.language = t.language),
{p}s AS (SELECT id, language, sum(lp) AS s FROM gr JOIN {p}t ON {p}t.gram = gr.gram GROUP BY ALL), {p}e AS (SELECT id, language, exp(s - max(s) OVER (PARTITION BY id)) AS e, s FROM {p}s),
{p}pr AS (SELECT id, language AS lang, e / sum(e) OVER (PARTITION BY id) AS p, row_number() OVER (PARTITION BY id ORDER BY s DESC, language) AS rn FROM {p}e)"""


def _rank_sql(p: str) -> str:
    """{p}pr (id, lang, p, rn) by out-of-place distance of the 300 most frequent."""
    return f"""{p}o AS (SELECT id, gram, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, gram) AS place FROM gr GROUP BY id, gram QUALIFY place <= 300), {p}z AS (SELECT id, count(*) AS kinds FROM {p}o GROUP BY id),
{p}n AS (SELECT {p}o.id, mo.language, sum(300 - least(abs({p}o.place - mo.rank), 300)) AS near FROM {p}o JOIN mo ON mo.gram = {p}o.gram AND mo.rank <= 300 GROUP BY ALL),
{p}pr AS (SELECT {p}n.id, language AS lang, near / (kinds * 300) AS p, row_number() OVER (PARTITION BY {p}n.id ORDER BY near DESC, language) AS rn FROM {p}n JOIN {p}z ON {p}z.id = {p}n.id)"""


#: Common tables of the SQL forms: br has a row per document and backend, pr a row per language with a probability.
VOTES = rf"""WITH tk AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[{W}]+')) AS word FROM documents),
hit AS (SELECT id, language, count(*) AS n FROM tk JOIN {LEX} ON lex.word = tk.word GROUP BY ALL),
{_MODEL}, {_GRAMS}, {_bayes_sql('nb')}, {_rank_sql('rk0')}, {scripted_sql('(SELECT doc_id AS id, text FROM documents)', 'sc0')},
sl AS (SELECT id, p, list_sort({_LANGS}) AS langs FROM sc0e),
pr AS (SELECT id, 0 AS k, language AS lang, n / sum(n) OVER (PARTITION BY id) AS p, row_number() OVER (PARTITION BY id ORDER BY n DESC, language) AS rn FROM hit
  UNION ALL SELECT id, 1, lang, p, rn FROM nbpr UNION ALL SELECT id, 2, lang, p, rn FROM rk0pr
  UNION ALL SELECT id, 3, unnest(langs), p / len(langs), unnest(range(1, len(langs) + 1)) FROM sl WHERE len(langs) > 0),
br AS (SELECT d.doc_id AS id, b.k, b.backend_name, coalesce(pr.lang, 'unknown') AS language, coalesce(pr.p, 0) AS confidence, coalesce(pr.p, 0) > 0.5 AS is_reliable
  FROM documents d CROSS JOIN {values(list(enumerate(NAMES)), 'b(k, backend_name)')} LEFT JOIN pr ON pr.id = d.doc_id AND pr.k = b.k AND pr.rn = 1)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.run_backends(table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text"), NAMES)


def kept_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for plans that read them several times: cast once, kept, dealt by text."""
    return dealt(votes(spark, sf_dir), "id")


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("id", "lang", F.round("score", 6).alias("score"))


@query(VOTES + " SELECT id, backend_name, language, round(confidence, 6) AS confidence, is_reliable FROM br")
def bkd13_run_all(spark, sf_dir):
    return votes(spark, sf_dir).select("id", "backend_name", "language", F.round("confidence", 6).alias("confidence"), "is_reliable")


@query(rf"""WITH tk AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[{W}]+')) AS word FROM documents), hit AS (SELECT id, language, count(*) AS n FROM tk JOIN {LEX} ON lex.word = tk.word GROUP BY ALL),
pr AS (SELECT id, language AS lang, n / sum(n) OVER (PARTITION BY id) AS p FROM hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, language) = 1)
SELECT d.doc_id AS id, 'lexicon' AS backend_name, coalesce(pr.lang, 'unknown') AS language, round(coalesce(pr.p, 0), 6) AS confidence, coalesce(pr.p, 0) > 0.5 AS is_reliable FROM documents d LEFT JOIN pr ON pr.id = d.doc_id""")
def bkd_lexicon(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")
    return B.lexicon(docs).select("id", "backend_name", "language", F.round("confidence", 6).alias("confidence"), "is_reliable")


#: A model trained on whole texts; a fifth of them is kept out by a hash of the text.
_TRAINED = f"""WITH {_GRAMS}, fo AS (SELECT doc_id AS id, lang AS language FROM documents WHERE ('0x' || substr(md5(text), 1, 6))::BIGINT % 5 <> 0 AND lang IS NOT NULL),
mo AS (SELECT language, gram, count(*) AS n, row_number() OVER (PARTITION BY language ORDER BY count(*) DESC, gram) AS rank FROM gr JOIN fo ON fo.id = gr.id GROUP BY language, gram QUALIFY rank <= 2000)"""


def _folded(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    fold = F.conv(F.substring(F.md5("text"), 1, 6), 16, 10).cast("long") % 5
    texts = docs.select(F.col("doc_id").alias("id"), "text", "lang", fold.alias("fold"))
    return texts, B.train_ngrams(texts.filter("fold <> 0"))


@query(f"{_TRAINED}, {_bayes_sql('nb')} SELECT doc_id AS id, coalesce(lang_, 'unknown') AS language, round(coalesce(p, 0), 4) AS confidence FROM documents d LEFT JOIN (SELECT id, lang AS lang_, p FROM nbpr WHERE rn = 1) r ON r.id = d.doc_id")
def bkd_ngram_nb(spark, sf_dir):
    texts, model = _folded(spark, sf_dir)
    return B.ngram_nb(texts, model).select("id", "language", F.round("confidence", 4).alias("confidence"))


@query(f"{_TRAINED}, {_bayes_sql('nb')} SELECT coalesce(p, 0) > 0.5 AS is_reliable, coalesce(lang_, 'unknown') AS language, count(*) AS n FROM documents d LEFT JOIN (SELECT id, lang AS lang_, p FROM nbpr WHERE rn = 1) r ON r.id = d.doc_id GROUP BY ALL")
def sql_table_function(spark, sf_dir):
    """The trained model as a table function in SQL text, over the whole table."""
    texts, model = _folded(spark, sf_dir)
    texts.createOrReplaceTempView("sql_texts")
    sql.register(spark, {"trained_nb": model})
    return spark.sql("SELECT is_reliable, language, count(*) AS n FROM trained_nb(TABLE(SELECT id, text FROM sql_texts)) GROUP BY is_reliable, language")


@query(f"{_TRAINED}, {_rank_sql('rk')} SELECT doc_id AS id, coalesce(lang_, 'unknown') AS language, round(coalesce(p, 0), 6) AS confidence FROM documents d LEFT JOIN (SELECT id, lang AS lang_, p FROM rkpr WHERE rn = 1) r ON r.id = d.doc_id")
def bkd_ngram_rank(spark, sf_dir):
    texts, model = _folded(spark, sf_dir)
    return B.ngram_rank(texts, model).select("id", "language", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {scripted_sql()}, l AS (SELECT id, p, list_sort({_LANGS}) AS langs FROM e) SELECT id, CASE WHEN len(langs) > 0 THEN langs[1] ELSE 'unknown' END AS language, CASE WHEN len(langs) > 0 THEN round(p / len(langs), 6) ELSE 0 END AS confidence FROM l")
def bkd_script(spark, sf_dir):
    """Documents, and texts in other scripts."""
    from .scalars import _texts

    return B.script(_texts(spark, sf_dir)).select("id", "language", F.round("confidence", 6).alias("confidence"))


@query(VOTES + f" SELECT br.id, br.backend_name, rel.r AS reliability FROM br JOIN {REL} ON rel.backend_name = br.backend_name WHERE br.language <> 'unknown'")
def bkd12_reliability(spark, sf_dir):
    rows = votes(spark, sf_dir).filter("language <> 'unknown'")
    return rows.join(F.broadcast(B.backend_dimension(spark)), "backend_name").select("id", "backend_name", "reliability")


@query("""WITH r AS (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN upper(lang) WHEN 1 THEN '' WHEN 2 THEN NULL ELSE lang || ' ' END AS raw, (doc_id % 10) / 10.0 AS c, doc_id % 3 = 0 AND lang IS NOT NULL AS told FROM documents),
n AS (SELECT *, coalesce(nullif(lower(trim(raw)), ''), 'unknown') AS language FROM r)
SELECT doc_id AS id, language, (CASE WHEN language = 'unknown' THEN NULL WHEN told THEN 0.25 ELSE c END)::DOUBLE AS own, (told OR language <> 'unknown')::INT AS n_probabilities FROM n""")
def bkd02_normalized(spark, sf_dir):
    """The documents' labels as a backend would give them: in capitals, empty, null, with a blank; a third with a probability."""
    way, lang = F.col("doc_id") % 4, F.col("lang")
    raw = F.when(way == 0, F.upper(lang)).when(way == 1, "").when(way == 3, F.concat(lang, F.lit(" ")))
    probs = F.when((F.col("doc_id") % 3 == 0) & lang.isNotNull(), F.create_map(lang, F.lit(0.25)))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("x").alias("backend_name"), raw.alias("language"), (F.col("doc_id") % 10 / 10.0).alias("confidence"), probs.alias("all_probabilities"))
    return B.normalized(rows).select("id", "language", F.try_element_at("all_probabilities", F.col("language")).alias("own"), F.size("all_probabilities").alias("n_probabilities"))


def _hard(weight: str) -> str:
    return VOTES + f""", a AS (SELECT *, {weight} AS w, bool_or(is_reliable) OVER (PARTITION BY id) AS sure FROM br),
s AS (SELECT id, language AS lang, sum(w) AS w FROM a WHERE (is_reliable OR NOT sure) AND language <> 'unknown' GROUP BY ALL)
SELECT id, lang, round(w / sum(w) OVER (PARTITION BY id), 6) AS score FROM s"""


@query(_hard("1.0"))
def vot01_hard(spark, sf_dir):
    return _rounded(V.hard_vote(votes(spark, sf_dir)))


_WEIGHTS = {"lexicon": 3.0, "ngram_nb": 1.0}
_W = "CASE backend_name WHEN 'lexicon' THEN 3.0 WHEN 'ngram_nb' THEN 1.0 ELSE 1.0 END"


@query(_hard(_W))
def vot02_hard_weighted(spark, sf_dir):
    return _rounded(V.hard_vote(votes(spark, sf_dir), _WEIGHTS))


@query(VOTES + " SELECT id, lang, round(sum(p) / 4, 6) AS score FROM pr GROUP BY id, lang")
def vot03_soft(spark, sf_dir):
    return _rounded(V.soft_vote(votes(spark, sf_dir)))


@query(VOTES + " SELECT id, lang, round(sum(p * CASE k WHEN 0 THEN 3.0 ELSE 1.0 END) / 6, 6) AS score FROM pr GROUP BY id, lang")
def vot04_soft_weighted(spark, sf_dir):
    return _rounded(V.soft_vote(votes(spark, sf_dir), _WEIGHTS))


def _weighted(weight: str) -> str:
    return VOTES + f""", a AS (SELECT br.*, {weight} AS w FROM br JOIN {REL} ON rel.backend_name = br.backend_name), b AS (SELECT *, w / sum(w) OVER (PARTITION BY id) AS share FROM a)
SELECT id, language AS lang, round(sum(share * confidence), 6) AS score FROM b WHERE language <> 'unknown' GROUP BY ALL"""


@query(_weighted("r * r"))
def vot05_weighted(spark, sf_dir):
    return _rounded(V.weighted_vote(votes(spark, sf_dir)))


@query(_weighted("r * 1.0"))
def vot06_weighted_linear(spark, sf_dir):
    return _rounded(V.weighted_vote(votes(spark, sf_dir), square=False))


@query(VOTES + """, s AS (SELECT id, language AS lang, count(*) AS n FROM br WHERE language <> 'unknown' GROUP BY ALL HAVING count(*) >= 3)
SELECT id, lang, round(n / 4, 6) AS score FROM s UNION ALL SELECT id, lang, round(sum(p) / 4, 6) FROM pr WHERE id NOT IN (SELECT id FROM s) GROUP BY id, lang""")
def vot07_08_consensus(spark, sf_dir):
    return _rounded(V.consensus_vote(kept_votes(spark, sf_dir), min_agreement=3))


_TIE = f"""SELECT id, language AS lang, count(*) / 4 * 0.3 + avg(confidence) * 0.25 + count(*) FILTER (is_reliable) / count(*) * 0.2 + max(r) / 5 * 0.15 AS s
  FROM br JOIN {REL} ON rel.backend_name = br.backend_name WHERE language <> 'unknown' GROUP BY id, language"""


@query(VOTES + f", t AS ({_TIE}) SELECT id, lang, round(least(CASE WHEN lang IN ('en', 'fr') THEN s ELSE s * 0.1 END, 1), 6) AS score FROM t")
def vot09_tie_break(spark, sf_dir):
    return _rounded(V.tie_break(votes(spark, sf_dir), allowed=["en", "fr"]))


_SOFT = "sc AS (SELECT id, lang, sum(p) / 4 AS score FROM pr GROUP BY id, lang)"


@query(VOTES + f", {_SOFT}, o AS (SELECT id, round(score - lead(score) OVER (PARTITION BY id ORDER BY score DESC, lang), 9) AS gap, row_number() OVER (PARTITION BY id ORDER BY score DESC, lang) AS rn FROM sc) SELECT id FROM o WHERE rn = 1 AND gap < 0.01")
def vot10_needs_tie_break(spark, sf_dir):
    return V.tied(V.soft_vote(votes(spark, sf_dir)))


@query(VOTES + f", {_SOFT}, o AS (SELECT id, round(score - lead(score) OVER (PARTITION BY id ORDER BY score DESC, lang), 9) AS gap, row_number() OVER (PARTITION BY id ORDER BY score DESC, lang) AS rn FROM sc), x AS (SELECT id FROM o WHERE rn = 1 AND gap < 0.01), t AS ({_TIE}) SELECT id, lang, round(score, 6) AS score FROM sc WHERE id NOT IN (SELECT id FROM x) UNION ALL SELECT id, lang, round(least(s, 1), 6) FROM t WHERE id IN (SELECT id FROM x)")
def fus01_break_ties(spark, sf_dir):
    rows = kept_votes(spark, sf_dir)
    return _rounded(V.break_ties(V.soft_vote(rows), rows))


@query()
def vot12_custom(spark, sf_dir):
    """A strategy of one's own: the most confident backend decides. Row-wise Python, tested against a plain model."""

    def boldest(rows: list[dict]) -> dict[str, float]:
        known = [r for r in rows if r["language"] != "unknown"]
        top = max(known, key=lambda r: (r["confidence"], r["backend_name"]), default=None)
        return {top["language"]: top["confidence"]} if top else {}

    return _rounded(V.custom_vote(boldest)(votes(spark, sf_dir)))


#: Hints of the queries: words of the corpus' languages that stand for something.
HINTS = [("the", "en"), ("that", "en"), ("les", "fr"), ("dans", "fr"), ("und", "de"), ("nicht", "de"), ("para", "es"), ("una", "es"), ("hola", "es"), ("merci", "fr")]
_HINTS = values(HINTS, "h(word, lang)")
_FOUND = rf"""ht AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[{W}]+')) AS token FROM documents),
hh AS (SELECT id, lang, count(*) AS n FROM ht JOIN {_HINTS} ON h.word = lower(token) GROUP BY ALL), ha AS (SELECT id, lang, n / sum(n) OVER (PARTITION BY id) * 0.8 AS score FROM hh)"""


@query(VOTES + f", {_SOFT}, {_FOUND} SELECT coalesce(sc.id, ha.id) AS id, coalesce(sc.lang, ha.lang) AS lang, round(coalesce(sc.score, 0) + coalesce(ha.score, 0) * CASE WHEN length(trim(d.text)) <= 5 THEN 2.0 ELSE 0.45 END, 6) AS score FROM sc FULL JOIN ha ON ha.id = sc.id AND ha.lang = sc.lang JOIN documents d ON d.doc_id = coalesce(sc.id, ha.id)")
def fus02_hint_boost(spark, sf_dir):
    from ..operators import hints as H

    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")
    found = H.lookup_all(docs, spark.createDataFrame(HINTS, "word string, lang string"))
    return _rounded(fusion.boost_hints(V.soft_vote(votes(spark, sf_dir)), found, docs, mode="short"))


@query(VOTES + f", {_SOFT} SELECT sc.id, sc.lang, round(score + CASE WHEN d.lang = sc.lang THEN 0.3 ELSE 0 END * 0.2, 6) AS score FROM sc JOIN documents d ON d.doc_id = sc.id")
def fus03_context_boost(spark, sf_dir):
    boosts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.lit(0.3).alias("boost"))
    return _rounded(fusion.boost_context(V.soft_vote(votes(spark, sf_dir)), boosts))


_RANKED = VOTES + f", {_SOFT}, al AS (SELECT * FROM sc WHERE lang IN ('en', 'fr', 'de')), no AS (SELECT id, lang, score AS raw, CASE WHEN max(score) OVER (PARTITION BY id) > 0 THEN least(score / max(score) OVER (PARTITION BY id), 1) ELSE score END AS score FROM al), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, lang) AS rn, lead(score) OVER (PARTITION BY id ORDER BY round(score, 9) DESC, lang) AS nxt FROM no)"


def _ranked(rows: DataFrame) -> DataFrame:
    scores = fusion.normalize(fusion.allow(V.soft_vote(rows), ["en", "fr", "de"]))
    return fusion.rank(scores.withColumn("score", F.round("score", 9)))


@query(_RANKED + " SELECT id, lang, round(round(score, 9), 6) AS score, round(raw, 6) AS raw_score, rn FROM rk")
def fus04_06_rank(spark, sf_dir):
    return _ranked(votes(spark, sf_dir)).select("id", "lang", F.round("score", 6).alias("score"), F.round("raw_score", 6).alias("raw_score"), "rn")


@query(_RANKED + """, v AS (SELECT id, language AS lang, string_agg(backend_name || '=' || printf('%.4f', round(confidence, 4)), ',' ORDER BY backend_name) AS votes FROM br GROUP BY ALL)
SELECT rk.id, string_agg(rk.lang || ':' || printf('%.4f', round(score, 4)) || ':' || coalesce(votes, ''), ';' ORDER BY rn) AS candidates FROM rk LEFT JOIN v ON v.id = rk.id AND v.lang = rk.lang WHERE rn <= 2 GROUP BY rk.id""")
def fus07_08_candidates(spark, sf_dir):
    rows = kept_votes(spark, sf_dir)
    found = fusion.candidates(_ranked(rows), rows, top_k=2)
    voted = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), ",")
    shown = F.transform("candidates", lambda c: F.concat(c["lang"], F.lit(":"), F.format_string("%.4f", c["confidence"]), F.lit(":"), voted(c["backend_votes"])))
    return found.select("id", F.array_join(shown, ";").alias("candidates"))


def _decide_sql(limit: float, allow: str = "true") -> str:
    return f""", de AS (SELECT id, lang, score, raw, CASE WHEN nxt IS NOT NULL AND score - nxt < 0.1 AND score < {limit} THEN 'disagreement' WHEN score < {limit} AND {allow} THEN 'low_confidence' END AS reason FROM rk WHERE rn = 1)
SELECT d.doc_id AS id, CASE WHEN de.id IS NULL OR reason IS NOT NULL THEN 'und' ELSE de.lang END AS lang, coalesce(round(score, 4), 0) AS confidence, coalesce(reason IS NULL AND score >= {limit}, false) AS reliable,
  CASE WHEN de.id IS NULL THEN 'low_confidence' ELSE reason END AS reason FROM documents d LEFT JOIN de ON de.id = d.doc_id"""


@query(_RANKED + _decide_sql(0.5))
def fus09_12_decide(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    out = fusion.with_missing(docs, fusion.decide(_ranked(votes(spark, sf_dir)), 0.5))
    return out.select("id", "lang", "confidence", "reliable", "reason")


@query(_RANKED.replace("least(score / max(score) OVER (PARTITION BY id), 1)", "least(score / sum(score) OVER (PARTITION BY id), 1)") + _decide_sql(0.6))
def fus05_sum_normalized(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    scores = fusion.normalize(fusion.allow(V.soft_vote(votes(spark, sf_dir)), ["en", "fr", "de"]), how="sum")
    out = fusion.with_missing(docs, fusion.decide(fusion.rank(scores.withColumn("score", F.round("score", 9))), 0.6))
    return out.select("id", "lang", "confidence", "reliable", "reason")
