"""Queries on normalisation, statistics, gates, scripts and proper nouns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nouns, stats, text
from ..operators.ranges import interval_join
from . import query, quoted, table, values

S, W = r"[\s\x1c-\x1f\x85\p{Z}]+", r"\p{L}\p{N}_"
#: Texts in scripts that the tables lack; they join the documents in the queries on scripts and gates.
SAMPLES = [(-1, "Привет, как дела?"), (-2, "こんにちは世界"), (-3, "안녕하세요 여러분"), (-4, "你好世界"), (-5, "שלום עולם"), (-6, "สวัสดีชาวโลก"), (-7, "Γειά σου Κόσμε"), (-8, "مرحبا بالعالم"), (-9, "नमस्ते दुनिया"), (-10, "Hello Привет мир"), (-11, "12345 678"), (-12, "ok"), (-13, ""), (-14, "!!! ... ???"), (-15, "  "), (-16, "a"), (-17, "1 2 3 a b 4 5 6 7 8 9"), (-18, "வணக்கம் உலகம்"), (-19, "Բարեւ աշխարհ"), (-20, "カタカナ")]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")
    return docs.unionByName(spark.createDataFrame(SAMPLES, "id long, text string"))


TEXTS = f"(SELECT doc_id AS id, text FROM documents UNION ALL SELECT id, text FROM {values(SAMPLES, 's(id, text)')})"
LETTERS = r"regexp_replace(text, '\P{L}', '', 'g')"


def normal_sql(column: str, noise: bool = True) -> str:
    out = f"regexp_replace(nfc_normalize({column}), '{S}', ' ', 'g')"
    if noise:
        for step in text.NOISE:
            out = f"regexp_replace({out}, '{step}', ' ', 'g')"
        out = f"regexp_replace({out}, '{S}', ' ', 'g')"
    return f"trim({out})"


@query("SELECT doc_id, md5(nfc_normalize(text)) AS nfc_md5 FROM documents")
def nrm01_nfc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.nfc(F.col("text"))).alias("nfc_md5"))


@query(f"SELECT page_id, md5({normal_sql('html')}) AS clean_md5, md5({normal_sql('html', False)}) AS spaced_md5, length({normal_sql('html')}) AS n FROM pages")
def nrm02_07_normalize(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.md5(text.normalize_text(html)).alias("clean_md5"), F.md5(text.normalize_text(html, strip_noise=False)).alias("spaced_md5"), F.char_length(text.normalize_text(html)).alias("n"))


_TAGS = [("zh-CN",), ("zh-tw",), ("zh-Hans-SG",), ("zh-hk-traditional",), ("zho",), ("cmn",), ("yue",), (" EN ",), ("por",), ("spa",), ("deu",), ("en-US",), ("ceb",), ("x",), ("",), ("unknown",), (None,), ("und",), ("zh",)]
_CASES = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in text.TAGS.items())


_TAG = values(list(enumerate(x for (x,) in _TAGS)), "s(i, known)")


@query(f"""WITH t AS (SELECT doc_id, tag, lower(trim(coalesce(tag, ''))) AS p FROM (SELECT doc_id, CASE WHEN s.i IS NULL THEN lang || '-' || source ELSE known END AS tag FROM documents LEFT JOIN {_TAG} ON s.i = doc_id % {len(_TAGS) + 1}))
SELECT doc_id, tag, coalesce(CASE p {_CASES} END, CASE WHEN p LIKE 'zh%' AND regexp_matches(p, 'hans|cn|simplified') THEN 'zh-Hans' WHEN p LIKE 'zh%' AND regexp_matches(p, 'hant|tw|traditional') THEN 'zh-Hant'
  WHEN p LIKE 'zh%' THEN 'zh' WHEN length(p) >= 2 THEN substr(p, 1, 2) ELSE 'und' END) AS lang FROM t""")
def nrm08_tags(spark, sf_dir):
    """Each document gets one of some tags, or one made of its language and source."""
    docs, at = table(spark, sf_dir, "documents"), (F.col("doc_id") % (len(_TAGS) + 1)).cast("int")
    own = F.concat("lang", F.lit("-"), "source")
    tagged = docs.select("doc_id", F.when(at == len(_TAGS), own).otherwise(F.get(F.array(*(F.lit(x) for (x,) in _TAGS)), at)).alias("tag"))
    return tagged.select("doc_id", "tag", text.normalize_tag(F.col("tag")).alias("lang"))


#: All labels of the tables, and some that go by their first letters.
_LABELS = sorted(text.ISO3.items()) + [(c, c) for c in text.ISO3_KEPT] + [("eng", "en"), ("fra", "fr"), ("deu", "de"), ("zh-min-nan", "zh"), ("pt-br", "pt"), ("sr-cyrl", "sr"), ("XYZ", "xy"), ("q", "q")]
_ISO = values([(i, a, b) for i, (a, b) in enumerate(_LABELS)], "c(i, label, code)")


@query(f"SELECT doc_id, label, code AS lang FROM documents JOIN {_ISO} ON i = doc_id % {len(_LABELS)}")
def nrm09_iso_labels(spark, sf_dir):
    """Each document gets one of all known labels."""
    known = F.array(*(F.lit(a) for a, _ in _LABELS))
    labels = table(spark, sf_dir, "documents").select("doc_id", F.get(known, (F.col("doc_id") % len(_LABELS)).cast("int")).alias("label"))
    return text.label_codes(labels).select("doc_id", "label", "lang")


@query("SELECT doc_id, substr(text, 1, 50) AS short, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS shown, round(n_chars / 7.0, 4) AS rounded FROM documents")
def nrm11_12_display(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 50).alias("short"), text.truncated(F.col("text"), 100, "...").alias("shown"), F.round(F.col("n_chars") / 7.0, 4).alias("rounded"))


def _script_sql() -> str:
    parts = []
    for name, own in stats.SCRIPTS.items():
        cls = "[" + "".join(rf"\p{{{s}}}" for s in own) + "]"
        parts.append(rf"{{'n': length(regexp_replace(l, '[^{cls[1:-1]}]', '', 'g')), 'first': -length(regexp_extract(l, '(?s)^(.*?){cls}', 1)), 'script': '{name}'}}")
    return "list_reverse_sort([" + ", ".join(parts) + "])[1]"


@query(rf"""WITH t AS (SELECT id, text, {LETTERS} AS l FROM {TEXTS}), s AS (SELECT *, {_script_sql()} AS best FROM t)
SELECT id, length(text) AS n_chars, length(l) AS n_letters, CASE WHEN length(text) > 0 THEN round(length(l) / length(text), 6) ELSE 0 END AS letter_ratio,
  CASE WHEN l = '' THEN 0 ELSE len(list_distinct(string_split(l, ''))) END AS unique_letters, CASE WHEN l = '' OR best.n = 0 THEN NULL ELSE best.script END AS script,
  CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text) > 0.8 ELSE true END AS is_mostly_ascii,
  regexp_matches(text, '[\x{{4E00}}-\x{{9FFF}}\x{{3040}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}]') AS has_cjk FROM s""")
def sta01_08_stats(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("id", stats.text_stats(F.col("text")).alias("s")).select("id", "s.*")
    return rows.withColumn("letter_ratio", F.round("letter_ratio", 6))


def _gate_sql(mode: str) -> str:
    return rf"""CASE WHEN p = '' THEN 'empty_text' WHEN length(p) < {stats.MIN_CHARS[mode]} OR n < {stats.MIN_LETTERS[mode]} THEN 'too_little_text' WHEN n = 0 OR n / length(p) < 0.3 THEN 'non_linguistic' END"""


@query(rf"""WITH t AS (SELECT id, {normal_sql('text')} AS p FROM {TEXTS}), n AS (SELECT id, p, length(regexp_replace(p, '\P{{L}}', '', 'g')) AS n FROM t)
SELECT id, {_gate_sql('short')} AS short_reason, {_gate_sql('default')} AS default_reason, {_gate_sql('long')} AS long_reason FROM n""")
def gat01_05_gates(spark, sf_dir):
    plain = _texts(spark, sf_dir).select("id", text.normalize_text(F.col("text")).alias("p"))
    return plain.select("id", *(stats.gate(F.col("p"), m).alias(f"{m}_reason") for m in ("short", "default", "long")))


_RANGES = [(a, b, s) for s, own in stats.SCRIPT_RANGES.items() for a, b in own]


@query(rf"""WITH c AS (SELECT unnest(string_split({LETTERS}, '')) AS ch FROM {TEXTS}), n AS (SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch)
SELECT ch, n.n, coalesce(r.script, CASE WHEN regexp_matches(ch, '[a-zA-Z\p{{Latin}}]') THEN 'Latin' ELSE 'Unknown' END) AS script
FROM n LEFT JOIN {values(_RANGES, 'r(a, b, script)')} ON unicode(ch) BETWEEN r.a AND r.b""")
def scr01_char_scripts(spark, sf_dir):
    """The letters, counted before they meet the scripts' intervals."""
    letters = F.split(F.regexp_replace("text", r"\P{L}", ""), "")
    chars = _texts(spark, sf_dir).select(F.explode(letters).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    ranges = spark.createDataFrame(_RANGES, "a int, b int, script string")
    joined = interval_join(chars.withColumn("cp", F.ascii("ch")), "cp", ranges, "a", "b", 256, "left")
    return joined.select("ch", "n", F.coalesce("script", F.when(F.col("ch").rlike(r"[a-zA-Z\p{IsLatin}]"), "Latin").otherwise("Unknown")).alias("script"))


def _counts_sql() -> str:
    cls = lambda s: stats.range_class(s).replace("Is", "")
    return "[" + ", ".join(f"{{'n': length(l) - length(regexp_replace(l, '{cls(s)}', '', 'g')), 's': '{s}'}}" for s in stats.SCRIPT_LANGUAGES) + "]"


_LANGS = "CASE s " + " ".join(f"WHEN '{s}' THEN [{', '.join(map(quoted, v))}]" for s, v in stats.SCRIPT_LANGUAGES.items() if v) + " END"


def scripted_sql(texts: str = TEXTS, p: str = "") -> str:
    """Common tables up to e (id, script s, its proportion p); their names begin with ``p``."""
    return rf"""{p}t AS (SELECT id, text, {LETTERS} AS l FROM {texts}), {p}c AS (SELECT id, text, {_counts_sql()} AS c FROM {p}t),
{p}d AS (SELECT id, text, c, list_sum(list_transform(c, lambda x: x.n)) AS total, list_max(list_transform(c, lambda x: x.n)) AS top, len(list_filter(c, lambda x: x.n > 0)) AS kinds FROM {p}c),
{p}e AS (SELECT *, CASE WHEN total = 0 THEN 'Unknown' WHEN top / total < 0.7 AND kinds > 1 THEN 'Mixed' ELSE list_filter(c, lambda x: x.n = top)[1].s END AS s, CASE WHEN total = 0 THEN 0 ELSE top / total END AS p FROM {p}d)
"""


_SCRIPTED = "WITH " + scripted_sql()


@query(_SCRIPTED + "SELECT id, s AS script, round(p, 6) AS proportion FROM e")
def scr02_detect_script(spark, sf_dir):
    found = _texts(spark, sf_dir).select("id", stats.detect_script(F.col("text")).alias("s"))
    return found.select("id", "s.script", F.round("s.proportion", 6).alias("proportion"))


@query(_SCRIPTED + f""", f AS (SELECT id, {_LANGS} AS langs, ['ru', 'en', 'ja', 'hi'] AS cand FROM e)
SELECT id, array_to_string(list_sort(CASE WHEN langs IS NULL OR len(list_intersect(langs, cand)) = 0 THEN cand ELSE list_intersect(langs, cand) END), ' ') AS langs FROM f""")
def scr03_filter_languages(spark, sf_dir):
    cand = F.array(*map(F.lit, ("ru", "en", "ja", "hi")))
    return _texts(spark, sf_dir).select("id", F.array_join(F.array_sort(stats.filter_languages(F.col("text"), cand)), " ").alias("langs"))


@query(_SCRIPTED + f", f AS (SELECT id, p, {_LANGS} AS langs FROM e) SELECT id, unnest(langs) AS lang, round(0.2 * p, 6) AS boost FROM f WHERE langs IS NOT NULL AND p >= 0.5")
def scr04_script_hints(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("id", F.explode(stats.script_hints(F.col("text"))).alias("lang", "boost"))
    return rows.withColumn("boost", F.round("boost", 6))


_N = lambda s: f"list_filter(c, lambda x: x.s = '{s}')[1].n"


@query(_SCRIPTED + f"""SELECT id, {_N('Hiragana')} + {_N('Katakana')} > 0 OR ({_N('Han')} > 0 AND {_N('Hangul')} = 0) AS is_ja, s = 'Hangul' AND p > 0.3 AS is_ko,
  {_N('Han')} > 0 AND {_N('Hiragana')} + {_N('Katakana')} = 0 AND {_N('Hangul')} = 0 AS is_zh FROM e""")
def scr05_07_cjk(spark, sf_dir):
    t = F.col("text")
    return _texts(spark, sf_dir).select("id", stats.is_japanese(t).alias("is_ja"), stats.is_korean(t).alias("is_ko"), stats.is_chinese(t).alias("is_zh"))


@query(rf"""WITH t AS (SELECT id, {LETTERS} AS l FROM {TEXTS}), s AS (SELECT id, l, {_script_sql()} AS best FROM t), n AS (SELECT id, CASE WHEN l = '' OR best.n = 0 THEN NULL ELSE best.script END AS script FROM s)
SELECT id, script, CASE script {' '.join(f"WHEN '{s}' THEN '{v}'" for s, v in stats.UNAMBIGUOUS.items())} END AS lang, CASE WHEN script IN ('Hangul', 'Thai', 'Hebrew') THEN true ELSE false END AS strict FROM n""")
def scr08_short_circuit(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("id", stats.dominant_script(F.col("text")).alias("script"))
    return rows.select("id", "script", stats.short_circuit(F.col("script")).alias("lang"), stats.short_circuit(F.col("script"), strict=True).isNotNull().alias("strict"))


_BLANK = r"[\s\p{Z}]+"
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_BLANK}', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"SELECT doc_id, len({_SENTENCES}) AS n, md5(array_to_string({_SENTENCES}, '|')) AS sentences_md5 FROM documents")
def pnf01_sentences(spark, sf_dir):
    found = nouns.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n"), F.md5(F.array_join(found, "|")).alias("sentences_md5"))


_COMMON = "[" + ", ".join(map(quoted, sorted(set(nouns.COMMON)))) + "]"


def _nouns_sql(mask: str) -> str:
    words = rf"list_filter(regexp_split_to_array(s, '{_BLANK}'), lambda w: w <> '')"
    keep = rf"NOT regexp_matches(w, '^[\p{{Lu}}\p{{Lt}}]') OR i = 1 OR list_contains({_COMMON}, lower(regexp_replace(w, '[^{W}]', '', 'g'))) OR regexp_matches(w, '\p{{Nd}}') OR (length(w) > 1 AND regexp_matches(w, '\p{{Lu}}') AND NOT regexp_matches(w, '[\p{{Ll}}\p{{Lt}}]'))"
    judged = f"list_filter(list_transform({words}, lambda w, i: CASE WHEN {keep} THEN w ELSE {mask} END), lambda w: w IS NOT NULL)"
    out = f"array_to_string(list_filter(list_transform({_SENTENCES}, lambda s: array_to_string({judged}, ' ')), lambda s: s <> ''), ' ')"
    return f"md5(CASE WHEN trim({out}) = '' THEN text ELSE {out} END)"


@query(f"SELECT doc_id, {_nouns_sql('NULL')} AS removed_md5, {_nouns_sql(quoted(nouns.MASK))} AS masked_md5, md5(text) AS none_md5 FROM documents")
def pnf02_04_filter_nouns(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", *(F.md5(nouns.filter_nouns(t, s)).alias(n) for s, n in (("remove", "removed_md5"), ("mask", "masked_md5"), ("none", "none_md5"))))


@query(rf"""WITH t AS (SELECT turn, conv_id, text, list_filter(regexp_split_to_array(text, '{_BLANK}'), lambda w: w <> '') AS w FROM conversations)
SELECT conv_id, turn, len(w) BETWEEN 1 AND 5 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^[\p{{Lu}}\p{{Lt}}]'))) = 0
  AND len(list_filter(w, lambda x: list_contains([{', '.join(map(quoted, nouns.NAMELESS))}], lower(x)))) = 0 AS likely FROM t""")
def pnf08_likely_name(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", nouns.is_likely_name(F.col("text")).alias("likely"))


@query()
def pnf06_identify_nouns(spark, sf_dir):
    """Look-arounds that RE2 lacks; tested on a fixture."""
    found = nouns.identify_nouns(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n"), F.md5(F.array_join(found, "|")).alias("nouns_md5"))
