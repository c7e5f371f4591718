"""Detector backends: each turns (id, text) into rows of backend results.

A result row is (id, backend_name, language, confidence, all_probabilities map, is_reliable). The built-in ones are
projections: texts are neither taken apart into rows nor shuffled. The lexicon and the script are Column expressions,
the n-gram models score Arrow batches with a broadcast model whose size was counted. Classes of one's own that detect
row by row are run in Arrow batches, as are adapters of other libraries where these are installed.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark import Accumulator, SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType

from ..functions.stats import detect_script, script_languages
from ..functions.text import WORD
from . import grams as G

RESULT = "id long, backend_name string, language string, confidence double, all_probabilities map<string,double>, is_reliable boolean"
RELIABLE = 0.5

# How far backends are trusted, 0 to 5 (names of widely used detectors, and the built-in ones).
RELIABILITY = {"fasttext": 5, "fastlangid": 5, "lingua": 4, "langid": 3, "pycld3": 3, "langdetect": 2, "ngram_nb": 4, "lexicon": 3, "ngram_rank": 3, "script": 2}
#: Frequent function words by language; the lexicon backend's model.
LEXICON = {
    "de": "der die das und ist nicht ein eine zu den von mit sich auf für im dem des auch als an es werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man",
    "en": "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know",
    "es": "el la de que y en un ser se no haber por con su para como estar tener le lo todo pero más hacer o poder este ir otro ese si me ya ver porque dar cuando él muy sin vez mucho saber qué sobre mi alguno mismo yo también hasta año dos querer entre así primero desde grande los las una es del al",
    "fr": "le la les de des du et un une en est que qui dans pour pas au sur par plus ne se ce il sont avec son ou aux cette ses mais nous comme on leur été tout elle fait ils bien très même être sans peut sa lui où deux ainsi entre après",
    "it": "il lo la gli di che e un una in è per non con si da come ma più anche sono del della al alla dei nel ha questo ho ci se mi o lei loro",
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om ook als dan maar bij of uit nog naar heeft hij zij wordt over deze door worden",
    "pt": "o a os as de que e em um uma do da não para com por se no na mais dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso",
}


def backend_dimension(spark, extra: dict[str, int] | None = None) -> DataFrame:
    """(backend_name, reliability)."""
    return spark.createDataFrame(sorted((RELIABILITY | {n: r for n, (_, r) in _registry.items()} | (extra or {})).items()), "backend_name string, reliability int")


def normalized(results: DataFrame) -> DataFrame:
    """Lower-case languages, ``unknown`` where empty, and the language itself in all_probabilities."""
    language = F.lower(F.coalesce(F.trim("language"), F.lit("")))
    language = F.when(language == "", "unknown").otherwise(language)
    probs = F.coalesce("all_probabilities", F.create_map().cast("map<string,double>"))
    out = results.withColumns({"language": language, "all_probabilities": probs})
    add = ~F.map_contains_key("all_probabilities", F.col("language")) & (F.col("language") != "unknown")
    return out.withColumn("all_probabilities", F.when(add, F.map_concat("all_probabilities", F.map_from_arrays(F.array("language"), F.array("confidence")))).otherwise(F.col("all_probabilities")))


def _descending(name: str) -> Column:
    """A key on which the greatest is the alphabetically first (language tags are ASCII)."""
    return F.translate(F.col(name), "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{WORD}]+"), F.lit(0))


def lexicon_result(text: Column, model: dict[str, str] | None = None) -> Column:
    """struct<language, confidence, all_probabilities>: the share of each language in the hits of a text's tokens among function words."""
    listed = {lang: sorted(set(own.split())) for lang, own in sorted((model or LEXICON).items())}
    every = sorted({w for own in listed.values() for w in own})

    def judged(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0), lambda a, x: a + x["n"])
        top = F.array_max(F.transform(counts, lambda x: x["n"]))
        best = F.get(F.filter(counts, lambda x: x["n"] == top), F.lit(0))["language"]  # ties go to the first alphabetically
        probs = F.map_from_entries(F.transform(F.filter(counts, lambda x: x["n"] > 0), lambda x: F.struct(x["language"], x["n"] / total)))
        none = F.struct(F.lit("unknown").alias("language"), F.lit(0.0).alias("confidence"), F.create_map().cast("map<string,double>").alias("all_probabilities"))
        return F.when(total > 0, F.struct(best.alias("language"), (top / total).alias("confidence"), probs.alias("all_probabilities"))).otherwise(none)

    def counted(hits: Column) -> Column:
        of = lambda own: F.size(F.filter(hits, lambda w: w.isin(own)))
        return F.array(*(F.struct(F.lit(lang).alias("language"), of(own).alias("n")) for lang, own in listed.items()))

    return _let(F.filter(words(text), lambda w: w.isin(every)), lambda hits: _let(counted(hits), judged))


def script_result(text: Column) -> Column:
    """The same of the languages of the text's script, the script's share dealt among them."""
    return written_result(detect_script(text))


def written_result(found: Column) -> Column:
    """The same of a script that ``detect_script`` found."""

    def judged(found: Column) -> Column:
        langs = F.array_sort(script_languages(found["script"]))
        share = found["proportion"] / F.size(langs)
        some = F.struct(F.get(langs, F.lit(0)).alias("language"), share.alias("confidence"), F.map_from_arrays(langs, F.transform(langs, lambda _: share)).alias("all_probabilities"))
        none = F.struct(F.lit("unknown").alias("language"), F.lit(0.0).alias("confidence"), F.create_map().cast("map<string,double>").alias("all_probabilities"))
        return F.when(F.size(langs) > 0, some).otherwise(none)

    return _let(found, judged)


def _projected(texts: DataFrame, result: Column, name: str) -> DataFrame:
    rows = texts.select("id", result.alias("r"))
    return rows.select("id", F.lit(name).alias("backend_name"), "r.language", "r.confidence", "r.all_probabilities", (F.col("r.confidence") > RELIABLE).alias("is_reliable"))


def lexicon(texts: DataFrame, model: dict[str, str] | None = None, name: str = "lexicon") -> DataFrame:
    return _projected(texts, lexicon_result(F.col("text"), model), name)


def script(texts: DataFrame, name: str = "script") -> DataFrame:
    return _projected(texts, script_result(F.col("text")), name)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ngrams(text: Column, n: int = G.N) -> Column:
    """Letter n-grams of a text, lower-cased, runs of other characters as one blank; the Column form of what the models count."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"\P{L}+", " ")), F.lit(" "))
    # The inner array holds the characters once; substring would count them from the text's start for each n-gram.
    cut = lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(p, i, n), ""))
    return _let(F.split(plain, ""), cut)


#: Rows of an n-gram model that are broadcast at most (some 100 bytes each); a larger one is refused.
MODEL_ROWS = 2_000_000


def train_ngrams(texts: DataFrame, top: int = 2000) -> DataFrame:
    """A model (language, gram, n, rank): the ``top`` n-grams of each language of ``texts`` (text, lang), over whole texts."""
    counted = texts.filter(F.col("lang").isNotNull()).select(F.col("lang").alias("language"), "text").mapInArrow(G.count, "language string, gram string, n long")
    counts = counted.groupBy("language", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("language").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def word_model() -> G.Model:
    """The built-in n-gram model: the n-grams of the lexicon's words."""
    rows = []
    for lang, own in LEXICON.items():
        counts: dict[str, int] = {}
        for w in own.split():
            for i in range(len(w)):
                gram = f" {w} "[i : i + G.N]
                counts[gram] = counts.get(gram, 0) + 1
        rows += [(lang, g, n, rank) for rank, (g, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])), 1)]
    return G.Model(rows)


def held_model(spark: SparkSession, model: DataFrame | G.Model | None):
    """(broadcast model, its languages); the built-in one for None. A table of more than MODEL_ROWS rows is refused."""
    if isinstance(model, DataFrame):
        rows = model.select("language", "gram", "n", "rank").limit(MODEL_ROWS + 1).collect()
        if len(rows) > MODEL_ROWS:
            raise ValueError(f"an n-gram model of more than {MODEL_ROWS} rows is not broadcast; train it with a smaller top")
        model = G.Model([tuple(r) for r in rows])
    model = model or word_model()
    return spark.sparkContext.broadcast(model), model.languages


def ngram_nb(texts: DataFrame, model: DataFrame | G.Model | None = None, name: str = "ngram_nb") -> DataFrame:
    """Multinomial naive Bayes over n-grams that the model knows, smoothed by one; posterior of each language."""
    held, languages = held_model(texts.sparkSession, model)
    return texts.select("id", "text").mapInArrow(G.results(name, lambda own: held.value.bayes(own), languages, RELIABLE), RESULT)


def ngram_rank(texts: DataFrame, model: DataFrame | G.Model | None = None, profile: int = 300, name: str = "ngram_rank") -> DataFrame:
    """Out-of-place distance between a text's n-gram ranks and each language's profile; confidence 1 - distance."""
    held, languages = held_model(texts.sparkSession, model)
    return texts.select("id", "text").mapInArrow(G.results(name, lambda own: held.value.ranked(own, profile), languages, RELIABLE), RESULT)


#: Backends on n-grams with the built-in model, which may share a pass over the texts.
GRAMS: dict[str, Callable] = {"ngram_nb": lambda held, texts, found: held.value.bayes(texts, found), "ngram_rank": lambda held, texts, found: held.value.ranked(texts, found=found)}


def with_grams(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` without their last column, a text, and with ``grams``, an array of struct<backend_name, r> for the backends ``names`` of GRAMS."""
    held, languages = held_model(rows.sparkSession, None)
    rest = rows.columns[:-1]
    columns = [(f"{n}_{part}", kind) for n in names for part, kind in (("language", StringType()), ("confidence", DoubleType()), ("probabilities", MapType(StringType(), DoubleType())))]
    schema = rows.select(*rest).schema
    for name, kind in columns:
        schema = schema.add(name, kind)
    scores = {n: partial(GRAMS[n], held) for n in names}
    out = rows.mapInArrow(G.beside(scores, languages, [*rest, *(c for c, _ in columns)]), schema)
    one = lambda n: F.struct(F.lit(n).alias("backend_name"), F.struct(F.col(f"{n}_language").alias("language"), F.col(f"{n}_confidence").alias("confidence"), F.col(f"{n}_probabilities").alias("all_probabilities")).alias("r"))
    return out.select(*rest, F.array(*map(one, names)).alias("grams"))


# --- backends of one's own ---------------------------------------------------------------------------------------


class Backend(ABC):
    """Detects row by row: detect(text) -> (language, confidence, probabilities or None, reliable)."""

    name: str = ""

    @abstractmethod
    def detect(self, text: str) -> tuple: ...

    def is_available(self) -> bool:
        return True

    def supported_languages(self) -> set[str]:
        return set()

    def detect_batch(self, texts: list[str]) -> list[tuple]:
        return [self.detect(t) for t in texts]


Scorer = Callable[[DataFrame], DataFrame]
_registry: dict[str, tuple[Scorer | type[Backend], int]] = {}
BUILT_IN: dict[str, Scorer] = {"lexicon": lexicon, "ngram_nb": ngram_nb, "ngram_rank": ngram_rank, "script": script}
#: Backends that are a Column of the text alone.
COLUMNS: dict[str, Callable[[Column], Column]] = {"lexicon": lexicon_result, "script": script_result}


class BackendUnavailable(RuntimeError):
    pass


def register_backend(name: str, scorer: Scorer | type[Backend], reliability: int = 3) -> None:
    """scorer: a function from (id, text) to result rows, or a subclass of Backend."""
    if name in RELIABILITY:
        raise ValueError(f"{name!r} is the name of a known backend")
    if isinstance(scorer, type) and not issubclass(scorer, Backend):
        raise TypeError("a backend class derives from Backend")
    if not isinstance(reliability, int) or not 1 <= reliability <= 5:
        raise ValueError("reliability is an integer from 1 to 5")
    _registry[name] = (scorer, reliability)


def backend(name: str, reliability: int = 3):
    """Decorator form of register_backend."""

    def put(scorer):
        register_backend(name, scorer, reliability)
        return scorer

    return put


def unregister_backend(name: str) -> bool:
    return _registry.pop(name, None) is not None


def list_backends() -> list[str]:
    """All names that can be created here, by falling reliability, then by name; other libraries' only where they are installed."""
    from .adapters import LIBRARIES

    there = [n for n, c in LIBRARIES.items() if c().is_available()]
    known = {n: RELIABILITY[n] for n in [*BUILT_IN, *there]} | {n: r for n, (_, r) in _registry.items()}
    return sorted(known, key=lambda n: (-known[n], n))


def clear_backends() -> None:
    _registry.clear()


#: Counts of failures by backend, and the application that each belongs to.
_failed: dict[str, Accumulator] = {}
_counting: dict[str, SparkContext] = {}


def failed_texts(name: str) -> int:
    """Texts on which the backend raised, over the jobs so far of this application (a task that ran again counts again)."""
    return _failed[name].value if name in _failed else 0


def row_wise(make: Callable[[], Backend], name: str) -> Scorer:
    """A scorer that runs a Backend in Arrow batches; a text on which it raises gets no row and is counted (``failed_texts``).

    A batch goes to ``detect_batch`` whole where the class has one of its own; if that raises, its texts go one by one.
    """

    def one_by_one(detector: Backend, texts: list[str], failed: Accumulator) -> Iterator[tuple | None]:
        for text in texts:
            try:
                yield detector.detect(text)
            except Exception:  # noqa: BLE001 - a backend that fails on a text has no vote on it
                failed.add(1)
                yield None

    def results(detector: Backend, texts: list[str], failed: Accumulator) -> list[tuple | None]:
        if type(detector).detect_batch is Backend.detect_batch:
            return list(one_by_one(detector, texts, failed))
        try:
            found = list(detector.detect_batch(texts))
        except Exception:  # noqa: BLE001 - some text of the batch
            return list(one_by_one(detector, texts, failed))
        if len(found) != len(texts):
            raise ValueError(f"{name}: detect_batch gave {len(found)} results for {len(texts)} texts")
        return found

    def run(batches: Iterator[pa.RecordBatch], failed: Accumulator) -> Iterator[pa.RecordBatch]:
        detector = make()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            told = results(detector, [text or "" for text in batch.column(1).to_pylist()], failed)
            for key, result in zip(batch.column(0).to_pylist(), told, strict=True):
                if result is None:
                    continue
                language, confidence, probs, reliable = result
                for column, value in zip(out, (key, name, language, float(confidence), list((probs or {}).items()), bool(reliable)), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.map_(pa.string(), pa.float64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])

    def scored(texts: DataFrame) -> DataFrame:
        context = texts.sparkSession.sparkContext
        if name not in _failed or _counting.get(name) is not context:
            _failed[name], _counting[name] = context.accumulator(0), context
        failed = _failed[name]
        return normalized(texts.select("id", "text").mapInArrow(lambda batches: run(batches, failed), RESULT))

    return scored


def create_backend(name: str) -> Scorer:
    if name in BUILT_IN:
        return BUILT_IN[name]
    from .adapters import LIBRARIES

    if name in _registry or name in LIBRARIES:
        scorer = _registry[name][0] if name in _registry else LIBRARIES[name]
        if isinstance(scorer, type):
            if not scorer().is_available():
                raise BackendUnavailable(name)
            return row_wise(scorer, name)
        return scorer
    raise BackendUnavailable(f"no backend {name!r}; there are {list_backends()}")


def run_backends(texts: DataFrame, scorers: Iterable[Scorer | str]) -> DataFrame:
    """The results of all backends."""
    made = [create_backend(s)(texts) if isinstance(s, str) else s(texts) for s in scorers]
    if not made:
        return texts.sparkSession.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, made)
