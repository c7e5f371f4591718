"""Word hints: a dimension (word, lang) that is joined with the tokens of texts."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WORD
from .backends import _descending, words

CONFIDENCE, PER_HIT, MOST_EXTRA, FUZZY = 0.8, 0.05, 0.15, 0.7
#: Likeness in percent from which a word counts as a hint.
RATIO = 80
#: Rows of a hint table up to which it is broadcast.
BROADCAST_ROWS = 200_000
#: Entries of a table of letters' places.
TABLE = 4_000_000


def _joinable(hints: DataFrame) -> DataFrame:
    """Broadcast after its rows were counted; a larger table is shuffled."""
    return F.broadcast(hints) if hints.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else hints


class Hints:
    """A dictionary of single words to languages, kept on the driver until it is joined."""

    def __init__(self, words: dict[str, str] | None = None, case_sensitive: bool = False, confidence: float = CONFIDENCE):
        self.case_sensitive, self.confidence, self._words = case_sensitive, confidence, {}
        self.add_many(words or {})

    def _key(self, word: str) -> str:
        return word.strip() if self.case_sensitive else word.strip().lower()

    def add(self, word: str, lang: str) -> None:
        key = self._key(word)
        if not key or " " in key:
            raise ValueError("a hint is a single word")
        self._words[key] = lang

    def add_many(self, words: dict[str, str]) -> None:
        for word, lang in words.items():
            self.add(word, lang)

    def remove(self, word: str) -> bool:
        return self._words.pop(self._key(word), None) is not None

    def get(self, word: str) -> str | None:
        return self._words.get(self._key(word))

    def __contains__(self, word: str) -> bool:
        return self._key(word) in self._words

    def __len__(self) -> int:
        return len(self._words)

    def __iter__(self):
        return iter(self._words)

    def merge(self, other: Hints) -> Hints:
        """The other's hints win; the settings stay."""
        return Hints(self._words | other._words, self.case_sensitive, self.confidence)

    def words(self) -> list[str]:
        return list(self._words)

    def languages(self) -> set[str]:
        return set(self._words.values())

    def items(self):
        return self._words.items()

    def to_dict(self) -> dict[str, str]:
        return dict(self._words)

    from_dict = classmethod(lambda cls, words, **options: cls(words, **options))

    def dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self._words.items()), "word string, lang string")

    # files

    @classmethod
    def load(cls, path: str, **options) -> Hints:
        with open(path, "rb") as f:
            if path.endswith(".toml"):
                return cls(tomllib.load(f).get("hints", {}), **options)
            if path.endswith(".json"):
                data = json.load(f)
                return cls(data.get("hints", data), **options)
        raise ValueError(f"hints are kept in .toml or .json files, not {path}")

    def save(self, path: str) -> None:
        if path.endswith(".toml"):
            text = "[hints]\n" + "".join(f"{json.dumps(k, ensure_ascii=False)} = {json.dumps(v)}\n" for k, v in self._words.items())
        elif path.endswith(".json"):
            text = json.dumps({"hints": self._words}, ensure_ascii=False, indent=2)
        else:
            raise ValueError(f"hints are kept in .toml or .json files, not {path}")
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)

    @classmethod
    def short_words(cls, lexicon: dict[str, Iterable[str]]) -> Hints:
        """Inverts {lang: words}; later languages overwrite. Every call makes its own copy."""
        return cls({w: lang for lang, own in lexicon.items() for w in own})


def merge_tables(first: DataFrame, second: DataFrame) -> DataFrame:
    """Right-biased union of hint tables."""
    both = first.withColumn("p", F.lit(0)).unionByName(second.withColumn("p", F.lit(1)))
    return both.groupBy("word").agg(F.max_by("lang", "p").alias("lang"))


def tokens(texts: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(id, pos, token, word): word is what hints are compared with."""
    found = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(rf"[{WORD}]+"), F.lit(0))).alias("pos", "token"))
    return found.withColumn("word", F.col("token") if case_sensitive else F.lower("token"))


def lookup_all(texts: DataFrame, hints: DataFrame, confidence: float = CONFIDENCE, case_sensitive: bool = False) -> DataFrame:
    """(id, lang, score): each language's share of the hits, times the confidence."""
    return shares(tokens(texts, case_sensitive), hints, confidence)


#: Hints up to which their words are looked for in the pass over the texts.
FEW = 10_000


def few_words(hints: DataFrame) -> list[str] | None:
    """The words of a table of at most FEW hints."""
    rows = hints.select("word").limit(FEW + 1).collect()
    return sorted({r[0] for r in rows if r[0] is not None}) if len(rows) <= FEW else None


def hit_words(text: Column, few: list[str]) -> Column:
    """The words of a text, as ``tokens`` has them, that are among ``few``."""
    found = F.regexp_extract_all(text, F.lit(rf"[{WORD}]+"), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.lower(t)), lambda w: w.isin(few))


def shares(found: DataFrame, hints: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """(id, lang, score) of words (id, word) of texts."""
    hits = found.join(_joinable(hints), "word").groupBy("id", "lang").agg(F.count("*").alias("n"))
    return hits.select("id", "lang", (F.col("n") / F.sum("n").over(Window.partitionBy("id")) * confidence).alias("score"))


def close(a: Column, b: Column) -> Column:
    """Whether two words are at most one edit apart."""
    return F.levenshtein(a, b, 1) >= 0


def fuzzy_matches(found: DataFrame, hints: DataFrame) -> DataFrame:
    """(word, lang): the first hint (alphabetically) of at least 3 letters within one edit of each distinct ``word``.

    One edit changes at most one of a word's two halves, so candidates share the first or the last half; that is an
    equi-join and not a comparison of all words with all hints.
    """
    mine = []
    for shift in (-1, 0, 1):  # the hint's length less the word's
        n_hint = F.char_length("w") + shift
        first = F.substring(F.col("w"), F.lit(1), F.floor(n_hint / 2).cast("int"))
        mine.append(F.struct(F.lit(shift).alias("s"), F.lit("a").alias("side"), n_hint.alias("n"), first.alias("part")))
        length = F.greatest(n_hint - F.floor(n_hint / 2) - 1, F.lit(0)).cast("int")
        last = F.when(length > 0, F.right(F.col("w"), length)).otherwise("")
        mine.append(F.struct(F.lit(shift).alias("s"), F.lit("z").alias("side"), n_hint.alias("n"), last.alias("part")))
    n = F.char_length("h")
    length = F.greatest(n - F.floor(n / 2) - 1, F.lit(0)).cast("int")
    theirs = F.array(F.struct(F.lit("a").alias("side"), n.alias("n"), F.substring(F.col("h"), F.lit(1), F.floor(n / 2).cast("int")).alias("part")), F.struct(F.lit("z").alias("side"), n.alias("n"), F.when(length > 0, F.right(F.col("h"), length)).otherwise("").alias("part")))
    left = found.select(F.col("word").alias("w")).distinct().filter(F.char_length("w") >= 3).select("w", F.explode(F.array(*mine)).alias("k"))
    right = hints.filter(F.char_length("word") >= 3).select(F.col("word").alias("h"), "lang").select("h", "lang", F.explode(theirs).alias("q"))
    met = left.join(_joinable(right), (F.col("k.side") == F.col("q.side")) & (F.col("k.n") == F.col("q.n")) & (F.col("k.part") == F.col("q.part"))).filter(close(F.col("w"), F.col("h")))
    return met.groupBy(F.col("w").alias("word")).agg(F.min_by("lang", "h").alias("lang"))


def common_letters(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The length of the longest common subsequence of each two words, bit-parallel over the first one's letters.

    All pairs of a batch go together, a letter of the second words at a time: a table has the places of each letter in
    each distinct first word. First words of over 64 letters, which a number can't hold, go one by one.
    """
    for a, b in pairs:
        (of_a, firsts), (of_b, seconds) = pd.factorize(a), pd.factorize(b)
        out = np.zeros(len(a), np.int32)
        size = np.array([len(w) for w in firsts], np.int64)
        codes, letters = np.unique(np.frombuffer("".join([*firsts, *seconds]).encode("utf-32-le"), "<u4"), return_inverse=True)
        length = np.array([len(w) for w in seconds], np.int64)
        after = np.zeros((len(seconds), max(length, default=0)), np.int64)  # 0 behind the end
        row = np.repeat(np.arange(len(seconds)), length)
        after[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = letters[size.sum() :] + 1
        for i in np.flatnonzero(size[of_a] > 64):
            out[i] = _common_of_long(firsts[of_a[i]], seconds[of_b[i]])
        starts, step = np.cumsum(size) - size, max(1, TABLE // (len(codes) + 1))
        for low in range(0, len(firsts), step):
            own = np.flatnonzero(size[low : low + step] <= 64) + low
            places = np.zeros((min(step, len(firsts) - low), len(codes) + 1), np.uint64)
            at = np.arange(size[own].sum()) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
            np.bitwise_or.at(places, (np.repeat(own - low, size[own]), letters[np.repeat(starts[own], size[own]) + at] + 1), np.uint64(1) << at.astype(np.uint64))
            rows = np.flatnonzero((of_a >= low) & (of_a < low + step) & (size[of_a] <= 64))
            free = np.full(len(rows), ~np.uint64(0))
            for letter in after[of_b[rows]].T:
                same = places[of_a[rows] - low, letter]
                free = (free + (free & same)) | (free & ~same)
            n = size[of_a[rows]].astype(np.uint64)
            out[rows] = np.bitwise_count(~free & (~np.uint64(0) >> (np.uint64(64) - np.maximum(n, np.uint64(1)))))
        yield pd.Series(out)


def _common_of_long(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    free = every = (1 << len(a)) - 1
    for c in b:
        same = where.get(c, 0)
        free = ((free + (free & same)) | (free & ~same)) & every
    return len(a) - free.bit_count()


def _share(x: Column, i: Column, n: Column) -> Column:
    """The i-th of n borders that cut ``x`` letters evenly."""
    return F.floor(i * x / n).cast("int")


def _letters(word: Column) -> Column:
    """The letters of a word as bits of a long, by their code modulo 64."""
    code = lambda i: F.ascii(F.substring(word, i, F.lit(1))) % 64
    one = F.lit(1).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.char_length(word)), F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", one, code(i))))


def ratio_matches(found: DataFrame, hints: DataFrame, percent: int = RATIO) -> DataFrame:
    """(word, hint, lang, ratio): for each distinct ``word`` of at least 3 letters the hint most like it, of those at or above
    ``percent``; ties go to the first hint alphabetically.

    The ratio is 200 times the longest common subsequence by the sum of the lengths, so alike words differ by at most
    D = (100 - percent) % of that sum in letters put in or taken out. Of D + 1 pieces of the hint one stands in the word
    unchanged, with at most as many differences before it as there are pieces before it, and likewise behind. Each
    word therefore offers, for each length that a hint may have, its substrings at those places, and pairs meet by
    equal hashes of (length, D, piece, letters): an equi-join that loses no pair, whose candidates are then checked.

    A letter that the other word lacks is not common, which by a number for each word leaves few candidates before they are made distinct.
    Words are few bytes but much work: they are dealt over all tasks, and stay where they are from there on.
    """
    spark = found.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    w, a, h = F.col("w"), F.char_length("w"), F.char_length("h")
    slack = lambda a, b: F.floor((100 - percent) * (a + b) / 100 + 1e-9).cast("int")
    # Of alike words the common letters are percent / 200 of the sum, and at most the shorter one's.
    span = lambda n: (F.ceil(n * percent / (200 - percent) - 1e-9).cast("int"), F.floor(n * (200 - percent) / percent + 1e-9).cast("int"))
    key = lambda b, d, i, text: F.xxhash64(b, d, i, text)

    def offered(b: Column) -> Column:
        d = slack(a, b)

        def piece(i: Column) -> Column:
            start, size = _share(b, i, d + 1), _share(b, i + 1, d + 1) - _share(b, i, d + 1)
            low = F.greatest(start - i, start + (a - b) - (d - i), F.lit(0))
            high = F.least(start + i, start + (a - b) + (d - i), a - size)
            places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda at: key(b, d, i, F.substring(w, at + 1, size)))

        return F.flatten(F.transform(F.sequence(F.lit(0), d), piece))

    def kept(d: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), d), lambda i: key(h, d, i, F.substring(F.col("h"), _share(h, i, d + 1) + 1, _share(h, i + 1, d + 1) - _share(h, i, d + 1))))

    left = found.select(F.col("word").alias("w")).distinct().filter(a >= 3).repartition(tasks, "w").withColumn("own", _letters(w))
    left = left.select("w", "own", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(*span(a)), offered)))).alias("key"))
    right = hints.filter("word <> ''").groupBy(F.col("word").alias("h")).agg(F.min("lang").alias("lang")).withColumn("theirs", _letters(F.col("h")))
    least, most = span(h)
    right = right.select("h", "lang", "theirs", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(slack(h, least), slack(h, most)), kept)))).alias("key"))
    at_most = lambda n, x, y: n - F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    own, theirs = F.col("own"), F.col("theirs")
    met = left.join(_joinable(right), "key").filter(200 * F.least(at_most(a, own, theirs), at_most(h, theirs, own)) >= percent * (a + h))
    met = met.select("w", "h", "lang").distinct()
    common = F.pandas_udf("int")(common_letters)
    met = met.withColumn("common", common("w", "h")).filter(200 * F.col("common") >= percent * (a + h))
    best = met.groupBy("w").agg(F.min(F.struct((-200 * F.col("common") / (a + h)).alias("less"), F.col("h").alias("hint"), "lang")).alias("m"))
    return best.select(F.col("w").alias("word"), "m.hint", "m.lang", (-F.col("m.less")).alias("ratio"))


def lookup(texts: DataFrame, hints: DataFrame, fuzzy: bool | str = True, confidence: float = CONFIDENCE) -> DataFrame:
    """(id, lang, confidence, kind): the language with most exact hits, else with most fuzzy ones; ties go to the first alphabetically.

    fuzzy: "ratio" matches words by ``ratio_matches``, True or "edit" by one edit, False not at all.
    """
    found = tokens(texts)
    exact = found.join(_joinable(hints), "word").groupBy("id", "lang").agg(F.count("*").alias("n"))
    best = lambda rows: rows.groupBy("id").agg(F.max_by("lang", F.struct("n", _descending("lang"))).alias("lang"), F.max("n").alias("n"))
    out = best(exact).select("id", "lang", F.least(F.lit(confidence) + F.least(F.col("n") * PER_HIT, F.lit(MOST_EXTRA)), F.lit(1.0)).alias("confidence"), F.lit("exact").alias("kind"))
    if not fuzzy:
        return out
    rest = found.join(out.select("id"), "id", "left_anti")
    matches = ratio_matches(rest, hints) if fuzzy == "ratio" else fuzzy_matches(rest, hints)
    near = rest.join(matches, "word").groupBy("id", "lang").agg(F.count("*").alias("n"))
    return out.unionByName(best(near).select("id", "lang", F.lit(confidence * FUZZY).alias("confidence"), F.lit("fuzzy").alias("kind")))
