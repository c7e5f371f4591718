"""Proper nouns by capitalisation, as Column expressions over arrays of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD

# Words that are kept even if capitalised; words that no name holds.
COMMON = [
    "the", "a", "an", "in", "on", "at", "to", "for", "of", "with", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need", "dare", "ought", "used", "i", "you", "he",
    "she", "it", "we", "they", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "and", "or", "but", "if", "then", "else",
    "when", "where", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "just", "also", "now", "here", "there", "der", "die", "das", "und", "oder", "le", "la", "les", "et", "ou",
    "el", "los", "las", "y", "o", "il", "lo", "gli", "e",
]
NAMELESS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "and", "or", "but", "in", "on", "at", "to", "for",
]
MASK = "[NAME]"
_BLANK = r"[\s\p{Z}]+"


def _split(text: Column) -> Column:
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences by their closing marks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])[\s\p{Z}]+"), lambda s: F.trim(s)), lambda s: s != "")


def _noun() -> str:
    """A proper noun in a text of single blanks: a capitalised word after another word of its sentence, without a digit, neither an
    acronym nor (marks within left out) one of the common words. The blank and the capital come first: they leave most places out."""
    common = "|".join(f"[^{WORD} ]*".join(w) for w in sorted(set(COMMON)))
    word = rf"(?:[\p{{Lu}}\p{{Lt}}](?![^ ])|(?=[^ ]*[\p{{Ll}}\p{{Lt}}])[\p{{Lu}}\p{{Lt}}][^ \p{{Nd}}]*(?![^ ]))"
    return rf" (?=[\p{{Lu}}\p{{Lt}}])(?<=[^.!? ] )(?!(?i:[^{WORD} ]*(?:{common})[^{WORD} ]*(?![^ ]))){word}"


def filter_nouns(text: Column, strategy: str = "remove", spaced: bool = False) -> Column:
    """Without (or with masked) proper nouns; strategy none, remove or mask. A text of nothing else stays as it is.

    spaced: the text has single blanks alone, none at its ends. The first word of a sentence always stays. One regex runs over the whole text; only capitals are looked at closer.
    """
    if strategy not in ("none", "remove", "mask"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "none":
        return text
    plain = text if spaced else F.trim(F.regexp_replace(text, _BLANK, " "))
    out = F.regexp_replace(plain, _noun(), f" {MASK}" if strategy == "mask" else "")
    return F.get(F.transform(F.array(out), lambda o: F.when(o == "", text).otherwise(o)), F.lit(0))


def identify_nouns(text: Column) -> Column:
    """Runs of capitalised words that are not the first word of a sentence."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?:[\s\p{Z}]+[A-Z][a-z]+)*(?![\p{L}\p{N}_])"), F.lit(0))
    firsts = F.array_distinct(F.transform(sentences(text), lambda s: F.substring_index(F.regexp_replace(s, _BLANK, " "), " ", 1)))
    return F.get(F.transform(F.array(firsts), lambda f: F.filter(found, lambda m: ~F.array_contains(f, m))), F.lit(0))


def is_likely_name(text: Column) -> Column:
    """One to five capitalised words, none of them a function word."""
    words = _split(text)
    capital = F.forall(words, lambda w: w.rlike(r"^[\p{Lu}\p{Lt}]"))
    plain = F.exists(words, lambda w: F.array_contains(F.array(*map(F.lit, NAMELESS)), F.lower(w)))
    return F.size(words).between(1, 5) & capital & ~plain
