"""Text statistics, gates and scripts as Column expressions."""

from __future__ import annotations

from functools import reduce
from string import ascii_letters

from pyspark.sql import Column
from pyspark.sql import functions as F

# Minima and thresholds by mode.
MIN_CHARS = {"short": 2, "default": 3, "long": 3}
MIN_LETTERS = {"short": 1, "default": 2, "long": 2}
THRESHOLDS = {"short": 0.3, "default": 0.5, "long": 0.6}
MIN_RATIO, ASCII_SHARE = 0.3, 0.8
EMPTY, TOO_LITTLE, NON_LINGUISTIC = "empty_text", "too_little_text", "non_linguistic"
LOW_CONFIDENCE, DISAGREEMENT, NO_BACKEND = "low_confidence", "disagreement", "no_backend"

#: Unicode's scripts by the names used here.
SCRIPTS = {"Latin": ["Latin"], "Cyrillic": ["Cyrillic"], "Arabic": ["Arabic"], "Hebrew": ["Hebrew"], "Greek": ["Greek"], "Devanagari": ["Devanagari"], "Hangul": ["Hangul"], "Thai": ["Thai"], "CJK": ["Han", "Hiragana", "Katakana"], "Armenian": ["Armenian"], "Georgian": ["Georgian"], "Tamil": ["Tamil"], "Telugu": ["Telugu"], "Kannada": ["Kannada"], "Malayalam": ["Malayalam"], "Gujarati": ["Gujarati"], "Bengali": ["Bengali"], "Punjabi": ["Gurmukhi"], "Oriya": ["Oriya"], "Sinhala": ["Sinhala"], "Khmer": ["Khmer"], "Lao": ["Lao"], "Myanmar": ["Myanmar"], "Tibetan": ["Tibetan"], "Ethiopic": ["Ethiopic"]}
# The language of scripts that only one is written in, as documented.
UNAMBIGUOUS = {"Hangul": "ko", "Thai": "th", "Hebrew": "he", "Armenian": "hy", "Georgian": "ka", "Tamil": "ta", "Telugu": "te", "Kannada": "kn", "Malayalam": "ml", "Gujarati": "gu", "Bengali": "bn", "Punjabi": "pa", "Oriya": "or", "Sinhala": "si", "Khmer": "km", "Lao": "lo", "Myanmar": "my", "Tibetan": "bo"}
#: The three of them that fire when script names are taken strictly as produced.
STRICT = ("Hangul", "Thai", "Hebrew")


def java_class(names: list[str]) -> str:
    return "[" + "".join(rf"\p{{Is{n}}}" for n in names) + "]"


def n_chars(text: Column) -> Column:
    return F.char_length(text)


def _rest(text: Column, of: str) -> Column:
    """``text`` without runs of a class: what is left is counted faster than single matches are."""
    return F.regexp_replace(text, of + "+", "")


def letters_of(text: Column) -> Column:
    """struct<n, others>: the number of letters, and those that are not Latin.

    Runs of plain letters and blanks, most of a text, go first and at once; classes of Unicode are asked about the rest alone.
    """

    def told(rest: Column) -> Column:
        plain = F.char_length(F.replace(text, F.lit(" "), F.lit(""))) - F.char_length(F.replace(rest, F.lit(" "), F.lit("")))
        return _let(_rest(rest, r"\P{L}"), lambda own: F.struct((plain + F.char_length(own)).alias("n"), _rest(own, r"\p{IsLatin}").alias("others")))

    return _let(_rest(text, f"[{ascii_letters} ]"), told)


def n_letters(text: Column) -> Column:
    return letters_of(text)["n"]


def letter_ratio(text: Column) -> Column:
    return _ratio(n_letters(text), F.char_length(text))


def _ratio(letters: Column, chars: Column) -> Column:
    return F.when(chars > 0, letters / chars).otherwise(F.lit(0.0))


def unique_letters(text: Column) -> Column:
    return _let(_rest(text, r"\P{L}"), _unique)


def _unique(letters: Column) -> Column:
    """Different letters: the plain ones are looked up one by one (most of them stand near the start), only others are taken apart."""
    plain = reduce(lambda a, b: a + b, [F.contains(letters, F.lit(c)).cast("int") for c in ascii_letters])
    others = _let(_rest(letters, "[A-Za-z]"), lambda rest: F.when(rest == "", 0).otherwise(F.size(F.array_distinct(F.split(rest, "")))))
    return plain + others


def is_mostly_ascii(text: Column) -> Column:
    """Whether more than the share is ASCII; a text of as many bytes as characters is all ASCII."""
    counted = F.char_length(_rest(text, r"[^\x00-\x7F]")) / F.char_length(text) > ASCII_SHARE
    return F.when(F.char_length(text) == F.octet_length(text), True).when(F.char_length(text) > 0, counted).otherwise(True)


def has_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿぀-ゟ゠-ヿ가-힯]")


def dominant_script(text: Column) -> Column:
    """The script of most letters, ties to the one seen first; null without letters. A Latin majority settles it at once."""
    return _let(letters_of(text), lambda letters: dominant_of(text, letters))


def dominant_of(text: Column, letters: Column) -> Column:
    """The same with the text's ``letters_of``."""
    latin = 2 * F.char_length(letters["others"]) < letters["n"]
    return F.when(letters["n"] == 0, None).when(latin, "Latin").otherwise(_let(_rest(text, r"\P{L}"), _most_seen))


def _most_seen(letters: Column) -> Column:
    counted = [
        F.struct(
            F.regexp_count(letters, F.lit(java_class(names))).alias("n"),
            (-F.char_length(F.regexp_extract(letters, rf"(?s)^(.*?){java_class(names)}", 1))).alias("first"),
            F.lit(script).alias("script"),
        )
        for script, names in SCRIPTS.items()
    ]
    return _let(F.array_max(F.array(*counted)), lambda b: F.when(b["n"] > 0, b["script"]))


def text_stats(text: Column) -> Column:
    """All statistics out of the text and its letters, which are made once."""

    def counted(letters: Column) -> Column:
        n, chars = F.char_length(letters), F.char_length(text)
        return F.struct(chars.alias("n_chars"), n.alias("n_letters"), _ratio(n, chars).alias("letter_ratio"), _unique(letters).alias("unique_letters"), dominant_script(letters).alias("script"), is_mostly_ascii(text).alias("is_mostly_ascii"), has_cjk(text).alias("has_cjk"))

    return _let(_rest(text, r"\P{L}"), counted)


def _by_mode(values: dict, mode: Column | str) -> Column:
    if isinstance(mode, str):
        return F.lit(values[mode])
    return F.when(mode == "short", values["short"]).when(mode == "long", values["long"]).otherwise(values["default"])


def threshold(mode: Column | str) -> Column:
    return _by_mode(THRESHOLDS, mode)


def gate(text: Column, mode: Column | str = "default", letters: Column | None = None) -> Column:
    """Why a normalised text is not looked at further, or null. letters: the text's ``letters_of``, where it is known."""

    def judged(letters: Column) -> Column:
        short = (F.char_length(text) < _by_mode(MIN_CHARS, mode)) | (letters < _by_mode(MIN_LETTERS, mode))
        bare = (letters == 0) | (letters / F.char_length(text) < MIN_RATIO)
        return F.when(F.trim(text) == "", EMPTY).when(short, TOO_LITTLE).when(bare, NON_LINGUISTIC)

    return _let(n_letters(text) if letters is None else letters["n"], judged)


# Languages by script, and the scripts' code point ranges, for the finer script filter.
SCRIPT_LANGUAGES = {
    "Cyrillic": ["ru", "uk", "bg", "sr", "mk", "be", "kk", "ky", "mn", "tg", "uz"],
    "Arabic": ["ar", "fa", "ur", "ps", "sd", "ug", "ku"],
    "Hebrew": ["he", "yi"],
    "Greek": ["el"],
    "Devanagari": ["hi", "mr", "ne", "sa"],
    "Bengali": ["bn", "as"],
    "Tamil": ["ta"],
    "Telugu": ["te"],
    "Thai": ["th"],
    "Georgian": ["ka"],
    "Armenian": ["hy"],
    "Ethiopic": ["am", "ti"],
    "Hangul": ["ko"],
    "Hiragana": ["ja"],
    "Katakana": ["ja"],
    "Han": ["zh", "ja"],
    "Latin": [],
}
SCRIPT_RANGES = {
    "Cyrillic": [(0x0400, 0x04FF), (0x0500, 0x052F)],
    "Arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF)],
    "Hebrew": [(0x0590, 0x05FF)],
    "Greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "Devanagari": [(0x0900, 0x097F)],
    "Bengali": [(0x0980, 0x09FF)],
    "Tamil": [(0x0B80, 0x0BFF)],
    "Telugu": [(0x0C00, 0x0C7F)],
    "Thai": [(0x0E00, 0x0E7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Armenian": [(0x0530, 0x058F)],
    "Ethiopic": [(0x1200, 0x137F)],
    "Hangul": [(0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3130, 0x318F)],
    "Hiragana": [(0x3040, 0x309F)],
    "Katakana": [(0x30A0, 0x30FF), (0x31F0, 0x31FF)],
    "Han": [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF)],
}
DOMINANT, HINT_SHARE = 0.7, 0.2


def range_class(script: str) -> str:
    """A regex class of the script's ranges (for Java and RE2)."""
    if script == "Latin":
        return r"[a-zA-Z\p{IsLatin}]"
    return "[" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in SCRIPT_RANGES[script]) + "]"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def script_counts(text: Column) -> Column:
    """array<struct<n, script>> of the letters of each script, in a fixed order. Latin letters are taken out first, so that the other scripts' classes run over what is left."""
    return _let(letters_of(text), _counts)


def _counts(letters: Column) -> Column:
    latin = letters["n"] - F.char_length(letters["others"])
    return F.array(*(F.struct((latin if s == "Latin" else F.regexp_count(letters["others"], F.lit(range_class(s)))).alias("n"), F.lit(s).alias("script")) for s in SCRIPT_LANGUAGES))


def _count(counts: Column, script: str) -> Column:
    return F.get(counts, F.lit(list(SCRIPT_LANGUAGES).index(script)))["n"]


def detect_script(text: Column) -> Column:
    """struct<script, proportion>: Unknown without letters of a known script, Mixed if several and none has the share."""
    return _written(script_counts(text))


def written_of(letters: Column) -> Column:
    """The same of a text's ``letters_of``."""
    return _written(_counts(letters))


def _written(counts: Column) -> Column:
    def judged(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0), lambda a, x: a + x["n"])
        top = F.array_max(F.transform(counts, lambda x: x["n"]))
        kinds = F.size(F.filter(counts, lambda x: x["n"] > 0))
        name = F.get(F.filter(counts, lambda x: x["n"] == top), F.lit(0))["script"]
        script = F.when(total == 0, "Unknown").when((top / total < DOMINANT) & (kinds > 1), "Mixed").otherwise(name)
        return F.struct(script.alias("script"), F.when(total == 0, 0.0).otherwise(top / total).alias("proportion"))

    return _let(counts, judged)


def script_languages(script: Column) -> Column:
    out = F.when(script == "Latin", F.array().cast("array<string>"))
    for s, langs in SCRIPT_LANGUAGES.items():
        if langs:
            out = out.when(script == s, F.array(*map(F.lit, langs)))
    return out


def filter_languages(text: Column, candidates: Column | None = None) -> Column:
    """Languages of the text's script, of the candidates if some are; candidates (or null) where the script decides nothing."""
    return languages_of(detect_script(text), candidates)


def languages_of(found: Column, candidates: Column | None = None) -> Column:
    """The same of a script that ``detect_script`` found."""
    none = F.array().cast("array<string>")
    if candidates is None:
        return _let(script_languages(found["script"]), lambda langs: F.when(F.size(F.coalesce(langs, none)) > 0, langs))
    both = _let(script_languages(found["script"]), lambda langs: F.array_intersect(F.coalesce(langs, none), candidates))
    return _let(both, lambda b: F.when(F.size(b) == 0, candidates).otherwise(b))


def script_hints(text: Column, min_proportion: float = 0.5) -> Column:
    """map<lang, boost> of the languages of a dominant script, or null."""

    def hinted(found: Column) -> Column:
        langs = script_languages(found["script"])
        usable = (F.size(langs) > 0) & (found["proportion"] >= min_proportion)
        return F.when(usable, F.map_from_arrays(langs, F.transform(langs, lambda _: F.lit(HINT_SHARE) * found["proportion"])))

    return _let(detect_script(text), hinted)


def is_japanese(text: Column) -> Column:
    return _let(script_counts(text), lambda c: (_count(c, "Hiragana") + _count(c, "Katakana") > 0) | ((_count(c, "Han") > 0) & (_count(c, "Hangul") == 0)))


def is_korean(text: Column) -> Column:
    found = detect_script(text)
    return (found["script"] == "Hangul") & (found["proportion"] > 0.3)


def is_chinese(text: Column) -> Column:
    return _let(script_counts(text), lambda c: (_count(c, "Han") > 0) & (_count(c, "Hiragana") + _count(c, "Katakana") == 0) & (_count(c, "Hangul") == 0))


def short_circuit(script: Column, allowed: list[str] | None = None, strict: bool = False) -> Column:
    """The language that the script alone decides, if it may be named, or null."""
    out = F.lit(None).cast("string")
    for name, lang in UNAMBIGUOUS.items():
        if (allowed is None or lang in allowed) and (not strict or name in STRICT):
            out = F.when(script == name, lang).otherwise(out)
    return out
