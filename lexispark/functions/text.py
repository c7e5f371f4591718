"""Normalisation of text and language tags, as Column expressions.

The classes are written out, since ``\\w``, ``\\s`` and ``\\b`` mean different things to different regex engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: What a run of white space is that is not a single blank already.
UNEVEN = rf"{SPACE[:-2]}&&[^ ]]{SPACE[:-1]}*| {SPACE}"
#: White space but the blank; most characters are told by the first test alone.
ODD = rf"[[^ -~]&&{SPACE[:-1]}]+"
#: The steps of noise removal, in order; white space is single blanks by then.
NOISE = [r"https?://[^ ]+", r"www\.[^ ]+", rf"[{WORD}][{WORD}.-]*@[{WORD}.-]+\.[{WORD}]+", rf"[@#][{WORD}]+"]


def nfc(text: Column) -> Column:
    """Canonical composition, by the Unicode library that comes with Spark. Texts of code points below U+0300 alone are composed already."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    beyond = (F.char_length(text) < F.octet_length(text)) & text.rlike("[^\\x{0}-\\x{2FF}]")
    return F.when(beyond, composed).otherwise(text)


def collapse_spaces(text: Column) -> Column:
    """Runs of white space as one blank. Only texts with blanks side by side, once other white space is blanks, are gone through for them."""
    even = lambda t: F.when(t.contains("  "), F.regexp_replace(t, UNEVEN, " ")).otherwise(t)
    return F.get(F.transform(F.array(F.regexp_replace(text, ODD, " ")), even), F.lit(0))


def strip_urls(text: Column) -> Column:
    some = text.contains("http") | text.contains("www.")
    return F.when(some, F.regexp_replace(F.regexp_replace(text, NOISE[0], " "), NOISE[1], " ")).otherwise(text)


def strip_emails(text: Column) -> Column:
    return F.when(text.contains("@"), F.regexp_replace(text, NOISE[2], " ")).otherwise(text)


def strip_mentions(text: Column) -> Column:
    """@mentions and #hashtags, with their words."""
    return F.regexp_replace(text, NOISE[3], " ")


def normalize_text(text: Column, strip_noise: bool = True, compose: bool = True) -> Column:
    """Composed (NFC), spaces collapsed, noise removed, trimmed; null becomes empty."""
    out = collapse_spaces(nfc(text) if compose else text)
    if strip_noise:
        noisy = lambda t: t.contains("http") | t.contains("www.") | t.contains("@") | t.contains("#")
        cleaned = lambda t: F.when(noisy(t), collapse_spaces(strip_mentions(F.get(F.transform(F.array(strip_urls(t)), strip_emails), F.lit(0))))).otherwise(t)
        out = F.get(F.transform(F.array(out), cleaned), F.lit(0))  # of a text that is made once
    return F.coalesce(F.trim(out), F.lit(""))


# Language tags that are renamed, from -> to.
TAGS = {"zh-cn": "zh-Hans", "zh-tw": "zh-Hant", "zho": "zh", "cmn": "zh", "yue": "zh-Yue", "por": "pt", "spa": "es", "fra": "fr", "deu": "de", "eng": "en", "rus": "ru", "jpn": "ja", "kor": "ko", "ara": "ar", "hin": "hi", "unknown": "und", "": "und"}


def normalize_tag(tag: Column) -> Column:
    """Renamed tags, Chinese by script or region, else the first two letters; shorter is ``und``."""
    plain = F.lower(F.trim(F.coalesce(tag, F.lit(""))))
    out = F.when(plain == F.lit(next(iter(TAGS))), TAGS[next(iter(TAGS))])
    for old, new in list(TAGS.items())[1:]:
        out = out.when(plain == old, new)
    out = out.when(plain.startswith("zh") & plain.rlike("hans|cn|simplified"), "zh-Hans")
    out = out.when(plain.startswith("zh") & plain.rlike("hant|tw|traditional"), "zh-Hant")
    return out.when(plain.startswith("zh"), "zh").when(F.char_length(plain) >= 2, F.substring(plain, 1, 2)).otherwise("und")


# ISO 639-3 codes whose two-letter code isn't their first two letters, with that code.
ISO3 = {
    "aao": "ar", "acm": "ar", "acw": "ar", "acx": "ar", "aeb": "ar", "ajp": "ar", "apc": "ar", "apd": "ar", "arg": "an", "ayl": "ar", "ben": "bn",
    "bos": "bs", "bul": "bg", "bxr": "mn", "cdo": "zh", "ces": "cs", "chv": "cv", "cjy": "zh", "ckb": "ku", "cmn": "zh", "cor": "kw", "cpx": "zh",
    "csp": "zh", "czh": "zh", "div": "dv", "est": "et", "fao": "fo", "fry": "fy", "gan": "zh", "gla": "gd", "gle": "ga", "glk": "fa", "glv": "gv",
    "hak": "zh", "hat": "ht", "hsn": "zh", "ibo": "ig", "iku": "iu", "ind": "id", "jav": "jv", "jpn": "ja", "kan": "kn", "kaz": "kk", "khk": "mn",
    "khm": "km", "kin": "rw", "kmr": "ku", "kon": "kg", "kpv": "kv", "lao": "lo", "lav": "lv", "lin": "ln", "lit": "lt", "ltc": "zh", "ltz": "lb",
    "lug": "lg", "lzh": "zh", "lzz": "ka", "mal": "ml", "mar": "mr", "mlt": "mt", "mnp": "zh", "mon": "mn", "mvf": "mn", "nan": "zh", "nav": "nv",
    "och": "zh", "orm": "om", "pes": "fa", "pnb": "pa", "pol": "pl", "por": "pt", "prs": "fa", "pus": "ps", "roh": "rm", "rue": "uk", "run": "rn",
    "sdh": "ku", "slk": "sk", "sme": "se", "sot": "st", "spa": "es", "srd": "sc", "swe": "sv", "tat": "tt", "tgl": "tl", "tsn": "tn", "tuk": "tk",
    "tur": "tr", "uig": "ug", "wln": "wa", "wuu": "zh", "xmf": "ka", "yue": "zh", "zlm": "ms", "zsm": "ms",
}
# ISO 639-3 codes that are kept, since there is no two-letter code.
ISO3_KEPT = [
    "ace", "ale", "als", "ang", "ast", "ban", "bar", "bcl", "bjn", "bug", "cbk", "ceb", "cho", "chp", "chr", "cjs", "ckt", "crh", "dgr", "dlm", "dsb",
    "eml", "ems", "enm", "ess", "esu", "eve", "evn", "ext", "frm", "fro", "frp", "frr", "fur", "gag", "gcf", "gmh", "goh", "gor", "gsw", "gwi", "hil",
    "hsb", "hup", "ilo", "itl", "izh", "kca", "ket", "kjh", "koi", "krc", "krl", "ksh", "kum", "lad", "liv", "lld", "lmo", "mak", "mdf", "mhr", "min",
    "mns", "moh", "mrj", "mus", "mwl", "myv", "mzn", "nap", "nds", "neg", "nio", "nog", "non", "nrf", "nso", "oaa", "olo", "osx", "pag", "pap", "pcd",
    "pfl", "pms", "rgn", "rup", "sah", "sas", "scn", "sco", "sel", "sgs", "sma", "smj", "smn", "sms", "stq", "szl", "tyv", "udm", "ulc", "vec", "vep",
    "vot", "vro", "war", "wym", "xal", "yrk",
]


def label_code(label: Column, mapping: dict[str, str] | None = None) -> Column:
    """The code of an ISO 639-3 label or a variant's label: by the tables above (and ``mapping``), else the first two letters, lower-cased."""
    known = ISO3 | {c: c for c in ISO3_KEPT} | (mapping or {})
    table = F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair))
    return F.coalesce(F.try_element_at(table, label), F.lower(F.substring(label, 1, 2)))


def label_codes(labels, mapping: dict[str, str] | None = None, label_col: str = "label"):
    """``labels`` with ``lang``, their codes."""
    return labels.withColumn("lang", label_code(F.col(label_col), mapping))


def truncated(text: Column, most: int, mark: str = "") -> Column:
    """The first ``most`` characters, with a mark if there are more."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)
