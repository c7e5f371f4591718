"""The whole default plan against a plain model of it: loops over the words and letters of one text at a time.

Only tables of values (word lists, script ranges, thresholds) are the library's; every step is told anew.
"""

import math
import unicodedata
from collections import Counter

import pytest
import regex

from lexispark.functions.nouns import COMMON
from lexispark.functions.stats import SCRIPT_LANGUAGES, SCRIPT_RANGES, SCRIPTS, UNAMBIGUOUS
from lexispark.operators.backends import LEXICON
from lexispark.plans.config import Config
from lexispark.plans.detect import detect
from lexispark.queries.votes import HINTS

TRUST = {"lexicon": 3, "ngram_nb": 4, "ngram_rank": 3, "script": 2}


def is_word(c):
    return unicodedata.category(c)[0] in "LN" or c == "_"


def is_letter(c):
    return unicodedata.category(c)[0] == "L"


def words_of(text):
    out, word = [], ""
    for c in text:
        if is_word(c):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] * bool(word)


def clean(text):
    one = lambda s: regex.sub(r"[ \t\n\x0b\f\r\x1c-\x1f\x85\p{Z}]+", " ", s)
    text = one(unicodedata.normalize("NFC", text or ""))
    for noise in (r"https?://[^ ]+", r"www\.[^ ]+", r"[\p{L}\p{N}_][\p{L}\p{N}_.-]*@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+", r"[@#][\p{L}\p{N}_]+"):
        text = regex.sub(noise, " ", text)
    return one(text).strip(" ")


def gate(text):
    letters = sum(map(is_letter, text))
    if not text:
        return "empty_text"
    if len(text) < 3 or letters < 2:
        return "too_little_text"
    return "non_linguistic" if letters / len(text) < 0.3 else None


def without_names(text):
    words, kept = text.split(), []
    for before, word in zip([None, *words], words, strict=False):
        plain = "".join(filter(is_word, word)).lower()
        cased = [unicodedata.category(c) for c in word]
        name = cased[0] in ("Lu", "Lt") and (len(word) == 1 or (any(c in ("Ll", "Lt") for c in cased) and "Nd" not in cased))
        first = before is None or before[-1] in ".!?"
        if first or not name or plain in COMMON:
            kept.append(word)
    return " ".join(kept) or text


def unicode_script(c):
    return next((s for s, names in SCRIPTS.items() if any(regex.match(rf"\p{{Script={n}}}", c) for n in names)), None)


def main_script(text):
    letters = [unicode_script(c) for c in text if is_letter(c)]
    counts = Counter(s for s in letters if s)
    return min(counts, key=lambda s: (-counts[s], letters.index(s))) if counts else None


def range_script(c):
    for script in SCRIPT_LANGUAGES:
        if script == "Latin":
            if regex.match(r"\p{Script=Latin}", c):
                return script
        elif any(a <= ord(c) <= b for a, b in SCRIPT_RANGES[script]):
            return script
    return None


def script_share(text):
    """(languages, share) of the text's script; none where it is Latin, mixed or unknown."""
    counts = Counter(filter(None, (range_script(c) for c in text if is_letter(c))))
    if not counts:
        return [], 0.0
    order = list(SCRIPT_LANGUAGES)
    top = min(counts, key=lambda s: (-counts[s], order.index(s)))
    share = counts[top] / sum(counts.values())
    if share < 0.7 and len(counts) > 1:
        return [], share
    return SCRIPT_LANGUAGES[top], share


def trigrams(text):
    plain = "".join(c if c.isalpha() else " " for c in text.lower())
    plain = " " + " ".join(plain.split()) + " "
    return [plain[i : i + 3] for i in range(len(plain) - 2)]


def learned():
    return {lang: Counter(f" {w} "[i : i + 3] for w in own.split() for i in range(len(w))) for lang, own in LEXICON.items()}


MODEL = learned()
KINDS = {g for own in MODEL.values() for g in own}
RANKS = {lang: {g: i for i, (g, _) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0])), 1)} for lang, own in MODEL.items()}


def best(shares):
    """(language, confidence), ties to the first alphabetically."""
    if not shares:
        return "unknown", 0.0
    top = min(shares, key=lambda x: (-shares[x], x))
    return top, shares[top]


def lexicon(text):
    tokens = words_of(text.lower())
    hits = {lang: sum(w in set(own.split()) for w in tokens) for lang, own in LEXICON.items()}
    total = sum(hits.values())
    return best({lang: n / total for lang, n in hits.items() if n})


def bayes(text):
    known = [g for g in trigrams(text) if g in KINDS]
    if not known:
        return "unknown", 0.0
    logs = {lang: sum(math.log((own[g] + 1) / (sum(own.values()) + len(KINDS))) for g in known) for lang, own in MODEL.items()}
    top = max(logs.values())
    odds = {lang: math.exp(x - top) for lang, x in logs.items()}
    return best({lang: x / sum(odds.values()) for lang, x in odds.items()})


def out_of_place(text):
    counts = Counter(trigrams(text))
    places = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], g))[:300], 1)}
    near = {}
    for lang, ranks in RANKS.items():
        shared = [g for g in places if ranks.get(g, 301) <= 300]
        if shared:
            near[lang] = sum(300 - min(abs(places[g] - ranks[g]), 300) for g in shared) / (len(places) * 300)
    return best(near)


def by_script(text):
    langs, share = script_share(text)
    return best({lang: share / len(langs) for lang in langs})


def plain_detect(text, hints=()):
    """(lang, confidence, reliable, script, reason, [(candidate, confidence, votes)])"""
    text = clean(text)
    reason = gate(text)
    if reason:
        return "und", 0.0, False, None, reason, []
    text = without_names(text)
    script = main_script(text)
    if script in UNAMBIGUOUS:
        return UNAMBIGUOUS[script], 0.99, True, script, None, []
    told = {"lexicon": lexicon(text), "ngram_nb": bayes(text), "ngram_rank": out_of_place(text), "script": by_script(text)}
    scores = Counter()
    for name, (lang, c) in told.items():
        scores[lang] += TRUST[name] ** 2 / sum(t**2 for t in TRUST.values()) * c
    del scores["unknown"]
    first = sorted(scores.values(), reverse=True)
    if len(first) > 1 and first[0] - first[1] < 0.01:
        admitted = script_share(text)[0]
        for lang in scores:
            own = [(n, c) for n, (x, c) in told.items() if x == lang]
            sure = sum(c > 0.5 for _, c in own)
            score = 0.3 * len(own) / len(told) + 0.25 * sum(c for _, c in own) / len(own) + 0.2 * sure / len(own) + 0.15 * max(TRUST[n] for n, _ in own) / 5
            scores[lang] = min(1.0, score + 0.05 * (lang in admitted))
    hinted = Counter(dict(hints)[w] for w in words_of(text) for w in [w.lower()] if w in dict(hints))
    for lang, n in hinted.items():
        scores[lang] += n / sum(hinted.values()) * 0.8 * 0.3
    if not scores:
        return "und", 0.0, False, script, "low_confidence", []
    top = max(scores.values())
    ranked = sorted(((min(s / top, 1.0) if top > 0 else s, lang) for lang, s in scores.items()), key=lambda x: (-x[0], x[1]))
    listed = [(lang[:2], c, {n: b for n, (x, b) in told.items() if x == lang}) for c, lang in ranked[:3]]
    c, lang = ranked[0]
    clash = len(ranked) > 1 and c - ranked[1][0] < 0.1 and c < 0.5
    reason = "disagreement" if clash else "low_confidence" if c < 0.5 else None
    return "und" if reason else lang[:2], c, reason is None, script, reason, listed


ODD = ["", None, "  ", "ok", "12345!!!", "a1b", "안녕하세요 여러분", "שלום לכולם וברוכים הבאים", "Привет, как дела сегодня", "это и to je mixed текст here", "これは日本語の文です", "你好，世界", "Ελληνικά γράμματα εδώ", "नमस्ते दुनिया कैसे हो", "مرحبا بالعالم كيف الحال"]
ODD += ["the and der die und le la est", "hola merci", "xyzzy qwrtp zzz", "Anna Berta Carl Dora", "NASA and ESA sent R2D2 to Mars. Paris is far. In Rome it was hot!", "see https://example.org/a?b=c and www.example.org or mail a.b@example.org @you #tag the end", "Café de la gare", "the " * 2000 + "und der " * 500, "I A É", "x y z the\u0085and", "é" * 400, "ﬁne ǅungla the of"]


@pytest.mark.parametrize("with_hints", [False, True])
def test_default_plan_is_the_plain_one(spark, sf_dir, with_hints):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    turns = [(10_000 + i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text").collect())]
    rows = docs + turns + [(100_000 + i, t) for i, t in enumerate(ODD)] + [(200_000 + i, " ".join(clean(t).split()[:3])) for i, (_, t) in enumerate(docs)]
    hints = HINTS if with_hints else []
    table = spark.createDataFrame(hints, "word string, lang string") if with_hints else None
    out = {r["id"]: r for r in detect(spark.createDataFrame(rows, "id long, text string"), Config(), hints=table, top_k=3).collect()}
    assert len(out) == len(rows)
    seen = Counter()
    for key, text in rows:
        lang, confidence, reliable, script, reason, listed = plain_detect(text, hints)
        got = out[key]
        assert (got["lang"], got["reliable"], got["script"], got["reason"]) == (lang, reliable, script, reason), (key, text and text[:80])
        assert got["confidence"] == pytest.approx(confidence, abs=1e-4)
        found = got["candidates"] or []
        assert [c["lang"] for c in found] == [c[0] for c in listed], (key, text and text[:80])
        for c, (_, share, votes) in zip(found, listed, strict=True):
            assert c["confidence"] == pytest.approx(share, abs=1e-4) and c["backend_votes"] == pytest.approx(votes, abs=1e-4)
        seen[reason or "named"] += 1
    assert seen["named"] > len(rows) / 2 and {"empty_text", "too_little_text", "low_confidence"} <= set(seen)
