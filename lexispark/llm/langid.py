"""Language identification by interpolated Kneser-Ney character models.

One model per language predicts each symbol (a lower-cased letter, or a border for any run of other characters) from
the three before it. The models' n-grams are held together, for each order, as one sorted array of 64-bit hashes with
the log-probabilities under every language beside it, so that one search serves all languages; contexts that are
missing back off through a second sorted array with the interpolation weights. A text goes to the language with the
lowest cross-entropy per symbol. Rejection is calibrated on texts kept out of the fit: a text is rejected when its
cross-entropy lies further above its language's mean, in units of what texts of its length vary by, than nearly all of
those.

Models are fitted on a bounded sample of labelled rows (``per_language`` rows of each language, drawn by a hash of
their ids); prediction reads whole texts.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; without any labelled text all
texts are ``und``; ties go to the language first in alphabetical order; repeated rows are predicted each; columns of
the input that clash with the added ones are replaced, all others are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .kernels import U, mix

ORDER = 4
#: Labelled rows of a language that are drawn for the fit, and of these the share kept for calibration.
PER_LANGUAGE, CALIBRATION = 1000, 0.25
#: Share of calibration texts that must be accepted, and the margin on the deviation found for it.
ACCEPT, MARGIN = 0.999, 1.5
#: Characters of texts that are taken together, and symbols (of one text or many) worked on at a time.
CHUNK, STEP = 1 << 19, 1 << 18
UNKNOWN = "und"
_BASE = 0x9E3779B97F4A7C15

_letters: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point of the BMP: itself if a letter, else 0."""
    if not _letters:
        _letters.append(np.array([c if chr(c).isalpha() else 0 for c in range(1 << 16)], np.uint32))
    return _letters[0]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each followed by a border, and offsets. Runs of other characters than letters are one border (0)."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    if (high := codes >= 1 << 16).any():
        found = np.unique(codes[high])
        kept = np.array([c if chr(c).isalpha() else 0 for c in found.tolist()], np.uint32)
        out = _fold()[np.where(high, 0, codes)]
        out[high] = kept[np.searchsorted(found, codes[high])]
    else:
        out = _fold()[codes]
    starts = np.concatenate([[0], ends[:-1]])
    before = np.empty(len(out), np.uint32)
    before[1:] = out[:-1]
    before[starts] = 0
    keep = (out != 0) | (before != 0)  # leading borders and all but the first of a run go
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[np.concatenate([starts, [len(out)]])]


def grams(sym: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """For each order 0 .. ORDER the hash of the n-gram that ends at each symbol; place is the symbol's in its text, before whose start stand borders."""
    n = len(sym)
    keys, power = [np.zeros(n, U)], 1
    for j in range(ORDER):
        shifted = np.zeros(n, U)
        shifted[j:] = sym[: n - j] if j else sym
        if j:
            shifted[place < j] = 0
        keys.append(keys[-1] + (shifted + U(1)) * U(power))
        power = power * _BASE % (1 << 64)
    return [mix(k + U(i)) for i, k in enumerate(keys)]


def contexts(keys: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """The hash of the ``order`` symbols before each symbol."""
    out = np.empty(len(keys), U)
    out[1:] = keys[:-1]
    start = np.uint64(sum(pow(_BASE, j, 1 << 64) for j in range(order)) % (1 << 64))
    out[place == 0] = mix(np.array([start], U) + U(order))[0]
    return out


def slices(sym: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(start, end, back, symbols, places) of at most STEP symbols each, with the ``back`` symbols before them that they depend on."""
    for start in range(0, len(sym), STEP):
        end, first = min(start + STEP, len(sym)), max(0, start - ORDER)
        index = np.arange(first, end)
        yield start, end, start - first, sym[first:end], index - offsets[np.searchsorted(offsets, index, "right") - 1]


class Hashes:
    """A sorted array of hashes with an index on their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift = U(64 - bits)
        self.starts = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=U)).astype(np.int32)
        self.deepest = int(np.diff(self.starts).max()) if len(keys) else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 where missing."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        at = self.starts[wanted >> self.shift]
        out = np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == wanted, at, -1)
        left = np.flatnonzero(out < 0)
        for step in range(1, self.deepest):
            if not len(left):
                break
            at_left = at[left] + step
            inside = at_left < self.starts[(wanted[left] >> self.shift).astype(np.int64) + 1]
            left, at_left = left[inside], at_left[inside]
            hit = self.keys[at_left] == wanted[left]
            out[left[hit]] = at_left[hit]
            left = left[~hit]
        return out


def _counted(sym: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The different n-grams of ORDER: key, count, suffix0 .. (hash of the last n symbols), ctx1 .. (of the n - 1 before the last)."""
    parts: list[dict[str, np.ndarray]] = []
    for _, _, back, own, place in slices(sym, offsets):
        keys = grams(own, place)
        found, at, counts = np.unique(keys[ORDER][back:], return_index=True, return_counts=True)
        part = {"key": found, "count": counts}
        for n in range(ORDER):
            part[f"suffix{n}"] = keys[n][back:][at]
            part[f"ctx{n + 1}"] = contexts(keys[n], place, n)[back:][at]
        parts.append(part)
    whole = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}
    if not whole:
        return {"key": np.zeros(0, U), "count": np.zeros(0, np.int64)} | {f"{k}{n}": np.zeros(0, U) for n in range(ORDER + 1) for k in ("suffix", "ctx")}
    found, at, inverse = np.unique(whole["key"], return_index=True, return_inverse=True)
    counts = np.bincount(inverse, whole["count"]).astype(np.int64)
    return {k: v[at] for k, v in whole.items()} | {"key": found, "count": counts}


def _kneser_ney(sym: np.ndarray, offsets: np.ndarray) -> list[dict]:
    """For each order: keys, count-based part, and for each context its weight; for one language."""
    grams_ = _counted(sym, offsets)
    found, counts, at = grams_["key"], grams_["count"], np.arange(len(grams_["key"]))
    orders: list[dict] = [{} for _ in range(ORDER + 1)]
    for n in range(ORDER, 0, -1):
        ctx, suffix = grams_[f"ctx{n}"][at], grams_[f"suffix{n - 1}"][at]
        once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
        discount = once / (once + 2 * twice) if once and twice else 0.5
        names, inverse, kinds = np.unique(ctx, return_inverse=True, return_counts=True)
        totals = np.bincount(inverse, counts)
        orders[n] = {"keys": found, "ctx": ctx, "suffix": suffix, "part": np.maximum(counts - discount, 0) / totals[inverse], "names": names, "weight": discount * kinds / totals}
        # A lower order counts the different symbols that its n-grams were seen after.
        found, first, counts = np.unique(suffix, return_index=True, return_counts=True)
        at = at[first]
    return orders


class Model:
    """Tables of all languages; ``scores`` gives cross-entropies."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        fitted = [_kneser_ney(*symbols(texts[lang])) for lang in self.langs]
        self.tables: list[tuple[Hashes, np.ndarray]] = []
        self.weights: list[tuple[Hashes, np.ndarray]] = []
        lower, lower_keys = None, None
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([o[n]["keys"] for o in fitted]))
            names = np.unique(np.concatenate([o[n]["names"] for o in fitted]))
            probs, weights = np.zeros((len(keys), len(fitted))), np.ones((len(names), len(fitted)))
            ctx, suffix = np.empty(len(keys), U), np.empty(len(keys), U)
            for o in fitted:
                place = np.searchsorted(keys, o[n]["keys"])
                ctx[place], suffix[place] = o[n]["ctx"], o[n]["suffix"]
            for i, o in enumerate(fitted):
                weights[np.searchsorted(names, o[n]["names"]), i] = o[n]["weight"]
                probs[np.searchsorted(keys, o[n]["keys"]), i] = o[n]["part"]
            base = np.full(probs.shape, 1.0 / (len(keys) + 1)) if n == 1 else lower[np.searchsorted(lower_keys, suffix)]
            if n == 1:
                self.unseen = np.log(weights[0] / (len(keys) + 1)).astype(np.float32)
            probs += weights[np.searchsorted(names, ctx)] * base
            lower, lower_keys = probs, keys
            self.tables.append((Hashes(keys), np.log(probs).astype(np.float32)))
            self.weights.append((Hashes(names), np.log(weights).astype(np.float32)))
        self.mean = self.spread = np.zeros(0)
        self.limit = np.inf

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) nats per symbol, the symbols of each text, and whether it has a letter."""
        sym, offsets = symbols(texts)
        sizes = np.diff(offsets)
        total = np.zeros((len(texts), len(self.langs)))
        for start, end, back, own, place in slices(sym, offsets):
            logs = self._logs(own, place)[back:]
            first, last = np.searchsorted(offsets, [start, end - 1], "right") - 1  # the texts that the slice is of
            full = first + np.flatnonzero(sizes[first : last + 1])
            total[full] += np.add.reduceat(logs, np.maximum(offsets[full] - start, 0), axis=0, dtype=np.float64)
        letters = np.add.reduceat(np.append(sym != 0, False).astype(np.int64), np.minimum(offsets[:-1], len(sym))) if len(texts) else sizes
        letters[sizes == 0] = 0
        return -total / np.maximum(sizes, 1)[:, None], sizes, letters > 0

    def _logs(self, sym: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(symbols, languages) log-probabilities, longest known n-grams first, by weights of missing contexts beyond."""
        keys = grams(sym, place)
        logs = np.zeros((len(sym), len(self.langs)), np.float32)
        todo = np.arange(len(sym))
        for n in range(ORDER, 0, -1):
            table, values = self.tables[n - 1]
            at = table.find(keys[n][todo])
            hit = at >= 0
            logs[todo[hit]] += values[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if n > 1:
                names, weights = self.weights[n - 1]
                at = names.find(contexts(keys[n - 1], place, n - 1)[todo])
                known = at >= 0
                logs[todo[known]] += weights[at[known]]
            else:
                logs[todo] += self.unseen
        return logs

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        """Mean and spreads of each language's cross-entropy, and the deviation that ACCEPT of the texts keep below.

        Texts vary between each other whatever their length, and short ones besides by chance, as 1 / sqrt(length).
        """
        means, spreads, deviations = [], [], []
        for i, lang in enumerate(self.langs):
            ce, sizes, good = self.scores(texts.get(lang, []))
            ce, sizes = ce[good, i], sizes[good]
            if not len(ce):
                means.append(np.nan), spreads.append((np.nan, np.nan))
                continue
            mean = float(np.average(ce, weights=np.minimum(sizes, 1000)))
            long = np.abs(ce - mean)[sizes >= np.median(sizes)]
            short = (np.abs(ce - mean) * np.sqrt(sizes))[sizes <= np.median(sizes)]
            means.append(mean), spreads.append((max(1e-3, 1.4826 * float(np.median(long))), 1.4826 * float(np.median(short))))
            deviations.append((ce - mean) / np.hypot(spreads[-1][0], spreads[-1][1] / np.sqrt(sizes)))
        self.mean, self.spread = np.array(means), np.array(spreads).reshape(-1, 2)
        if deviations and len(all_of := np.concatenate(deviations)) >= 20:
            self.limit = max(6.0, float(np.quantile(all_of, ACCEPT)) * MARGIN)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        ce, sizes, good = self.scores(texts)
        best = ce.argmin(axis=1)
        least = ce[np.arange(len(ce)), best]
        score = 1 / np.exp(-(ce - least[:, None]) * np.minimum(sizes, 64)[:, None]).sum(axis=1)
        if not len(self.mean):  # not calibrated: only texts without letters are rejected
            return [self.langs[b] if g else UNKNOWN for b, g in zip(best.tolist(), good.tolist(), strict=True)], np.where(good, score, 0.0), np.where(good, least, np.nan), ~good
        away = (least - self.mean[best]) / np.hypot(self.spread[best, 0], self.spread[best, 1] / np.sqrt(np.maximum(sizes, 1)))
        rejected = ~good | (np.nan_to_num(away, nan=0.0) > self.limit)
        return [self.langs[b] if g else UNKNOWN for b, g in zip(best.tolist(), good.tolist(), strict=True)], np.where(good, score, 0.0), np.where(good, least, np.nan), rejected


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Fits on at most ``per_language`` rows of each language among those that are ``usable``."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.filter(usable) if usable is not None else rows
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 40))
    # A share of each language that gives a tenth more than is wanted; the surplus goes by the same hash.
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (draw < int(min(1.0, (1.1 * per_language + 50) / n) * (1 << 40)) + 1))
    drawn: dict[str, list] = {}
    for r in rows.filter(wanted).select("lang", "text", draw.alias("draw")).toLocalIterator():
        drawn.setdefault(r["lang"], []).append((r["draw"], r["text"] or ""))
    parts = {lang: [t for _, t in sorted(own)[:per_language]] for lang, own in drawn.items()}
    parts = {lang: own for lang, own in parts.items() if any(c.isalpha() for t in own for c in t)}
    cut = {lang: min(len(own) - 1, round(len(own) * (1 - CALIBRATION))) or 1 for lang, own in parts.items()}
    model = Model({lang: own[: cut[lang]] for lang, own in parts.items()}) if parts else _empty()
    if parts:
        model.calibrate({lang: own[cut[lang] :] or own for lang, own in parts.items()})
    return model


def _empty() -> Model:
    model = Model.__new__(Model)
    model.langs = []
    return model


ADDED = {"lang_pred": T.StringType(), "score": T.DoubleType(), "cross_entropy": T.DoubleType(), "rejected": T.BooleanType()}


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and lang_pred, score, cross_entropy, rejected."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, t) for c, t in ADDED.items())])
    at = -1 if text_col not in keep else keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at if at >= 0 else batch.num_columns - 1)
            start = 0
            while start < batch.num_rows:
                own, size = [], 0
                while start + len(own) < batch.num_rows and (not own or size < CHUNK):
                    own.append(texts[start + len(own)].as_py())
                    size += len(own[-1] or "")
                lang, score, ce, rejected = held.value.predict(own)
                columns = [batch.column(i).slice(start, len(own)) for i in range(len(keep))]
                added = [pa.array(lang, pa.string()), pa.array(score), pa.array(ce, from_pandas=True), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays([*columns, *added], names=[*keep, *ADDED])
                start += len(own)

    columns = [F.col(c) for c in keep] + ([] if at >= 0 else [F.col(text_col).cast("string").alias("_text")])
    return docs.select(*columns).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the models don't reject, with the columns as they are, whatever their names."""
    apart = {c: fresh(f"_own_{c}", docs) for c in docs.columns if c.lower() in ADDED}
    text = apart.get(text_col, text_col)
    rows = identify(docs.withColumnsRenamed(apart), model, text).filter("not rejected")
    return rows.select(*(F.col(apart.get(c, c)).alias(c) for c in docs.columns))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of the fit: crc32 of its id as text is 2 modulo 4 (a row without an id is not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
