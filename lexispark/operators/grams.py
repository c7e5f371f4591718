"""Letter n-grams of texts in Arrow batches: counting for training, naive Bayes and rank-order scores (numpy only).

A text is lower-cased, runs of other characters than letters are one blank, and a blank stands at either end. Its n-grams are
packed in 64-bit integers that sort as the n-grams do. Texts are worked on in runs of bounded size, or one by one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

N, SHIFT = 3, 21
#: Characters of texts that are worked on together.
CHUNK = 1 << 18

_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(1 << 16)]))
    if not len(codes) or codes.max() < 1 << 16:
        return _letters[0][codes]
    found, inverse = np.unique(codes, return_inverse=True)
    return np.array([chr(c).isalpha() for c in found.tolist()])[inverse]


def runs(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about CHUNK characters."""
    own, size, start = [], 0, 0
    for row in range(len(texts)):
        own.append(texts[row].as_py() or "")
        size += len(own[-1])
        if size >= CHUNK:
            yield start, own
            own, size, start = [], 0, row + 1
    if own:
        yield start, own


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-grams of all texts, the text each is of)."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(f"\n{t}\n" for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0, *(len(t) + 2 for t in lowered)])
    sym = np.where(_is_letter(codes), codes, 0).astype(np.uint64)
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    keep[starts[:-1]] = True
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))[keep]
    sym = np.where(sym == 0, np.uint64(32), sym)[keep]
    n = len(sym) - N + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = np.zeros(n, np.uint64)
    for j in range(N):
        packed = (packed << np.uint64(SHIFT)) | sym[j : n + j]
    inside = owner[:n] == owner[N - 1 :]
    return packed[inside], owner[:n][inside]


def unpacked(key: int) -> str:
    return "".join(chr(int(key) >> (SHIFT * j) & ((1 << SHIFT) - 1)) for j in reversed(range(N)))


def packed(gram: str) -> int:
    out = 0
    for c in gram:
        out = out << SHIFT | ord(c)
    return out


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, text) to (language, gram, n), summed for each run of texts."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for row, texts in runs(batch.column(1)):
            keys, owner = grams(texts)
            names, of = np.unique(np.array([langs[row + i] or "" for i in range(len(texts))], dtype=object).astype(str), return_inverse=True)
            for i, name in enumerate(names.tolist()):
                found, n = np.unique(keys[of[owner] == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([unpacked(k) for k in found.tolist()], pa.string()), pa.array(n, pa.int64())], names=["language", "gram", "n"])


class Kinds:
    """The different n-grams of each text, sorted, with their number: ``keys``, ``n`` and the text each is of (``owner``)."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, owner: np.ndarray):
        self.keys, self.n, self.owner = keys, n, owner
        self._found: tuple[Model, np.ndarray] | None = None

    def places(self, model: Model) -> np.ndarray:
        """Places of the n-grams in the model, found once for all backends that share it."""
        if self._found is None or self._found[0] is not model:
            self._found = model, model.find(self.keys)
        return self._found[1]


def kinds(texts: list[str]) -> Kinds:
    keys, owner = grams(texts)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    for low, high in itertools.pairwise(edges.tolist()):
        keys[low:high].sort()
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return Kinds(keys[at], np.diff(at, append=len(keys)), owner[at])


class Model:
    """n-grams by key, and for each language (in alphabetical order) a value beside them: log-probability and rank (0: none)."""

    def __init__(self, rows: list[tuple[str, str, int, int]]):
        self.languages = sorted({r[0] for r in rows})
        self.keys = np.array(sorted({packed(r[1]) for r in rows}), np.uint64)
        place, column = {int(k): i for i, k in enumerate(self.keys.tolist())}, {x: i for i, x in enumerate(self.languages)}
        counts, self.ranks = np.zeros((len(place), len(column))), np.zeros((len(place), len(column)), np.int64)
        for language, gram, n, rank in rows:
            counts[place[packed(gram)], column[language]] = n
            self.ranks[place[packed(gram)], column[language]] = rank
        self.logs = np.log((counts + 1) / (counts.sum(axis=0) + len(place)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the n-grams, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def bayes(self, texts: list[str], found: Kinds | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) posteriors by naive Bayes over known n-grams, and which of them count. found: the texts' ``kinds``."""
        own = found or kinds(texts)
        at = own.places(self)
        at, owner, n = at[at >= 0], own.owner[at >= 0], own.n[at >= 0]
        sums = np.stack([np.bincount(owner, n * self.logs[at, j], len(texts)) for j in range(len(self.languages))], axis=1) if self.languages else np.zeros((len(texts), 0))
        some = np.bincount(owner, minlength=len(texts)) > 0
        p = np.exp(sums - sums.max(axis=1, keepdims=True)) if self.languages else sums
        return p / p.sum(axis=1, keepdims=True), np.repeat(some[:, None], len(self.languages), axis=1)

    def ranked(self, texts: list[str], profile: int = 300, found: Kinds | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) 1 - out-of-place distance of the ``profile`` most frequent n-grams, and languages that share any."""
        own = found or kinds(texts)
        at, edges = own.places(self), np.searchsorted(own.owner, np.arange(len(texts) + 1))
        p, some = np.zeros((len(texts), len(self.languages))), np.zeros((len(texts), len(self.languages)), bool)
        for i in range(len(texts)):
            n, places = own.n[edges[i] : edges[i + 1]], at[edges[i] : edges[i + 1]]
            places = places[_most(n, profile)]
            place = np.flatnonzero(places >= 0) + 1
            ranks = self.ranks[places[places >= 0]]
            known = (ranks > 0) & (ranks <= profile)
            near = np.where(known, profile - np.minimum(np.abs(place[:, None] - ranks), profile), 0)
            p[i] = near.sum(axis=0) / (max(1, len(places)) * profile)
            some[i] = known.any(axis=0)
        return p, some


def _most(n: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` greatest numbers, falling; of equal ones the first come first."""
    if len(n) > most:
        least = np.partition(n, len(n) - most)[len(n) - most]
        more, same = np.flatnonzero(n > least), np.flatnonzero(n == least)
        return np.concatenate([more[np.argsort(-n[more], kind="stable")], same[: most - len(more)]])
    return np.argsort(-n, kind="stable")


def _judged(p: np.ndarray, some: np.ndarray, languages: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The languages, confidences and probabilities of scored texts."""
    best = np.where(some, p, -1).argmax(axis=1).tolist() if languages else [0] * len(p)
    known = some.any(axis=1).tolist()
    confidence = [float(p[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]
    probs = [[(languages[j], float(p[i, j])) for j in np.flatnonzero(some[i])] for i in range(len(p))]
    language = pa.array([languages[b] if k else "unknown" for b, k in zip(best, known, strict=True)], pa.string())
    return language, pa.array(confidence, pa.float64()), pa.array(probs, pa.map_(pa.string(), pa.float64()))


def beside(scores: dict, languages: list[str], names: list[str]):
    """A function for mapInArrow from rows whose last column is a text to ``names``: the other columns, and for each of ``scores``
    ((texts, their kinds of n-grams) -> (probabilities, which count)) language, confidence and probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.columns[:-1]
            for row, texts in runs(batch.columns[-1]):
                found = kinds(texts)
                told = [c for score in scores.values() for c in _judged(*score(texts, found), languages)]
                yield pa.RecordBatch.from_arrays([*(c.slice(row, len(texts)) for c in rest), *told], names=names)

    return run


def results(name: str, score, languages: list[str], reliable: float):
    """A function for mapInArrow from (id, text) to backend result rows; score: texts -> (probabilities, which count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in runs(batch.column(1)):
                language, confidence, probs = _judged(*score(texts), languages)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(texts)),
                        pa.array([name] * len(texts), pa.string()),
                        language,
                        confidence,
                        probs,
                        pa.array([c > reliable for c in confidence.to_pylist()], pa.bool_()),
                    ],
                    names=["id", "backend_name", "language", "confidence", "all_probabilities", "is_reliable"],
                )

    return run
