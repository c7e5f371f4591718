"""Backends that stand on other libraries, where these are installed: each wraps one library's own call.

A library is imported on the executor that detects, once for each worker; ``is_available`` only looks whether it is there.
"""

from __future__ import annotations

import importlib
import importlib.util
import math

from .backends import Backend


class Library(Backend):
    """A backend of a library: ``module`` is looked for, ``load`` makes what ``detect`` calls."""

    module = ""

    def __init__(self):
        self.loaded = None

    def is_available(self) -> bool:
        return importlib.util.find_spec(self.module) is not None

    def load(self):
        return importlib.import_module(self.module)

    def detect(self, text: str) -> tuple:
        plain = " ".join(text.split())
        if not plain:
            return "unknown", 0.0, {}, False
        if self.loaded is None:
            self.loaded = self.load()
        return self.answer(plain)

    def answer(self, text: str) -> tuple:
        raise NotImplementedError


class FastText(Library):
    name, module = "fasttext", "ftlangdetect"

    def answer(self, text: str) -> tuple:
        found = self.loaded.detect(text)
        return found["lang"], float(found["score"]), {}, found["score"] > 0.5


class FastLangId(Library):
    name, module = "fastlangid", "fastlangid"

    def load(self):
        return importlib.import_module("fastlangid.langid").LID()

    def answer(self, text: str) -> tuple:
        found = self.loaded.predict(text, prob=True)
        lang, p = found if isinstance(found, tuple) else (found, 1.0)
        return lang, float(p), {}, p > 0.5


class Lingua(Library):
    name, module = "lingua", "lingua"

    def load(self):
        return importlib.import_module("lingua").LanguageDetectorBuilder.from_all_languages().build()

    def answer(self, text: str) -> tuple:
        probs = {v.language.iso_code_639_1.name.lower(): float(v.value) for v in self.loaded.compute_language_confidence_values(text)}
        lang = max(probs, key=lambda k: (probs[k], k), default="unknown")
        return lang, probs.get(lang, 0.0), probs, probs.get(lang, 0.0) > 0.5


class Cld3(Library):
    name, module = "pycld3", "cld3"

    def answer(self, text: str) -> tuple:
        found = self.loaded.get_language(text)
        if found is None:
            return "unknown", 0.0, {}, False
        more = self.loaded.get_frequent_languages(text, num_langs=5)
        return found.language, float(found.probability), {v.language: float(v.probability) for v in more}, bool(found.is_reliable)


class LangDetect(Library):
    name, module = "langdetect", "langdetect"

    def load(self):
        library = importlib.import_module("langdetect")
        library.DetectorFactory.seed = 0  # the same answer each time
        return library

    def answer(self, text: str) -> tuple:
        probs = {v.lang: float(v.prob) for v in self.loaded.detect_langs(text)}
        lang = max(probs, key=lambda k: (probs[k], k), default="unknown")
        return lang, probs.get(lang, 0.0), probs, probs.get(lang, 0.0) > 0.5


class LangId(Library):
    name, module = "langid", "langid"

    def answer(self, text: str) -> tuple:
        lang, p = self.loaded.classify(text)
        p = math.exp(p) if p < 0 else p
        p = min(max(float(p), 0.0), 1.0)
        return lang, p, {}, p > 0.5


LIBRARIES: dict[str, type[Library]] = {c.name: c for c in (FastText, FastLangId, Lingua, Cld3, LangDetect, LangId)}
