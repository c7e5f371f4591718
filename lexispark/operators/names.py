"""Names and entities found by taggers of other libraries, in Arrow batches; where a library is missing, texts stay as they are.

A tagger is made once for each worker, by a function without arguments, and maps a text to spans (start, end, label).
"""

from __future__ import annotations

import importlib
import importlib.util
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nouns import MASK

Tagger = Callable[[str], list[tuple[int, int, str]]]
# Kinds of entities that are taken for proper nouns; parts of a person's name.
ENTITIES = ("PERSON", "ORG", "GPE", "LOC", "FAC", "NORP")
NAME_PARTS = ("GivenName", "Surname", "MiddleName", "FirstInitial", "LastInitial", "Nickname")


def spacy_tagger(model: str = "en_core_web_sm") -> Tagger | None:
    """A tagger by spaCy, or None where it or the model isn't installed."""
    if not (importlib.util.find_spec("spacy") and importlib.util.find_spec(model)):
        return None
    pipeline = importlib.import_module("spacy").load(model)
    return lambda text: [(e.start_char, e.end_char, e.label_) for e in pipeline(text).ents]


def person_tagger() -> Tagger | None:
    """A tagger of the parts of persons' names by probablepeople, or None where it isn't installed."""
    if not importlib.util.find_spec("probablepeople"):
        return None
    library = importlib.import_module("probablepeople")

    def tag(text: str) -> list[tuple[int, int, str]]:
        try:
            parts, kind = library.tag(text)
        except library.RepeatedLabelError:
            return []
        if kind != "Person":
            return []
        found = [(m.start(), m.end(), label) for label, part in parts.items() if label in NAME_PARTS for m in re.finditer(rf"\b{re.escape(part)}\b", text, re.IGNORECASE)]
        return sorted(set(found))

    return tag


def filter_tagged(texts: DataFrame, make: Callable[[], Tagger | None], labels: tuple[str, ...] = ENTITIES, strategy: str = "remove") -> DataFrame:
    """``texts`` (id, text) with filtered and names (what was found), spans of ``labels`` removed or masked, blanks collapsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = make()
        for batch in batches:
            filtered, names = [], []
            for text in batch.column(1).to_pylist():
                spans = sorted(s for s in (tagger(text) if tagger and text else []) if s[2] in labels)
                out, found, end = text, [], 0
                if spans:
                    parts = []
                    for start, stop, _ in spans:
                        if start >= end:
                            parts += [text[end:start], MASK if strategy == "mask" else ""]
                            found.append(text[start:stop])
                            end = stop
                    out = " ".join("".join([*parts, text[end:]]).split())
                filtered.append(out)
                names.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(filtered, pa.string()), pa.array(names, pa.list_(pa.string()))], names=["id", "text", "filtered", "names"])

    return texts.select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, text string, filtered string, names array<string>")


def filter_entities(texts: DataFrame, model: str = "en_core_web_sm", strategy: str = "remove", labels: tuple[str, ...] = ENTITIES) -> DataFrame:
    return filter_tagged(texts, lambda: spacy_tagger(model), labels, strategy)


def filter_names(texts: DataFrame) -> DataFrame:
    return filter_tagged(texts, person_tagger, NAME_PARTS)
