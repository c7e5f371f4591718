"""Benchmark decontamination by greedy string tiling.

Texts are read as words (lower-cased, punctuation ignored, typographic and full-width marks and unusual blanks as well). A document and a benchmark item that share a seed, a run of
``least`` words, are a candidate pair. Such a pair is tiled: the longest matches between words not yet marked are
marked on both sides, again and again, down to matches of ``least`` words; Karp-Rabin hashes of all windows of the
current length find the matches (Wise's running Karp-Rabin greedy string tiling). Tiles are one-to-one and may stand in
any order, so passages that were reordered or interrupted are found. A document is contaminated by an item if the
tiles cover at least ``coverage`` of the item's words.

The seeds of a benchmark of at most BENCHMARK_BYTES are broadcast and documents are tested where they are read, with
no shuffle; those of a larger one are joined with the documents' seeds, of which only those travel that pass a filter of
fixed size (2 ** FILTER_BITS bits, 8 MB) over the benchmark's. Both ways give the same pairs.

Defined cases: null or empty texts and items of fewer than ``least`` words match nothing; rows that repeat give a
finding each; a null id is reported as null; ties between equally long matches go to the earlier place in the item,
then in the document; extra columns are ignored, and pass through ``drop_contaminated`` whatever their names; an empty
table of documents or items gives no finding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, hot_join, join_checked
from .kernels import PUNCTUATION, U, blanked, mix, runs, word_hashes
from .kernels import _power_table as powers
from .langid import Hashes

#: A benchmark's texts are broadcast up to so many bytes.
BENCHMARK_BYTES = 16 << 20
LEAST, COVERAGE = 5, 0.5
FOUND = "doc_id long, key long, item_id long, item_words long, matched long, coverage double, tiles array<struct<item_at:int,doc_at:int,words:int>>"
#: Pairs of equal windows that are looked at together.
PAIRS = 1 << 20
#: Logarithm of the bits in the filter over a large benchmark's seeds, which is broadcast.
FILTER_BITS = 26
_TILES = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("words", pa.int32())]))
_FIELDS = [("doc_id", pa.int64()), ("key", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64()), ("tiles", _TILES)]


def words_of(array: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets) of lower-cased texts without punctuation."""
    for row, data, offsets in runs(pc.utf8_lower(array)):
        yield row, *word_hashes(blanked(data), offsets, PUNCTUATION, fold=False)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[size:] - total[:n]) * down[:n])


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in doc, words)."""
    free_item, free_doc, tiles = np.ones(len(item), bool), np.ones(len(doc), bool), []
    size = max(least, min(len(item), len(doc), 32))
    while True:
        at_item, at_doc, length = _matches(item, doc, free_item, free_doc, size)
        if len(length) and length.max() > 2 * size:
            size = int(length.max())
            continue
        queue = list(zip((-length).tolist(), at_item.tolist(), at_doc.tolist(), strict=True))
        heapq.heapify(queue)
        while queue:
            n, p, t = heapq.heappop(queue)
            free = free_item[p : p - n] & free_doc[t : t - n]
            if free.all():
                free_item[p : p - n] = free_doc[t : t - n] = False
                tiles.append((p, t, -n))
            elif free.any():  # what longer tiles left of the match waits for its turn
                edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
                for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    if end - start >= size:
                        heapq.heappush(queue, (start - end, p + start, t + start))
        if size == least or not (free_item.any() and free_doc.any()):
            return tiles
        size = max(least, size // 2)


def _matches(item, doc, free_item, free_doc, size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal matches of at least ``size`` free words."""

    def places(hashes, free):
        taken = np.concatenate([[0], np.cumsum(~free)])
        ok = np.flatnonzero(taken[size:] == taken[: len(free) - size + 1]) if len(free) >= size else np.zeros(0, np.int64)
        return windows(hashes, size)[ok], ok

    a, at_a = places(item, free_item)
    b, at_b = places(doc, free_doc)
    order = np.argsort(a, kind="stable")
    a, at_a = a[order], at_a[order]
    low, high = np.searchsorted(a, b, "left"), np.searchsorted(a, b, "right")
    n = high - low
    ends = np.cumsum(n)
    starts, matched = [], 0
    while matched < len(n):  # as many of the document's windows at a time as have PAIRS equal ones, or one
        until = max(matched + 1, int(np.searchsorted(ends, (ends[matched - 1] if matched else 0) + PAIRS, "right")))
        own = slice(matched, until)
        m = n[own]
        p = at_a[np.repeat(low[own] - (np.cumsum(m) - m), m) + np.arange(m.sum())] if m.any() else np.zeros(0, np.int64)
        t = np.repeat(at_b[own], m)
        # Only where the match doesn't go on to the left.
        before = (p > 0) & (t > 0)
        before[before] = (item[p[before] - 1] == doc[t[before] - 1]) & free_item[p[before] - 1] & free_doc[t[before] - 1]
        starts.append((p[~before], t[~before]))
        matched = until
    p, t = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*starts, strict=True) if starts else ((), ())))
    length = np.full(len(p), size)
    going = np.arange(len(p))
    while len(going):
        i, j = p[going] + length[going], t[going] + length[going]
        going, i, j = (x[(i < len(item)) & (j < len(doc))] for x in (going, i, j))
        more = (item[i] == doc[j]) & free_item[i] & free_doc[j]
        going = going[more]
        length[going] += 1
    return p, t, length


class Items:
    """A benchmark's words and the places of its seeds."""

    def __init__(self, ids: list[int | None], texts: list[str | None], least: int):
        self.ids, self.words, seeds, owners = ids, [], [], []
        for _, hashes, offsets in words_of(pa.array(texts, pa.string())):
            self.words += [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        for i, own in enumerate(self.words):
            found = np.unique(windows(own, least))
            seeds.append(found)
            owners.append(np.full(len(found), i))
        flat, owner = np.concatenate([np.zeros(0, U), *seeds]), np.concatenate([np.zeros(0, np.int64), *owners])
        order = np.argsort(flat, kind="stable")
        flat, self.owners = flat[order], owner[order]
        keys, self.starts = np.unique(flat, return_index=True)
        self.starts = np.append(self.starts, len(flat))
        self.seeds = Hashes(keys)

    def sharing(self, found: np.ndarray) -> np.ndarray:
        """Items that hold any of the seeds at these places."""
        return np.unique(np.concatenate([self.owners[self.starts[i] : self.starts[i + 1]] for i in found.tolist()]))


def judge(item: np.ndarray, doc: np.ndarray, least: int, coverage: float) -> tuple | None:
    """(item's words, matched, coverage, tiles) if enough of the item is covered."""
    if len(item) < least or len(doc) < least:
        return None
    # Tiles are made of shared seeds, so what these cover is the most that tiles can.
    shared = np.isin(windows(item, least), windows(doc, least))
    reach = np.convolve(shared, np.ones(least, int)) > 0
    if reach.sum() < coverage * len(item):
        return None
    tiles = sorted(tile(item, doc, least))
    matched = sum(n for _, _, n in tiles)
    return (len(item), matched, matched / len(item), [{"item_at": p, "doc_at": t, "words": n} for p, t, n in tiles]) if matched >= coverage * len(item) else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE, limit: int = BENCHMARK_BYTES) -> DataFrame:
    """One row per document and item that contaminates it; key is xxhash64 of the document's text."""
    plain = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.filter(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item_text"))
    size = items.agg(F.sum(F.octet_length("item_text") + 16)).first()[0] or 0
    return _broadcast_way(plain, items, least, coverage) if size <= limit else _joined_way(plain, items, least, coverage)


def _broadcast_way(plain: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    rows = items.orderBy("item_id", "item_text").collect()
    held = plain.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["item_text"] for r in rows], least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        for batch in batches:
            for row, hashes, offsets in words_of(batch.column(2)):
                found = items.seeds.find(windows(hashes, least))
                places = np.flatnonzero(found >= 0)
                owner = np.searchsorted(offsets, places, "right") - 1
                inside = places + least <= offsets[owner + 1]  # not over the end of a text
                places, owner = places[inside], owner[inside]
                out = []
                for i in np.unique(owner).tolist():
                    lo, hi = np.searchsorted(owner, [i, i + 1])
                    doc = hashes[offsets[i] : offsets[i + 1]]
                    for j in items.sharing(np.unique(found[places[lo:hi]])).tolist():
                        if result := judge(items.words[j], doc, least, coverage):
                            out.append((batch.column(0)[row + i].as_py(), batch.column(1)[row + i].as_py(), items.ids[j], *result))
                if out:
                    yield _batch(out)

    return plain.mapInArrow(run, FOUND)


def _bits(seeds: DataFrame) -> np.ndarray:
    """A filter over ``seeds``: 64 bits in a number, one of them set for the first FILTER_BITS bits of each seed."""
    bit = F.shiftrightunsigned("seed", 64 - FILTER_BITS).alias("bit")
    words = seeds.select(bit).selectExpr("shiftright(bit, 6) AS word", "shiftleft(1L, CAST(bit & 63 AS INT)) AS bits")
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), U)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(U)
    return out


def _passing(seeds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Those of ``seeds`` whose bit is set."""
    at = seeds >> U(64 - FILTER_BITS)
    return seeds[(bits[at >> U(6)] >> (at & U(63))) & U(1) == 1]


def _seeds(least: int, bits=None):
    """(row, seed) of texts; with ``bits``, a broadcast filter, only of seeds that pass it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, hashes, offsets in words_of(batch.column(1)):
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    own = windows(hashes[a:b], least)
                    own = np.unique(own if bits is None else _passing(own, bits.value)).view(np.int64)
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0)[row + i].as_py(), len(own))), pa.array(own)], names=["row", "seed"])

    return run


def _joined_way(plain: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """Seeds of both sides meet by their hash; candidate pairs then fetch their texts, which are equal for equal keys."""
    items = items.withColumn("item_key", F.xxhash64("item_text"))
    texts, item_texts = plain.select("key", "text").dropDuplicates(["key"]), items.select("item_key", "item_text").dropDuplicates(["item_key"])
    theirs = checkpoint(item_texts.select("item_key", "item_text").mapInArrow(_seeds(least), "row long, seed long").withColumnRenamed("row", "item_key"))
    bits = plain.sparkSession.sparkContext.broadcast(_bits(theirs))
    mine = checkpoint(texts.select("key", "text").mapInArrow(_seeds(least, bits), "row long, seed long").withColumnRenamed("row", "key"))
    # A passage or an item that many documents have is dealt over tasks by their number.
    pairs = checkpoint(hot_join(mine, theirs, ["seed"], ["key"]).select("key", "item_key").distinct())
    both = hot_join(pairs, item_texts, ["item_key"], ["key"]).join(texts, "key").select("key", "item_key", "text", "item_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "item_key", "item_words", "matched", "coverage", "tiles"]
        types = [pa.int64()] * 4 + [pa.float64(), _TILES]
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                doc, item = (next(words_of(batch.column(c).slice(i, 1)))[1] for c in (2, 3))
                if result := judge(item, doc, least, coverage):
                    out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), *result))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "key long, item_key long, " + FOUND.split(", item_id long, ")[1]
    judged = checkpoint(both.mapInArrow(run, schema))
    out = judged.join(items.select("item_key", "item_id"), "item_key").join(plain.select("doc_id", "key"), "key")
    return out.select(*(n for n, _ in _FIELDS))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that an item contaminates."""
    bad = contaminated(docs, benchmark, id_col, text_col, **options)
    none, doc, key = F.lit(-(1 << 63)), fresh("_doc", docs), fresh("_key", docs)
    bad = checkpoint(bad.select(F.coalesce("doc_id", none).alias(doc), F.col("key").alias(key)).distinct())
    rows = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), none), key: F.xxhash64(text_col)})
    return join_checked(rows, bad, [doc, key], "left_anti", 32).select(*docs.columns)
