"""MinHash near-duplicates by min-max hashing.

Every hash function gives two signature values, the minimum and the maximum over a text's shingles; both collide
with a probability equal to the Jaccard similarity, so half the hash evaluations fill a signature, and the pair has
a lower variance than two independent minima (Ji et al., 2013). The signature is cut into bands; texts that share a
band are candidates, and a candidate pair becomes a link only when the full shingle sets are similar enough.

Work is proportional to the texts: texts with equal sets are collapsed first (map-side); a band's texts are compared
with one representative per round, unless their sizes alone keep them apart; only bands that still hold unconnected
texts go to the exact step. There only the unconnected texts travel: each meets those texts of its bands that are of a
size that may be alike, in blocks of bounded rows and shingles, so that what is sent is linear in a large group. Only
spanning edges are passed on. Keys that many rows share (a band, a representative) are salted.

Defined cases: null, empty and separator-only texts have an empty set and link with nothing; a text of 1 to k-1 words
has one shingle, the whole sequence; equal texts link; rows that share an id are one document, linked
by any of its texts; a null id is never linked and yields its own row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, hot_join, join_checked, sized_join
from .graph import components
from .kernels import U, common, mix, text_sets

#: 32 bands of 4 values: a pair at similarity 0.8 is missed with probability (1 - 0.8 ** 4) ** 32 < 5e-8.
BANDS, ROWS = 32, 4
#: Texts and shingles of either side that meet in one task of the exact step (one longer text makes a block).
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
_SEEDS = mix(np.arange(1, BANDS * ROWS // 2 + 1, dtype=U)) | U(1)
_ADD = mix(np.arange(1001, BANDS * ROWS // 2 + 1001, dtype=U))


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, bands) band hashes of non-empty sets, given one after another.

    Band g takes the minima of the functions g, g + 16, g + 32 and g + 48, band g + 16 their maxima.
    """
    starts, groups = offsets[:-1], BANDS // 2
    keys = np.empty((BANDS, len(starts)), U)
    for b in range(BANDS):
        keys[b] = b + 1
    for j in range(len(_SEEDS)):
        hashed = sets * _SEEDS[j] + _ADD[j]
        for b, least in ((j % groups, np.minimum), (j % groups + groups, np.maximum)):
            keys[b] = mix(keys[b] * U(0x9E3779B97F4A7C15) + least.reduceat(hashed, starts))
    return keys.T


def _sign(k: int):
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, sets, offsets in text_sets(batch.column(1), k):
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                prints = np.zeros((2, len(sizes)), U)
                bands = np.zeros((0, BANDS), U)
                if len(full):
                    starts = offsets[:-1][full]
                    prints[0, full] = np.add.reduceat(sets, starts)
                    prints[1, full] = np.add.reduceat(mix(sets), starts)
                    bands = signatures(sets, np.append(starts, len(sets)))
                ends = np.zeros(len(sizes) + 1, np.int32)
                ends[1:] = np.cumsum((sizes > 0) * BANDS)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(bands).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(sizes)), pa.array(sizes), *(pa.array(p.view(np.int64)) for p in prints), listed], schema=schema)

    return run


def _alike(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def _verify(k: int, percent: int):
    """Rows (a, b, a_text, b_text) whose full sets are similar enough, as (u, v)."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = batch.column(2)
            keep = np.zeros(len(a), bool)
            for row, sets, offsets in text_sets(batch.column(3), k):
                for i in range(len(offsets) - 1):
                    own, key = sets[offsets[i] : offsets[i + 1]], texts[row + i].as_py() or ""
                    if key not in held:
                        if len(held) > 64:
                            held.clear()
                        held[key] = next(text_sets(pa.array([key]), k))[1]
                    other = held[key]
                    small, big = sorted((len(own), len(other)))
                    if small and 100 * small >= percent * big:
                        keep[row + i] = _alike(common(own, other), len(own), len(other), percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], schema=schema)

    return run


def _meet(k: int, percent: int):
    """Two blocks: each lone text (side 0) against the texts of side 1: an edge for each other component that it reaches. Side 2 is both."""

    def run(rows: pa.Table) -> pa.Table:
        ids, comps, side = (rows.column(c).to_numpy() for c in ("cls", "comp", "side"))
        right = np.flatnonzero(side != 0)
        if len(right) == 0 or (side == 1).all():
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        sets: list[np.ndarray] = []
        for _, flat, offsets in text_sets(rows.column("text"), k):
            sets += [flat[offsets[i] : offsets[i + 1]] for i in range(len(offsets) - 1)]
        sizes = np.array([len(sets[i]) for i in right], np.int64)
        flat, owner = np.concatenate([sets[i] for i in right]), np.repeat(np.arange(len(right)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        us, vs = [], []
        for i in np.flatnonzero(side != 1):
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            inter = np.bincount(owner[at], minlength=len(right))
            linked = right[(inter > 0) & _alike(inter, len(sets[i]), sizes, percent) & (comps[right] != comps[i])]
            reached = linked[np.unique(comps[linked], return_index=True)[1]]
            us += [ids[i]] * len(reached)
            vs += ids[reached].tolist()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _text_pairs(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified pairs (a, b) of a checkpoint of pairs. The text of the hub side a meets its pairs last, once for each salt of a large hub."""
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")
    hubs = pairs.groupBy("a").agg(F.count("*").alias("n"))
    both = hot_join(both, texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), ["a"], ["b"], counts=hubs)
    return gathered(both.select("a", "b", "a_text", "b_text").mapInArrow(_verify(k, percent), "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per id: (id_col, n_shingles, component_id, kept). Texts link when 100 * |A & B| >= percent * |A | B|.

    component_id is the smallest id reachable over links, itself included; kept says whether that is the id itself.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = gathered(plain.mapInArrow(_sign(k), "id long, n_shingles long, f1 long, f2 long, bands array<long>"))
    sets = signed.filter("n_shingles > 0 and id is not null")

    # Texts with equal sets become one class, named by its smallest id.
    classes = gathered(sets.groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("cls"), F.max("id").alias("most"), F.first("bands").alias("bands")))
    copies = sets.select("id", "f1", "f2", "n_shingles").join(classes.filter("most > cls").select("f1", "f2", "n_shingles", "cls"), ["f1", "f2", "n_shingles"])
    links = gathered(copies.filter("id <> cls").select(F.col("id").alias("u"), F.col("cls").alias("v")))

    banded = classes.select("cls", F.col("n_shingles").alias("size"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min(F.struct("cls", "size")).alias("a"), F.max(F.struct("cls", "size")).alias("z"), F.count("*").alias("n")).filter("a.cls < z.cls")
    shared = gathered(shared)
    members = gathered(sized_join(banded, shared.drop("n"), ["band"], ["cls"], 64, counts=shared).select("band", "cls", "size", "a", "z"))
    near = lambda x, y: (F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y))
    wanted = gathered(members.select(F.col("cls").alias("id")).distinct())
    texts = join_checked(plain, wanted, ["id"], "left_semi", 16)

    # Alike sets differ in size by 100 / percent at most. First against the smallest text of each band; then, where a band still falls apart, against its largest.
    first = members.filter((F.col("a.cls") != F.col("cls")) & near(F.col("a.size"), F.col("size")))
    first = gathered(first.select(F.col("a.cls").alias("a"), F.col("cls").alias("b")).distinct())
    links = links.unionByName(_text_pairs(first, texts, k, percent))
    labelled, is_open = _labelled(members, links)
    if is_open:
        heads = gathered(labelled.groupBy("band").agg(F.max_by("comp", "cls").alias("z_comp"), F.count("*").alias("n")))
        tried = sized_join(labelled, heads.drop("n"), ["band"], ["cls"], 32, counts=heads)
        tried = tried.filter((F.col("z_comp") != F.col("comp")) & near(F.col("z.size"), F.col("size"))).select(F.col("z.cls").alias("a"), F.col("cls").alias("b")).distinct()
        tried = gathered(join_checked(tried, first.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti", 16))
        links = links.unionByName(_text_pairs(tried, texts, k, percent))
        labelled, is_open = _labelled(members, links)
    if is_open:
        links = links.unionByName(_exact(labelled, texts, k, percent))
    found = gathered(components(links))

    ids = signed.filter("id is not null").groupBy("id").agg(F.max("n_shingles").alias("n_shingles"))
    out = join_checked(ids, found.withColumnRenamed("node", "id"), ["id"], "left", 16).withColumn("component_id", F.coalesce("component_id", "id"))
    out = out.unionByName(signed.filter("id is null").select("id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def _labelled(members: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """The rows of bands that hold more than one component so far, with their component; whether there are any."""
    comps = gathered(components(links).select(F.col("node").alias("cls"), F.col("component_id").alias("comp")))
    named = gathered(join_checked(members, comps, ["cls"], "left", 16).withColumn("comp", F.coalesce("comp", "cls")))
    apart = gathered(named.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo < hi"))
    out = gathered(sized_join(named, apart.select("band"), ["band"], ["cls"], 16, counts=apart))
    return out, not out.isEmpty()


def _dealt(labelled: DataFrame, percent: int) -> DataFrame:
    """(lead, bucket, i, j, side, cls, comp): the pairs of blocks of the exact step.

    Bands with the same leading (largest) component are looked at together: every text outside of it (side 0) against all
    of them (side 1). Sizes fall in buckets so wide that alike texts differ by one bucket at most; a lone text visits
    the buckets on either side, others stay in their own. Lone texts go to all blocks of a bucket's texts, and these
    to all blocks of its visitors. Bands that make one block in all are one, and each of its texts is sent once.
    """
    sizes = labelled.groupBy("band", "comp").agg(F.count("*").alias("n"))
    leads = sizes.groupBy("band").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("lead"), F.sum("n").alias("n"))
    rows = hot_join(labelled, leads.drop("n"), ["band"], ["cls"], counts=leads).select("lead", "cls", "comp", "size").distinct()
    rows = gathered(rows)
    groups = rows.groupBy("lead").agg(F.count("*").alias("n"), ((F.count("*") <= BLOCK) & (F.sum("size") <= BLOCK_SHINGLES)).alias("whole"))
    rows = hot_join(rows, groups.drop("n"), ["lead"], ["cls"], counts=groups).withColumn("lone", F.col("comp") != F.col("lead"))
    rows = gathered(rows.withColumn("at", F.floor(F.log("size") / (math.log(max(100 / percent, 1.01)) * 1.000001)).cast("int")))
    zero = F.lit(0)
    small = rows.filter("whole").select("lead", zero.alias("bucket"), zero.alias("i"), zero.alias("j"), F.when(F.col("lone"), 2).otherwise(1).alias("side"), "cls", "comp")
    rows = rows.filter("not whole")
    lone = rows.filter("lone").withColumn("bucket", F.explode(F.array(*(F.col("at") + i for i in (-1, 0, 1)))))
    both = lone.withColumn("side", F.lit(0)).unionByName(rows.withColumn("bucket", F.col("at")).withColumn("side", F.lit(1)))
    blocks = lambda side: F.ceil(F.greatest(F.count_if(F.col("side") == side) / BLOCK, F.sum(F.when(F.col("side") == side, F.col("size"))) / BLOCK_SHINGLES)).cast("int")
    cells = gathered(both.groupBy("lead", "bucket").agg(blocks(0).alias("left"), blocks(1).alias("right"), F.count("*").alias("n")).filter("left > 0 and right > 0"))
    both = hot_join(both, cells.drop("n"), ["lead", "bucket"], ["cls", "side"], counts=cells)
    own = F.pmod(F.xxhash64("cls"), F.when(F.col("side") == 0, F.col("left")).otherwise(F.col("right"))).cast("int")
    all_of = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("right")).otherwise(F.col("left")) - 1))
    both = both.withColumn("own", own).withColumn("other", all_of)
    first = F.col("side") == 0
    return small.unionByName(both.select("lead", "bucket", F.when(first, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(first, F.col("other")).otherwise(F.col("own")).alias("j"), "side", "cls", "comp"))


def _exact(labelled: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components that share a band."""
    met = _dealt(labelled, percent).join(texts.withColumnRenamed("id", "cls"), "cls")
    return gathered(met.groupBy("lead", "bucket", "i", "j").applyInArrow(_meet(k, percent), "u long, v long").distinct())
