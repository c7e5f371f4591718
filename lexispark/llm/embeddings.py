"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Every vector is normalised and projected on many fixed random directions. Projections are sorted, and two vectors
collide in one when one lies in the window centred on the other; a pair that collides often enough is verified with the
exact cosine in double precision. Window and count are calibrated, for the dimension at hand, so that a pair exactly at the
threshold is kept with a probability of at least 1 - MISS: its difference along a direction is close to normal with a
known variance. A pair that collides often enough collides in one of the first few projections, so that only the
windows of those are enumerated; the pairs found are counted on, and given up as soon as they have missed too often.

Groups (label values) are of any size: equal vectors are collapsed first; a group is then cut at the medians of its
projections, those that spread widest first, each side also taking the vectors within half a window of the cut, so that
a pair that collides there shares a side. A group is cut as far as its size asks for and only where a cut lessens the
pairs (two sides of share s have 2 s^2 of them): a dense cluster, which no cut divides, stays whole. Of such a cell the core,
all vectors within half the threshold's angle of the cell's mean, needs no comparison: any two of it are linked. What is left is
dealt over tasks as pairs of blocks; m vectors out of the core send the n of the cell m / BLOCK times. A pair that several
cells share is counted in the first. Tasks return degrees and spanning edges only, never pairs.

Defined cases: null or zero vectors, vectors with null or non-finite components, and vectors without a label link with
nothing; vectors of different lengths never link; rows that share an id are one vector, linked by any of its rows; a
null id gets its own row without links; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hot_join, sized_join, small
from .graph import components

#: Projections that are counted; each of them may cut a group.
PROJECTIONS = 24
#: Vectors of a cell up to which it isn't cut again; vectors and bytes of a block within a cell.
CELL, BLOCK, BLOCK_BYTES = 4096, 1024, 8 << 20
#: Probability of losing a pair at the threshold by the count; each cut adds one of 4e-5.
MISS = 1e-6
#: Half-width of the windows in standard deviations of such a pair's difference, for counting and for cuts.
WINDOW, CUT_WINDOW = 3.0, 4.1
#: Share of a group's vectors within half a window of a cut up to which cutting lessens the pairs: 2 * (0.5 + x / 2) ** 2 < 1.
STRADDLE = 0.4


def directions(dim: int, n: int = PROJECTIONS) -> np.ndarray:
    """n fixed random directions of unit length."""
    made = np.random.default_rng(20_240_229 + dim).standard_normal((n, dim))
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def calibrated(threshold: float, dim: int) -> tuple[float, float, int]:
    """(standard deviation of a threshold pair's difference, window, least number of collisions)."""
    sigma = math.sqrt(2 - 2 * threshold) / math.sqrt(dim)
    p = math.erf(WINDOW / math.sqrt(2))
    below, count = 0.0, 0
    for c in range(PROJECTIONS + 1):  # the largest count that a threshold pair reaches with probability 1 - MISS
        term = math.comb(PROJECTIONS, c) * p**c * (1 - p) ** (PROJECTIONS - c)
        if below + term > MISS:
            break
        below, count = below + term, c + 1
    return sigma, WINDOW * sigma, count


def _project():
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("unit", pa.binary()), ("proj", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(2)
            lists = pa.array(lists) if isinstance(lists, pa.ChunkedArray) else lists
            offsets, flat = lists.offsets.to_numpy(), lists.values
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == dim)
                for at in range(0, len(rows), 1024):
                    own = rows[at : at + 1024]
                    matrix = values[offsets[own][:, None] + np.arange(dim)]
                    scale = np.abs(matrix).max(axis=1)
                    good = np.isfinite(scale) & (scale > 0)
                    own, matrix = own[good], matrix[good] / scale[good][:, None]
                    if not len(own):
                        continue
                    # The same sum whatever the batch, so that equal vectors have equal units.
                    matrix = matrix / np.sqrt(np.cumsum(matrix * matrix, axis=1)[:, -1])[:, None]
                    if dim not in held:
                        held[dim] = directions(dim)
                    places = pa.array(own)
                    projected = matrix @ held[dim].T
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * PROJECTIONS), pa.array(projected.ravel()))
                    units = pa.array([row.tobytes() for row in matrix], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(places), batch.column(1).take(places), pa.array(np.full(len(own), dim, np.int32)), units, listed], schema=schema)

    return run


def colliding(left: np.ndarray, right: np.ndarray, window: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of the columns of two arrays of projections that collide in at least ``least`` of them.

    Such a pair collides in one of the first ``misses + 1`` projections: their sorted windows are enumerated one after
    another, pairs that an earlier one had are left out, and the rest are counted on through the other projections.
    """
    misses = len(left) - least
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for p in range(misses + 1):
        by = np.argsort(right[p], kind="stable")
        ordered = right[p][by]
        low, high = np.searchsorted(ordered, left[p] - window, "left"), np.searchsorted(ordered, left[p] + window, "right")
        n = high - low
        i = np.repeat(np.arange(left.shape[1]), n)
        j = by[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        for q in range(p):  # collided before: found there
            new = np.abs(left[q][i] - right[q][j]) > window
            i, j = i[new], j[new]
        missed = np.full(len(i), p, np.uint8)
        for q in range(p + 1, len(left)):
            missed += np.abs(left[q][i] - right[q][j]) > window
            if missed.any():
                going = missed <= misses
                i, j, missed = i[going], j[going], missed[going]
        found.append((i, j))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _compare(threshold: float):
    """One pair of blocks (i <= j) of a cell: for each vector the copies it links with, and one edge for each linked component."""

    def run(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        take = rows.take(pa.array(order)).combine_chunks()
        ids, copies, also = (take.column(c).to_numpy() for c in ("cls", "copies", "also"))
        n, n_left = len(ids), int(np.count_nonzero(side == 0))
        same = take.column("i")[0].as_py() == take.column("j")[0].as_py()  # a block with itself; else either may be empty
        dim = int(take.column("dim")[0].as_py())
        units = np.frombuffer(b"".join(take.column("unit").to_pylist()), np.float64).reshape(n, dim)
        _, window, least = calibrated(threshold, dim)
        projected = np.ascontiguousarray((units @ directions(dim).T).T)
        first = 0 if same else n_left  # of the right side
        degree, parent, edges = np.zeros(n, np.int64), list(range(n)), []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for start in range(0, n if same else n_left, 256):
            end = min(start + 256, n if same else n_left)
            a, b = colliding(projected[:, start:end], projected[:, first:], window, least)
            a, b = a + start, b + first
            keep = (a < b if same else ids[a] != ids[b]) & ((also[a] & also[b]) == 0)
            a, b = a[keep], b[keep]
            for at in range(0, len(a), 1 << 14):
                x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                linked = np.einsum("ij,ij->i", units[x], units[y]) >= threshold
                x, y = x[linked], y[linked]
                np.add.at(degree, x, copies[y])
                np.add.at(degree, y, copies[x])
                for u, v in zip(x.tolist(), y.tolist(), strict=True):
                    ru, rv = root(u), root(v)
                    if ru != rv:
                        parent[rv] = ru
                        edges.append((ids[u], ids[v]))
        some = np.flatnonzero(degree)
        us = np.concatenate([ids[some], np.array([e[0] for e in edges], np.int64)])
        vs = [None] * len(some) + [int(e[1]) for e in edges]
        return pa.table({"u": us, "v": pa.array(vs, pa.int64()), "n": np.concatenate([degree[some], np.zeros(len(edges), np.int64)])})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.98) -> DataFrame:
    """One row per id: (id_col, n_links, component_id, kept); links join vectors of equal label with cosine >= threshold."""
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = rows.filter("id is not null and label is not null and v is not null")
    signed = checkpoint(usable.mapInArrow(_project(), "id long, label string, dim int, unit binary, proj array<double>"))

    # Equal directions are one class, named by its smallest id; a class of n vectors gives each n - 1 links.
    key = ["label", "dim", "unit"]
    classes = signed.groupBy(*key).agg(F.min("id").alias("cls"), F.countDistinct("id").alias("copies"), F.first("proj").alias("proj"))
    classes = checkpoint(classes)
    cells = checkpoint(_cells(classes, threshold))
    blocked = _blocked(_cored(cells, threshold))
    met = checkpoint(_dealt(blocked).groupBy(*_CELL, "i", "j").applyInArrow(_compare(threshold), "u long, v long, n long").unionByName(_core_links(blocked)))

    copied = hot_join(signed.drop("proj"), classes.select(*key, "cls", "copies"), key, ["id"], counts=classes.withColumnRenamed("copies", "n")).select("id", "cls", "copies").distinct()
    degrees = met.filter("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    named = degrees.select(F.col("u").alias("cls"), "n")
    degrees = hot_join(copied, named, ["cls"], ["id"], "left", counts=classes.select("cls", F.col("copies").alias("n"))).groupBy("id").agg(F.sum(F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    edges = met.filter("v is not null").select("u", "v").unionByName(copied.filter("id <> cls").select(F.col("id").alias("u"), F.col("cls").alias("v")))
    found = components(edges).withColumnRenamed("node", "id")
    out = rows.filter("id is not null").select("id").distinct().join(degrees, "id", "left").join(found, "id", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = out.unionByName(rows.filter("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


#: What a cell is named by.
_CELL = ["label", "dim", "cell"]
#: Angle by which a core is narrower than the bound, far above what rounding adds to an angle and far below what matters.
SLACK = 1e-6


#: Length of the mean of a cell's units below which no core is looked for: it would be a small share of the cell. Results do not
#: hang on it, as vectors out of cores are compared.
LEAN = 0.25


def _matrix(units: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(units.to_pylist()), np.float64).reshape(len(units), dim)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, dim, cell, unit) to the sum of the units of each cell of a batch, with their number as one more entry."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for (label, dim, cell), rows in _by_cell(table):
            total = _matrix(table.column("unit").take(pa.array(rows)), dim).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([dim], pa.int32()), pa.array([cell], pa.int64()), pa.array([[*total.tolist(), float(len(rows))]], pa.list_(pa.float64()))], names=[*_CELL, "total"])


def _by_cell(table: pa.Table) -> Iterator[tuple[tuple, list[int]]]:
    places: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(table.column(c).to_pylist() for c in _CELL), strict=True)):
        places.setdefault(key, []).append(i)
    yield from places.items()


def _inside(threshold: float):
    """Adds whether a vector is in its cell's core; also = 0 keeps to vectors whose pairs all count in this cell."""
    limit = math.cos(max(math.acos(min(threshold, 1.0)) / 2 - SLACK, 0.0)) if threshold < 1 else 2.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, core = pa.Table.from_batches([batch]), np.zeros(batch.num_rows, bool)
            also = table.column("also").to_numpy()
            for (_, dim, _), rows in _by_cell(table):
                centre = np.array(table.column("centre")[rows[0]].as_py()[:-1])
                size = np.linalg.norm(centre)
                if size > 0:
                    core[rows] = _matrix(table.column("unit").take(pa.array(rows)), dim) @ (centre / size) >= limit
            columns = [c for c in batch.schema.names if c != "centre"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(core & (also == 0))], names=[*columns, "core"])

    return run


def _cored(cells: DataFrame, threshold: float) -> DataFrame:
    """``cells`` and whether a vector belongs to its cell's core: it is at most half the threshold's angle from the mean of the cell.

    Any two vectors of a core are linked, by the triangle inequality of angles, so that they need not be compared. Only cells of
    more than one block have a core.
    """
    per_cell = cells.groupBy(*_CELL).agg(F.count("*").alias("n"))
    large = checkpoint(per_cell.filter(F.col("n") > BLOCK))
    widest = large.agg(F.max("dim")).first()[0]
    if widest is None:
        return cells.withColumn("core", F.lit(False))
    inside = sized_join(cells, large.select(*_CELL), _CELL, ["cls"], 64, large)
    total = inside.filter("also = 0").select(*_CELL, "unit").mapInArrow(_sums, "label string, dim int, cell long, total array<double>")
    total = total.select(*_CELL, F.posexplode("total").alias("at", "s")).groupBy(*_CELL, "at").agg(F.sum("s").alias("s"))
    centres = total.groupBy(*_CELL).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("centre"))
    length = F.sqrt(F.aggregate(F.slice("centre", 1, F.size("centre") - 1), F.lit(0.0), lambda a, x: a + x * x))
    centres = checkpoint(centres.filter(length >= LEAN * F.element_at("centre", -1)))
    if centres.isEmpty():
        return cells.withColumn("core", F.lit(False))
    kept = ", ".join(f"{n} {t}" for n, t in cells.dtypes)
    judged = sized_join(inside, centres, _CELL, ["cls"], 64 + 8 * widest, large).select(*cells.columns, "centre").mapInArrow(_inside(threshold), f"{kept}, core boolean")
    # Small and spread cells have no core, nor have those whose vectors all count in another cell first, too.
    rest = cells.join(F.broadcast(centres.select(*_CELL)) if small(centres.select(*_CELL), 64) else centres.select(*_CELL), _CELL, "left_anti")
    return checkpoint(judged.unionByName(rest.withColumn("core", F.lit(False))))


def _blocked(cells: DataFrame) -> DataFrame:
    """Each vector of a cell with its block: ``outer`` blocks of vectors out of the core, then those of the core.

    core_copies and core_first: how many vectors the core holds, copies counted, and the smallest class of it.
    """
    core = F.col("core")
    blocks = lambda n: F.ceil(F.greatest(n / BLOCK, n * F.col("dim") * 8 / BLOCK_BYTES)).cast("int")
    per_cell = checkpoint(cells.groupBy(*_CELL).agg(F.count("*").alias("n"), F.count_if(core).alias("k"), F.sum(F.when(core, F.col("copies"))).alias("core_copies"), F.min(F.when(core, F.col("cls"))).alias("core_first")))
    told = per_cell.select(*_CELL, blocks(F.col("n") - F.col("k")).alias("outer"), blocks(F.col("k")).alias("inner"), "core_copies", "core_first")
    out = hot_join(cells, told, _CELL, ["cls"], counts=per_cell)
    dealt = lambda n: F.pmod(F.xxhash64("cls"), F.greatest(n, F.lit(1))).cast("int")
    return out.withColumn("own", F.when(core, F.col("outer") + dealt(F.col("inner"))).otherwise(dealt(F.col("outer"))))


def _dealt(blocked: DataFrame) -> DataFrame:
    """The vectors by pairs of blocks i <= j that are to be compared: all but those of two blocks of the core."""
    outer, every = F.col("outer"), F.col("outer") + F.col("inner")
    others = F.when(~F.col("core"), F.sequence(F.lit(0), every - 1)).when(outer > 0, F.sequence(F.lit(0), F.greatest(outer, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    dealt = blocked.withColumn("other", F.explode(others))
    return dealt.select(*_CELL, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cls", "copies", "unit", "also")


def _core_links(blocked: DataFrame) -> DataFrame:
    """(u, v, n) of the vectors of cores, as ``_compare`` tells them: links with all others of the core, and an edge to its first."""
    core = blocked.filter("core")
    links = core.select(F.col("cls").alias("u"), F.lit(None).cast("long").alias("v"), (F.col("core_copies") - F.col("copies")).alias("n")).filter("n > 0")
    return links.unionByName(core.filter("cls <> core_first").select(F.col("cls").alias("u"), F.col("core_first").alias("v"), F.lit(0).cast("long").alias("n")))


def _cells(classes: DataFrame, threshold: float) -> DataFrame:
    """Each class with the cells it falls in, and the cuts (bits) at which it also stands on the side that comes first."""
    own = ["label", "dim"]
    half = F.sqrt(F.lit(2 - 2 * threshold)) / F.sqrt(F.col("dim")) * F.lit(CUT_WINDOW / 2)
    groups = classes.groupBy(*own).agg(F.count("*").alias("n"), F.array(*(F.percentile_approx(F.col("proj")[c], 0.5, 200) for c in range(PROJECTIONS))).alias("medians"))
    groups = checkpoint(groups)
    near = [F.avg((F.abs(F.col("proj")[c] - F.col("medians")[c]) <= half).cast("double")) for c in range(PROJECTIONS)]
    large = groups.filter(F.col("n") > CELL)
    spread = hot_join(classes.select(*own, "cls", "proj"), large.drop("n"), own, ["cls"], counts=large).groupBy(*own).agg(F.array(*near).alias("near"))
    # The cuts of a group: those that fewest vectors straddle first, while cells are large and cutting lessens the pairs.
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(PROJECTIONS - 1)), lambda c: F.struct(F.get("near", c).alias("near"), c.alias("c"), F.get("medians", c).alias("at"))))
    ranked = F.filter(ranked, lambda x: x["near"] <= STRADDLE)
    start = F.struct(F.col("n").cast("double").alias("n"), F.array().cast("array<struct<c:int,at:double>>").alias("cuts"))
    chosen = F.aggregate(ranked, start, lambda a, x: F.when(a["n"] <= CELL, a).otherwise(F.struct((a["n"] * (x["near"] + 1) / 2).alias("n"), F.concat(a["cuts"], F.array(F.struct(x["c"].alias("c"), x["at"].alias("at")))).alias("cuts"))))["cuts"]
    cuts = groups.join(spread, own, "left").select(*own, "n", F.when(F.col("near").isNull(), F.array().cast("array<struct<c:int,at:double>>")).otherwise(chosen).alias("cuts"))

    none = F.array().cast("array<struct<cell:bigint,also:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("also")))

    def cut(cells, x):
        value, at = F.get("proj", x["c"]), x["at"]
        below, above = value < at + F.col("half"), value >= at - F.col("half")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), x["c"])
        second = F.transform(cells, lambda y: F.struct((y["cell"] + bit).alias("cell"), (y["also"] + F.when(below, bit).otherwise(F.lit(0).cast("long"))).alias("also")))
        return F.concat(F.when(below, cells).otherwise(none), F.when(above, second).otherwise(none))

    rows = hot_join(classes, cuts.drop("n"), own, ["cls"], counts=cuts).withColumn("half", half)
    return rows.withColumn("at", F.explode(F.aggregate("cuts", whole, cut))).select(*own, "cls", "copies", "unit", F.col("at.cell").alias("cell"), F.col("at.also").alias("also"))
