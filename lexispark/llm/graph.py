"""Connected components of an edge list, on DataFrames alone.

Alternates the two star operations of Kiveris et al. (2014): the large star hangs a node's larger
neighbours on its smallest one, the small star its smaller ones. Neighbourhood minima are aggregated map-side
and joined back, a hub's edges dealt over several tasks; no neighbourhood is ever gathered. An edge list that was counted
to be small (LOCAL edges, 4 MB) is united in one executor task instead, which saves dozens of small shuffles; the
result is the same. Between rounds edges are Parquet files, which go when the next round's are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, hadoop_fs, hot_join, shared_path

#: Distinct edges up to which one task unites them.
LOCAL = 250_000


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find by smaller root over all edges."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((root(x) for x in nodes.tolist()), np.int64, len(parent))
    for at in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 100_000]), pa.array(roots[at : at + 100_000])], names=["node", "component_id"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). One star operation, again with u > v and no edge twice."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    counted = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    least = counted.drop("n")
    joined = hot_join(near, least, ["u"], ["v"], counts=counted)
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node that is its own minimum keeps its edges; for others the edge to the minimum stays.
        out = out.unionByName(least.filter("m < u").select("u", F.col("m").alias("v")))
    else:
        out = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def _stored(edges: DataFrame) -> tuple[DataFrame, str]:
    """``edges`` as Parquet in the shared folder, and its path.

    A checkpoint keeps the size that the optimizer estimates, which for a join is the product of its sides' sizes. Carried
    from round to round that number's digits multiply, until it alone fills the driver; of files the size is read.
    """
    path = shared_path(edges.sparkSession, "edges")
    edges.write.parquet(path)
    return edges.sparkSession.read.schema(edges.schema).parquet(path), path


def _removed(edges: DataFrame, path: str) -> None:
    fs, jpath = hadoop_fs(edges.sparkSession, path)
    fs.delete(jpath, True)


def components(edges: DataFrame, max_rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """(node, component_id): component_id is the smallest node reachable. Only nodes with an edge appear.

    edges: columns u, v (any order; loops, nulls and repeats are ignored).
    """
    edges = gathered(
        edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = sign(edges)
    if last[0] <= local:
        return edges.coalesce(1).mapInArrow(_unite, "node long, component_id long")
    old = None
    for _ in range(max_rounds):
        if not last[0]:
            break
        edges, path = _stored(_star(_star(edges, True), False))
        if old:
            _removed(edges, old)
        now, old = sign(edges), path
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("connected components did not settle")
    if old:
        edges = gathered(edges)
        _removed(edges, old)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component_id", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(roots)
