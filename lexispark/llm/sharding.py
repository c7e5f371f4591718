"""Immutable shards under a versioned manifest, with size-tiered compaction; DataFrame operations only.

An append writes a run of small Parquet shards and commits a manifest that lists them. Compaction takes runs of
similar size (their tier is the logarithm of their size) once a tier holds ``fan_in`` of them, and rewrites each set as
one run of files of about the target size, without a shuffle. A manifest is written under a temporary name and renamed
to its version, which fails where that version exists: of two writers one commits, the other starts again from the
new version. Readers use the newest manifest and never see shards that none lists; shards of replaced runs are
deleted only when asked for.

Only listings and sizes of files pass through the driver, never rows.

Each run keeps its schema in the manifest, and a store is read and compacted with the united one: columns that an arrival
lacks are null, whole numbers widen to the longest, float to double (names ignore case, the first spelling stays); an arrival whose types
can't be united with those that are there is refused before it is committed.

Defined cases: an empty arrival commits no shard; repeated rows, nulls and any columns are kept as they are; reading a
store without a manifest gives an error; compaction with nothing to do commits nothing, and one whose runs another
compaction has taken starts again. The rename must be atomic where the store is kept (HDFS, local and most shared file
systems; object stores need a file system layer that makes it so).
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, hadoop_fs, shared_path

#: Bytes of a shard that compaction aims at, runs of a tier that start it, and the size ratio between tiers.
TARGET, FAN_IN, RATIO = 128 << 20, 4, 4
#: Times that a commit starts again after another writer's.
ATTEMPTS = 100
#: Types that widen to the last one of those met.
_WIDER = [[T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()], [T.FloatType(), T.DoubleType()]]


class Conflict(RuntimeError):
    """Another writer has committed the version."""


def united(schemas: list[T.StructType]) -> T.StructType:
    """The columns of all schemas, each nullable; raises TypeError where the types of a column can't be united."""
    out: dict[str, T.StructField] = {}
    for field in (f for s in schemas for f in s.fields):
        old = out.setdefault(field.name.lower(), T.StructField(field.name, field.dataType))
        if old.dataType != field.dataType:
            row = next((w for w in _WIDER if old.dataType in w and field.dataType in w), None)
            if row is None:
                raise TypeError(f"column {field.name} is {old.dataType.simpleString()} in one arrival and {field.dataType.simpleString()} in another")
            out[field.name.lower()] = T.StructField(old.name, max(old.dataType, field.dataType, key=row.index))
    return T.StructType(list(out.values()))


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET, fan_in: int = FAN_IN):
        self.spark, self.path, self.target, self.fan_in = spark, path.rstrip("/"), target_bytes, fan_in

    # manifests

    def versions(self) -> list[int]:
        fs, folder = hadoop_fs(self.spark, f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        have = self.versions()
        if not have and version is None:
            return {"version": 0, "runs": []}
        fs, file = hadoop_fs(self.spark, self._name(have[-1] if version is None else version))
        stream = fs.open(file)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _name(self, version: int) -> str:
        return f"{self.path}/manifests/v{version:020d}.json"

    def commit(self, base: dict, runs: list[dict]) -> dict:
        """Publishes ``runs`` as the version after ``base``, or raises Conflict."""
        new = {"version": base["version"] + 1, "runs": runs}
        fs, temporary = hadoop_fs(self.spark, f"{self.path}/manifests/_{uuid.uuid4().hex}.tmp")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        target = jvm.org.apache.hadoop.fs.Path(self._name(new["version"]))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, target, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(temporary, False)
            if fs.exists(target):
                raise Conflict(f"version {new['version']} is there already") from e
            raise
        return new

    def _retry(self, change) -> dict:
        for _ in range(ATTEMPTS):
            base = self.manifest()
            runs = change(base["runs"])
            if runs is None:
                return base
            try:
                return self.commit(base, runs)
            except Conflict:
                continue
        raise Conflict(f"other writers committed {ATTEMPTS} times in between")

    def _added(self, run: dict | None):
        """The change that appends ``run``; raises TypeError if its columns don't go with those that are there."""

        def change(runs: list[dict]) -> list[dict] | None:
            if run:
                united([T.StructType.fromJson(r["schema"]) for r in [*runs, run] if "schema" in r])
            return [*runs, run] if run else None

        return change

    def _rows(self, runs: list[dict]) -> DataFrame:
        """The rows of ``runs`` in their united schema (read from the files where a manifest has none)."""
        files = [f"{self.path}/{f['path']}" for r in runs for f in r["files"]]
        if all("schema" in r for r in runs):
            return self.spark.read.schema(united([T.StructType.fromJson(r["schema"]) for r in runs])).parquet(*files)
        return self.spark.read.option("mergeSchema", "true").parquet(*files)

    # shards

    def _run(self, name: str, folder: str, tags: dict) -> dict | None:
        fs, path = hadoop_fs(self.spark, f"{self.path}/{folder}")
        if not fs.exists(path):
            return None
        files = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(path) if s.getPath().getName().startswith("part-"))
        files = [{"path": f"{folder}/{n}", "bytes": b} for n, b in files]
        return {"name": name, "bytes": sum(f["bytes"] for f in files), "files": files, **tags} if files else None

    def append(self, rows: DataFrame, tags: dict | None = None) -> dict:
        """Writes one arrival as a run of the shards its partitions make, and commits it."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return self._retry(self._added(self._run(name, f"data/{name}", {**(tags or {}), "schema": rows.schema.jsonValue()})))

    def append_batches(self, rows: DataFrame, batch_col: str) -> dict:
        """Writes all arrivals (values of ``batch_col``; null is one of them) in one job; each becomes a run and a version of its own, in order."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/data/{name}"
        by = fresh("_batch", rows)
        rows.withColumn(by, F.col(batch_col)).write.partitionBy(by).parquet(folder)
        fs, path = hadoop_fs(self.spark, folder)
        batches = sorted((s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()), key=lambda x: (len(x), x))
        made = self.manifest()
        for batch in batches:
            run = self._run(f"{name}-{batch}", f"data/{name}/{batch}", {"batch": batch.partition("=")[2], "schema": rows.schema.jsonValue()})
            made = self._retry(self._added(run))
        return made

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(1, size) / (1 << 20), RATIO)) + 1) if size >= 1 << 20 else 0

    def compact(self) -> dict:
        """Merges while a tier holds ``fan_in`` runs; the newest manifest."""
        while True:
            base = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for run in base["runs"]:
                tiers.setdefault(self.tier(run["bytes"]), []).append(run)
            due = next((own for _, own in sorted(tiers.items()) if len(own) >= self.fan_in), None)
            if due is None:
                return base
            merged = self._merge(due)
            gone = {r["name"] for r in due}

            def change(runs, merged=merged, gone=gone):
                if not gone <= {r["name"] for r in runs}:
                    return None  # another compaction took these runs
                return [merged, *(r for r in runs if r["name"] not in gone)]

            made = self._retry(change)
            if merged["name"] not in {r["name"] for r in made["runs"]}:  # start again; nobody has seen the shards
                fs, path = hadoop_fs(self.spark, f"{self.path}/data/{merged['name']}")
                fs.delete(path, True)

    def _merge(self, runs: list[dict]) -> dict:
        name, total = uuid.uuid4().hex, sum(r["bytes"] for r in runs)
        rows = self._rows(runs)
        rows.coalesce(max(1, round(total / self.target))).write.parquet(f"{self.path}/data/{name}")
        return self._run(name, f"data/{name}", {"merged": [r["name"] for r in runs], "schema": rows.schema.jsonValue()})

    def vacuum(self) -> int:
        """Deletes shards that the newest manifest does not list (readers of older versions must be done); their number."""
        listed = {f["path"] for r in self.manifest()["runs"] for f in r["files"]}
        fs, folder = hadoop_fs(self.spark, f"{self.path}/data")
        base, found, n = fs.makeQualified(folder).toString(), fs.listFiles(folder, True), 0
        while found.hasNext():
            path = found.next().getPath()
            inside = "data" + path.toString().split(base, 1)[1]
            if path.getName().startswith("part-") and inside not in listed:
                fs.delete(path, False)
                n += 1
        return n

    def read(self, version: int | None = None) -> DataFrame:
        runs = self.manifest(version)["runs"]
        if not runs:
            raise FileNotFoundError(f"{self.path} has no shard")
        return self._rows(runs)


def shard_round_trip(docs: DataFrame, batch_col: str, target_bytes: int = TARGET) -> DataFrame:
    """Appends ``docs`` as the arrivals that ``batch_col`` names, compacts, deletes what was replaced, and reads the store."""
    spark = docs.sparkSession
    store = ShardStore(spark, shared_path(spark, "shards"), target_bytes)
    store.append_batches(docs, batch_col)
    store.compact()
    store.vacuum()
    return store.read() if store.manifest()["runs"] else docs.limit(0)
