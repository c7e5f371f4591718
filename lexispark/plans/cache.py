"""Results of detection that outlive a call: a table by text hash and configuration, in files that all sessions share.

A cache is a folder. Results of each configuration are kept apart, by a fingerprint of all settings that bear on a result:

    config=<fingerprint>/batch-<uuid>/part-*.parquet     hash, the result's columns, made (when it was detected)

Each call appends one batch, with the results of texts that were not there. A batch counts once Spark has written its
``_SUCCESS``; what a writer that failed left is not read, and goes at the next compaction. Two writers that detect the same
text both append its result, which is the same; readers take the newest.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import __version__
from ..operators.fusion import text_hash, to_copies
from .config import Config, ConfigurationError
from .detect import RESULT, detect
from .keep import keep

#: Seconds after which a batch that was not finished is taken to be a failed writer's.
UNFINISHED = 86_400
_FOUND = "hash string, lang string, confidence double, raw_score double, reliable boolean, script string, backend string, reason string, candidates array<struct<lang:string,confidence:double,backend_votes:map<string,double>>>, made double"


def _told(value) -> object:
    """A setting as something that JSON holds; code is told by the name under which it can be imported."""
    if isinstance(value, dict):
        return {str(k): _told(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_told(v) for v in value]
    if isinstance(value, Callable):
        name = f"{value.__module__}.{getattr(value, '__qualname__', '')}"
        if not getattr(value, "__qualname__", "") or "<" in name:
            raise ConfigurationError(f"{value!r} has no name by which its results could be kept; give it one at the top of a module")
        return name
    return value


def fingerprint(config: Config, top_k: int = 1, hints: DataFrame | None = None, version: str = "") -> str:
    """Of all settings that bear on a result, the hints, the library's version and the caller's ``version`` of own backends."""
    settings = {f.name: _told(getattr(config, f.name)) for f in fields(config) if f.name != "once_per_text"}
    listed = None
    if hints is not None:
        row = hints.select("word", "lang").distinct().agg(F.count("*"), F.bit_xor(F.xxhash64("word", "lang")), F.bit_xor(F.xxhash64("lang", "word"))).first()
        listed = list(row)
    told = json.dumps([__version__, version, settings, top_k, listed], sort_keys=True)
    return hashlib.sha256(told.encode()).hexdigest()[:32]


class ResultCache:
    """max_age_seconds: older results are detected anew. max_rows: what compaction keeps of each configuration, the newest first.

    Rows of one call are equally old and stay or go together, so that compaction keeps at most ``max_rows``.
    """

    def __init__(self, spark: SparkSession, path: str, max_age_seconds: float | None = None, max_rows: int | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.max_age, self.max_rows, self.clock = spark, path.rstrip("/"), max_age_seconds, max_rows, clock

    # files

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _folders(self, path: str) -> list[str]:
        fs, place = self._fs(path)
        return sorted(f"{path}/{f.getPath().getName()}" for f in fs.listStatus(place) if f.isDirectory()) if fs.exists(place) else []

    def _whole(self, folder: str) -> bool:
        fs, place = self._fs(f"{folder}/_SUCCESS")
        return fs.exists(place)

    def _batches(self, key: str) -> list[str]:
        return [b for b in self._folders(f"{self.path}/config={key}") if self._whole(b)]

    def _append(self, found: DataFrame, key: str) -> str:
        batch = f"{self.path}/config={key}/batch-{uuid.uuid4().hex}"
        found.write.parquet(batch)
        return batch

    def _read(self, batches: list[str], now: float) -> DataFrame:
        """Results that are not too old at ``now``, the newest of each text."""
        rows = self.spark.read.schema(_FOUND).parquet(*batches) if batches else self.spark.createDataFrame([], _FOUND)
        if self.max_age is not None:
            rows = rows.filter(F.col("made") > now - self.max_age)
        if len(batches) < 2:
            return rows
        names = [n for n in rows.columns if n != "hash"]
        return rows.groupBy("hash").agg(F.max_by(F.struct(*names), "made").alias("r")).select("hash", "r.*")

    # use

    def detect(self, texts: DataFrame, config: Config | None = None, hints: DataFrame | None = None, top_k: int = 1, version: str = "") -> DataFrame:
        """What ``plans.detect.detect`` gives, and ``cached``: whether the result was there before this call.

        Each text that is not there is detected once and its result written before this returns. Only hashes meet the kept
        results; texts travel once, and of these only the ones to be detected go on. Where a side is small enough for it, Spark broadcasts
        it or filters the other by a Bloom filter of its hashes. Rows of one text, however many, are dealt over tasks.
        """
        config = config or Config()
        key = fingerprint(config, top_k, hints, version)
        rows = texts.select("id", "text")
        named = keep(rows.select("id", text_hash(F.col("text")).alias("hash")))
        asked = named.groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        before, now = self._batches(key), self.clock()
        known = self._read(before, now)
        new = keep(asked.join(known.select("hash"), "hash", "left_anti"))
        batches = before
        if not new.isEmpty():
            chosen = rows.join(new.select(F.col("first").alias("id")), "id", "left_semi").dropDuplicates(["id"])
            found = detect(chosen, config, hints=hints, top_k=top_k)
            found = found.join(new.select(F.col("first").alias("id"), "hash"), "id")
            made = F.lit(float(now))
            batches = [*before, self._append(found.select("hash", *[c for c in RESULT if c != "id"], made.alias("made")), key)]
        results = asked.join(self._read(batches, now), "hash").join(new.select("hash", F.lit(True).alias("new")), "hash", "left")
        held = results.select("hash", "n", *[c for c in RESULT if c != "id"], F.col("new").isNull().alias("cached"))
        return to_copies(named, held).select(*RESULT, "cached")

    def size(self, config: Config | None = None, **options) -> int:
        """Results that are kept of a configuration and not too old."""
        return self._read(self._batches(fingerprint(config or Config(), **options)), self.clock()).count()

    def compact(self) -> None:
        """Makes one batch of each configuration, without what is too old, more than ``max_rows``, or there twice.

        A reader that has begun before and reads on afterwards fails by missing files and must begin again.
        """
        for folder in self._folders(self.path):
            there = self._folders(folder)
            whole = [b for b in there if self._whole(b)]
            rows = self._read(whole, self.clock())
            if self.max_rows is not None:
                rows = self._newest(keep(rows))
            if whole:
                self._append(rows, folder.rsplit("config=", 1)[1])
            for batch in there:
                fs, place = self._fs(batch)
                if batch in whole or fs.getFileStatus(place).getModificationTime() < (time.time() - UNFINISHED) * 1000:
                    fs.delete(place, True)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The rows of the newest calls that come to ``max_rows`` at most; one count for each call is all that is sorted in one place."""
        calls = rows.groupBy("made").agg(F.count("*").alias("n"))
        newer = F.sum("n").over(Window.orderBy(F.desc("made")))
        since = calls.withColumn("all", newer).filter(F.col("all") <= self.max_rows).agg(F.min("made")).first()[0]
        return rows.filter(F.col("made") >= since) if since is not None else rows.limit(0)

    def clear(self) -> None:
        fs, place = self._fs(self.path)
        fs.delete(place, True)
