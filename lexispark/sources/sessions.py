"""A session store as a log by key: histories (session_id, history, expires_at) with upserts and time to live.

Sessions are dealt over buckets by their hash. A save writes one small file of what it adds for each bucket that it touches,
and appends that file to the bucket's list; deleting and clearing append a mark. A list is published under the next version of
its bucket by a rename that fails if that version exists: readers see a whole list, writers of different buckets don't meet, and
of two writers of one bucket the second starts again from the first one's list. Readers merge a session's entries in
the order of the list. A bucket with more than MOST entries is compacted: they become one, without what has expired. What is
written is so in proportion to the sessions touched, and a look at one session reads its bucket alone.

A save is atomic for each bucket, hence for each session, not over all of them. The last KEPT lists of a bucket and their files
stay for readers that have begun. Defined cases: turns without a language are left out; a null session id is never stored; a
session that has expired starts anew; clearing or deleting one that isn't there does nothing. For streams there is the
stateful form in ``streaming``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.context import HISTORY_TURNS

#: Buckets of a new store, entries of a bucket's list that start its compaction, lists that stay for readers, and times that a commit starts again.
BUCKETS, MOST, KEPT, ATTEMPTS = 64, 16, 3, 100
_TURNS = "array<struct<lang:string,confidence:double>>"
SCHEMA = f"session_id string, history {_TURNS}, expires_at timestamp"
_ENTRY = f"{SCHEMA}, entry string, kind string, at timestamp"


class SessionStore:
    def __init__(self, spark: SparkSession, path: str, max_turns: int = HISTORY_TURNS, ttl_seconds: int | None = None, buckets: int = BUCKETS):
        """buckets counts for a store that isn't there yet."""
        self.spark, self.path, self.max_turns, self.ttl = spark, path.rstrip("/"), max_turns, ttl_seconds
        self._buckets = buckets

    # files

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def _names(self, path: str) -> list[str]:
        fs, folder = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []

    def _text(self, path: str) -> str:
        fs, file = self._fs(path)
        stream = fs.open(file)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, path: str, text: str) -> bool:
        """Whether ``text`` became the file; False if another writer was first."""
        fs, temporary = self._fs(f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        target = jvm.org.apache.hadoop.fs.Path(path)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, target, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            fs.delete(temporary, False)
            if fs.exists(target):
                return False
            raise
        return True

    # lists of entries

    @property
    def buckets(self) -> int:
        """As the store was made."""
        name = f"{self.path}/buckets"
        fs, file = self._fs(name)
        if not fs.exists(file):
            self._publish(name, str(self._buckets))
        self._buckets = int(self._text(name))
        return self._buckets

    def _versions(self, bucket: int) -> list[int]:
        return sorted(int(n[1:]) for n in self._names(f"{self.path}/lists/{bucket:05d}") if n.startswith("v"))

    def _list(self, bucket: int, version: int) -> list[str]:
        return json.loads(self._text(self._name(bucket, version))) if version else []

    def _name(self, bucket: int, version: int) -> str:
        return f"{self.path}/lists/{bucket:05d}/v{version:020d}"

    def _commit(self, bucket: int, change: Callable[[list[str]], list[str] | None]) -> bool:
        """Publishes ``change`` of the bucket's list, again from the start where another writer was first; False if it has become void."""
        for _ in range(ATTEMPTS):
            version = (self._versions(bucket) or [0])[-1]
            new = change(self._list(bucket, version))
            if new is None:
                return False
            if self._publish(self._name(bucket, version + 1), json.dumps(new)):
                self._sweep(bucket)
                return True
        raise RuntimeError(f"other writers committed {ATTEMPTS} times in between")

    def _sweep(self, bucket: int) -> None:
        """Deletes lists that are no longer kept, and entries that only these have."""
        versions = self._versions(bucket)
        needed = {e for v in versions[-KEPT:] for e in self._list(bucket, v)}
        for old in versions[:-KEPT]:
            for entry in set(self._list(bucket, old)) - needed:
                fs, folder = self._fs(self._folder(entry, bucket))
                fs.delete(folder, True)
            fs, file = self._fs(self._name(bucket, old))
            fs.delete(file, False)

    def _folder(self, entry: str, bucket: int) -> str:
        return f"{self.path}/data/{entry}/bucket={bucket}"

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """(entry, its buckets) of rows (session_id, history, expires_at, kind)."""
        entry = uuid.uuid4().hex
        told = rows.withColumns({"entry": F.lit(entry), "at": F.current_timestamp(), "bucket": self._bucket(F.col("session_id"))})
        told.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{entry}")
        return entry, sorted(int(n.partition("=")[2]) for n in self._names(f"{self.path}/data/{entry}") if n.startswith("bucket="))

    def _append(self, rows: DataFrame) -> None:
        entry, touched = self._write(rows)
        for bucket in touched:
            self._commit(bucket, lambda entries: [*entries, entry])
        self.compact([b for b in touched if len(self._list(b, self._versions(b)[-1])) > MOST])

    def _bucket(self, session_id: Column) -> Column:
        return F.pmod(F.xxhash64(session_id), F.lit(self.buckets)).cast("int")

    # merging

    def _merged(self, lists: dict[int, list[str]]) -> DataFrame:
        """The sessions that entries make, whether or not they have expired by now."""
        paths = [self._folder(e, b) for b, own in lists.items() for e in own]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        places = self.spark.createDataFrame([(b, e, i) for b, own in lists.items() for i, e in enumerate(own)], "bucket int, entry string, place int")
        rows = self.spark.read.schema(_ENTRY).parquet(*paths).withColumn("bucket", self._bucket(F.col("session_id")))
        rows = rows.join(F.broadcast(places), ["bucket", "entry"])  # at most MOST and a few more for each bucket
        own = rows.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("place", "kind", "history", "expires_at", "at"))).alias("own"))
        none, never = F.array().cast(_TURNS), F.lit(None).cast("timestamp")
        state = lambda there, history, until: F.struct(there.alias("there"), history.alias("history"), until.alias("expires_at"))

        def step(held: Column, x: Column) -> Column:
            alive = held["there"] & F.coalesce(held["expires_at"] > x["at"], F.lit(True))
            longer = F.concat(F.when(alive, held["history"]).otherwise(none), x["history"])
            kept = F.slice(longer, F.greatest(F.size(longer) - (self.max_turns - 1), F.lit(1)), self.max_turns)
            gone = state(F.lit(False), none, never)
            cleared = F.when(alive, state(F.lit(True), none, held["expires_at"])).otherwise(gone)
            added = state(F.lit(True), F.when(x["kind"] == "state", x["history"]).otherwise(kept), x["expires_at"])
            return F.when(x["kind"] == "delete", gone).when(x["kind"] == "clear", cleared).otherwise(added)

        folded = own.select("session_id", F.aggregate("own", state(F.lit(False), none, never), step).alias("s"))
        return folded.filter("s.there").select("session_id", "s.history", "s.expires_at")

    def _alive(self, buckets: list[int]) -> DataFrame:
        lists = {b: self._list(b, (self._versions(b) or [0])[-1]) for b in buckets}
        return self._merged(lists).filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.current_timestamp()))

    def compact(self, buckets: list[int] | None = None) -> None:
        """Makes one entry of all entries of the buckets (all that have several by default)."""
        every = range(self.buckets) if buckets is None else buckets
        lists = {b: own for b in every if len(own := self._list(b, (self._versions(b) or [0])[-1])) > 1}
        if not lists:
            return
        rows = self._merged(lists).filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.current_timestamp()))
        entry, made = self._write(rows.withColumn("kind", F.lit("state")))
        for bucket, own in lists.items():
            new = [entry] if bucket in made else []
            if not self._commit(bucket, lambda entries, own=own, new=new: [*new, *entries[len(own) :]] if entries[: len(own)] == own else None):
                fs, folder = self._fs(self._folder(entry, bucket))  # another compaction was first
                fs.delete(folder, True)

    # sessions

    def sessions(self) -> DataFrame:
        """Those that have not expired."""
        return self._alive(list(range(self.buckets)))

    def save(self, turns: DataFrame) -> None:
        """turns: (session_id, turn, lang, confidence), joined to the stored histories; the last ``max_turns`` with a language stay."""
        rows = turns.filter((F.coalesce("lang", F.lit("")) != "") & F.col("session_id").isNotNull())
        fresh = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "lang", "confidence"))).alias("own"))
        last = F.slice("own", F.greatest(F.size("own") - (self.max_turns - 1), F.lit(1)), self.max_turns)
        until = F.timestamp_seconds(F.unix_timestamp(F.current_timestamp()) + self.ttl) if self.ttl else F.lit(None).cast("timestamp")
        history = F.transform(last, lambda t: F.struct(t["lang"].alias("lang"), t["confidence"].cast("double").alias("confidence")))
        self._append(fresh.select("session_id", history.alias("history"), until.alias("expires_at"), F.lit("turns").alias("kind")))

    def _mark(self, session_id: str, kind: str) -> None:
        self._append(self.spark.createDataFrame([(session_id, [], None, kind)], f"{SCHEMA}, kind string"))

    def load(self, session_id: str) -> list[tuple[str, float]] | None:
        """The session's history, from its bucket alone."""
        bucket = self.spark.createDataFrame([(session_id,)], "s string").select(self._bucket(F.col("s"))).first()[0]
        row = self._alive([bucket]).filter(F.col("session_id") == session_id).first()
        return None if row is None else [(t["lang"], t["confidence"]) for t in row["history"]]

    def exists(self, session_id: str) -> bool:
        return self.load(session_id) is not None

    def delete(self, session_id: str) -> None:
        self._mark(session_id, "delete")

    def clear(self, session_id: str) -> None:
        """Forgets the session's turns; the session itself and its time to live stay."""
        self._mark(session_id, "clear")
