"""WARC archives as a PySpark data source, and an archiver that stores equal payloads once.

Reading: ``spark.read.format("warc")`` plans one partition per run of files, takes filters on the record type and
other headers from Spark, parses a record's headers first, and passes over the payloads of records that are
filtered out or of which only headers are wanted. Files may be plain, have one gzip member per record, or be compressed
as a whole; members
written here carry their compressed size in a gzip extra field, so that a skipped member is not even inflated
beyond its headers. Writing: ``df.write.format("warc")`` makes one archive per task, under a temporary name until it is
complete; the job's commit gives the files their names, so a lost executor leaves nothing half-written to be read.

Files are reached through pyarrow's file systems, so paths may be local or in a store the executors share.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import checkpoint, hot_join, join_checked, shared_path

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, content_type string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Columns on which a filter is decided from a record's headers alone, and their headers.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: Bytes of a file that are read at a time; a record is held whole only while its payload is wanted.
BLOCK = 1 << 20
#: Records whose columns are handed to Spark at once, by payload bytes.
BATCH = 4 << 20


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- records -----------------------------------------------------------------------------------------------------


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with the subfield "sl": its compressed and its plain size."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = b"sl" + struct.pack("<HII", 8, (size := len(body) + 10 + 14 + 8) & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    assert size == 10 + 2 + len(extra) + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: str | None) -> str | None:
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def web_record(record_id: str, uri: str | None, date: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response with its HTTP block, or a revisit (identical payload digest) of which only the HTTP headers are kept."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", _clean(uri)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
        return record(headers, http)
    return record(headers, http + payload)


# --- reading -----------------------------------------------------------------------------------------------------


class _Input:
    """Bytes of one file: plain, or the inflated gzip members one after another; ``skip`` passes over what isn't wanted.

    Members and records need not coincide: a member may hold many records (a file compressed as a whole), and a
    record may go on in the next member. What is read stays in ``out`` until more is needed; ``at`` is the place in it.
    """

    def __init__(self, stream, gzipped: bool):
        self.stream, self.gzipped, self.raw, self.out, self.at, self.inflate = stream, gzipped, b"", b"", 0, None
        # Of the member: its place in the file, and its compressed and plain size if it tells.
        self.start, self.jump, self.plain, self.taken = 0, None, 0, 0

    def _member(self) -> bool:
        """At the start of the next member; False at the end of the file."""
        if not self.raw:
            self.raw = self.stream.read(1 << 16)
        if not self.raw:
            return False
        self.start, self.jump, self.taken = self.stream.tell() - len(self.raw), None, 0
        while len(self.raw) < 24 and (data := self.stream.read(1 << 16)):
            self.raw += data
        if self.raw[3:4] == b"\x04" and self.raw[12:16] == b"sl\x08\0":
            self.jump, self.plain = struct.unpack("<II", self.raw[16:24])
        self.inflate = zlib.decompressobj(31)
        return True

    def _more(self) -> bool:
        """Adds to ``out``; False at the end of the file."""
        if not self.gzipped:
            return self._add(self.stream.read(BLOCK))
        if (self.inflate is None or self.inflate.eof) and not self._member():
            return False
        data = self.raw or self.stream.read(1 << 16)
        if not data:
            raise ValueError("a gzip member ends too early")
        self._add(self.inflate.decompress(data, BLOCK))
        self.raw = self.inflate.unconsumed_tail or self.inflate.unused_data
        return True

    def _add(self, data: bytes) -> bool:
        """``out`` without what was taken, and ``data``: what is left is copied once a read, not once a record."""
        self.out, self.at = self.out[self.at :] + data, 0
        return bool(data)

    def _left(self) -> int:
        return len(self.out) - self.at

    def begin(self) -> bool:
        """At the next record; False at the end of the file."""
        while True:
            end = self.at
            while self.out[end : end + 1] in (b"\r", b"\n"):
                end += 1
            self._pass(end - self.at)
            if self._left():
                return True
            if not self._more():
                return False

    def _pass(self, n: int) -> None:
        self.at += n
        self.taken += n

    def until(self, mark: bytes) -> bytes:
        while (end := self.out.find(mark, self.at)) < 0:
            if not self._more():
                raise ValueError("a record's headers end too early")
        data = self.out[self.at : end]
        self._pass(end - self.at + len(mark))
        return data

    def take(self, n: int) -> bytes:
        parts, missing = [], n
        while missing > self._left():
            parts.append(self.out[self.at :])
            missing -= len(parts[-1])
            self.out, self.at = b"", 0
            if not self._more():
                raise ValueError("a record's block ends too early")
        parts.append(self.out[self.at : self.at + missing])
        self.at += missing
        self.taken += n
        return b"".join(parts)

    def skip(self, n: int) -> None:
        if self.gzipped and self.jump and self.taken + n + 4 == self.plain:  # the member's one record: straight to the next member
            self.stream.seek(self.start + self.jump)
            self.raw, self.out, self.at, self.inflate = b"", b"", 0, None
            return
        while n > self._left():
            n -= self._left()
            self.out, self.at = b"", 0
            if not self.gzipped:
                self.stream.seek(n, 1)
                return
            if not self._more():
                raise ValueError("a record's block ends too early")
        self._pass(n)


def read_records(stream, gzipped: bool, wanted, payload: str) -> Iterator[tuple]:
    """Rows of SCHEMA. wanted(headers) is asked before a block is touched; payload: full, digest or none."""
    source = _Input(stream, gzipped)
    while source.begin():
        lines = source.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        headers: dict[str, str] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        for key in ("warc-record-id", "warc-refers-to"):
            if key in headers:
                headers[key] = headers[key].strip("<>")
        if "warc-payload-digest" in headers:
            headers["warc-payload-digest"] = headers["warc-payload-digest"].removeprefix("sha1:")
        if not wanted(headers):
            source.skip(size)
            continue
        data, length, kind = None, None, headers.get("warc-type")
        http = headers.get("content-type", "").startswith("application/http")
        if payload == "none" and not (http and kind == "revisit"):
            source.skip(size)
        else:
            block = source.take(size)
            if http:
                head, _, block = block.partition(b"\r\n\r\n")
                if kind == "revisit":  # the payload's length is in the HTTP headers that are kept
                    length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            if kind != "revisit":
                length = len(block)
                headers["warc-payload-digest"] = base32_sha1(block)
                data = block if payload == "full" else None
        yield (*(headers.get(h) for h in HEADERS.values()), length, data)


@dataclass
class _Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.run = options["path"], options.get("payload", "full"), int(options.get("partitionbytes", 32 << 20))
        self.filters: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        """Equality and IN on columns that are headers are decided here, before a payload is read; others go back."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and not (f.attribute[0] == "payload_digest"):
                self.filters.append((f.attribute[0], tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self):
        fs, path = open_fs(self.path)
        info = fs.get_file_info(path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")))
        runs, size = [], 0
        for name, n in files:
            if not runs or size + n > self.run:
                runs.append([])
                size = 0
            runs[-1].append(name)
            size += n
        return [_Files(names) for names in runs] or [_Files([])]

    def read(self, partition):
        fs, _ = open_fs(self.path)
        tests = [(HEADERS[c], set(values)) for c, values in self.filters]
        wanted = lambda headers: all(headers.get(h) in values for h, values in tests)
        types = [pa.string()] * 7 + [pa.int64(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as stream:
                for row in read_records(stream, path.endswith(".gz"), wanted, self.payload):
                    rows.append(row)
                    size += 256 + len(row[-1] or b"")
                    if size > BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


# --- writing -----------------------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    """Rows of (record_id, target_uri, payload, payload_digest, refers_to); a revisit's payload is given but not stored."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.gzip = options["path"], overwrite, options.get("compression", "gzip") == "gzip"
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator):
        from pyspark import TaskContext

        fs, path = open_fs(self.path)
        task, name = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}"
        end = ".warc.gz" if self.gzip else ".warc"
        fs.create_dir(path, recursive=True)
        temporary, n = f"{path}/_{name}{end}.tmp", 0
        pack = member if self.gzip else bytes
        with fs.open_output_stream(temporary) as out:
            out.write(pack(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"software: lexispark\r\nformat: WARC File Format 1.1\r\n")))
            for batch in iterator:
                columns = {k: batch.column(k) for k in ("record_id", "target_uri", "payload", "payload_digest", "refers_to")}
                for i in range(batch.num_rows):
                    record_id, uri, payload, digest, refers_to = (c[i].as_py() for c in columns.values())
                    payload = payload or b""
                    out.write(pack(web_record(record_id, uri, self.date, payload, digest or base32_sha1(payload), refers_to)))
                    n += 1
        return _Written(temporary, f"{path}/part-{task:05d}-{name[5:13]}{end}", n)

    def commit(self, messages):
        fs, path = open_fs(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
                if f.is_file and f.path.endswith((".warc", ".warc.gz")):
                    fs.delete_file(f.path)
        for m in messages:
            if m is not None:
                fs.move(m.temporary, m.final)

    def abort(self, messages):
        fs, _ = open_fs(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(m.temporary).is_file:
                fs.delete_file(m.temporary)


class WarcDataSource(DataSource):
    """Options: path; reading: payload (full, digest: only its length and digest, none), partitionBytes; writing: compression (gzip, none), date."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# --- archiving pages ---------------------------------------------------------------------------------------------


def base32_column(hexed):
    """Bare base32 of 40 hex digits: each 40 bits are 8 digits of base 32, renamed."""
    groups = [F.translate(F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for i in range(4)]
    return F.concat(*groups)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str | None = "url", payload_col: str = "html", date: str | None = None) -> None:
    """Writes a record per row. Of equal payloads the row with the largest id is the response, the others revisit it.

    Only digests and ids are grouped. Rows that repeat the largest id are responses each; a null id is smaller than
    any other, and a response where all are null; a null payload is empty; extra columns are ignored.
    """
    uri = F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), uri.alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", base32_column(F.sha1("payload")))
    keys = rows.select("id", "payload_digest")
    most = keys.groupBy("payload_digest").agg(F.max("id").alias("response"), F.count("*").alias("n")).filter("n > 1")
    revisits = checkpoint(hot_join(keys, most.drop("n"), ["payload_digest"], ["id"], counts=most).filter("not id <=> response").select("id", "payload_digest", "response").distinct())
    rows = join_checked(rows.withColumn("k", F.coalesce("id", F.lit(-(1 << 63)))), revisits.select(F.coalesce("id", F.lit(-(1 << 63))).alias("k"), "payload_digest", "response"), ["k", "payload_digest"], "left", 96)
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    out = rows.select(urn("id").alias("record_id"), "target_uri", "payload", "payload_digest", F.when(F.col("response").isNotNull(), urn("response")).alias("refers_to"))
    register(pages.sparkSession)
    out.write.format("warc").option("path", path).option("date", date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")).mode("append").save()


def read_archive(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", payload).load()


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archives ``pages`` and reads the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to, url)."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    archive(pages, path)
    number = lambda c: F.expr(f"try_cast(substr({c}, 10) as bigint)")
    return read_archive(spark, path, payload="digest").filter(F.col("record_type").isin("response", "revisit")).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), F.col("target_uri").alias("url"))
