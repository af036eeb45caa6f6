"""WARC archives as a Spark data source.

``spark.dataSource.register(WarcSource)`` makes the format ``warc``:

* ``df.write.format("warc").mode("append").save(uri)`` writes rows (page_id, url,
  record_type, refers_to, payload_digest, payload_length, payload) as records.
  Tasks write files under unique names; the commit lists those that count in a
  manifest, so a task that runs again leaves nothing behind that is read.  Each
  record is a gzip member of its own with the standard's skip lengths (``sl``).
  The option ``date`` is the records' WARC-Date (by default, when the write began).
* ``spark.read.format("warc").load(uri)`` plans byte ranges of the files, which the
  writer marks at record boundaries, parses each record's headers first, and reads
  a payload only if the record passes all pushed predicates and the option
  ``payload`` is not ``false``; otherwise it seeks past the record, without inflating
  more than its head.  Predicates on the columns are pushed by Spark; the option
  ``header.<name>`` asks for records whose header of that name has the given value.
  Plain ``.warc`` files are read too.

Paths are URIs that pyarrow's file systems open (file, hdfs, s3, gs, ...).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from corpuslens.llm.store import fresh_path, join_hot, settle, table

SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, "
    "payload_length long, headers map<string,string>, payload binary"
)
ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ]
)
VERSION = b"WARC/1.1\r\n"
MANIFEST = "_manifest"
FILE_BYTES, SPLIT_BYTES, BATCH_BYTES = 256 << 20, 16 << 20, 4 << 20
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: Up to so many revisits (some 48 bytes each) are broadcast to the rows; more are joined.
BROADCAST_ROWS = 10_000
#: Fixed value: the profile of revisits with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TESTS = {
    EqualTo: lambda v, x: v == x,
    In: lambda v, x: v in x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
    StringStartsWith: lambda v, x: v.startswith(x),
    StringEndsWith: lambda v, x: v.endswith(x),
    StringContains: lambda v, x: x in v,
}


def urn(page_id, digest) -> str:
    """A record's id: of page and payload, so that only rows equal in both share one."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(ident: str | None) -> int | None:
    """The page in a record's id."""
    if not ident or not ident.startswith("<urn:page:"):
        return None
    page = ident[10:-1].split(":")[0]
    return int(page) if page else None


def record(date: str, page_id, url, kind, refers_to, digest, length, payload: bytes | None) -> bytes:
    """One record; line breaks in a url are percent-encoded, as headers are lines."""
    block = b""
    if kind == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload or b"")
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {urn(page_id, digest)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {length}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {urn(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: A gzip header with one extra field, and the skip-lengths field in it.
GZIP_HEAD, SKIP_FIELD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", struct.Struct("<H2sHII")


def member(data: bytes) -> bytes:
    """A gzip member that says how long it is, and how long its contents are."""
    body = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    size = len(GZIP_HEAD) + SKIP_FIELD.size + len(packed) + 8
    return GZIP_HEAD + SKIP_FIELD.pack(12, b"sl", 8, size, len(data)) + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Record:
    """A record at a place in a file: its headers at once, its block on request."""

    def __init__(self, f, at: int, name: str):
        f.seek(at)
        first = f.read(2048)
        self.f, self.at, self.rest, self.stop = f, at, None, None
        if first[:2] == b"\x1f\x8b":
            self.inflate = zlib.decompressobj(31)
            if first.startswith(GZIP_HEAD[:4]) and first[12:14] == b"sl":
                self.stop = at + SKIP_FIELD.unpack_from(first, 10)[3]
                first = first[: self.stop - at]
            self.seen = bytearray(self.inflate.decompress(first, 4096))
            grow = lambda: self.inflate.decompress(self.inflate.unconsumed_tail or f.read(8192), 8192)
        else:
            self.inflate, self.seen = None, bytearray(first)
            grow = lambda: f.read(8192)
        while (end := self.seen.find(b"\r\n\r\n")) < 0:
            more = grow()
            if not more:
                raise ValueError(f"{name}: no header end after {at}")
            self.seen += more
        if not self.seen.startswith(b"WARC/1."):
            raise ValueError(f"{name}: no record at {at}")
        self.headers = dict(line.split(": ", 1) for line in self.seen[:end].decode().split("\r\n")[1:] if ": " in line)
        self.begin, self.length = end + 4, int(self.headers["Content-Length"])
        if self.inflate is None:
            self.stop = at + self.begin + self.length + 4

    def block(self) -> bytes:
        """The record's block; inflates what is left of a gzip member."""
        need = self.begin + self.length
        while len(self.seen) < need:
            if self.inflate is None:
                self.seen += self.f.read(need - len(self.seen))
            else:
                self.seen += self.inflate.decompress(self.inflate.unconsumed_tail or self.f.read(1 << 16), need + 4 - len(self.seen))
        return bytes(memoryview(self.seen)[self.begin : need])

    def end(self) -> int:
        """Where the next record begins; a member without skip lengths is read to its end."""
        while self.stop is None:
            if self.inflate.eof:
                self.stop = self.f.tell() - len(self.inflate.unused_data)
            else:
                self.inflate.decompress(self.inflate.unconsumed_tail or self.f.read(1 << 16), 1 << 20)
        return self.stop


@dataclass
class Files(WriterCommitMessage):
    names: list
    splits: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, date: str | None):
        self.uri, self.date = uri, date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator) -> Files:
        store, root = fs.FileSystem.from_uri(self.uri)
        store.create_dir(root, recursive=True)
        names, splits, out, size = [], [], None, 0
        for batch in iterator:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_length", "payload")), strict=True):
                if out is not None and size >= FILE_BYTES:
                    out.close()
                    out = None
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    splits.append([0])
                    out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                if size - splits[-1][-1] >= SPLIT_BYTES:
                    splits[-1].append(size)
                data = member(record(self.date, *row))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            for s in splits[-1:]:
                s.append(size)
        return Files(names, splits)

    def commit(self, messages) -> None:
        store, root = fs.FileSystem.from_uri(self.uri)
        store.create_dir(root, recursive=True)
        files = {n: s for m in messages if m is not None for n, s in zip(m.names, m.splits, strict=True)}
        with store.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        store, root = fs.FileSystem.from_uri(self.uri)
        for name in [n for m in messages if m is not None for n in m.names]:
            store.delete_file(f"{root}/{name}")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


class WarcReader(DataSourceReader):
    def __init__(self, uri: str, with_payload: bool, headers: dict[str, str]):
        self.uri, self.with_payload, self.headers, self.tests = uri, with_payload, headers, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in (None, "payload", "headers"):
                yield f
            elif isinstance(f, IsNotNull):
                self.tests.append((name, "set", None))
            elif isinstance(f, IsNull):
                self.tests.append((name, "null", None))
            elif type(f) in TESTS:
                self.tests.append((name, type(f), f.value))
            else:
                yield f

    def partitions(self):
        """Byte ranges between marked record boundaries; files without marks are read whole."""
        store, root = fs.FileSystem.from_uri(self.uri)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        manifests = [f.path for f in found if f.base_name.startswith(MANIFEST)]
        marks = {}
        for path in manifests:
            with store.open_input_stream(path) as f:
                marks |= json.loads(f.read())
        names = {f.path: marks.get(f.base_name) for f in found if f.base_name.endswith((".warc", ".warc.gz")) and (not manifests or f.base_name in marks)}
        sizes = {f.path: f.size for f in found}
        out = []
        for path, cuts in sorted(names.items()):
            ends = [*(cuts or [0])]
            if ends[-1] != sizes[path]:
                ends.append(sizes[path])
            out += [Range(path, a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return out or [Range("", 0, 0)]

    def wanted(self, row: dict) -> bool:
        """Whether a record passes the pushed predicates; null passes none but IS NULL."""
        if self.headers:
            own = {k.lower(): v for k, v in row["headers"]}
            if any(own.get(k) != v for k, v in self.headers.items()):
                return False
        for name, test, value in self.tests:
            v = row[name]
            if test == "null":
                if v is not None:
                    return False
            elif v is None or test != "set" and not TESTS[test](v, value):
                return False
        return True

    def read(self, partition: Range):
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.uri)
        rows, held = [], 0
        with store.open_input_file(partition.path) as f:
            at = partition.start
            while at < partition.stop:
                found = Record(f, at, partition.path)
                headers = found.headers
                row = {
                    "page_id": page_of(headers.get("WARC-Record-ID")),
                    "url": headers.get("WARC-Target-URI"),
                    "record_type": headers["WARC-Type"],
                    "refers_to": page_of(headers.get("WARC-Refers-To")),
                    "payload_digest": headers.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None,
                    "payload_length": int(headers["X-Payload-Length"]) if "X-Payload-Length" in headers else None,
                    "headers": list(headers.items()),
                    "payload": None,
                }
                if self.wanted(row):
                    if self.with_payload and found.length:
                        body = found.block()
                        row["payload"] = body[body.index(b"\r\n\r\n") + 4 :]
                        held += found.length
                    rows.append(row)
                    held += 500
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, held = [], 0
                at = found.end()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class WarcSource(DataSource):
    """The format ``warc``; options: path, payload (``false`` leaves payloads unread), header.<name>, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        headers = {k.lower().removeprefix("header."): v for k, v in self.options.items() if k.lower().startswith("header.")}
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", headers)

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date"))


def register(spark: SparkSession) -> None:
    """Make the format known to the session and allow predicates to reach it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_roles(pages: DataFrame, least: int = LEAST_REVISIT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows to write: of equal payloads of at least ``least`` bytes, the smallest page_id holds the payload.

    Null html counts as empty.  Rows that repeat a page_id and payload are all
    responses if their page_id is the smallest; a row with a null page_id is a
    response and never referred to.  Columns other than page_id, url and
    html, whatever their names, are ignored; an empty table gives no rows.

    Only ids and digests are shuffled to find the revisits.  These few rows are broadcast
    to the pages if they are at most ``broadcast_rows``, or else joined."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"))
    digest = F.unhex(F.sha2("payload", 256)).alias("digest")
    narrow = settle(rows.select("page_id", digest, F.length("payload").cast("long").alias("payload_length")), "payloads")
    first = narrow.filter(F.col("payload_length") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n_same"))
    shared = settle(first.filter("first < last").select("digest", "first", "n_same"), "shared-payloads")
    revisits = settle(
        join_hot(narrow, shared, "digest", "n_same", shared.agg(F.sum("n_same")).first()[0] or 0).filter("page_id != first")
        .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").dropDuplicates(["p", "d"]),
        "revisits",
    )
    few = revisits.limit(broadcast_rows + 1).count() <= broadcast_rows
    small = F.broadcast(revisits) if few else revisits.hint("merge")
    own = rows.withColumn("digest", digest)
    joined = own.join(small, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left")
    held = F.col("first").isNull()
    return joined.select(
        "page_id",
        "url",
        F.when(held, "response").otherwise("revisit").alias("record_type"),
        F.col("first").alias("refers_to"),
        F.lower(F.hex("digest")).alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_length"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.when(held, F.col("payload")).alias("payload"),
    )


def described(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records of the archives.

    Responses are read with their payloads, which are measured; of revisits, picked by
    a pushed predicate, only headers are read."""
    own = spark.read.format("warc").load(folder).filter("record_type = 'response'")
    payload = F.coalesce("payload", F.lit(b""))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    held = own.withColumn("payload_bytes", F.length(payload).cast("long")).withColumn("payload_digest", F.sha2(payload, 256)).select(columns)
    other = spark.read.format("warc").option("payload", "false").load(folder).filter("record_type = 'revisit'")
    return held.unionByName(other.withColumnRenamed("payload_length", "payload_bytes").select(columns))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all of ``pages`` as WARC records, and describe each from the archives."""
    register(spark)
    folder = fresh_path(spark, "warc")
    with_roles(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(folder)
    return described(spark, folder)


OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
