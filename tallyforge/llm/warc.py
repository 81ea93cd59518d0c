"""WARC archives as a PySpark data source, ``spark.read.format("warc")``.

Files are planned as partitions of whole records; predicates on headers are
pushed down to the reader, which parses a record's headers first and skips the
payloads that nobody asked for. Written archives compress each record for
itself and say in the gzip header how long it is, so that skipping is seeking.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_path, settle, table

SCHEMA = "record_id string, record_type string, date string, target_uri string, payload_digest string, refers_to string, payload_length bigint, payload binary"
#: Header lines (fixed by the format) of the columns; the payload's length is an extension.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_length": "X-Payload-Length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Bytes of archives that make a partition; more where there would be over MOST partitions.
SPLIT, MOST = 4 << 20, 20_000
#: Bytes that are read to parse headers.
PEEK = 2048
#: Bytes that are passed before they are let go, and that a member is inflated by in one step.
KEPT = 1 << 20
MANIFEST = "_manifest-"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


def _line(value: str) -> str:
    """No header value can end its line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict, date: str) -> bytes:
    """A response record, or a revisit record without its payload."""
    revisit = row["record_type"] == "revisit"
    payload = row["payload"] or b""
    block = HTTP if revisit else HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_line(row['record_id'])}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_line(row['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if revisit:
        lines += [f"WARC-Refers-To: <{_line(row['refers_to'])}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(record: bytes, level: int) -> bytes:
    """A gzip member of one record, its lengths in the extra field "sl" (skip lengths)."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    size = 24 + len(body) + 8
    if max(size, len(record)) >= 1 << 32:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(record)) + body + tail


@dataclass
class Committed(ds.WriterCommitMessage):
    file: dict | None


class WarcWriter(ds.DataSourceArrowWriter):
    """One file per task. Only files that the job's manifest lists exist for readers, so those of lost or repeated tasks don't."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.level, self.date = int(options.get("level", 3)), options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        fs, root = _filesystem(self.path)
        fs.create_dir(root)
        name, starts, at, out = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0, None
        for batch in iterator:
            for row in batch.to_pylist():
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record_bytes(row, self.date), self.level)
                if at - starts[-1] >= SPLIT:
                    starts.append(at)
                out.write(data)
                at += len(data)
        if out is None:
            return Committed(None)
        out.close()
        return Committed({"name": name, "size": at, "starts": starts})

    def commit(self, messages: list[Committed | None]) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root)
        old = _manifests(fs, root) if self.overwrite else []
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([m.file for m in messages if m and m.file]).encode())
        for manifest in old:
            files = json.loads(fs.open_input_stream(manifest).read())
            fs.delete_file(manifest)
            for f in files:
                fs.delete_file(f"{root}/{f['name']}")

    def abort(self, messages: list[Committed | None]) -> None:
        fs, root = _filesystem(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{root}/{m.file['name']}")


def _manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith(MANIFEST))


@dataclass
class Spans(ds.InputPartition):
    """(file, first byte, end) of whole records."""

    spans: list[tuple[str, int, int]]


#: Predicates that the reader takes; each is asked of a header's value.
_TESTS = {
    ds.EqualTo: lambda v, x: v is not None and v == x,
    ds.EqualNullSafe: lambda v, x: v == x,
    ds.In: lambda v, x: v is not None and v in x,
    ds.GreaterThan: lambda v, x: v is not None and v > x,
    ds.GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
    ds.LessThan: lambda v, x: v is not None and v < x,
    ds.LessThanOrEqual: lambda v, x: v is not None and v <= x,
    ds.StringStartsWith: lambda v, x: v is not None and v.startswith(x),
    ds.StringContains: lambda v, x: v is not None and x in v,
    ds.IsNotNull: lambda v, _: v is not None,
    ds.IsNull: lambda v, _: v is None,
}


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema = options["path"].rstrip("/"), schema
        self.split, self.verify = int(options.get("splitBytes", SPLIT)), str(options.get("verify", "false")).lower() == "true"
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[ds.Filter]):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Spans]:
        fs, root = _filesystem(self.path)
        spans, one = [], fs.get_file_info(root)
        for manifest in [] if one.is_file else _manifests(fs, root):
            for f in json.loads(fs.open_input_stream(manifest).read()):
                spans += [(f"{root}/{f['name']}", a, b) for a, b in zip(f["starts"], [*f["starts"][1:], f["size"]], strict=True)]
        if not spans:  # archives of others
            files = [one] if one.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
            spans = [(f.path, 0, f.size) for f in sorted(files, key=lambda f: f.path) if f.is_file and f.path.endswith((".warc", ".warc.gz"))]
        most = max(self.split, sum(b - a for _, a, b in spans) // MOST)
        out, size = [], most
        for s in spans:
            if size >= most:
                out.append(Spans([]))
                size = 0
            out[-1].spans.append(s)
            size += s[2] - s[1]
        return out

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        names = self.schema.names
        kinds = {f.name: pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() for f in self.schema}
        fs, _ = _filesystem(self.path)
        rows: list[dict] = []
        size = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[c]) for c in names], names=names)

        for path, start, end in partition.spans if partition else ():
            with fs.open_input_file(path) as f:
                for row in self._records(f, start, end, "payload" in names or self.verify):
                    rows.append(row)
                    size += len(row.get("payload") or b"") + 200
                    if size >= 4 << 20:
                        yield flush()
                        rows, size = [], 0
        if rows:
            yield flush()

    def _records(self, f: pa.NativeFile, start: int, end: int, payloads: bool) -> Iterator[dict]:
        at = start
        while at < end:
            f.seek(at)
            packed = f.read(2) == b"\x1f\x8b"
            source = _Member(f, at) if packed else _Plain(f, at, end)
            while (head := source.head()) is not None:
                headers = _parsed(head)
                if not headers.get("content-length", "").isdigit():
                    raise ValueError(f"the record in or after byte {at} has no Content-Length")
                size, row = int(headers["content-length"]), _row(headers)
                if not all(_TESTS[kind](row.get(c), x) for kind, c, x in self.tests):
                    source.skip(size)
                    continue
                if payloads and row["record_type"] != "revisit":
                    row["payload"] = _payload(headers, source.take(size))
                    if self.verify and row.get("payload_digest") and row["payload_digest"] != base32_sha1(row["payload"]):
                        raise ValueError(f"{row['record_id']}: the payload doesn't have its digest")
                    if row["payload_length"] is None:
                        row["payload_length"] = len(row["payload"])
                else:
                    source.skip(size)
                yield row
            at = source.end()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _row(headers: dict[str, str]) -> dict:
    row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c] and row[c].strip("<>")
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    row["payload_length"] = int(row["payload_length"]) if row["payload_length"] is not None else None
    return row


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines[1:]) if colon}


_BLANK = re.compile(rb"[\r\n]*")


class _Plain:
    """The records of an archive that isn't compressed, from front to back; what is dropped isn't read.

    ``data`` holds what is read ahead, ``place`` where in it the next byte is:
    passing a record moves the place, and the front goes only now and then, so
    that time is linear in the records.
    """

    def __init__(self, f: pa.NativeFile, at: int, end: int):
        self.f, self.at, self.last, self.data, self.place = f, at, end, bytearray(), 0

    def held(self) -> int:
        return len(self.data) - self.place

    def more(self, size: int) -> bool:
        """Read on; false at the end."""
        at = self.at + self.held()
        self.f.seek(at)
        raw = self.f.read(max(0, min(size, self.last - at)))
        self.data += raw
        return bool(raw)

    def head(self) -> bytes | None:
        """The next record's headers, or None if there is no further one."""
        seen = 0
        while True:
            if not seen:
                self._pass(_BLANK.match(self.data, self.place).end() - self.place)
            if self.data.startswith(b"\x1f\x8b", self.place):
                return None  # a compressed part follows
            if (end := self.data.find(b"\r\n\r\n", self.place + max(0, seen - 3))) >= 0:
                return self.take(end + 4 - self.place)[:-4]
            seen = self.held()
            if not self.more(PEEK):
                if self.held():
                    raise ValueError(f"headers at byte {self.at} have no end")
                return None

    def take(self, size: int) -> bytes:
        while self.held() < size and self.more(size - self.held()):
            pass
        if self.held() < size:
            raise ValueError(f"the record at byte {self.at} is cut off")
        out = bytes(memoryview(self.data)[self.place : self.place + size])
        self._pass(size)
        return out

    def _pass(self, size: int) -> None:
        """Go on by ``size`` bytes, which may lie beyond what is held."""
        self.at, self.place = self.at + size, self.place + size
        if self.place >= len(self.data):
            self.data, self.place = bytearray(), 0
        elif self.place > max(KEPT, len(self.data) // 2):
            del self.data[: self.place]
            self.place = 0

    def skip(self, size: int) -> None:
        """Pass a payload."""
        self._pass(size)

    def end(self) -> int:
        return self.at


class _Member(_Plain):
    """The records of one gzip member, inflated at most KEPT bytes a step.

    A skip length tells where the member ends and how long its content is, so
    that the last record's payload need not be unpacked to pass it.
    """

    def __init__(self, f: pa.NativeFile, at: int):
        super().__init__(f, 0, 0)
        self.begin, self.raw, self.size, self.content = at, 0, None, None
        self.unpack = zlib.decompressobj(31)
        self.need(PEEK, PEEK)

    def need(self, size: int, inflated: int) -> bool:
        """Inflate so many bytes at most, of what is left of the last read or of ``size`` more."""
        raw = self.unpack.unconsumed_tail
        if not raw:
            self.f.seek(self.begin + self.raw)
            raw = self.f.read(size)
            if self.raw == 0 and len(raw) > 24 and raw[3] & 4 and raw[12:14] == b"sl":
                self.size, self.content = struct.unpack("<II", raw[16:24])
            self.raw += len(raw)
        before = len(self.data)
        self.data += self.unpack.decompress(raw, inflated)  # may still have some to give when all is read
        return bool(raw) or len(self.data) > before

    def more(self, size: int) -> bool:
        if self.content is not None and self.at + self.held() >= self.content or self.unpack.eof:
            return False
        if not self.need(min(max(size // 2, PEEK), KEPT), min(max(size, PEEK), KEPT)):
            raise ValueError(f"the gzip member at byte {self.begin} is cut off")
        return True

    def skip(self, size: int) -> None:
        if self.content is not None and self.at + size <= self.content <= self.at + size + 4:
            self._pass(self.content - self.at)  # nothing but blank lines follows
            return
        while size > self.held():
            size -= self.held()
            self._pass(self.held())
            if not self.more(size):
                raise ValueError(f"a record of the gzip member at byte {self.begin} is cut off")
        self._pass(size)

    def end(self) -> int:
        if self.size is not None:
            return self.begin + self.size
        while not self.unpack.eof:
            self._pass(self.held())
            self.more(KEPT)
        return self.begin + self.raw - len(self.unpack.unused_data)


class Warc(ds.DataSource):
    """Options: path; write: level, date; read: splitBytes, verify (payloads against their digests).

    The reader makes the columns of the schema it is given, by default SCHEMA;
    without the column payload no payload is decoded. Revisits have none.
    Archives of others may be plain, or gzip with any number of records a
    member; each of their files is one task, since nothing tells where a member
    begins. A record without a Content-Length, or one cut off, is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to the session, and let Spark push filters to Python readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def records(pages: DataFrame, *, id_: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Pages as WARC records (the columns of SCHEMA but date, and the payload's as binary).

    Of pages with equal payloads of at least ``least`` bytes the one of the
    largest id is a response and the others are revisits of it; smaller ones
    are all responses. A null payload is empty. Rows that repeat the id are all
    what that id is; rows with a null id are responses that nothing refers to.
    Equal payloads are told by SHA-256; a hot one is one row per task before
    the shuffle, and Spark can split it in the join.
    """
    body = pages.select(F.col(id_).alias("id"), F.col(url).alias("target_uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")).withColumn("key", F.sha2("payload", 256))
    first = settle(body.where(F.octet_length("payload") >= least).groupBy("key").agg(F.max("id").alias("first")), "responses")
    joined = body.join(first, "key", "left")
    revisit = F.col("id") != F.col("first")
    name = lambda c: F.concat(F.lit("urn:x-page:"), c.cast("string"))
    return joined.select(
        F.coalesce(name(F.col("id")), F.concat(F.lit("urn:x-none:"), F.col("key"))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        _base32(F.sha1("payload")).alias("payload_digest"),
        F.when(revisit, name(F.col("first"))).alias("refers_to"),
        "payload",
    )


def _base32(hex_: F.Column) -> F.Column:
    """Each five hex digits are four of base 32."""
    digits = F.array(*(F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))

    def four(i):
        n = F.conv(F.substr(hex_, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*(F.get(digits, F.shiftright(n, s).bitwiseAND(31)) for s in (15, 10, 5, 0)))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def write_archive(pages: DataFrame, path: str, *, date: str = "1970-01-01T00:00:00Z", level: int = 3, **columns) -> None:
    """Write a record per page to ``path``; see ``records``."""
    register(pages.sparkSession)
    records(pages, **columns).write.format("warc").option("date", date).option("level", level).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, columns: str = SCHEMA, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).options(**options).load(path)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page, from archives written and read back.

    The record type is pushed down twice: of responses every payload is decoded
    and verified against its digest; of revisits only the headers are parsed.
    """
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    headers = "record_id string, record_type string, payload_digest string, refers_to string, payload_length bigint"
    responses = read_archive(spark, path, headers + ", payload binary", verify="true").where("record_type = 'response'")
    revisits = read_archive(spark, path, headers).where("record_type = 'revisit'")
    back = responses.withColumn("payload_length", F.octet_length("payload").cast("long")).drop("payload").unionByName(revisits)
    id_ = lambda c: F.nullif(F.regexp_extract(c, "^urn:x-page:(-?[0-9]+)$", 1), F.lit("")).cast("long")
    return back.select(id_("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", id_("refers_to").alias("refers_to"))


OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4)::INT)) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
