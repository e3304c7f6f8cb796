"""WARC archives as a PySpark data source (``format("warc")``), reading and writing.

The reader plans partitions of files, takes record-type and header predicates from
the query, parses a record's headers first and seeks over the payload of records
that are not wanted. In compressed archives it can do so because the writer states
each gzip member's length in the member's header, in the extra field ``SL``; members
of other writers are decompressed and thrown away. Only columns of the requested
schema are produced: without ``payload`` in it no payload is kept. The writer
compresses each record by itself, writes under a name of the task attempt, and
publishes files when the job commits.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from .common import read_table, shared_folder

#: Column -> WARC header it holds.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, refers_to string, "
    "payload_digest string, content_type string, block_length long, http_length long, payload binary"
)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18
#: Start of a gzip member whose extra field SL holds the lengths of the member and of its content.
_STATED = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<H", 8)
#: Keys over which the rows of one repeated payload are dealt.
SALTS = 16
_OF = {name.lower(): column for column, name in HEADERS.items()}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI or a plain path."""
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def archive_files(path: str) -> list[tuple[str, int]]:
    fs, at = filesystem(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path))


class _Plain:
    """Buffered reader that can pass over bytes without reading them."""

    def __init__(self, stream):
        self.stream, self.buffer = stream, b""

    def _more(self) -> bytes:
        return self.stream.read(CHUNK)

    def until(self, mark: bytes, most: int | None = None) -> bytes | None:
        """Bytes up to and including ``mark``; None if the file, or its next ``most`` bytes, hold none."""
        while (at := self.buffer.find(mark, 0, most)) < 0:
            more = b"" if most is not None and len(self.buffer) >= most else self._more()
            if not more:
                return None
            self.buffer += more
        out, self.buffer = self.buffer[: at + len(mark)], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n and (more := self._more()):
            parts.append(more)
            have += len(more)
        data = b"".join(parts)
        self.buffer = data[n:]
        return data[:n]

    def skip(self, n: int) -> None:
        have = min(n, len(self.buffer))
        self.buffer = self.buffer[have:]
        if n > have:
            self.stream.seek(self.stream.tell() + n - have)


class _Zipped(_Plain):
    """The same over concatenated gzip members; members that state their lengths are passed over unread."""

    def __init__(self, stream):
        super().__init__(stream)
        self.raw, self.member = b"", None

    def _begin(self) -> None:
        """Starts a member: where it ends in the file and how much is in it, if it says so."""
        if len(self.raw) < len(_STATED) + 8:
            self.raw += self.stream.read(CHUNK)
        self.end = self.left = None
        if self.raw.startswith(_STATED[:4]) and self.raw[10:16] == _STATED[10:]:
            size, self.left = struct.unpack("<II", self.raw[16:24])
            self.end = self.stream.tell() - len(self.raw) + size
        self.member = zlib.decompressobj(31)

    def _more(self) -> bytes:
        while True:
            if self.member is None:
                self._begin()
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    return b""
            out = self.member.decompress(self.raw, CHUNK)
            self.raw = self.member.unconsumed_tail
            if self.left is not None:
                self.left -= len(out)
            if self.member.eof:
                self.raw, self.member = self.member.unused_data, None
            if out:
                return out

    def skip(self, n: int) -> None:
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer = b""
            if self.member is not None and self.left is not None and n >= self.left:
                n -= self.left
                ahead = self.end - (self.stream.tell() - len(self.raw))
                self.raw = self.raw[ahead:] if ahead <= len(self.raw) else b""
                if not self.raw:
                    self.stream.seek(self.end)
                self.member = None
                if not n:
                    return
            self.buffer = self._more()
            if not self.buffer:
                return
        self.buffer = self.buffer[n:]


def _fields(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields


def records(stream, zipped: bool, wanted, columns: set[str]) -> Iterator[dict]:
    """Records of one archive as dicts; ``wanted(headers)`` decides before any payload is read."""
    source = (_Zipped if zipped else _Plain)(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        fields = _fields(head.lstrip(b"\r\n"))
        length = int(fields.get("content-length", 0))
        row = {column: fields.get(name) for name, column in _OF.items()}
        row["block_length"] = length
        if not wanted(row):
            source.skip(length + 4)
            continue
        http = fields.get("content-type", "").startswith("application/http")
        if http and columns & {"payload", "http_length"}:
            inner = source.until(b"\r\n\r\n", length) or b""
            sent = _fields(inner).get("content-length")
            row["http_length"] = int(sent) if sent and sent.isdigit() else None
            length -= len(inner)
        if "payload" in columns:
            row["payload"] = source.take(length)
            source.skip(4)
        else:
            source.skip(length + 4)
        yield row


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, dict(options)
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith)):
                kind = type(f).__name__
                self.tests.append((kind, column, frozenset(f.value) if kind == "In" else f.value))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append(("IsNotNull", column, None))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for kind, column, value in self.tests:
            have = row[column]
            if have is None:
                return False
            if kind == "EqualTo" and have != value or kind == "In" and have not in value:
                return False
            if kind == "StringStartsWith" and not have.startswith(value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        """Small files share a partition of about ``splitBytes``; a larger one has its own."""
        limit = int(self.options.get("splitbytes", self.options.get("splitBytes", 64 << 20)))
        out, now, size = [], [], 0
        for path, n in archive_files(self.options["path"]):
            if now and size + n > limit:
                out.append(Files(now))
                now, size = [], 0
            now.append(path)
            size += n
        return [*out, Files(now)] if now or not out else out

    def read(self, partition: Files):
        columns = self.schema.names
        shape = to_arrow_schema(self.schema)
        fs, _ = filesystem(self.options["path"])
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as stream:
                for row in records(stream, path.endswith(".gz"), self.wanted, set(columns)):
                    rows.append({c: row.get(c) for c in columns})
                    size += len(rows[-1].get("payload") or b"") + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=shape)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=shape)


def serialise(row: dict, zipped: bool = True) -> bytes:
    """One record: WARC headers, HTTP headers, and for other than revisits the payload."""
    payload = row.get("payload") or b""
    revisit = row["record_type"] == "revisit"
    stated = row.get("http_length")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if stated is None else stated}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        value = "application/http;msgtype=response" if column == "content_type" else row.get(column)
        if value is not None:
            lines.append(f"{name}: " + re.sub(r"[\r\n]+", " ", value))
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += [f"Content-Length: {len(block)}", "", ""]
    data = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    if not zipped:
        return data
    packer = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = len(_STATED) + 8 + len(body) + 8
    if max(size, len(data)) >> 32:  # the fields have 32 bits
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()
    return _STATED + struct.pack("<II", size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data))


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """One file per task and ``fileBytes``; what failed or repeated tries of a task wrote goes when the job ends."""

    def __init__(self, options: dict):
        self.options, self.job = dict(options), uuid.uuid4().hex
        fs, at = filesystem(self.options["path"])
        fs.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        limit = int(self.options.get("filebytes", self.options.get("fileBytes", 256 << 20)))
        fs, at = filesystem(self.options["path"])
        name = f"part-{self.job}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > limit:
                    if out is not None:
                        out.close()
                    files.append(f"{at}/{name}-{len(files)}.warc.gz")
                    out, size = fs.open_output_stream(files[-1] + ".open", compression=None), 0
                data = serialise(row)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, _ = filesystem(self.options["path"])
        for message in messages:
            for f in message.files if message else ():
                fs.move(f + ".open", f)
        self._sweep()

    def abort(self, messages) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Deletes the unpublished files of this job; failed tries are known by their names only."""
        fs, at = filesystem(self.options["path"])
        for f in fs.get_file_info(pafs.FileSelector(at)):
            if f.base_name.startswith(f"part-{self.job}-") and f.base_name.endswith(".open"):
                fs.delete_file(f.path)


class WarcSource(DataSource):
    """Options: ``path``; ``splitBytes`` when reading; ``fileBytes`` when writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    register(spark)
    full = T._parse_datatype_string(SCHEMA)
    schema = full if columns is None else T.StructType([f for f in full if f.name in columns])
    return spark.read.format("warc").schema(schema).load(path)


def write_warc(rows: DataFrame, path: str) -> None:
    """Write rows with the columns of ``SCHEMA`` (missing ones are null) as new archives under ``path``."""
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").save(path)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: four times five bytes as eight base-32 digits, in the RFC's letters."""
    digest = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as records; of equal payloads the smallest page_id is the response, others revisit it.

    Payloads under ``least_bytes`` bytes are never revisits. Null html is an empty
    payload. Rows that share the smallest page_id are all responses; a null page_id
    revisits if any equal payload has an id.
    """
    made = pages.select(
        F.col("page_id"), F.col("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", base32_sha1(F.col("payload")))
    # only repeated digests reach the join; the rows of one that a third of all pages share are dealt over several keys
    first = (
        made.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("d"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    )
    made = made.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (
        F.octet_length("payload") >= least_bytes
    )
    return made.join(first, (made.digest == first.d) & (made.salt == first.s), "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("http_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_id_of(urn: Column) -> Column:
    number = F.regexp_extract(urn, r"^<urn:x-page:(-?[0-9]+)>$", 1)
    return F.when(number != "", number).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archives into the shared folder, then read them back: responses by payload, revisits by headers."""
    pages = read_table(spark, sf_dir, "pages")
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(pages), path)
    responses = read_warc(spark, path, ["record_type", "record_id", "payload"]).where("record_type = 'response'").select(
        page_id_of(F.col("record_id")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = (
        read_warc(spark, path, ["record_type", "record_id", "refers_to", "payload_digest", "http_length"])
        .where("record_type = 'revisit'")
        .select(
            page_id_of(F.col("record_id")).alias("page_id"),
            F.col("http_length").alias("payload_bytes"),
            F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
            "record_type",
            page_id_of(F.col("refers_to")).alias("refers_to"),
        )
    )
    return responses.unionByName(revisits)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
bits AS (SELECT page_id, n, x, array_to_string(list_transform(string_split(x, ''), lambda c:
           ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][
             strpos('0123456789abcdef', c)]), '') AS s FROM h),
d AS (SELECT page_id, n, array_to_string(list_transform(generate_series(0, 31), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(generate_series(1, 5), lambda j:
          CAST(substr(s, CAST(5 * i + j AS INTEGER), 1) AS INTEGER) * CAST(power(2, 5 - j) AS INTEGER))) AS INTEGER), 1)), '') AS digest FROM bits),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
