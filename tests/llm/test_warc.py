import base64
import gzip
import hashlib
import io
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowloom.llm import warc

from .helpers import rows_of, save

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (5, "http://a/5", "<p>same é</p>"), (3, "http://a/3", "<p>same é</p>"), (9, "http://a/9", "<p>same é</p>"),
    (1, None, None), (2, "http://a/2", ""), (7, "http://a/\r\nx", "<p>own\r\n\r\nWARC/1.1\r\n</p>"), (8, "http://a/8", "x" * 3_000_000),
    (None, "http://a/n", "<p>no id</p>"),
]


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and i != f
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_query_equals_brute_force(spark, tmp_path):
    save(spark.createDataFrame(ROWS, SCHEMA).withColumn("payload", F.lit(1)).repartition(3), tmp_path, "pages")
    assert rows_of(warc.query(spark, str(tmp_path)), *COLUMNS) == expected(ROWS)


def test_empty_table(spark, tmp_path):
    save(spark.createDataFrame([], SCHEMA), tmp_path, "pages")
    assert warc.query(spark, str(tmp_path)).count() == 0


def test_files_are_plain_warc_and_round_trip(spark, tmp_path):
    warc.write_warc(warc.page_records(spark.createDataFrame(ROWS, SCHEMA)), f"{tmp_path}/w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "w").rglob("*.warc.gz"))
    n, at = 0, 0
    while at < len(data):  # an independent walk over headers and lengths
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].split(b"\r\n")
        assert head[0] == b"WARC/1.1"
        length = int(next(x for x in head if x.startswith(b"Content-Length")).split(b":")[1])
        assert data[end + 4 + length : end + 8 + length] == b"\r\n\r\n"
        at, n = end + 8 + length, n + 1
    assert n == len(ROWS)
    back = warc.read_warc(spark, f"{tmp_path}/w").where("record_type = 'response'")
    assert {bytes(r.payload) for r in back.collect()} == {(h or "").encode() for _, _, h in ROWS}


def test_predicates_are_pushed_and_payloads_skipped(spark, tmp_path):
    warc.write_warc(warc.page_records(spark.createDataFrame(ROWS, SCHEMA)), f"{tmp_path}/w")
    got = warc.read_warc(spark, f"{tmp_path}/w", ["record_type", "target_uri"])
    some = got.where((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://a/5"))
    assert [r.target_uri for r in some.collect()] == ["http://a/5"]
    assert "Filter" not in some._jdf.queryExecution().optimizedPlan().toString()
    assert got.where(F.col("record_type").isin("metadata", "request")).count() == 0
    assert got.where("record_type <> 'response'").count() == 3
    taken = []

    class Counted(warc._Plain):
        def take(self, n):
            taken.append(n)
            return super().take(n)

    raw = warc.serialise({"record_type": "response", "record_id": "r", "payload": b"y" * 500}, zipped=False) * 3
    plain, warc._Plain = warc._Plain, Counted
    try:
        assert not list(warc.records(io.BytesIO(raw), False, lambda row: False, {"payload"})) and not taken
        assert [len(r["payload"]) for r in warc.records(io.BytesIO(raw), False, lambda row: True, {"payload"})] == [500] * 3
    finally:
        warc._Plain = plain


def other_archive():
    """Records as other writers make them: empty and headless HTTP blocks, no extra field."""
    def record(kind, block, content="application/http;msgtype=response"):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{kind}>\r\nContent-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    return [
        record("warcinfo", b"software: x\r\n", "application/warc-fields"), record("revisit", b""), record("response", b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\nmore"),
        record("request", b"GET / HTTP/1.1"), record("resource", b"\x00\x01" * 400_000, "image/png"), record("metadata", b"a: b", "application/warc-fields"),
    ]


@pytest.mark.parametrize("packed", [lambda r: (b"".join(r), False), lambda r: (b"".join(map(gzip.compress, r)), True), lambda r: (gzip.compress(b"".join(r)), True)])
def test_archives_of_other_writers(packed):
    data, zipped = packed(other_archive())
    got = {r["record_type"]: r["payload"] for r in warc.records(io.BytesIO(data), zipped, lambda row: True, {"payload"})}
    assert got == {
        "warcinfo": b"software: x\r\n", "revisit": b"", "response": b"body\r\n\r\nmore", "request": b"GET / HTTP/1.1",
        "resource": b"\x00\x01" * 400_000, "metadata": b"a: b",
    }
    some = [r["payload"] for r in warc.records(io.BytesIO(data), zipped, lambda row: row["record_type"] == "metadata", {"payload"})]
    assert some == [b"a: b"]


def test_unwanted_members_are_not_decompressed():
    noise = os.urandom(2_000_000)
    data = b"".join(warc.serialise({"record_type": k, "record_id": f"<{i}>", "payload": noise}) for i, k in enumerate(["response", "metadata", "response", "response", "metadata"]))

    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            out = super().read(n)
            self.read_bytes += len(out)
            return out

    assert gzip.decompress(data).count(noise) == 5
    stream = Counted(data)
    got = [r["record_id"] for r in warc.records(stream, True, lambda row: row["record_type"] == "metadata", {"record_id"})]
    assert got == ["<1>", "<4>"] and stream.read_bytes <= 6 * warc.CHUNK
    got = list(warc.records(io.BytesIO(data), True, lambda row: row["record_type"] == "metadata", {"payload"}))
    assert [r["payload"] == noise for r in got] == [True, True]


def test_unpublished_files_of_a_job_are_swept(tmp_path):
    writer = warc.WarcWriter({"path": str(tmp_path)})
    for name in (f"part-{writer.job}-000000-a-0.warc.gz.open", f"part-{writer.job}-000001-b-0.warc.gz.open", "part-other-0.warc.gz.open"):
        Path(tmp_path, name).write_bytes(b"")
    writer.commit([warc.Written([f"{tmp_path}/part-{writer.job}-000001-b-0.warc.gz"])])
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"part-{writer.job}-000001-b-0.warc.gz", "part-other-0.warc.gz.open"]


def test_file_partitions(tmp_path):
    for k in range(5):
        Path(tmp_path, f"{k}.warc.gz").write_bytes(b"x" * 100)
    parts = warc.WarcReader(None, {"path": str(tmp_path), "splitBytes": "250"}).partitions()
    assert [len(p.paths) for p in parts] == [2, 2, 1]
