"""WARC archives with an index: written once, then read by sorted and coalesced byte ranges.

A task writes its records to files of its own, each record a gzip member, and returns the index: file, offset, length, URL and
digest of every record. The index is what commits an archive: Spark keeps the rows of one attempt of a task only, so files of lost
or repeated attempts are in no index, and are removed. A reader sorts the chosen index rows by file and offset, joins neighbouring
ranges into one read, and checks each payload against its digest.

Payloads that come more than once and have at least `least` bytes are written once: the record of the largest page_id is the response,
the others are revisits of it. Defined cases: a null payload is empty; a null page_id is the smallest, and written as no field; rows
that share the largest page_id of their payload are responses, each of them; a null URL is no field, and control characters in a URL
are percent-encoded; other columns are not archived; of no pages, no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, shared_dir, small_batches, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows of the table of repeated payloads that are broadcast at most; each is about 150 bytes. Beyond, the join shuffles.
MOST_BROADCAST = 100_000
INDEX = "file string, offset long, length long, url string, digest string, page_id string, record_type string"
RECORD = "file string, offset long, page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def qualified(spark: SparkSession, path: str) -> str:
    """path with its file system, in the form that pyarrow reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", full))


def member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member; fields that are None are left out."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}", "", ""]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode()) + c.compress(block) + c.compress(b"\r\n\r\n") + c.flush()


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block) of an unpacked record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not sep or not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def _one_line(url: str | None) -> str | None:
    return url and re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def archived(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, date: str = "1970-01-01T00:00:00Z", folder: str | None = None, file_bytes: int = 1 << 30) -> DataFrame:
    """Writes a record per row of pages to `folder` (a new one in the shared folder) and returns the index, a table."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    plain = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), body.alias("body")).withColumns({"bytes": F.length("body").cast("long"), "key": F.sha2("body", 256)})
    copies = plain.where(F.col("bytes") >= least).groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "url")).alias("last")).where("n > 1").select("k", "last")
    copies = written(copies, "copies")
    few = F.broadcast(copies) if copies.count() <= MOST_BROADCAST else copies
    found = plain.join(few, F.col("key") == F.col("k"), "left")
    again = F.col("k").isNotNull() & ~F.col("id").eqNullSafe(F.col("last.id"))
    rows = found.select(
        F.col("id").cast("string").alias("id"), "url", F.sha1("body").alias("digest"), "bytes", again.alias("again"), F.when(~again, F.col("body")).alias("body"),
        F.when(again, F.col("last.id").cast("string")).alias("of"), F.when(again, F.col("last.url")).alias("of_url"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index: list[tuple] = []
                for k in range(batch.num_rows):
                    number, link, digest, size, repeat, data, of, of_url = (c[k].as_py() for c in batch.columns)
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        first = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out.write(first)
                        at = len(first)
                    link, kind = _one_line(link), "revisit" if repeat else "response"
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
                    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Target-URI", link), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
                    if repeat:
                        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _one_line(of_url)), ("WARC-Refers-To-Date", date)]
                    fields += [("Content-Type", "application/http; msgtype=response"), ("Page-ID", number if number is None else quote(number)), ("Page-Refers-To", of if of is None else quote(of)), ("Payload-Length", size)]
                    record = member(fields, http if repeat else http + data)
                    out.write(record)
                    index.append((f"{folder}/{name}", at, len(record), link, digest, number, kind))
                    at += len(record)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4), strict=True)] if index else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4)], names=["file", "offset", "length", "url", "digest", "page_id", "record_type"])
        finally:
            if out is not None:
                out.close()

    index = written(rows.mapInArrow(lean(write), INDEX), "warc-index")
    _sweep(index, folder)
    return index


def _sweep(index: DataFrame, folder: str) -> None:
    """Removes archives of the folder that the index does not name: those of failed attempts."""
    spark = index.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(re.sub("^s3:", "s3a:", folder))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        named = {r.file.rpartition("/")[2] for r in index.select("file").distinct().collect()}  # an archive or so a task
        for f in fs.listStatus(path):
            if f.getPath().getName().endswith(".warc.gz") and f.getPath().getName() not in named:
                fs.delete(f.getPath(), False)


def indexed(spark: SparkSession, files: list[str]) -> DataFrame:
    """The index of existing archives of gzip members, a task for each file, which it streams through."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for row in _members(file):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4), strict=True)], names=["file", "offset", "length", "url", "digest", "page_id", "record_type"])

    paths = spark.createDataFrame([(qualified(spark, f),) for f in files], "file string").repartition(max(1, len(files)), "file")
    return paths.mapInArrow(scan, INDEX).where("record_type <> 'warcinfo'")


def _members(file: str, most: int = 1 << 20) -> Iterator[tuple]:
    fs, path = pyarrow.fs.FileSystem.from_uri(file)
    with fs.open_input_file(path) as f:
        at, begin, unpack, head = 0, 0, zlib.decompressobj(31), b""
        while data := f.read_at(most, at):
            at += len(data)
            while data:
                more = unpack.decompress(data)
                head = head if b"\r\n\r\n" in head else head + more
                if not unpack.eof:
                    break
                data = unpack.unused_data
                fields, _ = parsed(head)
                digest = fields.get("warc-payload-digest")
                end = at - len(data)
                yield file, begin, end - begin, fields.get("warc-target-uri"), digest and _hex(digest), unquote(fields["page-id"]) if "page-id" in fields else None, fields["warc-type"]
                begin, unpack, head = end, zlib.decompressobj(31), b""


def ranges(rows: Iterator[tuple[str, int, int]], gap: int, most: int) -> Iterator[list[tuple[str, int, int]]]:
    """Groups of sorted (file, offset, length) that one read fetches: at most `gap` unwanted bytes between two of them, and not
    over `most` bytes in all unless a single record is."""
    group: list[tuple[str, int, int]] = []
    for r in rows:
        if group and (r[0] != group[0][0] or r[1] - (group[-1][1] + group[-1][2]) > gap or r[1] + r[2] - group[0][1] > most):
            yield group
            group = []
        group.append(r)
    if group:
        yield group


def records(index: DataFrame, *, gap: int = 1 << 16, most: int = 8 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """The records of index rows: file, offset, page_id, url, record_type, refers_to, payload_digest, payload_bytes (both of the
    full payload) and payload, null in revisits. A payload that does not have its digest is an error."""
    total = index.agg(F.sum("length")).first()[0] or 0
    chosen = index.select("file", "offset", "length")
    dealt = chosen.repartitionByRange(max(1, -(-total // task_bytes)), "file", "offset").sortWithinPartitions("file", "offset")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        opened, f = None, None
        for group in ranges(wanted, gap, most):
            if group[0][0] != opened:
                if f is not None:
                    f.close()
                opened = group[0][0]
                fs, path = pyarrow.fs.FileSystem.from_uri(opened)
                f = fs.open_input_file(path)
            start = group[0][1]
            data = f.read_at(group[-1][1] + group[-1][2] - start, start)
            rows = [_record(file, offset, zlib.decompress(data[offset - start : offset - start + length], 31)) for file, offset, length in group]
            columns = zip(zip(*rows, strict=True), (pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["file", "offset", "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])
        if f is not None:
            f.close()

    return dealt.mapInArrow(lean(fetch), RECORD)


def _record(file: str, offset: int, raw: bytes) -> tuple:
    fields, block = parsed(raw)
    digest, size, payload = _hex(fields["warc-payload-digest"]), int(fields["payload-length"]), None
    if fields["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"{file} at {offset}: the payload does not have its digest")
    number, of = (unquote(fields[k]) if k in fields else None for k in ("page-id", "page-refers-to"))
    return file, offset, number, fields.get("warc-target-uri"), fields["warc-type"], of, digest, size, payload


def restored(found: DataFrame) -> DataFrame:
    """Rows of records() in which revisits have the payload of the response that they refer to."""
    first = found.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("d"), F.col("page_id").alias("p")).agg(F.first("payload").alias("full"))
    joined = found.join(first, (F.col("payload_digest") == F.col("d")) & (F.col("refers_to") == F.col("p")), "left")
    return joined.select(*[F.coalesce("payload", "full").alias("payload") if c == "payload" else F.col(c) for c in found.columns])
