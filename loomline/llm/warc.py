"""Legacy archive converter: ARC files of version 1 and 2 to WARC, and readers and writers of both.

An ARC record is a header line whose fields depend on the version that the file's first record declares, and as many bytes
as the line's last field says. The converter cuts files by these lengths and gives each record what WARC needs and ARC
lacks: an identifier (from the file's name and the record's offset), a timestamp in ISO form, a type, and SHA-1 digests of
block and payload. Payloads that occur more than once are kept in one record; the others become revisits of it.

Files are written by Spark's own writer, which reaches any storage: a row is a record, the line separator is what ends a
record in the format, and every file begins with its version or info record because rows and files are counted alike.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, new_path, remove, small, stage

#: Records in a file at most, its first one included, and bytes in a file, about, before it is gzipped.
FILE_RECORDS, FILE_BYTES = 4096, 32 << 20
#: The archives' compression: a third of the default's time for an eighth more bytes.
GZIP_LEVEL = "BEST_SPEED"

#: The fields of a header line by version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class ArcRecord(NamedTuple):
    offset: int
    fields: dict[str, str]
    block: bytes


def arc_head(name: str, version: int) -> bytes:
    body = f"{version} 0 loomline\n{ARC_TITLES[version]}\n"
    given = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": "20240101000000", "type": "text/plain", "length": str(len(body))}
    return (" ".join(given.get(f, "-") for f in ARC_FIELDS[version]) + "\n" + body).encode()


def arc_record(version: int, url: str, date: str, kind: str, block: bytes) -> bytes:
    given = {"url": url.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") or "-", "ip": "0.0.0.0", "date": date, "type": kind, "status": "200", "length": str(len(block))}
    return (" ".join(given.get(f, "-") for f in ARC_FIELDS[version]) + "\n").encode() + block


def _taken(stream: BinaryIO, size: int, at: int) -> bytes:
    got = stream.read(size)
    if len(got) < size:
        raise ValueError(f"the record at {at} is cut off")
    return got


def read_arc(content: bytes | BinaryIO) -> Iterator[ArcRecord]:
    """The records of a file, the version record left out, one in memory at a time. ValueError if a header line or a length does not fit."""
    stream = io.BytesIO(content) if isinstance(content, bytes) else content
    at, version = 0, 0
    while line := stream.readline():
        begin, at = at, at + len(line)
        if line == b"\n":
            continue
        if not line.endswith(b"\n"):
            raise ValueError(f"no end of the header line at {begin}")
        parts = line[:-1].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        if not version:
            # the version record's own header has the fields of the version that its body names
            size = int(parts[-1]) if parts[0].startswith("filedesc://") and parts[-1].isdigit() else 0
            body = _taken(stream, size, begin)
            named = body.split(b" ", 1)[0]
            version = int(named) if named.isdigit() else 0
            if version not in ARC_FIELDS:
                raise ValueError("the file does not begin with a version record of version 1 or 2")
            block = body
        names = ARC_FIELDS[version]
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"bad header line at {begin}")
        if begin:
            block = _taken(stream, int(parts[-1]), begin)
        at += len(block)
        if not parts[0].startswith("filedesc://"):
            yield ArcRecord(begin, dict(zip(names, parts, strict=True)), block)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Status line and headers with their blank line, and the payload. A block that is no HTTP message is all payload."""
    end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    return (b"", block) if end < 0 else (block[: end + 4], block[end + 4 :])


def http_field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower():
            return value.strip().decode("latin-1")
    return None


def record_id(file: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{file}@{offset}'.encode()).digest()[:16], version=4)}>"


def iso_date(date: str) -> str:
    """The 14 digits of an ARC date in ISO form; shorter ones are filled up, others count as the first of 1970."""
    date = (date + "19700101000000"[len(date) :])[:14] if date.isdigit() else "19700101000000"
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:]}Z"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends after its block, which the file writer adds."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + block


def read_warc(content: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, one in memory at a time."""
    stream = io.BytesIO(content) if isinstance(content, bytes) else content
    at = 0
    while line := stream.readline():
        begin, at = at, at + len(line)
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {begin}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            at += len(line)
            key, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[key.lower()] = value.strip()
        block = _taken(stream, int(headers["content-length"]), begin)
        at += len(line) + len(block)
        yield headers, block


def records_per_file(pages: DataFrame) -> int:
    """How many records of mean size make FILE_BYTES, FILE_RECORDS at most."""
    mean = pages.agg(F.avg(F.octet_length("html") + 512)).first()[0] or 512
    return int(max(2, min(FILE_RECORDS, FILE_BYTES // mean)))


def _write(rows: DataFrame, path: str, ending: str, per_file: int) -> None:
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", ending).option("compression", "gzip").option("zlib.compress.level", GZIP_LEVEL).option("maxRecordsPerFile", per_file).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, per_file: int = FILE_RECORDS) -> None:
    """pages(page_id, url, html) as gzipped ARC files, of versions 1 and 2 in turn by partition. Null html is empty; a null id is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, n = 1 + part % 2, 0
        for batch in batches:
            for a in range(0, len(batch), 256):
                out = []
                for page, url, html in zip(*(batch.column(c).slice(a, 256).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    if n % per_file == 0:
                        out.append(arc_head(f"pages-{part:05d}-{n // per_file:05d}.arc", version))
                        n += 1
                    payload = (html or "").encode()
                    own = "" if page is None else f"X-Page-Id: {page}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n"
                    date = (_EPOCH + timedelta(seconds=(page or 0) % 31_536_000)).strftime("%Y%m%d%H%M%S")
                    out.append(arc_record(version, url or "", date, "text/html", head.encode() + payload))
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _write(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "record binary"), path, "\n", per_file)


def _arc_rows(spark: SparkSession, path: str, with_blocks: bool) -> DataFrame:
    """The records of ARC files: file, offset, page_id, digest, and with_blocks also url, date and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                file = name.as_py().rpartition("/")[2]
                held: list[tuple] = []
                for r in read_arc(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer()))):
                    block = r.block
                    head, payload = split_http(block)
                    page = http_field(head, b"X-Page-Id")
                    held.append((file, r.offset, None if page is None else int(page), base32_sha1(payload), *((r.fields["url"], r.fields["date"], block) if with_blocks else ())))
                    if len(held) == 256:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    kinds = [("file", pa.string(), "string"), ("offset", pa.int64(), "bigint"), ("page_id", pa.int64(), "bigint"), ("digest", pa.string(), "string")]
    if with_blocks:
        kinds += [("url", pa.string(), "string"), ("date", pa.string(), "string"), ("block", pa.binary(), "binary")]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t, _) in enumerate(kinds)], names=[n for n, _, _ in kinds])
    return _files(spark, path).mapInArrow(run, ", ".join(f"{n} {s}" for n, _, s in kinds))


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_revisit: int = 0, per_file: int = FILE_RECORDS) -> None:
    """ARC files to gzipped WARC files. Of records with equal payloads of at least least_revisit bytes the one with the largest
    page id (then file and offset) is the response; records without a page id come last. The others are revisits of it."""
    found = stage(_arc_rows(spark, arc_path, False), "arc")
    rank = F.struct(F.col("page_id").isNotNull(), "page_id", "file", "offset")
    chosen = found.groupBy("digest").agg(F.max(rank).alias("r"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", F.col("r.file").alias("to_file"), F.col("r.offset").alias("to_offset"))
    rows = _arc_rows(spark, arc_path, True).join(small(stage(chosen, "chosen"), 256), "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for a in range(0, len(batch), 256):
                out = []
                for file, offset, digest, url, date, block, to_file, to_offset in zip(*(batch.column(c).slice(a, 256).to_pylist() for c in ("file", "offset", "digest", "url", "date", "block", "to_file", "to_offset")), strict=True):
                    if n % per_file == 0:
                        info = b"software: loomline\r\nformat: WARC File Format 1.1\r\n"
                        out.append(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f"info {file}", offset)), ("WARC-Date", iso_date(date)), ("Content-Type", "application/warc-fields")], info))
                        n += 1
                    head, payload = split_http(block)
                    revisit = to_file is not None and (to_file, to_offset) != (file, offset) and len(payload) >= least_revisit
                    kept = head if revisit else block
                    headers = [
                        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(file, offset)), ("WARC-Target-URI", url), ("WARC-Date", iso_date(date)),
                        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(kept)}"),
                    ]
                    if revisit:
                        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(to_file, to_offset))]
                    out.append(warc_record(headers, kept))
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _write(rows.mapInArrow(run, "record binary"), warc_path, "\r\n\r\n", per_file)


def read_pages(spark: SparkSession, warc_path: str) -> DataFrame:
    """Responses and revisits of WARC files: page_id, payload_bytes, payload_digest, record_type, record_id, refers_to_id. A digest that does not fit its payload is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for headers, block in read_warc(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer()))):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"the payload of {headers['warc-record-id']} has another digest")
                    page = http_field(head, b"X-Page-Id")
                    size = len(payload) if kind == "response" else int(http_field(head, b"Content-Length") or 0)
                    rows.append((None if page is None else int(page), size, digest, kind, headers["warc-record-id"], headers.get("warc-refers-to")))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id"])

    return _files(spark, warc_path).mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, record_id string, refers_to_id string")


def round_trip(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """pages(page_id, url, html) to ARC, to WARC, and back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; null ids are kept as null and never chosen as response before others; of repeated rows one
    is the response. No rows give no rows. Other columns are not read. The files lie in the shared folder; the ARC files go
    once they are converted.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    per_file = records_per_file(pages)
    write_arc(pages, arc, per_file)
    convert(spark, arc, warc, least_revisit, per_file)
    remove(spark, arc)
    back = stage(read_pages(spark, warc), "records")
    target = back.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    revisits = back.filter("record_type = 'revisit'").join(target, "refers_to_id")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return revisits.select(*columns).unionByName(back.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("bigint")).select(*columns))


ORACLE = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
parts as (select page_id, unnest(range(8)) as k, ('0x' || substr(h, 5 * unnest(range(8)) + 1, 5))::bigint as v from p),
letters as (
  select page_id, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32768) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 1024) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1), '' order by k) as payload_digest
  from parts group by page_id),
chosen as (select html, max(page_id) as largest from p group by html)
select page_id, strlen(html)::bigint as payload_bytes, payload_digest,
  case when page_id = largest then 'response' else 'revisit' end as record_type, case when page_id = largest then null else largest end as refers_to
from p join letters using (page_id) join chosen using (html)
"""
