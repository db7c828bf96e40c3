"""WARC archives: write, read, and resolve revisit records."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path

END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
READ = "page_id long, url string, type string, digest string, refers_to long, payload_bytes long, payload_digest string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(archive: str, sha1: str, page_id: int | None) -> str:
    """The id of the response of a payload, which its revisits name: fixed by the archive, the payload and the page."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}|{sha1}|{page_id}')}>"


def head_of(fields: list[tuple[str, object]]) -> bytes:
    """Header lines, left out where the value is null; line breaks in values are percent-encoded."""
    lines = [f"{k}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + END


def member(record: bytes) -> bytes:
    """A gzip member of its own, without a time, so that equal records are equal bytes."""
    packer = zlib.compressobj(wbits=31)
    return packer.compress(record) + packer.flush()


def write(records: DataFrame, path: str, archive_bytes: int = 32 << 20) -> None:
    """Write records (page_id, url, type, sha1, refers_to, bytes, copies, payload) as archives of about archive_bytes, one gzip
    member a record, with fresh headers. A response holds the HTTP head and the payload, a revisit the HTTP head alone.

    Each archive is one row of Spark's text sink, which commits whole tasks only and writes to any store. The sink ends a row
    with a separator: it is the zero byte that ends a gzip member of less than 16 MiB, and such a member ends every archive.
    """
    name, now = path.rstrip("/").rsplit("/", 1)[-1], datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        size = 0
        used: set[str] = set()  # ids of responses whose page_id is repeated

        def archive() -> pa.RecordBatch:
            data = b"".join(members)
            data = data if data[-1] == 0 else data + member(b"")
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["archive"])

        for batch in batches:
            for page, url, kind, sha1, refers_to, length, copies, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                response = kind == "response"
                own = record_id(name, sha1, page) if response and copies else None  # small payloads have no revisits
                if own is None or own in used:
                    own = f"<urn:uuid:{uuid.uuid4()}>"
                elif copies > 1:
                    used.add(own)
                block = HTTP.format(length).encode() + (payload or b"" if response else b"")
                head = head_of([
                    ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", now), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{base32(bytes.fromhex(sha1))}"),
                    ("WARC-Profile", None if response else PROFILE), ("WARC-Refers-To", None if response else record_id(name, sha1, refers_to)),
                    ("X-Page-Id", page), ("X-Refers-To-Page-Id", refers_to), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block)),
                ])
                members.append(member(head + block + END))
                size += len(members[-1])
                if size >= archive_bytes:
                    yield archive()
                    members, size = [], 0
        if members:
            yield archive()

    columns = ["page_id", "url", "type", "sha1", "refers_to", "bytes", "copies", "payload"]
    archives = records.select(columns).mapInArrow(pack, "archive binary")
    archives.select(F.col("archive").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def records_of(archive: bytes, step: int = 1 << 12) -> Iterator[bytes]:
    """The records of an archive; a member is read in small pieces, so that what follows it is not copied again and again."""
    view, at = memoryview(archive), 0
    while at < len(view):
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            piece = view[at : at + step]
            if not piece:
                raise ValueError("the archive ends inside a record")
            out.append(unpacker.decompress(piece))
            at += len(piece)
        at -= len(unpacker.unused_data)
        if record := b"".join(out):
            yield record


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = head.decode().split("\r\n")
    return {k.lower(): v.lstrip(" ") for k, _, v in (line.partition(":") for line in lines[1:])}


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in path: page_id, url, type, digest (as written), refers_to, payload_bytes and payload_digest (both
    of the payload in the record, found by the lengths in the headers), and, if asked for, the payload (binary).

    An archive is one row, so its size bounds what a task holds; each head is parsed once.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * payload)
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for record in records_of(archive.as_py()):
                    head, _, rest = record.partition(END)
                    f = fields_of(head)
                    body = rest[: int(f["content-length"])].partition(END)[2]
                    page, of = f.get("x-page-id"), f.get("x-refers-to-page-id")
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append((page and int(page), f.get("warc-target-uri"), f["warc-type"], digest, of and int(of), len(body), base32(hashlib.sha1(body).digest()), *[body] * payload))
                    size += len(body) * payload
                    if size >= 8 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, READ + ", payload binary" * payload)


def deduplicated(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Records for write(): of pages with equal payloads of at least `least` bytes, that of the largest id is the
    response and the others revisit it; smaller payloads are all responses.

    Headers (id, url, digest, size) are written once to the shared folder and meet by digest. A payload is shuffled once, by
    (digest, id), so a page with a great many copies spreads; revisits carry no payload, and their join with the responses
    is one that Spark splits.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    heads = materialise(rows.drop("payload"), "warc-heads")
    each = heads.filter(F.col("bytes") >= least).groupBy("sha1", "page_id").agg(F.count(F.lit(1)).alias("copies"))
    newest = F.max_by(F.struct("page_id", "copies"), F.coalesce("page_id", F.lit(-(1 << 63))))
    first = materialise(each.groupBy("sha1").agg(newest.alias("f")).select(F.col("sha1").alias("_sha1"), F.col("f.page_id").alias("_first"), F.col("f.copies").alias("copies")), "warc-first")
    none = F.lit(None).cast("long")
    mine = (F.col("sha1") == F.col("_sha1")) & F.col("page_id").eqNullSafe(F.col("_first"))
    responses = rows.join(first.hint("shuffle_hash"), mine).withColumn("type", F.lit("response")).withColumn("refers_to", none)
    slim = heads.filter(F.col("bytes") >= least).join(first, F.col("sha1") == F.col("_sha1")).filter(~F.col("page_id").eqNullSafe(F.col("_first")))
    revisits = slim.withColumn("type", F.lit("revisit")).withColumn("refers_to", F.col("_first")).withColumn("payload", F.lit(None).cast("binary"))
    columns = ["page_id", "url", "type", "sha1", "refers_to", "bytes", "copies", "payload"]
    out = responses.select(columns).unionByName(revisits.select(columns))
    if least > 0:
        small = rows.filter(F.col("bytes") < least).withColumn("type", F.lit("response")).withColumn("refers_to", none).withColumn("copies", F.lit(0).cast("long"))
        out = out.unionByName(small.select(columns))
    return out


def resolve(records: DataFrame) -> DataFrame:
    """Rows of read() with payload_bytes and payload_digest of the full payload: a response's own, read back, and for a
    revisit those of the response with its digest. A revisit without one has null payload_bytes."""
    columns = ["page_id", "type", "refers_to", "payload_bytes", "payload_digest"]
    responses = records.filter("type = 'response'").select(columns)
    originals = responses.groupBy("payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    revisits = records.filter("type = 'revisit'").select("page_id", "type", "refers_to", F.col("digest").alias("payload_digest")).join(originals, "payload_digest", "left")
    return responses.unionByName(revisits.select(columns))


def archived(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """Write pages as deduplicated archives, read them back once and resolve the revisits: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    Null html is an empty payload; empty payloads are equal payloads like any other. Null urls leave out their field.
    A null page_id is smaller than any id. Rows that repeat the largest id of their payload are responses all, the
    others revisits. An empty table gives an empty result. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(deduplicated(pages, least=least), path)
    back = materialise(read(spark, path, payload=False), "warc-back")
    return resolve(back).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h FROM p),
m AS (SELECT h, max(page_id) AS first FROM d GROUP BY h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN m USING (h)
"""
