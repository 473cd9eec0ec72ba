"""WARC archives with revisit records.

Headers (page_id, payload digest, length) go through a shuffle without the
payloads; of the records with one digest and length, the one with the largest
page_id stays a response and the others become revisits of it. Pages get their
decision back by page_id and are written as WARC 1.1 records with new headers.
Reading parses the archives, checks each response's payload against its digest,
and joins revisits to originals by record id.

Archives are ``.warc.gz`` files with one gzip member a record and an empty one at
the end. A task gathers members up to FILE_BYTES and hands them to Spark's text
writer as one row, a file each, so they are made in whatever store the path
names. Readers hold one file, of FILE_BYTES and one record at most, and unpack it
record by record.

Defined results: null html counts as empty, a null url as none; empty payloads
are deduplicated like others if ``min_bytes`` is 0; rows that repeat a page_id
with one payload have equal record types; a page without a page_id revisits the
largest page_id with its payload and is a response if there is none; an empty table gives no archive, which reads as no record; extra columns are ignored.
Pages are written whole, up to the 2 GB that a row of Spark holds. A group of
copies may be of any size, as only its largest page_id is gathered, and the join
with it may be split.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import folder, staged

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 16 << 20
#: An empty gzip member, which ends each archive.
END = gzip.compress(b"", mtime=0)
RECORD_SCHEMA = "record_id string, record_type string, page_id string, url string, payload_digest string, payload_bytes long, refers_to_record string, payload string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits at a time, from five hexadecimal digits to four of base 32."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("papyra page "), page_id.cast("string")).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def _headed(pages: DataFrame) -> DataFrame:
    read = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return read.withColumn("payload_digest", base32_sha1(F.col("html"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` with digest, length, record type and the page a revisit refers to."""
    read = _headed(pages)
    key = ["payload_digest", "payload_bytes"]
    # Both sides are tables, so that Spark may split a digest that very many pages share.
    heads = staged(read.where("page_id is not null").select("page_id", *key).distinct(), "headers")
    originals = staged(heads.where(F.col("payload_bytes") >= min_bytes).groupBy(*key).agg(F.max("page_id").alias("original")), "originals")
    decided = heads.join(originals, key, "left")
    known = read.where("page_id is not null").join(decided, ["page_id", *key])
    # Pages without an id are no original; they meet theirs by payload.
    unknown = read.where("page_id is null").join(originals, key, "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return known.unionByName(unknown).select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
    )


def records(decided: DataFrame, date: str = DATE) -> DataFrame:
    """One WARC record per row, less the CR LF CR LF that ends it."""
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), "payload_bytes", F.lit(CRLF * 2))
    block = F.when(F.col("record_type") == "response", F.concat(head, "html")).otherwise(head)
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <"), _record_id(F.coalesce(F.col("page_id").cast("string"), F.uuid())), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Refers-To: <"), _record_id(F.col("refers_to")), F.lit(">")),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return decided.select(F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF * 2), block).alias("value"))


def _archives(batches: Iterator[pa.RecordBatch], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Records to gzip members, about ``file_bytes`` in a row."""
    members: list[bytes] = []
    size = 0

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])

    for batch in batches:
        for record in batch.column(0):
            members.append(gzip.compress(record.as_buffer(), compresslevel=6, mtime=0))
            size += len(members[-1])
            if size >= file_bytes:
                yield full()
                members, size = [], 0
    if members:
        yield full()


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE, file_bytes: int = FILE_BYTES) -> None:
    """Write the archives of ``pages`` under ``path``."""
    lines = records(decide(pages, min_bytes), date).select(F.concat("value", F.lit(CRLF * 2)).cast("binary").alias("value"))
    # The text writer copies bytes as they are; its line separator is what ends an archive.
    rows = lines.mapInArrow(lambda batches: _archives(batches, file_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.options(lineSep=END.decode("latin-1"), encoding="ISO-8859-1", maxRecordsPerFile=1).text(path)
    spark = pages.sparkSession
    at, fs = folder(spark, path)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    for n, status in enumerate(s for s in fs.listStatus(at) if s.getLen() and s.getPath().getName().startswith("part-")):
        fs.rename(status.getPath(), Path(at, f"papyra-{n:08d}.warc.gz"))


def _unpacked(archive: bytes) -> Iterator[bytes]:
    """The members of an archive, one at a time."""
    at = 0
    while at < len(archive):
        member, parts = zlib.decompressobj(wbits=31), []
        # In small pieces, as what lies behind the member is copied.
        while not member.eof:
            piece = archive[at : at + (1 << 14)]
            if not piece:
                raise ValueError("the archive ends within a record")
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        yield b"".join(parts)


def parse(archive: bytes) -> Iterator[dict]:
    """Records of one archive file, compressed or not."""
    if archive[:2] == b"\x1f\x8b":
        for record in _unpacked(archive):
            yield from parse(record)
        return
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(fields["Content-Length"])
        block = archive[start:stop]
        at = stop + 4
        head, _, payload = block.partition(b"\r\n\r\n")
        http = dict(line.split(": ", 1) for line in head.decode("ascii").split(CRLF)[1:])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload and digest differ in {fields['WARC-Record-ID']}")
        yield {
            "record_id": fields["WARC-Record-ID"].strip("<>"),
            "record_type": fields["WARC-Type"],
            "page_id": fields.get("X-Page-ID"),
            "url": fields.get("WARC-Target-URI"),
            "payload_digest": digest,
            "payload_bytes": int(http["Content-Length"]),
            "refers_to_record": fields["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in fields else None,
            "payload": payload.decode("utf-8") if fields["WARC-Type"] == "response" else None,
        }


def read(spark, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives under ``path``."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int64() if f.endswith("long") else pa.string() for f in RECORD_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = parse(content.as_py())
                while rows := list(islice(found, 256)):
                    for row in [] if payloads else rows:
                        row["payload"] = None
                    columns = [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD_SCHEMA)


def resolved(found: DataFrame) -> DataFrame:
    """Records with ``refers_to``: the page of the response that a revisit names. ``found`` is read three times."""
    responses = found.where("record_type = 'response'")
    originals = responses.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.max("page_id").alias("refers_to"))
    # A table, so that Spark may split an original that very many revisits name.
    revisits = found.where("record_type <> 'response'").join(staged(originals, "responses"), "refers_to_record", "left")
    return responses.withColumn("refers_to", F.lit(None).cast("string")).unionByName(revisits)
