"""WARC archives: written one gzip member per record, read back by tasks that scan byte ranges.

A range's task looks for gzip magic from its first byte on, takes a hit for a record only if the member's
head decodes to a WARC header, and owns the records that start inside its range; the last of them may end in
the next range. So a file needs no index and splits at any byte.

Defined cases: a null payload is empty. Payloads under min_bytes are responses. Of equal larger payloads the
one with the largest page_id is the response and the others revisit it; rows that repeat that page_id are
responses too; rows without page_id are responses and never revisited. Null urls are written as empty.
Extra columns are ignored. An empty table gives an empty archive and an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.llm.common import shared_dir, written

MIN_BYTES = 1000
#: Bytes of archive that one task scans, and that are read at once while scanning.
RANGE, READ = 16 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"

READ_BACK = "record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary, file string, at long"


#: Names that Spark's file systems have and pyarrow's have otherwise.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "dbfs:/": "file:///dbfs/"}


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    for theirs, ours in SCHEMES.items():
        if uri.startswith(theirs):
            uri = ours + uri[len(theirs) :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def classify(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to: what to write for each row."""
    body = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    same = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1")
    refers = F.when(F.col("page_id") < F.col("newest"), F.col("newest"))
    # Payloads move once, dealt by digest; an adaptive join splits a digest that many rows share.
    return rows.join(same, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    name = "" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {''.join(url.split())}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Payload-Length: {len(payload)}"]
        payload = b""
    head += [f"Content-Length: {len(payload)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + payload + b"\r\n\r\n") + pack.flush()


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Writes one archive for each task below folder; path and bytes of each archive.

    An archive appears under its name by one rename when it is whole. A task that runs again writes another
    name, and only the names that come back in the result count.
    """

    def run(batches):
        where, path = place(folder)
        name = f"{path}/{uuid.uuid4().hex}.warc.gz"
        size, out = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    where.create_dir(path, recursive=True)
                    out = where.open_output_stream(f"{name}.part", compression=None)
                size += out.write(record(*(x.as_py() for x in row)))
        if out is not None:
            out.close()
            where.move(f"{name}.part", name)
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name.rpartition('/')[2]}"], "size": [size]})

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "file string, size long")


def scan(source, start: int, stop: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, header, block) of the records that start in bytes start..stop-1 of source."""
    size, at, buf, base = source.size(), start, b"", start
    while at < stop:
        hit = buf.find(MAGIC, at - base) if buf else -1
        if hit < 0:
            # Two bytes may begin a magic that the next read completes.
            at = max(at, base + len(buf) - 2)
            if base + len(buf) >= size:
                return
            rest = buf[at - base :]
            base = at
            source.seek(base + len(rest))
            buf = rest + source.read(READ)
            continue
        at = base + hit
        if at >= stop:
            return
        member = decode(source, at, buf, base, size)
        if member is None:
            at += 1
            continue
        end, head, block = member
        yield at, head, block
        if end > base + len(buf):
            base, buf = end, b""
        at = end


def decode(source, at: int, buf: bytes, base: int, size: int):
    """End, header and block of the gzip member at a byte, or None if it is no WARC record."""
    inflate, out, data, pos = zlib.decompressobj(31), bytearray(), buf[at - base :], base + len(buf)
    head_end = -1
    while True:
        try:
            out += inflate.decompress(data)
        except zlib.error:
            return None
        if head_end < 0:
            head_end = out.find(b"\r\n\r\n")
            # A header has any length: what begins as a record is read on to the end of its member.
            if not out.startswith(b"WARC/"[: len(out)]):
                return None
        if inflate.eof:
            break
        if pos >= size:
            return None
        source.seek(pos)
        data = source.read(READ)
        pos += len(data)
    if head_end < 0:
        return None
    head, body = bytes(out[:head_end]), out[head_end + 4 :]
    length = int(fields(head).get("content-length", "-1"))
    if length < 0 or len(body) < length:
        return None
    return pos - len(inflate.unused_data), head, bytes(body[:length])


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def read(spark: SparkSession, files: DataFrame, span: int = RANGE, payload: bool = True) -> DataFrame:
    """All records of the archives in files (file, size), each read by the task whose range it starts in."""

    def run(batches):
        for batch in batches:
            for file, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True):
                where, path = place(file)
                rows, held = [], 0
                with where.open_input_file(path) as source:
                    for at, head, block in scan(source, start, stop):
                        f = fields(head)
                        page = f.get("warc-record-id", "")[10:-1]
                        kind = f.get("warc-type")
                        size = len(block) if kind == "response" else int(f.get("x-payload-length", len(block)))
                        digest = hashlib.sha1(block).hexdigest() if kind == "response" else f.get("warc-payload-digest", "").removeprefix("sha1:")
                        refers = f["warc-refers-to"][10:-1] if "warc-refers-to" in f else None
                        rows.append((page, kind, refers, f.get("warc-target-uri"), size, digest, block if payload else None, file, at))
                        held += len(block) if payload else 0
                        if len(rows) >= 5000 or held > READ:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(span).cast("long"))).alias("start"))
    dealt = ranges.select("file", "start", (F.col("start") + span).alias("stop")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "start")
    return dealt.mapInArrow(run, READ_BACK)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["record_id", "record_type", "refers_to", "target_uri", "payload_bytes", "payload_digest", "payload", "file", "at"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back: page_id and what its record says."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = written(write(classify(pages, min_bytes), folder), "archives")
    back = read(spark, files, payload=False)
    number = lambda c: F.when(F.length(c) > 0, F.col(c)).cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, CASE WHEN payload_bytes >= {MIN_BYTES} THEN nullif(max(page_id) OVER (PARTITION BY payload_digest), page_id) END AS refers_to FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""
