"""WARC archives with revisit records.

Only headers (digest, id, size) are shuffled to find the payloads that occur more than once and the first page of each.
A bitmap of fixed size, broadcast, tells which rows may have such a payload: all others are written where they lie, and
only those that may meet the first pages by digest. Each record is a gzip member of its own, so archives can be
read from any record on. A task packs records into blobs of about BLOB bytes, and Spark's text sink writes
BLOBS of them to a file, whatever the file system: files are bounded by bytes. Between blobs the sink puts an empty member.

Headers are fresh: the date of writing, record ids made of page, digest and place, digests of payload and block, and a
warcinfo record in front of each blob.

Edge cases: a null html is an empty payload; a null url leaves the target out; line breaks and other controls in a url
are percent-encoded; rows that repeat both page_id and payload of a first response are responses too, with its record
id; a null page_id is never first unless all copies have none; an empty table gives no records. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import remove, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = b"\r\n\r\n"
BLOB, BLOBS, LEVEL = 16 << 20, 4, 3
BITS = 1 << 24  # of the bitmap: 512 rows of 4 KB
EMPTY = gzip.compress(b"", mtime=0)
CONTROLS = re.compile("[\x00-\x20\x7f]")


def named(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5('|'.join(map(str, parts)).encode()).hexdigest())}>"


def record(kind: str, date: str, record_id: str, block: bytes, content_type: str, fields: dict[str, str | None]) -> bytes:
    """A record as a gzip member; fields without a value are left out."""
    lines = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Date: {date}".encode(), f"WARC-Record-ID: {record_id}".encode()]
    lines += [f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in fields.items() if v is not None]
    lines += [b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(), f"Content-Type: {content_type}".encode(), b"Content-Length: %d" % len(block)]
    return gzip.compress(b"\r\n".join(lines) + SEPARATOR + block + SEPARATOR, LEVEL, mtime=0)


def _blobs(date: str):
    def run(batches):
        from pyspark import TaskContext

        place, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def blob():
            info = record("warcinfo", date, named("warcinfo", date, place, n), b"software: lumenframe\r\nformat: WARC File Format 1.1\r\n", "application/warc-fields", {})
            return pa.RecordBatch.from_pydict({"blob": pa.array([b"".join([info, *held])], pa.binary())})

        for batch in batches:
            payloads = batch.column("payload").cast(pa.binary())
            for page, url, digest, first, copies, payload in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "first", "copies")), payloads):
                payload = payload.as_buffer().to_pybytes()
                revisit = bool(copies) and page != first
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + SEPARATOR
                fields = {"WARC-Target-URI": None if url is None else CONTROLS.sub(lambda m: f"%{ord(m[0]):02X}", url), "X-Page-Id": page, "WARC-Payload-Digest": f"sha256:{digest}"}
                if revisit:
                    fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": named(first, digest)}
                own = named(page, digest) if copies and not revisit else named(page, digest, place, n)
                held.append(record("revisit" if revisit else "response", date, own, http if revisit else http + payload, "application/http; msgtype=response", fields))
                n, size = n + 1, size + len(held[-1])
                if size >= BLOB:
                    yield blob()
                    held, size = [], 0
        if held:
            yield blob()

    return run


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 100, date: str | None = None) -> None:
    """One record a row under path; of equal payloads of least_bytes or more one is stored, the others revisit it. date: now, if it is None."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload"), 256))
    heads = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    heads = stored(heads, "warc-first")
    x = F.pmod(F.xxhash64("digest"), F.lit(BITS))
    bits = heads.groupBy(F.bitmap_bucket_number(x).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits"))
    marked = rows.withColumns({"bucket": F.bitmap_bucket_number(x), "bit": F.bitmap_bit_position(x)}).join(F.broadcast(bits), "bucket", "left")
    on = F.coalesce(F.expr("shiftright(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) & 1") == 1, F.lit(False))
    columns = ["page_id", "url", "payload", "digest", "first", "copies"]
    alone = marked.where(~on | (F.octet_length("payload") < least_bytes)).withColumns({"first": F.lit(None).cast("long"), "copies": F.lit(None).cast("long")}).select(*columns)
    shared = marked.where(on & (F.octet_length("payload") >= least_bytes)).select("page_id", "url", "payload", "digest").join(heads, "digest", "left").select(*columns)
    blobs = alone.unionAll(shared).mapInArrow(_blobs(date), "blob binary")
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", BLOBS).text(path)
    remove(heads)


def parse(stream):
    """(headers, block) of each record of a binary stream; headers by lower-case name."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("a WARC record is cut short")
        yield headers, block


def _records(with_payload: bool):
    def run(batches):
        out: list[tuple] = []
        names = ("record_id", "record_type", "page_id", "url", "digest", "refers_to_id", "bytes", "payload")
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
        held = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

        for found in batches:
            for content in found.column(0):
                for headers, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())), 1 << 20)):
                    kind = headers["warc-type"]
                    if headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                        raise ValueError(f"the block of {headers['warc-record-id']} does not match its digest")
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(SEPARATOR)
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"the payload of {headers['warc-record-id']} does not match its digest")
                    page = headers.get("x-page-id")
                    out.append((headers["warc-record-id"], kind, int(page) if page else None, headers.get("warc-target-uri"), digest, headers.get("warc-refers-to"), size, payload.decode() if with_payload and kind == "response" else None))
                    held += len(payload) if with_payload else 200
                    if held > 16 << 20:
                        yield batch()
                        out, held = [], 0
        if out:
            yield batch()

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record of the archives under path: its headers, and the payload of responses if with_payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_records(with_payload), "record_id string, record_type string, page_id long, url string, digest string, refers_to_id string, bytes long, payload string")


def resolve(records: DataFrame) -> DataFrame:
    """The op5 contract's columns: each revisit joined to the response that it names."""
    responses = records.where("record_type = 'response'")
    named = responses.select(F.col("record_id").alias("refers_to_id"), "digest", F.col("page_id").alias("refers_to"), F.col("bytes").alias("stored")).dropDuplicates(["refers_to_id", "digest"])
    named = stored(named, "warc-responses")  # one row each: Spark can split the revisits of a page that many revisit
    own = records.select("page_id", "bytes", "digest", "record_type", "refers_to_id").join(named, ["refers_to_id", "digest"], "left")
    return own.select("page_id", F.coalesce("stored", "bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q
"""
