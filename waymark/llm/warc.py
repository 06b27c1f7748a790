"""WARC archives: one gzip member per record, written and read sequentially.

Writing: each task streams its rows into archive files of about ARCHIVE_BYTES, a gzip member for each
record. Files get names of their own and count only if the task that wrote them reports them, so a
task that is run again leaves no double records. Archives lie in the shared folder; pyarrow's file
systems open it, whatever the scheme.

Reading: an archive is read front to back in blocks, each member is decompressed incrementally, the
record's header tells by Content-Length where its block ends, and block and payload digests are
verified. Nothing larger than one record is held.

Of records with equal payloads of at least MIN_REVISIT bytes, that with the largest page_id is the
response and the others are revisits that name it; the payload's digest and its length (in the HTTP
header that a revisit keeps) are those of the full payload.

Defined cases: null html is an empty payload; null url has no target; null page_id is written as
``null`` and never is the largest (if all ids are null, all are responses); equal ids with equal
payloads are all responses; control characters in a url are percent-encoded; no rows write no file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import shared_path, table, written

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
_BLOCK = 1 << 18
#: The date of every record: the synthetic pages have none.
DATE = "2024-01-01T00:00:00Z"


def _uri(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if revisit:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def open_shared(path: str, mode: str):
    """A stream at a path of the shared folder, read from or written by a task."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)
    if mode == "w":
        system.create_dir(name.rpartition("/")[0], recursive=True)
        return system.open_output_stream(name, compression=None)
    return system.open_input_stream(name, compression=None)


def _members(stream):
    """The decompressed bytes of each gzip member, as an iterator of blocks."""
    left = stream.read(_BLOCK)
    while left:

        def blocks(z=zlib.decompressobj(31)):
            nonlocal left
            while not z.eof:
                if not left and not (left := stream.read(_BLOCK)):
                    raise ValueError("the archive ends inside a record")
                out = z.decompress(left, _BLOCK)
                left = z.unused_data if z.eof else z.unconsumed_tail
                if out:
                    yield out

        yield blocks()
        left = left or stream.read(_BLOCK)


def read_archive(stream):
    """Yields (headers, http_length, payload or None) of each record; checks frames and digests."""
    for blocks in _members(stream):
        held = bytearray()
        while (end := held.find(b"\r\n\r\n")) < 0:
            held += next(blocks, b"") or _fail("a record has no header's end")
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            _fail("a record does not begin with WARC/")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        length = int(headers["Content-Length"])
        for more in blocks:
            held += more
            if len(held) > end + 4 + length + 4:
                _fail("a record is longer than its Content-Length")
        block, tail = bytes(held[end + 4 : end + 4 + length]), held[end + 4 + length :]
        if len(block) < length or tail != b"\r\n\r\n":
            _fail("a record's Content-Length does not match")
        if headers["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
            _fail("a block does not match its digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        http_length = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
        if headers["WARC-Type"] == "revisit":
            yield headers, http_length, None
            continue
        if len(payload) != http_length or headers["WARC-Payload-Digest"] != f"sha1:{hashlib.sha1(payload).hexdigest()}":
            _fail("a payload does not match its length or digest")
        yield headers, http_length, payload


def _fail(what: str):
    raise ValueError(what)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, refers_to (of revisits, else null) and revisit of each page.

    Only ids and digests are grouped; the pages themselves are joined with the digests found twice,
    which Spark broadcasts if they are few and else meets by digest, splitting large groups.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long"), "url", "html", F.when(F.length(payload) >= min_bytes, F.sha1(payload)).alias("__digest"))
    slim = keyed.where("__digest IS NOT NULL").groupBy("__digest").agg(F.max("page_id").alias("__first"), F.count(F.lit(1)).alias("n"))
    twice = written(slim.where("n > 1 AND __first IS NOT NULL").select(F.col("__digest").alias("__twin"), "__first"), "payloads")
    # Pages too short to be revisits get keys of their own, so that they don't meet in one task.
    key = F.coalesce(F.col("__digest"), F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    out = keyed.withColumn("__digest", key).join(twice, F.col("__digest") == F.col("__twin"), "left")
    revisit = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return out.select("page_id", "url", "html", F.when(revisit, F.col("__first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html, refers_to, revisit); returns archive, n_records, n_bytes of the files that count."""

    def run(batches):
        rows, stream, name, count, size = [], None, "", 0, 0
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")]
            for page_id, url, html, refers_to, revisit in zip(*columns):
                if stream is None:
                    name, count, size = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = open_shared(name, "w")
                raw = member(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, revisit))
                stream.write(raw)
                count, size = count + 1, size + len(raw)
                if size >= archive_bytes:
                    stream.close()
                    rows.append((name, count, size))
                    stream = None
        if stream is not None:
            stream.close()
            rows.append((name, count, size))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "n_records", "n_bytes"])

    return written(pages.mapInArrow(run, "archive string, n_records long, n_bytes long"), "archives")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, with_html: bool = False) -> DataFrame:
    """The records of archives (archive, n_records), verified; fails if a file has other than n_records."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    schema = schema.append(pa.field("html", pa.string())) if with_html else schema
    number = lambda uri: None if uri is None or uri == "<urn:page:null>" else int(uri[10:-1])

    def run(batches):
        for b in batches:
            for name, expected in zip(b.column("archive").to_pylist(), b.column("n_records").to_pylist()):
                rows, n, held = [], 0, 0
                with open_shared(name, "r") as stream:
                    for headers, length, payload in read_archive(stream):
                        n += 1
                        row = [number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), length, headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"], number(headers.get("WARC-Refers-To"))]
                        rows.append([*row, None if payload is None else payload.decode("utf-8", "surrogatepass")] if with_html else row)
                        held += length if with_html else 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if n != expected:
                    raise ValueError(f"{name} has {n} records, not {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    # A file for each task, dealt by name.
    dealt = archives.repartition(max(1, min(archives.count(), 100_000)), "archive")
    return dealt.mapInArrow(run, RECORDS + ", html string" * with_html)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = with_revisits(table(spark, sf_dir, "pages"))
    archives = write_archives(pages, shared_path(spark, "warc"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL with the same rows.
OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM s)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
