"""WARC archives: writer and sequential reader (operator 10).

The writer puts one gzip member per record into .warc.gz files of bounded size in the shared folder
and returns a manifest of them. The reader streams each file: it inflates member after member
through incremental zlib decompression, frames records by Content-Length and verifies block and
payload digests; a record that doesn't hold raises. File names carry the writing attempt, and only
files of the stored manifest are read, so that tasks may be run again or twice. What was read is checked as a
whole too: each revisit's digest must be that of the response it refers to.

Of records with equal payloads of `least` bytes or more, that with the largest id is written as a
response, the others as revisits that refer to it.

Defined cases: null html is an empty payload; a null or repeated id is kept as it is (all rows with
the group's largest id are responses; a group of null ids only has responses); null url is an empty
target; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_file, shared_dir, store, table

MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Rows of the table of repeated payloads up to which it is broadcast; 64 bytes a row at most.
BROADCAST_ROWS = 200_000


class WarcError(ValueError):
    pass


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One gzip member."""
    sha = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"X-Page: {'' if page_id is None else page_id}",
        f"WARC-Target-URI: {' '.join(url.split())}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_b32(sha)}", f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(f: BinaryIO, step: int = 1 << 16, most_head: int = 1 << 20) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time, each framed while it is inflated.

    A member is inflated `step` bytes at a time and no further than its header's Content-Length allows,
    so one that was made to swell can't take more memory than it declares.
    """
    rest = f.read(step)
    while rest:
        z, out, need = zlib.decompressobj(31), bytearray(), 0
        while not z.eof:
            rest = rest or f.read(step)
            try:
                got = z.decompress(rest, step)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            if not got and not rest:
                raise WarcError("the archive ends inside a record")
            out += got
            rest = z.unconsumed_tail or z.unused_data
            if not need and (end := out.find(b"\r\n\r\n", max(0, len(out) - len(got) - 3))) >= 0:
                need = end + 8 + _length(_header(bytes(out[:end])))
            if len(out) > (need or most_head):
                raise WarcError("the block differs from its content length" if need else "no WARC header")
        yield bytes(out)
        rest = rest or f.read(step)


def _header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC header")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _length(h: dict[str, str]) -> int:
    try:
        n = int(h["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no content length") from e
    if n < 0:
        raise WarcError("no content length")
    return n


def parse(member: bytes) -> dict:
    """A record's fields; its length and digests are verified."""
    head, found, body = member.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("no WARC header")
    h = _header(head)
    n = _length(h)
    if len(body) != n + 4 or body[n:] != b"\r\n\r\n":
        raise WarcError("the block differs from its content length")
    block = body[:n]
    if h.get("warc-block-digest") not in (None, _b32(hashlib.sha1(block).digest())):
        raise WarcError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = dict(x.lower().split(b":", 1) for x in http.split(b"\r\n")[1:] if b":" in x)
    size = int(said.get(b"content-length", len(payload)))
    kind, digest = h.get("warc-type"), h.get("warc-payload-digest", "")
    if kind != "revisit" and (size != len(payload) or digest != _b32(hashlib.sha1(payload).digest())):
        raise WarcError("payload digest or length differs")
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(h.get("x-page")), "url": h.get("warc-target-uri", ""), "record_type": kind, "refers_to": number(h.get("x-refers-to-page")) if kind == "revisit" else None,
        "payload_bytes": size, "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex(), "payload": None if kind == "revisit" else payload,
    }


def _writer(folder: str, most: int):
    def run(it):
        out, path, n, size = None, "", 0, 0
        done = []
        for b in it:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                page_id, url, html, refers, revisit = r
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_file(path, "w")
                z = record(page_id, url or "", (html or "").encode("utf-8", "surrogatepass"), refers, revisit)
                out.write(z)
                n, size = n + 1, size + len(z)
                if size >= most:
                    out.close()
                    out = None
                    done.append((path, n, size))
            yield _rows(done)
            done = []
        if out is not None:
            out.close()
            yield _rows([(path, n, size)])

    return run


def _rows(done):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["path", "records", "bytes"])


def decisions(pages: DataFrame, least: int) -> DataFrame:
    """pages with digest, refers_to and revisit. The table of repeated payloads is broadcast behind a check of its rows."""
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    d = d.withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    same = d.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    same = store(same)
    if same.count() <= BROADCAST_ROWS:
        same = F.broadcast(same)
    d = d.join(same, "digest", "left")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return d.select("page_id", "url", "html", F.when(revisit, F.col("keep")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, least: int = 1000, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes archives; returns their stored manifest."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    return store(decisions(pages, least).mapInArrow(_writer(folder, archive_bytes), MANIFEST))


def _read(it):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    for b in it:
        for path, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows, held, n = [], 0, 0
            with open_file(path, "r") as f:
                for m in members(f):
                    rows.append(parse(m))
                    held, n = held + len(m), n + 1
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if n != records:
                raise WarcError(f"{path} holds {n} records, the manifest says {records}")
            yield pa.RecordBatch.from_pylist(rows, schema)


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's archives."""
    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("path", "records").repartition(n, "path").mapInArrow(_read, RECORD)


def read_bytes(data: bytes) -> list[dict]:
    return [parse(m) for m in members(io.BytesIO(data))]


def checked(records: DataFrame) -> DataFrame:
    """The records, stored, once every revisit was found to have the digest of the response it refers to."""
    records = store(records)
    revisits = records.filter("record_type = 'revisit'").select("refers_to", F.col("payload_digest").alias("digest"))
    responses = records.filter("record_type = 'response'").select("page_id", "payload_digest")
    lost = revisits.join(responses.hint("merge"), (F.col("refers_to") == F.col("page_id")) & (F.col("digest") == F.col("payload_digest")), "left_anti").count()
    if lost:
        raise WarcError(f"{lost} revisits without a response of their digest")
    return records


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(read(write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     w AS (SELECT *, count(*) OVER g AS k, max(page_id) OVER g AS top FROM p WINDOW g AS (PARTITION BY d))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND k > 1 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND k > 1 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM w
"""
