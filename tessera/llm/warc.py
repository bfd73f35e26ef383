"""WARC archives: a record writer and a splittable reader.

Writing: one gzip member per record, one archive per Spark partition, in a
folder on any file system that pyarrow opens (``file:``, ``hdfs:``, ``s3:``).
An archive is written under a name of its attempt and moved into place when
complete, so a retried or speculative task leaves one whole archive.  Equal
payloads of at least ``min_bytes`` become one response (smallest page id)
and revisits that refer to it.

Reading: archives are cut into byte ranges that have nothing to do with the
records.  The task of a range looks for the gzip magic, takes a candidate as
a member only if it inflates to a ``WARC/`` version line, and owns the
records that start inside its range; it reads past the end of the range to
finish its last one.  Payloads stream through the digest, so a task holds a
chunk of a record, not the whole.

Defined results: a null html is an empty payload; a null page id is written
without its header and read back as null (it is never chosen as a referred
page unless all ids of the payload are null, and then all rows are
responses); rows that repeat the smallest id are responses each; a null url
is left out and control characters in it are percent-encoded; an empty table
gives no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tessera.llm import text_arrays as ta
from tessera.session import ensure_checkpoint_dir, materialize

MIN_BYTES = 0
SPLIT_BYTES = 8 << 20
CHUNK = 256 << 10
MAGIC = b"\x1f\x8b\x08"
LEVEL = 3
_HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)", re.M)


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(uri: str):
    """pyarrow file system and path of a Hadoop-style location."""
    if re.match(r"^file:/+", uri):
        return fs.LocalFileSystem(), "/" + uri.split(":", 1)[1].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def record_types(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages`` plus ``payload_bytes, payload_digest, first_id``: the smallest
    page id of the payload's group.  Only the digests of groups of two or more
    travel to the join, and the rows of large groups are pre-counted per task."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select("page_id", "url", "html", F.octet_length(body).cast("long").alias("payload_bytes"),
                         F.unhex(F.sha1(body)).alias("sha"))
    groups = (known.where(F.col("payload_bytes") >= min_bytes).groupBy("sha")
              .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return known.join(groups, "sha", "left")


def _record(page_id, url, html, sha, first_id) -> bytes:
    payload = (html or "").encode()
    revisit = first_id is not None and page_id is not None and page_id > first_id
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}",
            f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)
        head.append(f"WARC-Target-URI: {clean}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{first_id}>"]
        block = http
    else:
        block = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``record_types`` rows; ``path, bytes, records`` of each archive."""

    def run(batches):
        task = TaskContext.get()
        store, base = _open(folder)
        final = f"{base}/part-{task.partitionId():06d}.warc.gz"
        attempt = f"{base}/.{task.taskAttemptId()}-{uuid.uuid4().hex}"
        out, size, n = None, 0, 0
        for part in ta.blocks(batches, "html"):
            for row in zip(*(part.column(i).to_pylist() for i in range(5))):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(attempt)
                member = _record(*row)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            store.move(attempt, final)
            scheme = re.match(r"^[a-z0-9]+:", folder)
            path = folder.rstrip("/") + final[len(base):] if scheme else final
            yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "records": n}])

    return records.select("page_id", "url", "html", "sha", "first_id").mapInArrow(
        run, "path string, bytes long, records long")


def _members(handle, start: int, end: int, size: int):
    """Yield the member headers that start in ``[start, end)`` with a reader of
    their inflated bytes; validates each candidate, skips false magic."""
    window, at = b"", start               # file bytes [at, at + len(window))
    while at < end:
        if len(window) < 64 << 10 and at + len(window) < size:
            handle.seek(at + len(window))
            window += handle.read(CHUNK)
        found = window.find(MAGIC)
        if found < 0:
            step = max(len(window) - 2, 1)
            if at + len(window) >= size:
                return
            at, window = at + step, window[step:]
            continue
        at, window = at + found, window[found:]
        if at >= end:
            return
        record = _Inflate(handle, at, window, size)
        if record.head(5) == b"WARC/":
            yield record
            record.drain()
            if record.whole:
                at, window = record.end, b""
                continue
        at, window = at + 1, window[1:]


class _Inflate:
    """Inflated bytes of one gzip member, read chunk by chunk."""

    def __init__(self, handle, at, window, size):
        self.handle, self.next, self.size = handle, at + len(window), size
        self.pending, self.ready = window, b""
        self.z = zlib.decompressobj(31)
        self.whole, self.end = False, at

    def more(self) -> bool:
        """Inflate another chunk into ``ready``; False at the end or on damage."""
        if self.whole or self.z is None:
            return False
        if not self.pending:
            if self.next >= self.size:
                self.z = None
                return False
            self.handle.seek(self.next)
            self.pending = self.handle.read(CHUNK)
            self.next += len(self.pending)
        try:
            self.ready += self.z.decompress(self.pending, CHUNK)
        except zlib.error:
            self.z = None
            return False
        self.pending = self.z.unconsumed_tail
        if self.z.eof:
            self.whole, self.end = True, self.next - len(self.z.unused_data)
        return True

    def head(self, n: int) -> bytes:
        while len(self.ready) < n and self.more():
            pass
        return self.ready[:n]

    def until(self, mark: bytes, most: int | None = None) -> bytes:
        """Bytes up to and with ``mark``, ``most`` at most (empty if it is not found)."""
        while mark not in self.ready and (most is None or len(self.ready) < most) and self.more():
            pass
        cut = self.ready.find(mark, 0, most)
        if cut < 0:
            return b""
        got, self.ready = self.ready[:cut + len(mark)], self.ready[cut + len(mark):]
        return got

    def take(self, n: int):
        """Yield the next ``n`` bytes in chunks."""
        while n > 0 and (self.ready or self.more()):
            got, self.ready = self.ready[:n], self.ready[n:]
            n -= len(got)
            yield got

    def drain(self):
        self.ready = b""
        while self.more():
            self.ready = b""


def _parse(record: _Inflate):
    """One record's row, or None if its header is no WARC header."""
    head = {k.strip().lower(): v.strip() for k, v in _HEADER.findall(record.until(b"\r\n\r\n"))}
    if b"warc-type" not in head or not head.get(b"content-length", b"").isdigit():
        return None
    left, http = int(head[b"content-length"]), b""
    if head.get(b"content-type", b"").startswith(b"application/http"):
        http = record.until(b"\r\n\r\n", left)
        left -= len(http)
    sha, size = hashlib.sha1(), 0
    for chunk in record.take(left):
        sha.update(chunk)
        size += len(chunk)
    page = re.match(rb"<urn:page:(-?\d+)>", head.get(b"warc-record-id", b""))
    refers = re.match(rb"<urn:page:(-?\d+)>", head.get(b"warc-refers-to", b""))
    kind = head[b"warc-type"].decode()
    digest = base64.b32encode(sha.digest()).decode()
    if kind == "revisit":
        digest = head.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
        size = int(head.get(b"x-payload-length", b"0"))
    return {"page_id": int(page[1]) if page else None, "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": int(refers[1]) if refers else None,
            "url": head[b"warc-target-uri"].decode() if b"warc-target-uri" in head else None}


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Read ``path, bytes`` archives by byte ranges; one row per record."""
    ranges = archives.select("path", "bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("at"))

    def run(batches):
        for batch in batches:
            for path, size, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                store, name = _open(path)
                rows = []
                with store.open_input_file(name) as handle:
                    for record in _members(handle, at, min(at + split_bytes, size), size):
                        row = _parse(record)
                        if row:
                            rows.append(row)
                        if len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ROW)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, "
             "refers_to long, url string")


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES,
                  split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write ``pages`` as archives and read them back by byte ranges.

    ``folder`` defaults to a new one under the shared checkpoint folder.
    """
    spark = pages.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    written = materialize(write_archives(record_types(pages, min_bytes), folder))
    return read_archives(written, split_bytes)
