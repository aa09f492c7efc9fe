"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader decompresses incrementally, frames records by Content-Length and verifies block and payload digests.  Archives are
written and read through pyarrow's file systems, so the folder may be any URI of theirs that all executors reach (s3a and s3n count as s3).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import map_arrow, shared_folder, split, table, written

CHUNK = 1 << 16
ROLL_BYTES = 1 << 30
#: So many digests, those of most rows, are broadcast, so that rows of a hot payload are not shuffled.
HOT = 4096
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that is not well formed, or whose content does not have the digest it states."""


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None
    error: str | None = None


def digest(*parts: bytes) -> str:
    h = hashlib.sha1(usedforsecurity=False)
    for p in parts:
        h.update(p)
    return base64.b32encode(h.digest()).decode()


def _lines(*pairs: tuple[str, object]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None).encode()


def _member(headers: bytes, *block: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([z.compress(b"WARC/1.1\r\n" + headers + b"\r\n"), *(z.compress(p) for p in block), z.compress(b"\r\n\r\n"), z.flush()])


def info_member() -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return _member(_lines(("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))), block)


def page_member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (headers of the response, no payload) if refers_to is given."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    http = b"HTTP/1.1 200 OK\r\n" + _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))) + b"\r\n"
    kept = [http] if refers_to is not None else [http, payload]
    headers = _lines(
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", target), ("WARC-Date", DATE),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"), ("WARC-Profile", None if refers_to is None else REVISIT),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(*kept)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", sum(map(len, kept))),
    )
    return _member(headers, *kept)


class _Members:
    """The decompressed bytes of one gzip member after another, a bounded number at a time."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.z, self.raw, self.have, self.ended = stream, None, b"", b"", True

    def next(self) -> bool:
        """Go to the next member; False at the end of the archive."""
        if not self.ended or self.have:
            raise WarcError("a record does not end with its gzip member")
        self.raw = self.raw or self.stream.read(CHUNK)
        if not self.raw:
            return False
        self.z, self.ended = zlib.decompressobj(31), False
        return True

    def fill(self) -> bool:
        """More decompressed bytes; False at the member's end."""
        while not self.ended:
            raw = self.raw or self.stream.read(CHUNK)
            if not raw:
                raise WarcError("the archive ends inside a gzip member")
            try:
                got = self.z.decompress(raw, CHUNK)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from None
            self.raw = self.z.unconsumed_tail
            if self.z.eof:
                self.raw, self.ended = self.z.unused_data, True
            if got:
                self.have += got
                return True
        return False

    def head(self) -> bytes:
        while (at := self.have.find(b"\r\n\r\n")) < 0:
            if len(self.have) > 1 << 20 or not self.fill():
                raise WarcError("a record's headers have no end")
        head, self.have = self.have[:at], self.have[at + 4 :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.have and not self.fill():
                raise WarcError("a record is shorter than its Content-Length")
            part, self.have = self.have[:n], self.have[n:]
            n -= len(part)
            yield part


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_records(stream: BinaryIO, keep_payload: bool = False, strict: bool = True) -> Iterator[Record]:
    """The records of an archive in order; memory stays bounded unless payloads are kept.  SHA-1 digests are verified, others are not.

    A record whose framing is broken is a WarcError, as what follows it cannot be found; one whose digest differs is too, or, if not
    ``strict``, has the error in it.
    """
    members = _Members(stream)
    while members.next():
        version, *lines = members.head().decode(errors="replace").split("\r\n")
        if not version.startswith("WARC/1."):
            raise WarcError(f"not a WARC record: {version[:20]!r}")
        headers = _fields(lines)
        if not headers.get("content-length", "").isdigit():
            raise WarcError("a record has no Content-Length")
        block, body, seen, parts, http = hashlib.sha1(usedforsecurity=False), hashlib.sha1(usedforsecurity=False), 0, [], {}
        pending = b"" if "application/http" in headers.get("content-type", "") else None
        for part in members.take(int(headers["content-length"])):
            block.update(part)
            if pending is not None:  # the HTTP headers come before the payload
                pending += part
                if (at := pending.find(b"\r\n\r\n")) < 0:
                    continue
                http, part, pending = _fields(pending[:at].decode(errors="replace").split("\r\n")[1:]), pending[at + 4 :], None
            body.update(part)
            seen += len(part)
            if keep_payload:
                parts.append(part)
        if b"".join(members.take(4)) != b"\r\n\r\n" or members.fill():
            raise WarcError("a record is longer than its Content-Length")
        by_sha1, revisit = headers.get("warc-payload-digest", "").startswith("sha1:"), headers.get("warc-type") == "revisit"
        stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        own, whole = (base64.b32encode(h.digest()).decode() for h in (body, block))
        error, of_block = None, headers.get("warc-block-digest", "")
        if of_block.startswith("sha1:") and of_block != f"sha1:{whole}" or by_sha1 and not revisit and stated != own:
            error = f"a digest differs in {headers.get('warc-record-id')}"
            if strict:
                raise WarcError(error)
        length = http.get("content-length", "")
        size = (int(length) if length.isdigit() else 0) if revisit else seen
        yield Record(headers, http, size, stated if revisit else own, b"".join(parts) if keep_payload and not revisit else None, error)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the written archives: (path, records, bytes).

    Of rows with equal payloads of at least ``least_bytes``, those with the smallest page_id are responses and the others revisits of
    it.  A null html is an empty payload; a row without page_id is never what others refer to, unless all lack one: then all are responses.
    An archive's name is new for each attempt of a task, and only archives in the returned table count: what a lost
    executor left behind is not read.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    first = p.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = written(first, "firsts")
    hot = first.orderBy(F.desc("n"), "sha").limit(HOT)
    may, never = split(p, first, ["sha"])  # pages that nothing repeats stay where they are
    met = may.join(F.broadcast(hot.select("sha", "first")), "sha", "left")
    columns = ("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    rest = met.where("first is null").drop("first").join(first.select("sha", "first"), "sha", "left") if first.count() > HOT else met.where("first is null")
    linked = met.where("first is not null").select(*columns).union(rest.select(*columns)).union(never.select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")))

    def make(batches):
        where, base = file_system(folder)
        where.create_dir(base, recursive=True)
        out, path, n, size, done = None, "", 0, 0, []
        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is not None and size >= roll_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
                if out is None:
                    path = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = where.open_output_stream(path, compression=None), 1, 0
                    out.write(info_member())
                member = page_member(page_id, url, html.encode(), refers_to)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_pylist([{"path": a, "records": b, "bytes": c} for a, b, c in done], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return written(map_arrow(linked, make, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, path, error[, payload]) of each response and revisit record.

    ``archives`` has a column ``path`` within ``folder``'s file system; any WARC archive of a gzip member a record will do.  ``page_id`` and
    ``refers_to`` are null for records whose id (``record_id``, as it is) is not one of a page.  A record with another digest than it
    states has an ``error``; an archive that is broken at some point has a row with nothing but ``path`` and ``error`` after its good records.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("path", pa.string()), ("error", pa.string())]
    schema = pa.schema(fields + [("payload", pa.binary())] * payload)

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d{1,19})>", urn or "")
        return int(found[1]) if found else None

    def rows_of(where, path):
        try:
            with where.open_input_stream(path, compression=None) as stream:
                for r in read_records(stream, payload, strict=False):
                    h = r.headers
                    if h.get("warc-type") in ("response", "revisit"):
                        yield number(h.get("warc-record-id")), h.get("warc-target-uri"), r.payload_bytes, r.payload_digest, h["warc-type"], number(h.get("warc-refers-to")), h.get("warc-record-id"), path, r.error, r.payload
        except WarcError as e:
            yield *[None] * 7, path, str(e), None

    def make(batches):
        where, _ = file_system(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                for row in rows_of(where, path):
                    rows.append(dict(zip(schema.names, row, strict=False)))
                    held += len(row[-1] or b"")
                    if len(rows) == 4096 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    paths = archives.select("path")
    return map_arrow(paths.repartition(max(1, paths.count())), make, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, path string, error string" + ", payload binary" * payload)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """A record for each row of ``pages``, written to archives in the shared folder and read back; see ``write_archives``.

    A row of an archive that cannot be read back whole is an error that names the archive.
    """
    folder = f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    sound = F.when(F.col("error").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat_ws(": ", "path", "error")).cast("long"))
    return read_archives(archives, folder).select(sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, nullif(first, page_id) AS refers_to FROM p JOIN f USING (html))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM d
"""
