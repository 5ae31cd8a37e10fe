"""WARC archives: writing with identical-payload revisits, and a sequential reader.

Every record is one gzip member. The reader never holds a member or a file whole: it inflates in pieces, finds the
header block, frames the record by Content-Length, hashes the block and the payload as they pass, and checks both
digests and the gzip trailer. Archives are files in a folder that all executors see; a task writes under a name of its
own attempt and renames at the end, so a task that runs again leaves one whole archive.

Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the largest page_id is the response, and the
others are revisits that name it and repeat its payload digest and HTTP header but not its payload.

Defined cases: null html is an empty payload; null url gives a record without a target; a null page_id is written as
``null``, read back as null, and is never preferred as the response; rows that share page_id and payload are all
responses if they hold the largest page_id; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import fresh_path, settle, table, text_or_empty

REVISIT_BYTES, SALTS, PIECE, MAX_HEADER, LEVEL = 1000, 16, 1 << 20, 1 << 20, 6
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """The archive is cut off, badly framed, or fails a digest."""


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    payload_sha1: str = ""
    payload: bytes | None = None

    @property
    def type(self) -> str:
        return self.headers["warc-type"]


def digest_text(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def digest_hex(text: str) -> str | None:
    """The SHA-1 that a digest header names, in base 32 or hex; null for other hashes."""
    kind, _, value = text.partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if re.fullmatch("[0-9A-Fa-f]{40}", value) else base64.b32decode(value.upper()).hex()


def record_id(page_id: int | None, sha1: bytes) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{sha1.hex()}>"


def page_of(record: str) -> int | None:
    """The page that a record id of ours names; null for ids of other writers."""
    own = re.match(r"<urn:x-page:(-?\d+):", record)
    return int(own[1]) if own else None


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as a gzip member; a revisit of ``refers_to`` if that is given."""
    sha1 = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, sha1)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha1)}"]
    head += [f"WARC-Payload-Digest: {digest_text(sha1)}", f"WARC-Block-Digest: {digest_text(hashlib.sha1(block).digest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Members:
    """The inflated bytes of one gzip member after another, in pieces."""

    def __init__(self, read: Callable[[int], bytes], max_header: int | None = MAX_HEADER):
        self.read, self.max_header, self.raw, self.unpacker, self.buffer = read, max_header, b"", None, b""

    def next_member(self) -> bool:
        self.raw = self.raw or self.read(PIECE)
        if not self.raw:
            return False
        self.unpacker, self.buffer = zlib.decompressobj(31), b""
        return True

    def more(self) -> bytes:
        """Some bytes of this member, or none at its end."""
        while not self.unpacker.eof:
            self.raw = self.raw or self.read(PIECE)
            if not self.raw:
                raise WarcError("the archive ends inside a gzip member")
            try:
                out = self.unpacker.decompress(self.raw, PIECE)
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            self.raw = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            if out:
                return out
        return b""

    def until(self, mark: bytes) -> bytes:
        held, sought = bytearray(self.buffer), 0
        while (at := held.find(mark, sought)) < 0:
            if (self.max_header is not None and len(held) > self.max_header) or not (piece := self.more()):
                raise WarcError("no end of header")
            sought = max(0, len(held) - len(mark) + 1)
            held += piece
        self.buffer = bytes(held[at + len(mark) :])
        return bytes(held[:at])

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            piece = self.buffer or self.more()
            if not piece:
                raise WarcError("the member is shorter than its Content-Length")
            self.buffer, piece = piece[n:], piece[:n]
            n -= len(piece)
            yield piece

    def rest(self) -> bytes:
        held = self.buffer
        while piece := self.more():
            held += piece
            if len(held) > MAX_HEADER:
                raise WarcError("the member is longer than its Content-Length")
        return held


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode().split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"bad header line {line!r}")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(read: Callable[[int], bytes], keep_payload: bool = False, max_header: int | None = MAX_HEADER) -> Iterator[Record]:
    """The records of an archive in order. ``read(n)`` gives up to n raw bytes, none at the end. ``max_header``: None for archives of our own, whose urls have any length.

    A block of type application/http starts with an HTTP header, and the rest is the payload; any other block is payload.
    """
    members = _Members(read, max_header)
    while members.next_member():
        head = members.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise WarcError("no WARC version line")
        record = Record(_fields(head))
        try:
            length = int(record.headers["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("no valid Content-Length") from e
        block_hash, payload_hash, kept, http = hashlib.sha1(), hashlib.sha1(), [], b""
        seen = not record.headers.get("content-type", "").lower().startswith("application/http")
        for piece in members.take(length):
            block_hash.update(piece)
            if not seen:
                http += piece
                at = http.find(b"\r\n\r\n", max(0, len(http) - len(piece) - 3))
                if at < 0:
                    if len(http) > MAX_HEADER:
                        raise WarcError("no end of HTTP header")
                    continue
                record.http, piece, seen = _fields(http[:at]), http[at + 4 :], True
            payload_hash.update(piece)
            record.payload_bytes += len(piece)
            if keep_payload:
                kept.append(piece)
        if members.rest() != b"\r\n\r\n":
            raise WarcError("the record does not end after its Content-Length")
        told = {kind: digest_hex(record.headers.get(f"warc-{kind}-digest", "none")) for kind in ("block", "payload")}
        if told["block"] not in (None, block_hash.hexdigest()):
            raise WarcError(f"block digest of {record.headers.get('warc-record-id')}")
        if record.type == "revisit":
            record.payload_bytes = int(record.http.get("content-length", 0))
            record.payload_sha1 = told["payload"] or ""
        else:
            record.payload_sha1 = payload_hash.hexdigest()
            if told["payload"] not in (None, record.payload_sha1):
                raise WarcError(f"payload digest of {record.headers.get('warc-record-id')}")
            record.payload = b"".join(kept) if keep_payload else None
        yield record


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, head: the page that a revisit names, null for responses.

    Groups of equal payloads are found on digests alone and joined back under a salt, so a payload that is a third of
    all pages is spread over ``SALTS`` keys.
    """
    html = text_or_empty("html").cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("payload"))
    digest = F.when(F.octet_length("payload") >= REVISIT_BYTES, F.sha2("payload", 256))
    heads = rows.select("page_id", digest.alias("_d")).where("_d IS NOT NULL").groupBy("_d").agg(F.max("page_id").alias("head"), F.count("*").alias("_n")).where("_n > 1 AND head IS NOT NULL")
    heads = heads.select(F.col("_d").alias("_digest"), "head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    rows = rows.withColumn("_d", F.coalesce(digest, F.concat(F.lit("-"), F.col("page_id").cast("string")), F.lit("-"))).withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    found = rows.join(heads, (F.col("_d") == F.col("_digest")) & (F.col("_salt") == F.col("_s")), "left")
    return found.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("head"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one archive for each partition of the planned records; returns path, records, bytes."""
    planned = plan_records(pages)

    def write(batches):
        from pyarrow import fs

        ctx = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, n, size, out = f"records-{ctx.partitionId():06d}.warc.gz", 0, 0, None
        part = posixpath.join(root, f".{name}.{ctx.taskAttemptId()}")
        for batch in batches:
            for page_id, url, payload, head in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "head")), strict=True):
                out = out or store.open_output_stream(part, compression=None)
                member = make_record(page_id, url, payload, head)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out:
            out.close()
            store.move(part, posixpath.join(root, name))
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return settle(planned.mapInArrow(write, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to of all records of the archives, read in order."""

    def read(batches):
        from pyarrow import fs

        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for paths in batches:
            for path in paths.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_stream(at, compression=None) as stream:
                    for r in read_records(stream.read, max_header=None):
                        revisit = r.headers.get("warc-refers-to")
                        rows.append((page_of(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), r.type, r.payload_bytes, r.payload_sha1, page_of(revisit) if revisit else None))
                        if len(rows) >= 5000:
                            yield batch()
                            rows = []
                if rows:
                    yield batch()

    spread = archives.select("path").repartition(max(1, min(archives.count(), 10_000)), "path")
    return spread.mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN strlen(html) >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 1000 AND head <> page_id THEN head END AS refers_to
FROM g
"""
