"""WARC (1): a writer, and a sequential reader with one gzip member per record.

The reader decompresses member after member with zlib in pieces, frames each record by its Content-Length, and
verifies block and payload digests while it reads; at most one piece and one header are held, however long a record.
Of records with equal payloads (by SHA-1) of at least ``min_bytes`` bytes, that with the largest key is a
``response``, the others are ``revisit`` records, which hold the HTTP header alone; their payload's length is in that
header's Content-Length, its digest in WARC-Payload-Digest, and the response's key in WARC-Refers-To.

A null payload is empty; a null URL gets a urn of the key. Repeated rows are records of their own: rows that
repeat both key and payload of a response are responses too. An empty table gives no archive. Other columns are not read.
Archives are files in the shared folder, written under a name of the attempt and renamed when complete, so a lost
task leaves nothing behind that the reader would see.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, open_store, save, table

PIECE = 1 << 16
#: Bytes of an HTTP header at most.
MAX_HEADER = 1 << 20
#: A new archive begins beyond so many bytes.
ARCHIVE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed WARC-Date: the corpus has no fetch times.
DATE = "2024-01-01T00:00:00Z"
#: So many shared payloads at most are sent to all executors (about 20 MB).
BROADCAST_ROWS = 300_000
#: Beyond that, rows of one payload are spread over so many keys when its response is looked up.
SALTS = 32


class WarcError(ValueError):
    """An archive that isn't whole or whose digests don't match."""


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_urn(key: int | None) -> str:
    return f"urn:x-record:{'null' if key is None else key}"


def key_of(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, level: int) -> bytes:
    """A gzip member with one record."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_urn(key)}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join((url or record_urn(key)).split()),
        f"WARC-Payload-Digest: sha1:{base32_sha1(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_urn(refers_to)}>"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(whole) + packer.flush()


@dataclass
class Record:
    """What the reader found out about one record; ``payload`` only on request."""

    headers: dict[str, str]
    http_headers: dict[str, str]
    payload_bytes: int
    payload_digest: str
    offset: int
    payload: bytes | None = None

    @property
    def type(self) -> str:
        return self.headers["warc-type"]


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text.startswith((" ", "\t")) and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


@dataclass
class _Member:
    """Bytes of one gzip member, decompressed piece by piece."""

    source: BinaryIO
    pending: bytes
    unzip: object = field(default_factory=lambda: zlib.decompressobj(31))
    held: bytes = b""
    read: int = 0

    def fill(self) -> bool:
        """More decompressed bytes in ``held``, or False at the member's end."""
        while not self.unzip.eof:
            if not self.pending:
                self.pending = self.source.read(PIECE)
                if not self.pending:
                    raise WarcError("the archive ends inside a member")
            before = len(self.pending)
            try:
                got = self.unzip.decompress(self.pending, PIECE)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            self.pending = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            self.read += before - len(self.pending)
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with ``mark``."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self.fill():
                raise WarcError("a header doesn't end")
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """Exactly ``n`` bytes."""
        while n:
            if not self.held and not self.fill():
                raise WarcError("a block is shorter than its Content-Length")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def read_records(source: BinaryIO, keep_payload: bool = False) -> Iterator[Record]:
    """Records of an archive in order; raises WarcError for a broken frame or a digest that doesn't match."""
    pending, offset = b"", 0
    while True:
        pending = pending or source.read(PIECE)
        if not pending:
            return
        member = _Member(source, pending)
        lines = member.until(b"\r\n\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise WarcError(f"no WARC version at byte {offset}")
        headers = _headers(lines[1:])
        if not headers.get("content-length", "").isdigit():
            raise WarcError(f"no Content-Length at byte {offset}")
        block, payload, size, head, kept = hashlib.sha1(), hashlib.sha1(), 0, b"", []
        http: dict[str, str] | None = None if headers.get("content-type", "").startswith("application/http") else {}
        for piece in member.pieces(int(headers["content-length"])):
            block.update(piece)
            if http is None:
                head += piece
                end = head.find(b"\r\n\r\n", max(0, len(head) - len(piece) - 3))
                if end < 0:
                    if len(head) > MAX_HEADER:
                        raise WarcError(f"no end of an HTTP header at byte {offset}")
                    continue
                http, piece = _headers(head[:end].split(b"\r\n")[1:]), head[end + 4 :]
            payload.update(piece)
            size += len(piece)
            if keep_payload:
                kept.append(piece)
        if b"".join(member.pieces(4)) != b"\r\n\r\n" or member.held or member.fill():
            raise WarcError(f"the record at byte {offset} doesn't end with its member")
        digest = "sha1:" + base32_sha1(payload.digest())
        if headers.get("warc-block-digest", want := "sha1:" + base32_sha1(block.digest())) != want:
            raise WarcError(f"block digest of {headers.get('warc-record-id')}")
        if headers.get("warc-type") == "revisit":
            digest, size = headers.get("warc-payload-digest", digest), int((http or {}).get("content-length", 0))
        elif headers.get("warc-payload-digest", digest) != digest:
            raise WarcError(f"payload digest of {headers.get('warc-record-id')}")
        yield Record(headers, http or {}, size, digest.removeprefix("sha1:"), offset, b"".join(kept) if keep_payload else None)
        pending, offset = member.pending, offset + member.read


def write_archives(rows: DataFrame, path: str, level: int = 3) -> list[str]:
    """Write rows of (key, url, payload, revisit, refers_to) as archives under ``path``; their names, one per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = open_store(path)
        out, names, size = None, [], 0

        def close() -> None:
            out.close()
            store.move(f"{names[-1]}.attempt-{task.taskAttemptId()}", names[-1])

        for batch in batches:
            for key, url, payload, revisit, refers_to in zip(*(c for c in batch.columns)):
                if out is None or size > ARCHIVE_BYTES:
                    if out is not None:
                        close()
                    store.create_dir(root, recursive=True)
                    names.append(f"{root}/part-{task.partitionId():06d}-{len(names):04d}.warc.gz")
                    out, size = store.open_output_stream(f"{names[-1]}.attempt-{task.taskAttemptId()}", compression=None), 0
                body = (payload.as_py() or "").encode()
                data = record(key.as_py(), url.as_py(), body, refers_to.as_py(), revisit.as_py(), level)
                out.write(data)
                size += len(data)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n.rpartition("/")[2] for n in names], pa.string())], ["name"])

    rows = rows.select("key", "url", "payload", "revisit", "refers_to")
    return sorted(f"{path}/{r[0]}" for r in rows.mapInArrow(run, "name string").collect())  # one row per file


def read_archives(spark: SparkSession, paths: list[str], keep_payload: bool = False) -> DataFrame:
    """One row per record: archive, offset, key, url, record_type, refers_to, payload_bytes, payload_digest, payload."""
    schema = (
        "archive string, offset long, key long, url string, record_type string, refers_to long, "
        "payload_bytes long, payload_digest string, payload binary"
    )
    arrow = pa.schema(
        [("archive", pa.string()), ("offset", pa.int64()), ("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = open_store(path)
                rows: list[tuple] = []
                with store.open_input_stream(name, compression=None) as source:
                    for r in read_records(source, keep_payload):
                        rows.append((
                            path, r.offset, key_of(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), r.type,
                            key_of(r.headers["warc-refers-to"]) if "warc-refers-to" in r.headers else None,
                            r.payload_bytes, r.payload_digest, r.payload,
                        ))
                        if len(rows) >= (64 if keep_payload else 4096):
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    if not paths:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return files.mapInArrow(run, schema)


def broken_revisits(records: DataFrame) -> DataFrame:
    """Revisits whose size or digest isn't that of the response they refer to, or that refer to none."""
    found = records.where("record_type = 'response'").select(F.col("key").alias("refers_to"), F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("digest"))
    same = (F.col("payload_bytes") == F.col("size")) & (F.col("payload_digest") == F.col("digest"))
    rows = records.where("record_type = 'revisit'").join(found, "refers_to", "left")
    return rows.where(~F.coalesce(same, F.lit(False))).select("key", "refers_to")


def with_revisits(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """Rows of (key, url, payload, revisit, refers_to): of equal payloads, that with the largest key is the response.

    Only payloads that occur under several keys are looked up. While they are few (BROADCAST_ROWS, counted), their
    table goes to the executors and no payload is shuffled; beyond that rows and table meet by digest and salt.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(key).cast("long").alias("key"),
        F.col(url).alias("url"),
        F.col(payload).alias("payload"),
        F.when(F.octet_length(body) >= min_bytes, F.unhex(F.sha1(body.cast("binary")))).alias("sha1"),
    )
    known = F.coalesce(F.col("key"), F.lit(-(2**63)))
    shared = (
        rows.where(F.col("sha1").isNotNull())
        .groupBy("sha1")
        .agg(F.max(known).alias("top"), F.min(known).alias("low"), F.max("key").alias("lead"))
        .where(F.col("top") != F.col("low"))
        .select("sha1", "lead")
    )
    shared, _ = save(shared, "warc-shared-payloads")
    if shared.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(shared), "sha1", "left")
    else:
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", salt).join(salted, ["sha1", "salt"], "left")
    revisit = F.col("lead").isNotNull() & ~F.col("key").eqNullSafe(F.col("lead"))
    return joined.select(
        "key", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("lead")).alias("refers_to")
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, and what the reader finds in the archives."""
    pages = table(spark, sf_dir, "pages")
    paths = write_archives(with_revisits(pages, "page_id", "url", "html"), new_path(spark, "warc"))
    return read_archives(spark, paths).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


#: Base32 of a SHA-1, five bits at a time from its hexadecimal digits.
_BITS = "(({0}) * 16 + ({1})) // (1 << (3 - (5 * i) % 4)) % 32"
_DIGIT = "(strpos('0123456789abcdef', substr(h, {0}, 1)) - 1)"
ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), s AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
l AS (SELECT h, max(page_id) AS lead FROM s GROUP BY h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({_BITS.format(_DIGIT.format('5 * i // 4 + 1'), _DIGIT.format('5 * i // 4 + 2'))})::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to FROM s JOIN l USING (h)
"""
