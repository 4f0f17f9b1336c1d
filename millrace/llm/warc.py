"""WARC archives: one gzip member per record, written by the tasks; a sequential reader with digest checks.

Writing: payloads are grouped by SHA-1 with a partial aggregate that keeps the least id, so equal payloads are never
gathered; the least id becomes a response, the others revisit it and carry no payload. Each attempt of a task writes an
archive under a name of its own and never touches another's; the manifest, committed once for each task, names those
that count, and what lost attempts left is removed after that.

Reading: bytes stream through zlib member by member; a record is framed by its Content-Length; payload digests are
verified while the payload is read. A task reads an archive from front to back, and there is a task for each archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

CHUNK = 1 << 18
LEVEL = 4
#: Equal payloads of at least so many bytes are revisits of the first.
LEAST_REVISIT = 0
#: Reading tasks at most; beyond it a task reads several archives, one after the other.
MOST_READERS = 100_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Damaged(ValueError):
    """An archive that breaks off, a record that isn't framed as it says, or a payload whose digest is another."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    tail = (value or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes | None, payload_bytes: int, payload_digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit's block is the HTTP head alone."""
    block = HTTP % payload_bytes + (b"" if revisit else payload or b"")
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Payload-Length: {payload_bytes}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Record(NamedTuple):
    headers: dict[str, str]
    payload: bytes


class Members:
    """Bytes of one gzip member after another, decompressed as they are asked for."""

    def __init__(self, file: BinaryIO):
        self.file, self.raw = file, b""

    def next_member(self) -> bool:
        """Starts the next member; False at the end of the file."""
        self.raw = self.raw or self.file.read(CHUNK)
        self.zip, self.data = zlib.decompressobj(31), b""
        return bool(self.raw)

    def more(self) -> bool:
        """Decompresses a little more; False at the member's end."""
        while not self.zip.eof:
            pending = self.zip.unconsumed_tail or self.raw
            from_file = not self.zip.unconsumed_tail
            if not pending:
                pending = self.file.read(CHUNK)
                if not pending:
                    raise Damaged("the archive breaks off inside a record")
            out = self.zip.decompress(pending, CHUNK)
            if from_file:
                self.raw = b""
            if self.zip.eof:
                self.raw = self.zip.unused_data
            if out:
                self.data += out
                return True
        return False

    def line(self) -> bytes:
        while b"\r\n" not in self.data:
            if not self.more():
                raise Damaged("a header without an end")
        line, _, self.data = self.data.partition(b"\r\n")
        return line

    def take(self, n: int) -> Iterator[bytes]:
        """n bytes in pieces."""
        while n:
            if not self.data and not self.more():
                raise Damaged("a record is shorter than its Content-Length")
            piece, self.data = self.data[:n], self.data[n:]
            n -= len(piece)
            yield piece


def read(file: BinaryIO) -> Iterator[Record]:
    """The records of an archive in order. Memory: one record's payload and a chunk."""
    members = Members(file)
    while members.next_member():
        if not members.line().startswith(b"WARC/"):
            raise Damaged("a member doesn't begin with a WARC record")
        headers: dict[str, str] = {}
        while line := members.line():
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if not colon:
                raise Damaged(f"not a header: {name[:80]}")
            headers[name.strip().lower()] = value.strip()
        if not headers.get("content-length", "").isdigit():
            raise Damaged("a record without a Content-Length")
        left = int(headers["content-length"])
        head, payload, sha, in_payload = b"", [], hashlib.sha1(), not headers.get("content-type", "").startswith("application/http")
        for piece in members.take(left):
            if not in_payload:
                head += piece
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                in_payload, piece = True, head[at + 4 :]
            payload.append(piece)
            sha.update(piece)
        rest = members.data
        while members.more():
            rest = members.data
        if rest != b"\r\n\r\n":
            raise Damaged("a record isn't followed by two line ends")
        stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if headers.get("warc-type") != "revisit" and stated and base64.b32encode(sha.digest()).decode() != stated:
            raise Damaged(f"the payload of {headers.get('warc-record-id')} has another digest")
        yield Record(headers, b"".join(payload))


def filesystem(uri: str):
    """(pyarrow filesystem, path) for file:, hdfs:, s3: and gs: folders alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def resolved(pages: DataFrame, payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, body (null for revisits), payload_bytes, sha (hex), first (page_id of the response)."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b"")).alias("body"))
    return named.select("*", F.octet_length("body").cast("long").alias("payload_bytes"), F.sha1("body").alias("sha"))


def write(pages: DataFrame, folder: str, scratch: Scratch, payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Writes `pages` (page_id, url, `payload`) to archives in `folder`; returns the written manifest (file, records)."""
    named = resolved(pages, payload)
    keys = scratch.save(named.select("page_id", "payload_bytes", "sha"), "keys")
    # written before they are joined, so that pages with one common payload can be split over tasks
    firsts = scratch.save(keys.where(F.col("payload_bytes") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"), "firsts")
    # only pages that are not first need a look-up; their ids go to the page rows as a small left join
    # repeated rows go before the join: an aggregate after it, on its key and more, would keep Spark from splitting
    single = keys.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "sha").distinct()
    revisits = single.join(firsts, "sha").where("page_id <> first").select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "first")
    revisits = scratch.save(revisits, "revisits")
    rows = named.join(revisits, (F.col("page_id") == F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    rows = rows.select("page_id", "url", F.when(F.col("_id").isNull(), F.col("body")).alias("body"), "payload_bytes", "sha", "first", F.col("_id").isNotNull().alias("revisit"))

    run_id = uuid.uuid4().hex[:16]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if written := write_archive(batches, folder, run_id, TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_arrays([pa.array([written[0]]), pa.array([written[1]], pa.int64())], names=["file", "records"])

    manifest = scratch.save(rows.mapInArrow(run, "file string, records long"), "manifest")
    drop_lost(folder, run_id, manifest)
    return manifest


def write_archive(batches: Iterator[pa.RecordBatch], folder: str, run_id: str, part: int) -> tuple[str, int] | None:
    """Writes the rows of a partition as an archive with a name that no other attempt has; (file, records), None without rows."""
    system, path = filesystem(folder)
    name, records, out = f"{run_id}-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0, None
    for batch in batches:
        if out is None and len(batch):
            system.create_dir(path, recursive=True)
            out = system.open_output_stream(f"{path}/{name}", compression=None)
        for r in batch.to_pylist():
            out.write(record(r["page_id"], r["url"], r["body"], r["payload_bytes"], base64.b32encode(bytes.fromhex(r["sha"])).decode(), r["first"], r["revisit"]))
            records += 1
    if out is None:
        return None
    out.close()
    return f"{folder}/{name}", records


def drop_lost(folder: str, run_id: str, manifest: DataFrame) -> None:
    """Removes archives of this run that the manifest doesn't name. Both lists have a name for each task or attempt."""
    from pyarrow import fs

    system, path = filesystem(folder)
    named = {r["file"].rpartition("/")[2] for r in manifest.select("file").collect()}
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.base_name.startswith(f"{run_id}-") and info.base_name not in named:
            system.delete_file(info.path)


def archived(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives that `manifest` (file) names; with the payload if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch["file"].to_pylist():
                system, path = filesystem(uri)
                with system.open_input_stream(path, compression=None) as raw:
                    held, size = [], 0
                    for r in read(raw):
                        h = r.headers
                        revisit = h["warc-type"] == "revisit"
                        held.append((page_of(h["warc-record-id"]), int(h["warc-payload-length"]) if revisit else len(r.payload), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], page_of(h.get("warc-refers-to")) if revisit else None, r.payload))
                        size += len(r.payload) * payloads
                        if len(held) >= 1000 or size > 8 << 20:
                            yield rows(held)
                            held, size = [], 0
                    if held:
                        yield rows(held)

    def rows(held: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*held, strict=True))
        arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        if payloads:
            arrays.append(pa.array(cols[5], pa.binary()))
            names.append("payload")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    files = manifest.select("file").distinct()
    dealt = files.repartitionByRange(min(MOST_READERS, max(1, files.count())), "file")  # an archive to a task
    return dealt.mapInArrow(run, RECORDS + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame, folder: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Writes `pages` (page_id, url, html, others ignored) as archives and reads them back: a row per page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty payload; a null url
    is about:blank. Pages with equal payloads are grouped whatever their urls; the least page_id is the response.
    Repeated rows with one page_id and payload are alike: both responses or both revisits. A null page_id is always a
    response and is never referred to. A very long page is one record, held by a task as a whole while it is written or
    read. Of pages that tie in their payload the least page_id is the response. An empty table gives no archive and an
    empty result.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    return archived(write(pages, folder or scratch.path("archives"), scratch))


def archive_bytes(rows: list[tuple]) -> io.BytesIO:
    """An archive in memory from record()'s arguments; for tests."""
    return io.BytesIO(b"".join(record(*r) for r in rows))
