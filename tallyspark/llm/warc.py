"""Web pages written to WARC archives and read back as a table of record chunks.

Writing: pages with equal payloads (by SHA-1, length and a second hash) share one response record, that of the largest
id; the others become revisit records that refer to it. Payloads of under `least` bytes are responses always. Each task writes gzip-compressed archives, a member
for each record, in the given folder under a name of its own, and moves on to another one at ROLL bytes; a file takes
its name only when it is complete, so a task that runs again leaves nothing half-written.

Reading: an archive is streamed and inflated piece by piece. Payloads come as rows (archive, offset, chunk number) of up
to CHUNK bytes with the bytes so far and the SHA-1 so far, so no record is ever held as a whole; the row with `last`
set has the digest and length of the full payload.

Defined cases: a null payload counts as empty; a null url leaves out the target header; among rows of equal payload, all
rows with the largest id are responses; rows with a null id are responses unless others of their payload have an id,
and refer to that then; repeated rows give a record each.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, joined, quoted, scratch

CHUNK, ROLL, READ = 1 << 20, 256 << 20, 1 << 18
ID = "urn:tallyspark:page:"


def _store(path: str):
    """A file system and the path in it, for a folder or file that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{os.path.abspath(path)}")


def record(page_id, url: str | None, payload: bytes | memoryview, digest: str, refers_to) -> Iterator[bytes]:
    """The parts of a record: headers, then the payload unless it refers to another one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else len(payload))}"]
    yield ("\r\n".join(head) + "\r\n\r\n").encode() + http
    if not revisit:
        for at in range(0, len(payload), CHUNK):
            yield payload[at : at + CHUNK]
    yield b"\r\n\r\n"


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, payload, refers_to) -> (path, records, bytes) of the archives written."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    out, name, records, size, made = None, "", 0, 0, []

    def close() -> None:
        nonlocal out
        out.close()
        store.move(f"{root}/.{name}", f"{root}/{name}")
        made.append((f"{folder}/{name}", records, size))
        out = None

    for batch in batches:
        for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
            if out is None:
                name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = store.open_output_stream(f"{root}/.{name}", compression=None)
            # The text lies in the batch as UTF-8 already; it is looked at there, a chunk at a time, and never copied as a whole.
            body = memoryview(payload.as_buffer()) if payload.is_valid and payload.as_buffer() is not None else memoryview(b"")
            sha = hashlib.sha1()
            for at in range(0, len(body), CHUNK):
                sha.update(body[at : at + CHUNK])
            digest = base64.b32encode(sha.digest()).decode()
            press = zlib.compressobj(4, zlib.DEFLATED, 31)
            for part in record(page_id.as_py(), url.as_py(), body, digest, refers_to.as_py()):
                size += out.write(press.compress(part)) or 0
            size += out.write(press.flush()) or 0
            records += 1
            if size >= ROLL:
                close()
    if out is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["path", "records", "bytes"])


def records_of(stream) -> Iterator[tuple[int, dict[str, str], dict[str, str], Iterator[bytes]]]:
    """(offset, WARC headers, HTTP headers, parts of the payload) of each record of a gzip-compressed archive. The
    parts must be read before the next record."""
    buffer, inflate, offset, end = b"", zlib.decompressobj(31), 0, False
    raw, fed = b"", 0

    def more() -> bytes:
        """The next inflated bytes, at most READ; empty at the end of the archive."""
        nonlocal inflate, raw, end, fed
        while True:
            if not raw and not end:
                raw = stream.read(READ)
                end = not raw
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            if not raw and end:
                return b""
            before = len(raw)
            got = inflate.decompress(raw, READ)
            raw = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            fed += before - len(raw)
            if got:
                return got

    def line() -> bytes | None:
        nonlocal buffer
        while b"\r\n" not in buffer:
            got = more()
            if not got:
                return None
            buffer += got
        x, buffer = buffer.split(b"\r\n", 1)
        return x

    def block() -> dict[str, str]:
        found = {}
        while x := line():
            name, _, value = x.decode("utf-8", "replace").partition(":")
            found[name.strip().lower()] = value.strip()
        return found

    while True:
        offset = fed
        first = line()
        while first == b"":
            offset = fed
            first = line()
        if first is None:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at {offset}: {first[:40]!r}")
        head = block()
        left = int(head["content-length"])
        http = {}
        if head.get("content-type", "").startswith("application/http") and left:
            status = line() or b""
            left -= len(status) + 2
            while x := line():
                left -= len(x) + 2
                name, _, value = x.decode("utf-8", "replace").partition(":")
                http[name.strip().lower()] = value.strip()
            left -= 2

        def parts() -> Iterator[bytes]:
            nonlocal buffer, left
            while left > 0:
                if not buffer:
                    buffer = more()
                    if not buffer:
                        raise ValueError("an archive ends within a record")
                part, buffer = buffer[:left], buffer[left:]
                left -= len(part)
                yield part

        body = parts()
        yield offset, head, http, body
        for _ in body:
            pass


def _read(payloads: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["archive", "offset", "record_id", "record_type", "refers_to", "chunk_no", "payload", "bytes_so_far", "digest_so_far", "last"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, at = _store(path)
            rows, held = [], 0
            with store.open_input_stream(at, compression=None) as stream:
                for offset, head, http, body in records_of(stream):
                    key = (path, offset, head["warc-record-id"].strip("<>"), head["warc-type"], head.get("warc-refers-to", "<>").strip("<>") or None)
                    if head["warc-type"] == "revisit":
                        rows.append((*key, 0, None, int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:"), True))
                    else:
                        digest, n, so_far, chunk = hashlib.sha1(), 0, 0, []
                        size = 0
                        for part in body:
                            while part:
                                take, part = part[: CHUNK - size], part[CHUNK - size :]
                                digest.update(take)
                                size += len(take)
                                if payloads:
                                    chunk.append(take)
                                if size == CHUNK:
                                    so_far += size
                                    rows.append((*key, n, b"".join(chunk) if payloads else None, so_far, base64.b32encode(digest.digest()).decode(), False))
                                    n, size, held, chunk = n + 1, 0, held + CHUNK * payloads, []
                                    if held >= 4 * CHUNK:
                                        yield batch_of(rows)
                                        rows, held = [], 0
                        # The last row may be empty: that the payload ends is known only then.
                        rows.append((*key, n, b"".join(chunk) if payloads else None, so_far + size, base64.b32encode(digest.digest()).decode(), True))
                        held += size * payloads
                    if held >= 4 * CHUNK or len(rows) >= 5000:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes pages; returns (path, records, bytes) of the archives.

    A null payload is empty; a page without id gets a record id without number; of pages that repeat an id and a payload each has a record. Of equal
    payloads the largest id is the response (null is least); an empty table gives no archive; other columns, whatever their names, are left out.
    A payload is written from where it lies in its batch, a chunk at a time."""
    bounded_batches(pages.sparkSession)
    page = pages.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(url_col)).alias("url"), F.col(quoted(payload_col)).alias("payload"))
    text = F.coalesce("payload", F.lit(""))
    hashed = page.withColumns({"sha": F.sha1(text.cast("binary")), "other": F.xxhash64(text), "size": F.octet_length(text).cast("long")})
    with scratch(pages.sparkSession) as s:
        same = ["sha", "other", "size"]
        groups = s.save(hashed.groupBy(*same).agg(F.max("id").alias("first"), F.count("*").alias("rows")).where((F.col("rows") > 1) & (F.col("size") >= least)).select(*same, "first"))
        refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")), F.col("first"))
        told = joined(hashed, groups, same, "left").select("id", "url", "payload", refers.alias("refers_to"))
        return s.keep(told.mapInArrow(lambda b: _write(folder, b), "path string, records long, bytes long"))


def read_archives(spark: SparkSession, paths: DataFrame, payloads: bool = True) -> DataFrame:
    """The chunk table of archives(path): (archive, offset, record_id, record_type, refers_to, chunk_no, payload,
    bytes_so_far, digest_so_far, last). payloads: whether the payload column is filled."""
    n = max(1, int(paths.count()))
    schema = "archive string, offset long, record_id string, record_type string, refers_to string, chunk_no long, payload binary, bytes_so_far long, digest_so_far string, last boolean"
    return paths.select("path").repartition(min(n, 4096)).mapInArrow(lambda b: _read(payloads, b), schema)
