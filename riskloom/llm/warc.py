"""WARC archives written and read as a chunked record table.

Read, a record is rows of (record id, chunk number, data), each with the bytes and
the SHA-1 of the payload so far, so no record is ever whole in the reader's memory,
however large. Written, payloads are compressed and put out in chunks, but come from
table rows, so a task holds those of one Arrow batch. Archives are gzip
files with a member for each record, in any file system Arrow knows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import local_path, materialize, partitions, scratch

CHUNK = 1 << 20
#: bytes of payload after which a task begins another archive
ARCHIVE_BYTES = 1 << 30
#: copies shorter than this are all written as responses
LEAST_REVISIT = 1000
#: chunks (of at most CHUNK bytes) in a batch of the chunk table that has data
BATCH_CHUNKS = 16
#: signs that stay as they are in a URI, % among them, as what is escaped already stays so
_URI_SIGNS = "!#$%&'()*+,/:;=?@[]~"
_DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, payload_bytes long"
CHUNKS = "path string, record_id string, page_id long, url string, record_type string, refers_to long, chunk_no long, last boolean, data binary, bytes_so_far long, sha1_so_far string"


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to: which records of equal payloads refer to which.

    Only digests that occur twice come into the join, so payloads move only if those are many.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    twice = p.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    p = p.join(twice, "digest", "left")
    # rows that repeat the response's page_id are responses too
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return p.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"urn:sha1:{hashlib.sha1(f'{page_id}/{digest}'.encode()).hexdigest()}"


def _pieces(page_id, url, payload: memoryview, digest: str, kind: str, refers_to) -> Iterator[bytes | memoryview]:
    """A WARC/1.1 record, piece by piece."""
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = len(http) + (0 if kind == "revisit" else len(payload))
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_record_id(page_id, digest)}>", f"WARC-Date: {_DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Bytes: {len(payload)}", f"Content-Length: {body}"]
    if url is not None:
        uri = quote(url, safe=_URI_SIGNS)
        head.append("WARC-Target-URI: " + uri)
        if uri != url:  # for readers of our own: what it was before it became a URI
            head.append("X-Original-URL: " + url.encode("unicode_escape").decode("ascii"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{_record_id(refers_to, digest)}>", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    yield ("\r\n".join(head) + "\r\n\r\n").encode()
    yield http
    if kind != "revisit":
        for i in range(0, len(payload), CHUNK):
            yield payload[i : i + CHUNK]
    yield b"\r\n\r\n"


def write(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html); returns the manifest (path, records, payload_bytes).

    A null html is an empty payload; null ids and urls leave their header out; a table without rows writes nothing.
    A task attempt writes files of its own name, and only those of attempts that ended are in the manifest, so lost
    executors leave nothing that is read.
    """

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = local_path(folder)
        fs.create_dir(base, recursive=True)
        out, records, size, done = None, 0, 0, []
        for b in batches:
            rows = [b.column(i) for i in range(b.num_columns)]
            for i in range(b.num_rows):
                page_id, url, digest, kind, refers = (rows[k][i].as_py() for k in (0, 1, 3, 4, 5))
                payload = memoryview(rows[2][i].as_buffer())
                if out is None:
                    path = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):03d}.warc.gz"
                    out, records, size = fs.open_output_stream(path, compression=None), 0, 0
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                for piece in _pieces(page_id, url, payload, digest, kind, refers):
                    out.write(z.compress(piece))
                out.write(z.flush())
                records, size = records + 1, size + len(payload)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "payload_bytes"])

    return materialize(plan(pages).mapInArrow(run, MANIFEST), "manifest")


class _Inflated:
    """Bytes of a file of gzip members, as they are asked for."""

    def __init__(self, raw):
        self.raw, self.z, self.held = raw, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.z.eof:
            rest = self.z.unused_data or self.raw.read(CHUNK)
            if not rest:
                return False
            self.z = zlib.decompressobj(31)
        else:
            rest = self.z.unconsumed_tail or self.raw.read(CHUNK)
            if not rest:
                raise EOFError("a record is cut off")
        self.held += self.z.decompress(rest, CHUNK)
        return True

    def line_block(self) -> bytes | None:
        """Up to and without the next empty line; None at the end of the file."""
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.held:
                    raise EOFError("a header is cut off")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + 4]
        return out

    def take(self, most: int) -> bytes:
        while not self.held:
            if not self._more():
                raise EOFError("a payload is cut off")
        out = bytes(self.held[:most])
        del self.held[: len(out)]
        return out


def chunks_of(raw) -> Iterator[dict]:
    """The chunk rows of one open archive; raises if a payload is not what its header says."""
    src = _Inflated(raw)
    while (head := src.line_block()) is not None:
        field = dict(x.split(": ", 1) for x in head.decode("ascii").split("\r\n")[1:])
        left = int(field["Content-Length"])
        http = src.line_block()
        left -= len(http) + 4
        sha1 = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        row = {"record_id": field["WARC-Record-ID"][1:-1], "page_id": int(field["X-Page-ID"]) if "X-Page-ID" in field else None, "url": field["X-Original-URL"].encode("ascii").decode("unicode_escape") if "X-Original-URL" in field else field.get("WARC-Target-URI"), "record_type": field["WARC-Type"], "refers_to": int(field["X-Refers-To-Page"]) if "X-Refers-To-Page" in field else None}
        if field["WARC-Type"] == "revisit":
            yield row | {"chunk_no": 0, "last": True, "data": b"", "bytes_so_far": int(field["X-Payload-Bytes"]), "sha1_so_far": sha1}
        else:
            digest, so_far, no = hashlib.sha1(), 0, 0
            while True:
                data = src.take(min(CHUNK, left)) if left else b""
                left -= len(data)
                digest.update(data)
                so_far += len(data)
                yield row | {"chunk_no": no, "last": not left, "data": data, "bytes_so_far": so_far, "sha1_so_far": digest.hexdigest()}
                no += 1
                if not left:
                    break
            if digest.hexdigest() != sha1:
                raise ValueError(f"{row['record_id']}: payload and digest differ")
        if src.take(2) + src.take(2) != b"\r\n\r\n":
            raise ValueError(f"{row['record_id']}: no end of record")


def read(manifest: DataFrame, data: bool = True) -> DataFrame:
    """The chunk table of the archives of a manifest; without ``data``, that column is null and only last chunks are rows."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_parse_datatype_string(CHUNKS))
    most = BATCH_CHUNKS if data else 1000

    def run(batches):
        from pyarrow import fs as afs

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = (afs.LocalFileSystem(), path) if path.startswith("/") else local_path(path)
                with fs.open_input_stream(at, compression=None) as raw:
                    rows = []
                    for row in chunks_of(raw):
                        if data or row["last"]:
                            rows.append(row | {"path": path, "data": row["data"] if data else None})
                        if len(rows) >= most:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.select("path").repartition(partitions(manifest.sparkSession), "path").mapInArrow(run, CHUNKS)


def digests(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    manifest = write(pages, folder or scratch(pages.sparkSession, "warc"))
    return read(manifest, data=False).select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type", "refers_to")
