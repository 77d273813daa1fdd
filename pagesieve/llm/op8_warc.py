"""WARC archives as a chunked record table: writing, reading, payload digests, revisits."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import id_back, id_of, query, scratch, stored, table

# Payload bytes of one chunk row, and the archive size after which a task begins another file.
CHUNK, FILE = 1 << 18, 1 << 26
READ = 1 << 18
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value

CHUNKS = "file string, record long, page_id long, url string, record_type string, refers_to long, payload_digest string, chunk int, data binary, bytes_so_far long, digest_so_far string, last boolean"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header(lines: list[tuple[str, str]]) -> bytes:
    """Header block; line ends inside a value would end the header, so they become %0D and %0A."""
    safe = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {safe(v)}\r\n".encode() for k, v in lines) + b"\r\n"


def planned(pages: DataFrame) -> DataFrame:
    """(id, url, html, sha1, response_id): of pages with equal payloads the largest page_id is the response."""
    own = pages.select(id_of("page_id").alias("id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    top = stored(own.groupBy("sha1").agg(F.max("id").alias("response_id")), "responses")
    return own.join(top.withColumnRenamed("sha1", "of_sha1"), F.col("sha1") == F.col("of_sha1")).drop("of_sha1")


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", chunk: int = CHUNK, file_bytes: int = FILE) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) and return the archives' paths.

    Archives are ``.warc.gz`` files with one gzip member a record, written by each task into
    ``folder``, which all executors share (a URI with its scheme, or a path of a shared mount). A task's files have names of their own and the
    returned table lists the files of tasks that ended well, so a lost executor or a task
    that ran twice leaves nothing double in it.

    The payload is the html in UTF-8 (NULL: empty). It is compressed in slices of ``chunk``
    bytes. Pages with an equal payload are revisits of the one with the largest page_id and
    have no payload of their own; rows that share that page_id are all responses. A NULL
    page_id counts as the smallest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, size, paths = None, "", 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, sha1, top = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4))
                view = memoryview(batch.column(2)[i].as_buffer() or b"")
                if out is None:
                    path = f"{root}/part-{uuid.uuid4().hex}.warc.gz"
                    out, size = fs.open_output_stream(path, compression=None), 0
                    paths.append(path)
                revisit = page != top
                digest = "sha1:" + base32_sha1(bytes.fromhex(sha1))
                head = [
                    ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{url}')}>"),
                    ("WARC-Date", date), ("WARC-Page-ID", str(page)), ("WARC-Payload-Digest", digest),
                    ("Content-Type", "application/octet-stream"), ("Content-Length", str(0 if revisit else len(view))),
                ]
                head += [("WARC-Target-URI", url)] * (url is not None) + [("WARC-Profile", REVISIT), ("WARC-Refers-To-Page-ID", str(top))] * revisit
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                parts = [_header(head)] + ([] if revisit else [view[k : k + chunk] for k in range(0, len(view), chunk)]) + [b"\r\n\r\n"]
                for part in parts:
                    data = z.compress(part)
                    size += out.write(data)
                size += out.write(z.flush())
                if size >= file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    wide = planned(pages).select("id", "url", "html", "sha1", "response_id")
    return stored(wide.mapInArrow(run, "path string"), "archives")


class _Stream:
    """Bytes of a file of gzip members, a bounded piece at a time."""

    def __init__(self, file):
        self.file, self.buffer, self.raw, self.z = file, b"", b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.file.read(READ)
                if not self.raw:
                    return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(self.raw, READ)
            self.raw = self.z.unconsumed_tail or self.z.unused_data
            if out:
                self.buffer += out
                return True

    def line(self) -> bytes | None:
        while (k := self.buffer.find(b"\n")) < 0:
            if not self._more():
                return None
        out, self.buffer = self.buffer[: k + 1], self.buffer[k + 1 :]
        return out

    def pieces(self, length: int, chunk: int) -> Iterator[bytes]:
        while length:
            while len(self.buffer) < min(chunk, length):
                if not self._more():
                    raise EOFError("the archive ends inside a record")
            out, self.buffer = self.buffer[: min(chunk, length)], self.buffer[min(chunk, length) :]
            length -= len(out)
            yield out


def read_chunks(archives: DataFrame, folder: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Record table of the archives: a row for each record and chunk of its payload, at least one a record.

    Chunks are numbered from 0 and hold ``chunk`` bytes but for the last. ``bytes_so_far``
    and ``digest_so_far`` (SHA-1 in base32) cover the payload up to the chunk's end, so the
    row marked ``last`` has the whole payload's figures, and no record is ever held whole.
    ``record`` is the record's number in its file. Without ``with_data`` the bytes stay out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        names = [x.split(" ")[0] for x in CHUNKS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in _records(fs, path, chunk, with_data):
                    rows.append(row)
                    held += len(row[8] or b"")
                    if len(rows) >= 4096 or held >= 8 * chunk:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    # One row a file, dealt out so that files are read side by side; with a number, as a few
    # short rows would else be folded into one task.
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.repartition(n, "path").mapInArrow(run, CHUNKS)


def _records(fs: pafs.FileSystem, path: str, chunk: int, with_data: bool) -> Iterator[tuple]:
    with fs.open_input_stream(path, compression=None) as file:
        stream, record = _Stream(file), 0
        while (line := stream.line()) is not None:
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record begins here: {line[:40]!r} in {path}")
            head = {}
            while (line := stream.line()) not in (b"\r\n", b"\n", None):
                k, _, v = line.decode().partition(":")
                head[k.strip().lower()] = v.strip()
            sha, size, number = hashlib.sha1(), 0, 0
            length = int(head["content-length"])
            refers = head.get("warc-refers-to-page-id")
            fixed = (path, record, int(head["warc-page-id"]), head.get("warc-target-uri"), head["warc-type"], int(refers) if refers else None, head["warc-payload-digest"].removeprefix("sha1:"))
            if not length:
                yield (*fixed, 0, b"" if with_data else None, 0, base32_sha1(sha.digest()), True)
            for piece in stream.pieces(length, chunk):
                sha.update(piece)
                size += len(piece)
                yield (*fixed, number, piece if with_data else None, size, base32_sha1(sha.copy().digest()), size == length)
                number += 1
            for _ in stream.pieces(4, 4):
                pass
            record += 1


def payloads(chunks: DataFrame) -> DataFrame:
    """One row a record with the full payload's figures; revisits take theirs from the response they refer to."""
    ends = chunks.where("last").select("page_id", "record_type", "refers_to", "payload_digest", "bytes_so_far", "digest_so_far")
    found = ends.where("record_type = 'response'").groupBy("page_id", "digest_so_far").agg(F.max("bytes_so_far").alias("full")).select(F.col("page_id").alias("of_page"), F.col("digest_so_far").alias("of_digest"), "full")
    joined = ends.join(found, (F.col("refers_to") == F.col("of_page")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        id_back(F.col("page_id")).alias("page_id"), F.when(revisit, F.col("full")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("of_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"), "record_type", id_back(F.col("refers_to")).alias("refers_to"),
    )


SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
p AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM d),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
b AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1), '' ORDER BY k) AS payload_digest
      FROM m, unnest(range(0, 32)) t(k) GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN m USING (h) JOIN b USING (h)
"""


@query("op8_warc_chunks", SQL)
def op8(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = scratch(spark, "warc")
    archives = write_archives(pages, folder)
    return payloads(stored(read_chunks(archives, folder), "chunks", compression="zstd"))
