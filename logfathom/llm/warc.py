"""WARC archives: one gzip member a record, an index of byte ranges, coalesced range reads.

Writing returns the index: archive, offset, length, URL and digest of each record. Reading
takes any selection of index rows, sorts it by archive and offset, and joins neighbouring
ranges into one read. Archives lie in a folder that driver and executors share; a task
names its files by its attempt, and only the index rows of the attempt that succeeded
count, so a lost executor leaves at most unused files.

Edge cases: null html is an empty payload, null URLs have no WARC-Target-URI; records with
equal payloads of at least ``MIN_REVISIT`` bytes revisit the one with the smallest page_id
(rows tied on it are all responses; a null page_id never is the smallest, and where all are
null all are responses); repeated rows give repeated records; a payload of any
length is one record, read back whole; an empty table gives an empty
index; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, staged

MIN_REVISIT = 100
#: An archive is closed beyond so many bytes. Ranges are read together across gaps and up to sums of so many.
ARCHIVE_BYTES, GAP_BYTES, READ_BYTES = 64 << 20, 64 << 10, 8 << 20
INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, archive string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record: a response with an HTTP block, or a revisit without a payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload if refers_to is None else head + b"\r\n"
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Page-ID": page_id,
        "WARC-Payload-Length": len(payload),
        "WARC-Refers-To": None if refers_to is None else record_id(refers_to, digest),
        "WARC-Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        task, out, n, at = TaskContext.get(), None, 0, 0
        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            rows = []
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz"
                    out, at, n = files.open_output_stream(f"{base}/{name}", compression=None), 0, n + 1
                payload = html or b""
                member = _gzip(record(page_id, url, payload, digest, refers_to))
                out.write(member)
                rows.append((page_id, url, digest, len(payload), "response" if refers_to is None else "revisit", refers_to, name, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names)
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write a record per row of ``pages`` (page_id, url, html); the index and the archives' folder."""
    folder = shared_dir(pages.sparkSession)
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1])
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    pages = pages.select("page_id", "url", body.alias("html"), F.sha2(body, 256).alias("digest"))
    large = pages.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = large.where("n > 1").select(F.col("digest").alias("_d"), "first")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    rows = pages.join(again, F.col("digest") == F.col("_d"), "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return staged(rows.mapInArrow(_writer(folder), INDEX)), folder


def _reader(folder: str):
    def flush(files: fs.FileSystem, path: str, rows: list[dict]) -> Iterator[tuple]:
        start, end = rows[0]["offset"], rows[-1]["offset"] + rows[-1]["length"]
        with files.open_input_file(path) as f:
            data = f.read_at(end - start, start)
        for r in rows:
            at = r["offset"] - start
            fields, payload = parsed(zlib.decompress(data[at : at + r["length"]], 31))
            whole = fields["WARC-Type"] == "response"
            digest = hashlib.sha256(payload).hexdigest() if whole else fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if whole and f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
                raise OSError(f"{path} at {r['offset']}: the payload does not fit its digest")
            number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
            yield number("WARC-Page-ID"), fields.get("WARC-Target-URI"), len(payload) if whole else number("WARC-Payload-Length"), digest, fields["WARC-Type"], number("WARC-Refers-To-Page-ID"), payload if whole else None

    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in RECORD.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        run: list[dict] = []

        def out() -> pa.RecordBatch:
            rows = list(flush(files, f"{base}/{run[0]['archive']}", run))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for r in batch.to_pylist():
                last = run[-1] if run else r
                if run and (r["archive"] != last["archive"] or r["offset"] - last["offset"] - last["length"] > GAP_BYTES or r["offset"] + r["length"] - run[0]["offset"] > READ_BYTES):
                    yield out()
                    run = []
                run.append(r)
        if run:
            yield out()

    return read


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that rows of an index point to, in about one task an archive.

    The number of tasks follows the bytes to read: by the size of the few index rows alone, Spark would put all in one.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, total // ARCHIVE_BYTES + 1)
    ranges = index.select("archive", "offset", "length").repartition(tasks, "archive").sortWithinPartitions("archive", "offset")
    return ranges.mapInArrow(_reader(folder), RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Per page, from its record as read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_records(*write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
