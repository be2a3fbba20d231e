"""WARC archives: one gzip member a record, written by tasks and read back by byte ranges.

Paths go through pyarrow.fs, so an archive folder may be local, on HDFS or in an object store.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, shared_dir, table

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
MIN_REVISIT_BYTES = 100
SPLIT_BYTES = 32 << 20
CHUNK = 1 << 20
#: Bytes in which a candidate's record header is decoded until its blank line comes.
HEADER_BYTES = 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, verified boolean"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    if not urlsplit(path).scheme:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def _line(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header alone and names the response it repeats."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if is_revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head.append(("Content-Length", str(len(block))))
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(text + block + b"\r\n\r\n") + squeeze.flush()


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to) for each row of pages; refers_to is null for responses.

    Of equal payloads of at least 100 bytes the smallest page_id is the response. Digests alone are
    grouped, with map-side minima. The html is shuffled once, in a join by digest whose hot keys AQE
    splits, or not at all if few payloads repeat.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("digest", F.sha2(html.cast("binary"), 256))
    big = rows.where(F.octet_length(html) >= MIN_REVISIT_BYTES)
    first = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = settle(first)
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.octet_length(html) >= MIN_REVISIT_BYTES, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes an archive a task and returns (path, bytes, records). A retried task replaces its file by a rename."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(folder)
        context = TaskContext.get()
        name = f"{base}/pages-{context.partitionId():06d}.warc.gz"
        partial = f"{base}/.{context.partitionId():06d}-{uuid.uuid4().hex}.tmp"
        store.create_dir(base, recursive=True)
        size = n = 0
        with store.open_output_stream(partial) as out:
            for b in batches:
                for page_id, url, html, digest, refers_to in zip(*(b.column(i) for i in range(5))):
                    page, to = page_id.as_py(), refers_to.as_py()
                    member = record(page, url.as_py(), html.as_py(), digest.as_py(), to, to is not None and to != page)
                    out.write(member)
                    size += len(member)
                    n += 1
        store.move(partial, name)
        yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [n]})

    # checkpointed, so that reading back does not write again
    return settle(records.mapInArrow(run, "path string, bytes long, records long"))


class Tail:
    """The bytes of a file from an offset on, read ahead in chunks."""

    def __init__(self, file: pa.NativeFile, offset: int, size: int):
        self.file, self.at, self.size, self.held = file, offset, size, b""

    def more(self) -> bool:
        if self.at + len(self.held) >= self.size:
            return False
        self.file.seek(self.at + len(self.held))
        self.held += self.file.read(CHUNK)
        return True

    def skip(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def starts_record(tail: Tail) -> bool:
    """Whether a gzip member that holds a whole WARC header, of any length, starts here."""
    stream, fields, at, data, end = zlib.decompressobj(31), bytearray(), 0, b"", -1
    while end < 0 and not stream.eof:
        if not data:
            if at >= len(tail.held) and not tail.more():
                return False
            data = tail.held[at : at + HEADER_BYTES]
            at += len(data)
        try:
            part = stream.decompress(data, HEADER_BYTES)
        except zlib.error:
            return False
        data = stream.unconsumed_tail
        seen = max(0, len(fields) - 3)
        fields += part
        if not fields.startswith(b"WARC/1."[: len(fields)]):
            return False
        end = fields.find(b"\r\n\r\n", seen)
    return end >= 0 and fields.startswith(b"WARC/1.") and 0 <= fields.find(b"\r\nContent-Length:") < end and 0 <= fields.find(b"\r\nWARC-Type:") < end


def find_record(tail: Tail, end: int) -> bool:
    """Moves on to the first record that starts before end; false if there is none."""
    while tail.at < end:
        at = tail.held.find(MAGIC)
        if at < 0:
            keep = min(len(tail.held), len(MAGIC) - 1)
            tail.skip(len(tail.held) - keep)
            if not tail.more():
                return False
            continue
        tail.skip(at)
        if tail.at >= end:
            return False
        if starts_record(tail):
            return True
        tail.skip(1)
    return False


def member(tail: Tail) -> bytes:
    """The decoded member that starts here; moves on to what follows it. Raises on truncated or damaged data."""
    stream, parts = zlib.decompressobj(31), []
    while not stream.eof:
        if not tail.held and not tail.more():
            raise EOFError("truncated gzip member")
        data = tail.held
        parts.append(stream.decompress(data))
        tail.skip(len(data) - len(stream.unused_data))
    return b"".join(parts)


def records_in(path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record that starts in [start, end); reads past end to finish the last."""
    store, base = open_fs(path)
    with store.open_input_file(base) as file:
        tail = Tail(file, start, file.size())
        while find_record(tail, end):
            head, _, rest = member(tail).partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            yield fields, rest[: int(fields["content-length"])]


def parsed(fields: dict[str, str], block: bytes) -> tuple:
    """A row of RECORD. A response's payload is measured and hashed; a revisit's figures are those it states."""
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields.get("warc-payload-digest", "").partition(":")[2]
    is_revisit = fields.get("warc-type") == "revisit"
    sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    n = int(sizes[0]) if is_revisit and sizes else len(payload)
    digest = stated if is_revisit else hashlib.sha256(payload).hexdigest()
    url = fields.get("warc-target-uri")
    return (
        _page(fields.get("warc-record-id")), url, fields.get("warc-type"), _page(fields.get("warc-refers-to")) if is_revisit else None,
        n, digest, None if is_revisit else payload, digest == stated,
    )


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records (RECORD) of the archives in files (path, bytes). Each byte range is a row of work of its own.

    Bytes that belong to no record are skipped; a damaged member raises. Tables with clashing names
    are no concern, as columns are made here. No files give no rows.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in RECORD.split(", "))])
        for b in batches:
            for path, start, end in zip(*(b.column(i) for i in range(3))):
                rows, held = [], 0
                for fields, block in records_in(path.as_py(), start.as_py(), end.as_py()):
                    rows.append(parsed(fields, block))
                    held += len(block)
                    if held > (4 << 20):
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    splits = files.where("bytes > 0").select("path", F.explode(steps).alias("start"))
    splits = splits.select("path", "start", (F.col("start") + split_bytes).alias("end"))
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, 2)
    return splits.repartition(4 * tasks, "path", "start").mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes pages to archives in folder and reads them back (RECORD), one row for each row of pages.

    A null html is an empty payload, a null url an empty one, and a null page_id stays null and never
    answers for others unless all equal payloads have null. Rows that repeat a page_id with an equal
    payload are responses all, as each is the smallest page_id of its payload.
    """
    return read_archives(write_archives(plan_records(pages), folder), split_bytes)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    out = archive_pages(table(spark, sf_dir, "pages"), folder)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= {MIN_REVISIT_BYTES} GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to, true AS verified
FROM d LEFT JOIN f USING (digest)
"""
