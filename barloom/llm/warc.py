"""WARC archives: a writer, and a splittable reader (operator 7).

The writer gives every record a gzip member of its own. The reader splits archives by byte ranges: a task looks for the
gzip magic in its range, takes a position for a member only if the header decodes and inflating it yields a whole WARC
record, and owns the records that start inside its range; the last one may end beyond it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import read, slices, work_dir

MAGIC = b"\x1f\x8b\x08"
_HEAD = re.compile(rb"WARC/1\.[01]\r\n")
RECORDS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, at long, size long"


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme Spark gives it, so that tasks open the same folder as Spark's own writers."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().toString()


def decide(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, digest, bytes, refers_to) of pages (page_id, body binary).

    Of the pages with equal bodies of at least least_bytes, the largest page_id is the response (refers_to null) and the
    others refer to it. Only ids and digests are shuffled; a hot body is a count per task first, and the join back is
    one that AQE can split.
    """
    rows = pages.select("page_id", F.sha1("body").alias("digest"), F.length("body").cast("long").alias("bytes"))
    groups = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    copies = groups.filter("n > 1").select("digest", "bytes", "top")
    joined = rows.join(copies, ["digest", "bytes"], "left")
    return joined.select("page_id", "digest", "bytes", F.when(F.col("page_id") != F.col("top"), F.col("top")).alias("refers_to"))


def _record(page_id: int | None, url: str, body: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record. A revisit keeps the HTTP header (with the full length) and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if refers_to is not None else http + body
    name = "" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {datetime(2024, 1, 1, tzinfo=UTC):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", body: str = "html", least_bytes: int = 1000, level: int = 6) -> DataFrame:
    """Write one record per row of `pages` into archives below `path` (a folder all executors share); returns the
    manifest (archive, bytes) once all are written.

    A null body is empty and a null url blank. Rows with the same page_id are records of their own; they must not differ
    in body, else each is judged by its own body. A retried task writes an archive of a new name, and only the archives
    of successful attempts are in the manifest. No rows give no archives.
    """
    path = _qualified(pages.sparkSession, path)
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(body).cast("binary"), F.lit(b"")).alias("body"))
    plan = decide(rows, least_bytes).distinct()
    keyed = rows.withColumn("digest", F.sha1("body"))
    both = keyed.join(plan.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, size, out = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz", 0, None
        store, folder = fs.FileSystem.from_uri(path)
        try:
            for batch in batches:
                for part in slices(batch, "body"):
                    for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "body", "digest", "refers_to")), strict=True):
                        if out is None:
                            store.create_dir(folder, recursive=True)
                            out = store.open_output_stream(f"{folder}/{name}", compression=None)
                        member = _member(_record(*row), level)
                        out.write(member)
                        size += len(member)
        finally:
            if out is not None:
                out.close()
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size])], ["archive", "bytes"])

    made = both.select("page_id", "url", "body", "digest", "refers_to").mapInArrow(run, "archive string, bytes long")
    made.write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema("archive string, bytes long").parquet(f"{path}/manifest")


def _inflate(source: pa.NativeFile, at: int, end: int, step: int = 1 << 18) -> tuple[bytes, int] | None:
    """(content, bytes) of the gzip member at `at`, or None if there is none."""
    packer, out, pos = zlib.decompressobj(31), [], at
    try:
        while not packer.eof:
            chunk = source.read_at(min(step, end - pos), pos) if pos < end else b""
            if not chunk:
                return None
            pos += len(chunk)
            out.append(packer.decompress(chunk))
            if len(out) == 1 and len(out[0]) >= 10 and not _HEAD.match(out[0]):
                return None
    except zlib.error:
        return None
    content = b"".join(out)
    return (content, pos - at - len(packer.unused_data)) if _HEAD.match(content) else None


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _parse(content: bytes) -> tuple | None:
    """(page_id, type, refers_to, payload length, digest, payload) of a record; None if it isn't whole."""
    head, found, rest = content.partition(b"\r\n\r\n")
    fields = _fields(head)
    if not found or not fields.get("content-length", "").isdigit() or len(rest) < int(fields["content-length"]):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda key: (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(key, ""))) and int(m[1])
    kind = fields.get("warc-type", "")
    if kind == "response":
        return number("warc-record-id"), kind, None, len(payload), hashlib.sha1(payload).hexdigest(), payload
    length = _fields(http).get("content-length", "0")
    return number("warc-record-id"), kind, number("warc-refers-to"), int(length), fields.get("warc-payload-digest", "").removeprefix("sha1:"), None


def read_warc(manifest: DataFrame, path: str, split_bytes: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """The records of the archives named in `manifest` (archive, bytes), read in ranges of split_bytes.

    The digest of a response is taken from its payload; a revisit has its header's digest and length, and no payload.
    """
    path = _qualified(manifest.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
        for batch in batches:
            for name, size, start in zip(*(batch.column(c).to_pylist() for c in ("archive", "bytes", "start")), strict=True):
                stop, rows, held = min(start + split_bytes, size), [], 0
                with store.open_input_file(f"{folder}/{name}") as source:
                    window = source.read_at(min(split_bytes + len(MAGIC) - 1, size - start), start)
                    at = start
                    while (hit := window.find(MAGIC, at - start)) >= 0 and start + hit < stop:
                        at = start + hit
                        member = _inflate(source, at, size)
                        record = member and _parse(member[0])
                        if not record:
                            at += 1  # magic inside other data
                            continue
                        rows.append((*record[:5], record[5] if payloads else None, name, at, member[1]))
                        held += record[3] if payloads else 0
                        at += member[1]
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
                            rows, held = [], 0
                        if at >= stop:
                            break
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    ranges = manifest.select("archive", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    return ranges.repartition(_tasks(manifest, split_bytes), "archive", "start").mapInArrow(run, RECORDS)


def _tasks(manifest: DataFrame, split_bytes: int) -> int:
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    return max(1, min(total // split_bytes + 1, 100_000))



def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, read the archives back by byte ranges and return what they hold."""
    path = work_dir(spark, "warc")
    manifest = write_warc(read(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return read_warc(manifest, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(encode(coalesce(html, ''))) AS d FROM pages),
g AS (SELECT d, n, max(page_id) AS top, count(*) AS c FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.top IS NOT NULL AND g.c > 1 AND g.top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.top IS NOT NULL AND g.c > 1 AND g.top <> p.page_id THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n
"""
