"""WARC archives with an index first (op 7).

Every task writes its records as gzip members of standard WARC files in the shared folder and
emits one index row for each: file, offset, length, URL and digest. Readers never scan an
archive: selected index rows are sorted by place, neighbours are joined into ranges of a few
MB, and each range is fetched with one read and cut into records.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.skew import join_one
from .common import materialize, shared_dir, table, utf8

LEAST_SHARED = 100  # bytes of a payload that is worth a revisit record
FILE_BYTES = 128 << 20
RANGE_BYTES, GAP_BYTES = 4 << 20, 64 << 10
_ID = "urn:quillspark:page:"
INDEX = "page_id long, record_type string, file string, offset long, length long, url string, digest string"


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:]))
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def decide(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, digest, refers_to) of the records that revisit an earlier payload. Only
    numbers and digests are shuffled; the pages of a very common payload are dealt over copies
    of its one row."""
    slim = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least).where("page_id is not null")
    slim = materialize(slim.select("page_id", "digest"), "digests")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("other")).where("refers_to <> other").drop("other")
    return join_one(slim, first, ["digest"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, where: str, least: int = LEAST_SHARED, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of ``pages`` below ``where`` and return the index.

    A file is named by the attempt that wrote it, so attempts never touch each other's files and
    the index, which comes from the attempt that counted, always fits its files; those that it
    doesn't name are left over from repeated attempts. A file gets its name when it is whole.
    Pages with a null page_id are always responses.
    """
    key = F.sha2(F.coalesce("html", F.lit("")), 256)
    rows = pages.select("page_id", "url", "html", key.alias("digest")).join(decide(pages, least), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(where)
        fs.create_dir(root, recursive=True)
        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        out = name = None
        at = count = 0
        index: list[tuple] = []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                fs.move(f"{root}/.{name}", f"{root}/{name}")
                out = None

        for b in batches:
            for i, url, digest, ref, html in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4)), utf8(b.column(2))):
                if out is None:
                    name, at, count = f"part-{part:06d}-{count:04d}.warc.gz", 0, count + 1
                    out = fs.open_output_stream(f"{root}/.{name}", compression=None)
                data = _member(_record(i, url, html or b"", digest, ref, date))
                out.write(data)
                index.append((i, "response" if ref is None else "revisit", name, at, len(data), url, digest))
                at += len(data)
                if at >= FILE_BYTES:
                    close()
            if len(index) >= 5000:
                yield _index(index)
                index = []
        close()
        if index:
            yield _index(index)

    return materialize(rows.mapInArrow(run, INDEX), "warc-index")


def _index(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["page_id", "record_type", "file", "offset", "length", "url", "digest"])


def read_records(index: DataFrame, where: str) -> DataFrame:
    """The records of the selected ``index`` rows: page_id, record_type, url, digest,
    refers_to, payload_bytes, intact (the payload's digest holds; null for revisits), html.

    Neighbours less than 64 KB apart within the same 4 MB of a file are one read. Index columns
    other than file, offset and length don't matter; no rows give no rows.
    """
    place = Window.partitionBy("file").orderBy("offset")
    gap = F.col("offset") - F.coalesce(F.lag(F.col("offset") + F.col("length")).over(place), F.lit(0))
    near = index.select("file", "offset", "length", (F.when(gap > GAP_BYTES, 1).otherwise(0)).alias("_new"))
    near = near.withColumn("_run", F.sum("_new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = near.groupBy("file", "_run", F.expr(f"offset div {RANGE_BYTES}").alias("_block")).agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(where)
        for b in batches:
            for file, start, stop, records in zip(*(b.column(k).to_pylist() for k in range(4))):
                with fs.open_input_file(f"{root}/{file}") as f:
                    data = f.read_at(stop - start, start)
                rows = []
                for r in records:
                    a = r["offset"] - start
                    head, payload = parse_record(zlib.decompress(data[a : a + r["length"]], 31))
                    number = lambda k: int(x) if (x := head.get(k, "").strip("<>").removeprefix(_ID)) else None
                    response = head["warc-type"] == "response"
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    rows.append((number("warc-record-id"), head["warc-type"], head.get("warc-target-uri"), digest, number("warc-refers-to"), len(payload) if response else None, hashlib.sha256(payload).hexdigest() == digest if response else None, payload.decode() if response else None))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], names=["page_id", "record_type", "url", "digest", "refers_to", "payload_bytes", "intact", "html"])

    return ranges.select("file", "start", "stop", "records").mapInArrow(run, "page_id long, record_type string, url string, digest string, refers_to long, payload_bytes long, intact boolean, html string")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read all records back; page_id, payload_bytes, payload_digest,
    record_type, refers_to, intact. A revisit has the size of the response it refers to.

    Null html is an empty payload, a null URL has no header. Of repeated rows of one page_id
    with the smallest id of their payload, all are responses.
    """
    where = shared_dir(pages.sparkSession, "warc")
    index = write_archives(pages, where)
    back = materialize(read_records(index, where).drop("html", "url"), "warc-records")
    sizes = back.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.first("payload_bytes").alias("_bytes"), F.first("intact").alias("_intact"))
    out = join_one(back, sizes, ["refers_to", "digest"], "left")
    return out.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", F.coalesce("intact", "_intact").alias("intact"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to, TRUE AS intact
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest
"""
