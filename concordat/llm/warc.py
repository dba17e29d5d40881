"""WARC archives with revisit records.

``write_archives`` decides response or revisit by payload digest and writes
one gzip member per record; ``read_archives`` streams the records back;
``resolve_revisits`` gives each revisit record the facts of its response.

Only headers are shuffled by digest: groups are counted with partial sums and
written, so that a digest which a third of the pages share is a skewed key of a
join of plain inputs, which adaptive execution splits.  Payloads are shuffled once,
by (page id, digest), where such a group is spread over its pages; only those of
response records pass that join.

Defined results for odd input: a null payload is an empty one; rows that
repeat the largest page id of a payload are all responses; a row without page
id revisits the group's largest id, and is a response if no row of the group
has one; a payload of any length is one record, held whole by one task; repeated
rows are records of their own; an empty table writes no record; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, open_fs, publish, scratch, small_batches

#: RFC 4648 base-32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"

HEADERS = "page_id long, url string, record_type string, refers_to long, payload_digest string, block_bytes long, archive string, position long"


def base32_sha1(payload: F.Column) -> F.Column:
    """Upper-case base-32 SHA-1, from built-in functions: 5 hex digits are 4 symbols."""
    digest = F.sha1(payload)
    out = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _headers(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload.cast("binary")).alias("payload_digest"))


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    rows = _headers(pages)
    heads = materialize(rows.drop("payload"), "warc-heads")
    groups = heads.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.filter("n > 1 and first_id is not null").select("payload_digest", "first_id"), "warc-groups")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    heads = materialize(heads.join(groups, "payload_digest", "left").withColumn("again", again), "warc-roles")
    # A page id and a digest have one role, so responses are found by them.
    first = materialize(heads.filter("not again").select(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest")).distinct(), "warc-first")
    responses = rows.join(first, rows.page_id.eqNullSafe(first.id) & (rows.payload_digest == first.digest), "left_semi")
    responses = responses.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType))
    revisits = heads.filter("again").select("page_id", "url", F.lit(None).cast("string").alias("payload"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("first_id").alias("refers_to"))
    return responses.union(revisits)


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _un_urn(value: str) -> int | None:
    n = value.strip("<>").rpartition(":")[2]
    return int(n) if n else None


def encode_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One WARC 1.1 record; a revisit has the headers and no payload."""
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: {_urn(page_id)}".encode(), f"WARC-Date: {date}".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + " ".join(url.split()).encode())
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}".encode(), f"WARC-Refers-To: {_urn(refers_to)}".encode()]
        payload = b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head += [f"WARC-Payload-Digest: sha1:{digest}".encode(), b"Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}".encode()]
    return CRLF.join(head) + CRLF * 2 + http + payload + CRLF * 2


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 256 << 20, level: int = 1) -> DataFrame:
    """Write records; returns the manifest (archive, records, bytes), materialised.

    A file holds about ``file_bytes`` of compressed records at most.
    """
    small_batches(rows.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, done = TaskContext.get().partitionId(), 0, []
        stream = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row = next(stream, None)
        while row is not None:
            uri, n = f"{folder}/part-{part:06d}-{k:04d}.warc.gz", 0

            def fill(out):
                nonlocal row, n
                while row is not None and out.tell() < file_bytes:
                    page_id, url, payload, digest, kind, refers_to = row
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(z.compress(encode_record(page_id, url, (payload or "").encode(), digest, kind, refers_to, date)) + z.flush())
                    n += 1
                    row = next(stream, None)

            size = publish(uri, fill)
            done.append((uri, n, size))
            k += 1
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    out = rows.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to").mapInArrow(write, "archive string, records long, bytes long")
    return materialize(out, "warc-manifest")


def iterate_records(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, headers, block) of each gzip member; holds one record at a time."""
    raw, eof, position = b"", False, 0
    while True:
        z, parts = zlib.decompressobj(31), []
        start = position
        while not z.eof:
            if not raw:
                raw = stream.read(1 << 20)
                if not raw:
                    eof = True
                    break
            parts.append(z.decompress(raw))
            position += len(raw) - len(z.unused_data)
            raw = z.unused_data
        if eof:
            if any(parts):
                raise EOFError("the archive ends within a record")
            return
        record = b"".join(parts)
        head, _, rest = record.partition(CRLF * 2)
        first, *lines = head.split(CRLF)
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {start}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
        n = int(headers["content-length"])
        if len(rest) != n + 4:
            raise ValueError(f"record at {start}: block of {len(rest) - 4} bytes, not {n}")
        yield start, headers, rest[:n]


def read_archives(spark: SparkSession, manifest: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the manifest's archives, checked against their digests.

    One file is read as a stream by one task; files are dealt evenly.
    """
    small_batches(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "block_bytes", "archive", "position", "payload"]
            keep = len(names) - (not payload)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:keep], kinds[:keep], strict=True)], names=names[:keep])

        rows, held = [], 0
        for uri in (x for b in batches for x in b.column(0).to_pylist()):
            fs, path = open_fs(uri)
            with fs.open_input_stream(path, compression=None) as stream:
                for position, h, block in iterate_records(stream):
                    body = block.partition(CRLF * 2)[2]
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"{uri} at {position}: the payload does not match its digest")
                    refers = h.get("warc-refers-to")
                    rows.append((_un_urn(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], _un_urn(refers) if refers else None, digest, len(body), uri, position, body.decode() if payload else None))
                    held += len(body) if payload else 100
                    if held > 8 << 20:
                        yield flush(rows)
                        rows, held = [], 0
        if rows:
            yield flush(rows)

    files = manifest.select("archive").repartition(max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism)))
    return files.mapInArrow(read, HEADERS + (", payload string" if payload else ""))


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """Each record with the full payload's size: revisits take it from their response.

    The join key is the response's page id *and* digest, one row per key and written
    first, so a payload that many records revisit is a skewed side that can be split.
    """
    originals = (
        headers.filter("record_type = 'response'")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("block_bytes").alias("original_bytes"), F.min("archive").alias("original_archive"))
    )
    originals = materialize(originals, "warc-originals")
    out = headers.join(originals, ["refers_to", "payload_digest"], "left")
    return out.withColumn("payload_bytes", F.when(F.col("record_type") == "revisit", F.col("original_bytes")).otherwise(F.col("block_bytes")))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(with_roles(pages), scratch(spark, "warc"))
    back = materialize(read_archives(spark, manifest), "warc-headers")
    return resolve_revisits(back).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hx FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(hx, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '') AS payload_digest
      FROM p),
g AS (SELECT payload_digest, max(page_id) AS m FROM d GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> m THEN m END AS refers_to
FROM d JOIN g ON d.payload_digest = g.payload_digest
"""
