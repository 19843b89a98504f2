"""WARC archives: deduplicating writer and sequential reader.

The writer puts one gzip member per record into archive files below a shared
folder, each file from one task and under a name of that attempt; only the
manifest that Spark commits says which files count, so a repeated or killed
attempt leaves no record twice. The reader goes through a file front to back
in bounded pieces: one zlib decompressor per gzip member, headers up to the
blank line, then exactly Content-Length bytes, with block and payload digests
recomputed on the way.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parquet_stage, scratch_path

PIECE = 1 << 18               # bytes read and inflated at a time
MIN_REVISIT_BYTES = 100       # shorter payloads are always stored
ARCHIVE_BYTES = 256 << 20     # a writer starts a new archive beyond this
GZIP = 31                     # zlib's window bits for a gzip member


def classify(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html",
             min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``id, url, payload, payload_bytes, payload_digest, record_type,
    refers_to`` for each page. Among equal payloads of ``min_bytes`` or more
    the smallest id is the response. A null payload is empty; a null id is
    larger than all others, and if no copy has an id all are responses; rows
    that repeat the smallest id are all responses."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    p = (p.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
         .withColumn("payload_digest", F.sha2("payload", 256)))
    # partial aggregation leaves one row per digest and task; only digests
    # that do occur again are joined back
    first = (p.filter(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("digest"))
             .agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    j = p.join(first, p["payload_digest"] == first["digest"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return j.select("id", "url", "payload", "payload_bytes", "payload_digest",
                    F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                    F.when(revisit, F.col("first_id")).alias("refers_to"))


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def encode_record(row: dict) -> bytes:
    """One record as a gzip member. Its block is the HTTP response; a revisit
    keeps the HTTP head only and names the payload by digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + row["payload"]
    url = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", row["record_type"]),
            ("WARC-Record-ID", record_id(row["id"]) if row["id"] is not None else f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url),
            ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
            ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if row["id"] is not None:
        head.append(("X-Page-ID", str(row["id"])))
    if revisit:
        head += [("WARC-Refers-To", record_id(row["refers_to"])), ("X-Refers-To-Page-ID", str(row["refers_to"])),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append(("Content-Length", str(len(block))))
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, GZIP)
    return z.compress(lines.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``classify`` into archives below ``folder``, a path
    that all executors share. Returns the manifest (path, records, bytes),
    itself stored, in which only committed attempts appear."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _filesystem(folder)
        filesystem.create_dir(base, recursive=True)
        out, name, n, size = None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = filesystem.open_output_stream(f"{base}/{name}", compression=None)
                member = encode_record(row)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"path": name, "records": n, "bytes": size}], schema=schema)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": name, "records": n, "bytes": size}], schema=schema)

    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    return parquet_stage(records.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


class DamagedArchive(ValueError):
    """Framing or a digest of an archive is wrong."""


def read_records(stream) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of an open archive, in order."""
    raw = b""
    while True:
        raw = raw or stream.read(PIECE)
        if not raw:
            return
        inflate = zlib.decompressobj(GZIP)
        head, block, left = b"", bytearray(), None
        while not inflate.eof:
            packed = inflate.unconsumed_tail or raw or stream.read(PIECE)
            data = inflate.decompress(packed, PIECE)
            if not packed and not data and not inflate.eof:
                raise DamagedArchive("the archive ends inside a record")
            raw = inflate.unused_data if inflate.eof else b""
            if left is None:
                head += data
                end = head.find(b"\r\n\r\n")
                if end < 0:
                    continue
                data, lines = head[end + 4:], head[:end].decode().split("\r\n")
                if lines[0] != "WARC/1.1":
                    raise DamagedArchive(f"not a record: {lines[0][:40]!r}")
                headers = dict(x.split(": ", 1) for x in lines[1:])
                left = int(headers["Content-Length"])
            block += data
        if left is None or len(block) != left + 4 or block[-4:] != b"\r\n\r\n":
            raise DamagedArchive("Content-Length does not frame the record")
        yield headers, bytes(block[:left])


def parse_record(headers: dict, block: bytes) -> dict:
    """A row from a record, its digests verified."""
    if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise DamagedArchive(f"block digest of {headers['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise DamagedArchive(f"payload digest of {headers['WARC-Record-ID']}")
    return {"page_id": headers.get("X-Page-ID"), "url": headers["WARC-Target-URI"],
            "payload_bytes": int(fields["Content-Length"]), "payload_digest": digest,
            "record_type": headers["WARC-Type"], "refers_to": headers.get("X-Refers-To-Page-ID"),
            "payload": None if revisit else payload}


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the manifest's archives: ``page_id, url,
    payload_bytes, payload_digest, record_type, refers_to, payload`` (null for
    a revisit), ids as text. Each archive is read by one task, record by record; a
    damaged archive fails the job, as does one whose record count is not the
    manifest's."""
    schema = pa.schema([(k, pa.string()) for k in ("page_id", "url")] + [("payload_bytes", pa.int64())]
                       + [(k, pa.string()) for k in ("payload_digest", "record_type", "refers_to")]
                       + [("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _filesystem(folder)
        for batch in batches:
            for item in batch.to_pylist():
                rows, size, n = [], 0, 0
                with filesystem.open_input_stream(f"{base}/{item['path']}", compression=None) as stream:
                    for headers, block in read_records(stream):
                        row = parse_record(headers, block)
                        n += 1
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if n != item["records"]:
                    raise DamagedArchive(f"{item['path']} has {n} records, {item['records']} were written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = max(1, manifest.count())
    return (manifest.repartition(min(n, 100_000)).mapInArrow(
        read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to string, payload binary"))


def round_trip(pages: DataFrame, with_payload: bool = False, **names) -> DataFrame:
    """Write ``pages`` as archives in the shared scratch folder and read them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    return read_archives(spark, write_archives(classify(pages, **names), folder), folder, with_payload)
