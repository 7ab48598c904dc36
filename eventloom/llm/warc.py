"""WARC archives written from, and read into, a table of payload chunks.

A payload travels as rows (record, chunk number, bytes), none larger than CHUNK, with the digest of the payload so far.
Writers and readers hold one chunk at a time, whatever the size of a record. Files are gzip members, one a record, and
go to the shared folder; a manifest lists those of the tasks that succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import materialize, shared_folder

CHUNK = 1 << 20
#: Bytes after which a task goes on in another file.
ARCHIVE = 1 << 30
#: Payloads of at least so many bytes are stored once.
LEAST = 0
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """(id, url, payload, size, sha1, refers_to): refers_to is the largest id with an equal payload, null for its own row.

    A null payload is an empty one; an empty table gives no rows; columns not named are not looked at, so their names are
    free. Null ids come before all others. Rows that repeat id and payload are alike: with the
    largest id, all of them are responses.
    """
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("size", F.length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    first = rows.where(F.col("size") >= least).groupBy("sha1").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    other = ~F.col("id").eqNullSafe(F.col("top")) & F.col("top").isNotNull()
    return rows.join(first, "sha1", "left").select("id", "url", "payload", "size", "sha1", F.when(other, F.col("top")).alias("refers_to"))


def to_chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk, a record's chunks one after another; a revisit has one empty chunk, as has an empty payload."""
    size = F.when(F.col("refers_to").isNull(), F.col("size")).otherwise(0)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(size - 1, F.lit(0)), F.lit(chunk).cast("long"))
    cut = records.withColumn("body", F.when(F.col("refers_to").isNull(), F.col("payload"))).select("id", "url", "size", "refers_to", "sha1", "body", F.posexplode(starts).alias("chunk_no", "at"))
    return cut.select("id", "url", "size", "refers_to", "sha1", "chunk_no", F.coalesce(F.expr(f"substring(body, int(at) + 1, {chunk})"), F.lit(b"")).alias("data"))


class _Writer:
    """One task's archives; records come as chunks."""

    def __init__(self, folder: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.out, self.files = None, []

    def record(self, row: dict) -> None:
        self.end_record()
        if self.out is None or self.out.tell() >= ARCHIVE:
            self.end_file()
            self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
            self.out, self.count = self.store.open_output_stream(self.path, compression=None), 0
        http, now = HTTP.format(row["size"]), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        page = "" if row["id"] is None else row["id"]
        revisit = row["refers_to"] is not None
        lines = [
            "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {now}",
            f"WARC-Target-URI: {''.join((row['url'] or '').split())}", f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(row['sha1']))}",
            *([f"WARC-Refers-To: <urn:page:{row['refers_to']}>", f"WARC-Profile: {REVISIT}"] if revisit else []),
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else row['size'])}",
        ]
        self.zip = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.count += 1
        self.put(("\r\n".join(lines) + "\r\n\r\n" + http).encode())

    def put(self, data: bytes) -> None:
        self.out.write(self.zip.compress(data))

    def end_record(self) -> None:
        if self.out is not None and self.zip is not None:
            self.put(b"\r\n\r\n")
            self.out.write(self.zip.flush())
            self.zip = None

    def end_file(self) -> None:
        self.end_record()
        if self.out is not None:
            self.files.append((self.path, self.count, self.out.tell()))
            self.out.close()
            self.out = None

    zip = None


def write(records: DataFrame, folder: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """The manifest (path, records, bytes) of the archives that hold the records; no records, no archives.

    Each attempt of a task writes files of its own name; only those of the attempt that succeeded are in the manifest.
    """
    spark = records.sparkSession
    folder = folder or shared_folder(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for row in (dict(zip(batch.schema.names, (c[k].as_py() for c in batch.columns), strict=True)) for k in range(batch.num_rows)):
                if writer is None:
                    writer = _Writer(folder)
                    writer.store.create_dir(writer.folder, recursive=True)
                if row["chunk_no"] == 0:
                    writer.record(row)
                writer.put(row["data"])
        if writer:
            writer.end_file()
            scheme = folder[: folder.find(writer.folder.lstrip("/"))].rstrip("/") if "://" in folder else ""
            paths, counts, sizes = zip(*writer.files, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([f"{scheme}/{p.lstrip('/')}" for p in paths]), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return materialize(to_chunks(records, chunk).mapInArrow(run, "path string, records long, bytes long"))


class _Source:
    """Bytes of one archive as a stream, gzip members one after another."""

    def __init__(self, raw, size: int):
        self.raw, self.size, self.zip, self.held = raw, size, zlib.decompressobj(31), b""
        self.buffer = bytearray()

    def fill(self) -> bool:
        if not (data := self.held or self.raw.read(self.size)):
            return False
        if self.zip.eof:
            self.zip = zlib.decompressobj(31)
        self.buffer += self.zip.decompress(data, self.size)
        self.held = self.zip.unconsumed_tail or self.zip.unused_data
        return True

    def line(self) -> bytes | None:
        while (end := self.buffer.find(b"\r\n")) < 0:
            if not self.fill():
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + 2]
        return out

    def some(self, most: int) -> bytes:
        while len(self.buffer) < most and self.fill():
            pass
        out = bytes(self.buffer[:most])
        del self.buffer[: len(out)]
        return out

    def head(self) -> tuple[str, dict[str, str], int] | None:
        """First line, fields and length of a block of header lines."""
        if (first := self.line()) is None:
            return None
        fields, length = {}, len(first) + 2
        while line := self.line():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
            length += len(line) + 2
        return first.decode(), fields, length + 2


def _page(urn: str | None) -> str | None:
    return urn.removeprefix("<urn:page:").removesuffix(">") or None if urn else None


def read(spark: SparkSession, manifest: DataFrame, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """A row for each chunk of each record in the archives, read as a stream.

    record: path and number of the record; id, refers_to as text; record_type; stored_size, of the payload by its HTTP
    header; chunk_no; data (null unless payloads); size_so_far and digest_so_far of the payload up to this chunk, the
    digest in base32. A revisit has one row without data, with the size and digest of the payload that it refers to.
    Records of other types give no rows; a payload that differs from its record's SHA-1 is an error. An empty manifest
    gives no rows.
    """
    schema = pa.schema([("record", pa.string()), ("id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("size_so_far", pa.int64()), ("digest_so_far", pa.string()), ("digest", pa.string())])

    def records(path: str) -> Iterator[dict]:
        store, place = fs.FileSystem.from_uri(path)
        with store.open_input_stream(place, compression=None) as raw:
            source, n = _Source(raw, 1 << 18), -1
            while (head := source.head()) is not None:
                n += 1
                _, fields, _ = head
                kind, rest, http = fields.get("warc-type"), int(fields.get("content-length", 0)), {}
                if kind in ("response", "revisit") and rest and fields.get("content-type", "").startswith("application/http"):
                    _, http, length = source.head()
                    rest -= length
                given = fields.get("warc-payload-digest", "")
                row = {"record": f"{path}#{n}", "id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")), "digest": given.removeprefix("sha1:") or None}
                if kind != "response":
                    if kind == "revisit":
                        yield row | {"chunk_no": 0, "size_so_far": int(http.get("content-length", 0)), "digest_so_far": row["digest"]}
                    while rest:  # warcinfo, request, metadata and other records hold no payload of a page
                        if not (data := source.some(min(chunk, rest))):
                            raise ValueError(f"{path} ends within record {n}")
                        rest -= len(data)
                else:
                    digest, size, k = hashlib.sha1(), 0, 0
                    while True:
                        data = source.some(min(chunk, rest))
                        if len(data) < min(chunk, rest):
                            raise ValueError(f"{path} ends within record {n}")
                        digest.update(data)
                        size, rest = size + len(data), rest - len(data)
                        yield row | {"chunk_no": k, "data": data if payloads else None, "size_so_far": size, "digest_so_far": base32(digest.digest())}
                        k += 1
                        if not rest:
                            break
                    if given.startswith("sha1:") and given[5:].upper() != base32(digest.digest()):
                        raise ValueError(f"{path}: record {n} has another payload than its digest says")
                source.some(4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in records(path):
                    held.append({f.name: row.get(f.name) for f in schema})
                    size += len(row.get("data") or b"") + 200
                    if size > 4 * CHUNK:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    spread = manifest.select("path").repartition(spark.sparkContext.defaultParallelism * 4, "path")
    return spread.mapInArrow(run, "record string, id string, url string, record_type string, refers_to string, chunk_no int, data binary, size_so_far long, digest_so_far string, digest string")


def records_of(chunks: DataFrame) -> DataFrame:
    """(record, id, url, record_type, refers_to, size, digest): whole records; the last chunk carries the sums."""
    return chunks.groupBy("record").agg(
        *[F.first(c).alias(c) for c in ("id", "url", "record_type", "refers_to")],
        F.max("size_so_far").alias("size"),
        F.max_by("digest_so_far", "chunk_no").alias("digest"),
    )
