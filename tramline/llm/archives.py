"""WARC archives: one gzip member per record, written by tasks and read back sequentially."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._job import known, new_path, small_batches, staged

LEAST_BYTES = 100
#: A file is closed when its records' payloads pass this.
FILE_BYTES = 64 << 20
BLOCK = 1 << 16
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    """One record: its headers (names in lower case) and its block."""

    headers: dict[str, str]
    block: bytes
    offset: int


def member(headers: dict[str, str], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def records(source: BinaryIO) -> Iterator[Record]:
    """Reads members one after the other; memory holds one record and one block of the file.

    Raises ValueError on a cut-off or malformed record, a wrong length, bytes
    after a record in its member, or a block digest that doesn't hold.
    """
    pending, offset = b"", 0
    while True:
        if not pending:
            pending = source.read(BLOCK)
            if not pending:
                return
        inflate, out, used = zlib.decompressobj(wbits=31), bytearray(), 0
        need = head = None
        while not inflate.eof:
            if not pending:
                pending = source.read(BLOCK)
                if not pending:
                    raise ValueError(f"member at {offset} is cut off")
            try:
                out += inflate.decompress(pending)
            except zlib.error as e:
                raise ValueError(f"member at {offset}: {e}") from e
            used += len(pending) - len(inflate.unused_data)
            pending = inflate.unused_data
            if head is None and (end := out.find(b"\r\n\r\n")) >= 0:
                head, need = _headers(bytes(out[:end]), offset), end + 4
                if "content-length" not in head:
                    raise ValueError(f"member at {offset} has no length")
            if head is not None and len(out) > need + int(head["content-length"]) + 4:
                raise ValueError(f"member at {offset} is longer than its record")
        if head is None or len(out) != need + int(head["content-length"]) + 4 or out[-4:] != b"\r\n\r\n":
            raise ValueError(f"member at {offset} doesn't end where its record does")
        block = bytes(out[need:-4])
        if "warc-block-digest" in head and head["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"block digest of the member at {offset} doesn't hold")
        yield Record(head, block, offset)
        offset += used


def _headers(raw: bytes, offset: int) -> dict[str, str]:
    first, *rest = raw.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"member at {offset} is no WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}


def _http(payload: bytes | None, size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")


NO_URL = "urn:none"


def _target(url: str | None) -> tuple[str, bool]:
    """A url as a header value, and whether it had to be escaped: what a header can't hold as it is comes back the same."""
    if url is None:
        return NO_URL, False
    if url and url != NO_URL and url.isprintable() and url == url.strip():
        return url, False
    return "%" + quote(url, safe=""), True


def _one(row: dict) -> bytes:
    payload = row["payload"]
    revisit = row["refers_to"] is not None
    block = _http(None if revisit else payload, len(payload))
    url, escaped = _target(row["url"])
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
    }
    if escaped:
        headers["X-Target-Escaped"] = "percent"
    if revisit:
        headers |= {"WARC-Refers-To": f"<urn:page:{row['refers_to']}>", "WARC-Profile": _PROFILE}
    return member(headers | {"Content-Type": "application/http; msgtype=response"}, block)


def _written(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        sink, path, held, n = None, "", 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if sink is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"  # an attempt's own: a retry never meets another's file
                    sink, held, n = store.open_output_stream(path, compression=None), 0, 0
                sink.write(_one(row))
                held, n = held + len(row["payload"]), n + 1
                if held >= file_bytes:
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pydict({"path": [path.rpartition("/")[2]], "records": pa.array([n], pa.int64())})
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path.rpartition("/")[2]], "records": pa.array([n], pa.int64())})

    return run


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, least: int = LEAST_BYTES, id_col: str = "page_id") -> DataFrame:
    """Writes a record per row of ``pages`` (id, url, html) below ``folder``; returns the manifest (path, records).

    Of rows with equal payloads of ``least`` bytes or more, the one with the
    smallest id is a response; the others are revisits that hold no payload.  The folder
    must be one that all executors share.  Files that no task of the manifest
    names come from lost attempts and aren't read.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), known(id_col).alias("_k"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("large", F.octet_length("payload") >= least)
    first = rows.filter("large").groupBy("payload_digest").agg(F.min("_k").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    # payloads that can't be revisited needn't meet others: the empty ones alone may be a third of all rows
    linked = rows.filter("large").join(first, "payload_digest", "left").unionByName(rows.filter("not large").withColumn("first", F.lit(None).cast("long")))
    # of rows that repeat the smallest id, each is a response: nothing smaller holds its payload
    refers = F.when(F.col("large") & F.col("first").isNotNull() & (F.col("_k") > F.col("first")), F.col("first"))
    made = linked.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))
    spark = pages.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return staged(made.mapInArrow(_written(folder, file_bytes), "path string, records long"), "manifest")[0]


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path, count in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, seen = [], 0
                with store.open_input_stream(f"{root}/{path}", compression=None) as source:
                    for record in records(source):
                        rows.append(_row(record))
                        seen += 1
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if seen != count:
                    raise ValueError(f"{path} holds {seen} records, not {count}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _id(urn: str | None) -> int | None:
    got = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(got) if got else None


def _row(record: Record) -> tuple:
    head, h = record.block.split(b"\r\n\r\n", 1)[0], record.headers
    body = memoryview(record.block)[len(head) + 4 :]
    size = int(next(x for x in head.decode().split("\r\n") if x.startswith("Content-Length:")).partition(":")[2])
    said = h["warc-payload-digest"].removeprefix("sha256:")
    if h["warc-type"] == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != said):
        raise ValueError(f"payload of {h['warc-record-id']} doesn't hold")
    url = h["warc-target-uri"]
    url = unquote(url[1:]) if "x-target-escaped" in h else None if url == NO_URL else url
    return _id(h["warc-record-id"]), url, size, said, h["warc-type"], _id(h.get("warc-refers-to"))


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """A row per record of the manifest's files: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A file is read by one task, record by record; every length and digest is
    checked, and a fault ends the query.
    """
    files = manifest.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("path"))
    return files.mapInArrow(_read(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads them back.

    Null html is an empty payload; a null url is left out of the record, and one that a header can't hold
    (blank, line ends, control characters) is escaped there and comes back unchanged.  Null
    ids come after all others.  An empty table gives no files and no rows.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    return read_archives(spark, folder, write_archives(pages, folder, id_col=id_col))


def read_bytes(data: bytes) -> list[Record]:
    return list(records(io.BytesIO(data)))
