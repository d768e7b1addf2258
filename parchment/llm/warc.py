"""WARC archives with revisit records for repeated payloads.

1. ``write_raw`` writes a response record per row to gzip-member WARC files in the shared folder.
2. ``headers`` reads the records' headers from archives: place, digest, length; revisit records in the input keep the digest and target they name.
3. ``resolve`` shuffles headers by payload digest: the least id among the responses of each digest is the original, joined back to the others as revisits.
   A revisit in the input stays one: of that original at any length, or of the target it names where the input has none.
4. ``write_deduplicated`` reads originals at their places and writes new archives with fresh headers; revisits carry no payload.

Archives go through a file system named by the folder's address (``pyarrow.fs``), so tasks on any machine reach them.  A task writes under a
name of its own and renames at the end; a repeated task replaces the same file.

Null payloads are empty.  Payloads under ``LEAST_BYTES`` are responses always.  Repeated ids stay separate records; with equal payloads the first stays response.
A null id is written as a record without page number and comes back null; it is an original only where no other id has the payload.  An empty table writes no file.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import scratch, small_batches, stored

LEAST_BYTES = 100
#: Bytes of one archive file.
FILE_BYTES = 64 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
HEADER = "path string, start long, length long, serial long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_serial long, refers_page long"


def file_system(address: str):
    """File system and path of an address such as file:///x or hdfs://host/x."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address if "://" in address else "file://" + address.removeprefix("file:"))


def record(kind: str, page_id, serial: int, url: str | None, digest: str, size: int, payload: bytes, refers: tuple | None = None) -> bytes:
    """A WARC record with a header block and, for responses, the payload."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:record:{serial}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:record:{refers[0]}>", f"X-Refers-To-Page: {refers[1]}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _line(url: str | None) -> str:
    return " ".join((url or "").split())


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        k, _, v = line.partition(": ")
        fields[k.rstrip(":")] = v
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


class Archive:
    """Gzip members appended to numbered files of one task; each file gets its name when it is whole."""

    def __init__(self, folder: str):
        self.fs, self.folder = file_system(folder)
        self.fs.create_dir(self.folder, recursive=True)
        context = TaskContext.get()
        self.name = f"part-{context.partitionId():06d}"
        self.own = f".{self.name}.{context.taskAttemptId()}"
        self.number, self.at, self.out = 0, 0, None

    def put(self, raw: bytes) -> tuple[str, int, int]:
        if self.out is not None and self.at >= FILE_BYTES:
            self.close()
        if self.out is None:
            self.out, self.at = self.fs.open_output_stream(f"{self.folder}/{self.own}-{self.number}", compression=None), 0
        member = gzip.compress(raw, 6, mtime=0)
        place = (f"{self.folder}/{self.name}-{self.number}.warc.gz", self.at, len(member))
        self.out.write(member)
        self.at += len(member)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.folder}/{self.own}-{self.number}", f"{self.folder}/{self.name}-{self.number}.warc.gz")
            self.out, self.number = None, self.number + 1


def write_raw(pages: DataFrame, folder: str) -> DataFrame:
    """pages(page_id, url, html) -> (path, records): archives of response records, one per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, files = Archive(folder), {}
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, url, body in zip(*(c.to_pylist() for c in batch.columns)):
                digest = hashlib.sha256(body).hexdigest()
                place = archive.put(record("response", i, serial, url, digest, len(body), body))
                files[place[0]] = files.get(place[0], 0) + 1
                serial += 1
        archive.close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(list(files)), pa.array(list(files.values()))], ["path", "records"])

    small_batches(pages.sparkSession)
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body")).mapInArrow(
        run, "path string, records long"
    )


def members(fs, path: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, record) of each gzip member of a file, read in sequence."""
    import zlib

    with fs.open_input_stream(path, compression=None) as f:
        start, held = 0, b""
        while True:
            engine, parts, used = zlib.decompressobj(31), [], 0
            while not engine.eof:
                if not held:
                    held = f.read(1 << 20)
                    if not held:
                        break
                parts.append(engine.decompress(held))
                used += len(held) - len(engine.unused_data)
                held = engine.unused_data
            if not used:
                return
            if not engine.eof:
                raise ValueError(f"{path} ends within a record")
            yield start, used, b"".join(parts)
            start += used


_HEADER = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("serial", pa.int64()), ("page_id", pa.int64())]
    + [("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    + [("record_type", pa.string()), ("refers_serial", pa.int64()), ("refers_page", pa.int64())]
)
_RECORD = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    + [("record_type", pa.string()), ("refers_to", pa.int64())]
)


def _rows(batches: Iterator[pa.RecordBatch], folder: str, schema: pa.Schema, of) -> Iterator[pa.RecordBatch]:
    fs, _ = file_system(folder)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            for start, length, raw in members(fs, path):
                rows.append(of(path, start, length, *parse(raw)))
                if len(rows) == 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _serial(record_id: str | None) -> int | None:
    return _number(record_id and record_id.strip("<>").rpartition(":")[2])


def headers(files: DataFrame, folder: str) -> DataFrame:
    """Archive files -> their records' headers; the digest and length of a response are taken from its payload."""

    def one(path, start, length, f, payload) -> dict:
        full = f["WARC-Type"] != "revisit"
        return {
            "path": path,
            "start": start,
            "length": length,
            "serial": _serial(f["WARC-Record-ID"]),
            "page_id": _number(f["X-Page-ID"]),
            "url": f["WARC-Target-URI"],
            "payload_bytes": len(payload) if full else int(f["X-Payload-Length"]),
            "payload_digest": hashlib.sha256(payload).hexdigest() if full else f["WARC-Payload-Digest"].removeprefix("sha256:"),
            "record_type": f["WARC-Type"],
            "refers_serial": _serial(f.get("WARC-Refers-To")),
            "refers_page": _number(f.get("X-Refers-To-Page")),
        }

    return _spread(files).mapInArrow(lambda batches: _rows(batches, folder, _HEADER, one), HEADER)


def _tasks(files: DataFrame) -> int:
    """Tasks that share archive files: one a file, within reason.  A stated number keeps the rows, which are small while the
    files are not, from being put together."""
    return max(1, min(files.count(), 20_000))


def _spread(files: DataFrame) -> DataFrame:
    """One row a file, dealt evenly."""
    paths = stored(files.select("path").distinct(), "paths")
    return paths.repartition(_tasks(paths), "path")


def resolve(heads: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Headers with ``original``: struct(page_id, serial) of the record to refer to, null for responses and for revisits
    that have none."""
    revisit = F.col("record_type") == "revisit"
    order = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("o"), "serial", "page_id")
    firsts = (
        heads.where(~revisit)
        .groupBy("payload_digest")
        .agg(F.min(order).alias("first"))
        .select(F.col("payload_digest").alias("d"), "first.serial", "first.page_id")
    )
    joined = heads.join(
        firsts.select("d", F.struct("page_id", "serial").alias("first")),
        (heads.payload_digest == F.col("d")) & (revisit | (heads.payload_bytes >= least)),
        "left",
    )
    named = F.when(F.col("refers_serial").isNotNull(), F.struct(F.col("refers_page").alias("page_id"), F.col("refers_serial").alias("serial")))
    return joined.select(
        *heads.columns,
        F.when(revisit, F.coalesce("first", named)).when(F.col("first.serial") != F.col("serial"), F.col("first")).alias("original"),
    )


def write_deduplicated(resolved: DataFrame, source: str, folder: str, tasks: int) -> DataFrame:
    """(path, records) of new archives: payloads of responses are read at their places, revisits are headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, files = Archive(folder), {}
        fs, _ = file_system(source)
        opened, name = None, None
        for batch in batches:
            for r in batch.to_pylist():
                kind, payload, refers = "revisit", b"", None
                if r["original"] is None and r["record_type"] != "revisit":
                    kind = "response"
                    if name != r["path"]:
                        if opened is not None:
                            opened.close()
                        opened, name = fs.open_input_file(r["path"]), r["path"]
                    opened.seek(r["start"])
                    payload = parse(gzip.decompress(opened.read(r["length"])))[1]
                elif r["original"] is not None:
                    refers = (r["original"]["serial"], "" if r["original"]["page_id"] is None else r["original"]["page_id"])
                raw = record(kind, r["page_id"], r["serial"], r["url"], r["payload_digest"], r["payload_bytes"], payload, refers)
                place = archive.put(raw)
                files[place[0]] = files.get(place[0], 0) + 1
        archive.close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(list(files)), pa.array(list(files.values()))], ["path", "records"])

    # records of a file together and in order, so that each file is read once and forward
    placed = resolved.repartition(tasks, "path").sortWithinPartitions("path", "start")
    return placed.mapInArrow(run, "path string, records long")


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives; a response's digest is that of the payload read."""

    def one(path, start, length, f, payload) -> dict:
        revisit = f["WARC-Type"] == "revisit"
        return {
            "page_id": _number(f["X-Page-ID"]),
            "payload_bytes": int(f["X-Payload-Length"]) if revisit else len(payload),
            "payload_digest": f["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
            "record_type": f["WARC-Type"],
            "refers_to": _number(f.get("X-Refers-To-Page")),
        }

    return _spread(files).mapInArrow(
        lambda batches: _rows(batches, folder, _RECORD, one),
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def deduplicate(archives: DataFrame, source: str, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Archives (path) below ``source`` -> (path, records) of deduplicated archives below ``folder``."""
    heads = stored(headers(archives, source), "headers")
    return stored(write_deduplicated(resolve(heads, least), source, folder, _tasks(archives)), "files")


def pages_to_records(pages: DataFrame) -> DataFrame:
    """Write pages as archives, resolve repeats, write deduplicated archives and read them back."""
    spark = pages.sparkSession
    raw, final = scratch(spark, "warc-raw"), scratch(spark, "warc")
    files = stored(write_raw(pages, raw), "files")
    return read_records(deduplicate(files, raw, final), final)
