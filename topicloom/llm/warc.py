"""WARC archives, index first: offset, length, URL and digest of each record, then coalesced byte-range reads of the records selected."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, small_batches, written

#: Records are read in one piece if so few bytes or fewer lie between them.
GAP = 64 << 10
#: A piece ends at the record that brings it to so many bytes.
PIECE = 8 << 20
#: Bytes of a file whose selected records are one group of work.
SPLIT = 64 << 20
_control = re.compile(r"[\x00-\x20\x7f]")


def _digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    """One record as a gzip member. Control characters and spaces of a URL are percent-encoded; a null id or URL has no header."""
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + _control.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: {_digest(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + c.flush()


def parse(plain: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and payload of a record."""
    head, _, body = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, body[: int(fields.get("content-length", len(body)))]


def members(stream, block: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, plain bytes) of each gzip member of a file read from its start, a block at a time.

    A file of plain records without compression has each of them, found by Content-Length. A cut-off last member is left out.
    """
    data = stream.read(block)
    at = 0
    if data[:5] == b"WARC/":
        while data:
            while (end := data.find(b"\r\n\r\n")) < 0:
                more = stream.read(block)
                if not more:
                    return
                data += more
            size = next((int(line.split(b":")[1]) for line in data[:end].split(b"\r\n") if line.lower().startswith(b"content-length:")), 0)
            length = end + 4 + size + 4
            while len(data) < length:
                more = stream.read(max(block, length - len(data)))
                if not more:
                    return
                data += more
            yield at, length, data[:length]
            at, data = at + length, data[length:] or stream.read(block)
        return
    while data:
        d, out, used = zlib.decompressobj(31), [], 0
        while True:
            out.append(d.decompress(data))
            if d.eof:
                used += len(data) - len(d.unused_data)
                break
            used += len(data)
            data = stream.read(block)
            if not data:
                return
        yield at, used, b"".join(out)
        at, data = at + used, d.unused_data or stream.read(block)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as pyarrow names it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/+", "file:///", full)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(path, records, bytes) of each archive written to the shared folder, one for each task.

    A task writes a file of its own name, so one that runs again leaves an unused
    file, never a spoilt one. Rows with null html have no record.
    """
    spark = pages.sparkSession
    small_batches(spark)
    base = _qualified(spark, new_path(spark, "warc"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(base)
        name, out, n, size = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for b in batches:
            for i, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                data = record(i, url, html.as_py().encode())
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([f"{base}/{name}"]), pa.array([n]), pa.array([size])], ["path", "records", "bytes"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string").alias("h")).filter("h is not null")
    return written(rows.mapInArrow(write, "path string, records long, bytes long"), "archives")


def index(archives: DataFrame) -> DataFrame:
    """(path, offset, length, page_id, url, digest) of every record of the archives in the column path, which are read once each, a task to a file.

    Records without a digest have it computed from the payload; without an id or a URL they have null.
    """
    small_batches(archives.sparkSession)
    names = ["path", "offset", "length", "page_id", "url", "digest"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_stream(at, compression=None) as stream:
                    rows: list[tuple] = []
                    for offset, length, plain in members(stream):
                        head, body = parse(plain)
                        page = head.get("x-page-id")
                        rows.append((path, offset, length, None if page is None else int(page), head.get("warc-target-uri"), head.get("warc-payload-digest") or _digest(body)))
                        if len(rows) == 5000:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows = []
                    if rows:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    # As many partitions as files: a scan of one holds up no other.
    files = archives.select("path").dropna().distinct()
    spread = files.repartitionByRange(max(1, min(files.count(), 20_000)), "path")
    return spread.mapInArrow(scan, "path string, offset long, length long, page_id long, url string, digest string")


def fetch(selected: DataFrame, gap: int = GAP, piece: int = PIECE) -> DataFrame:
    """(page_id, url, digest, html) of index rows: sorted by place, and ranges that touch or nearly do are read as one.

    Rows repeated in the selection are returned each.
    """
    small_batches(selected.sparkSession)
    names = ["page_id", "url", "digest", "html"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream, run, end, size = None, None, [], 0, 0

        def out() -> pa.RecordBatch:
            start = run[0][1]
            stream.seek(start)
            data = stream.read(end - start)
            rows = []
            for _, offset, length, page, url, digest in run:
                part = data[offset - start : offset - start + length]
                _, body = parse(part if part[:5] == b"WARC/" else zlib.decompress(part, 31))
                rows.append((page, url, digest, body.decode("utf-8", "replace")))
            run.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                path, offset, length = row[:3]
                if run and (path != opened or offset > end + gap or size >= piece):
                    yield out()
                if path != opened:
                    if stream is not None:
                        stream.close()
                    system, at = fs.FileSystem.from_uri(path)
                    opened, stream = path, system.open_input_file(at)
                if not run:
                    end, size = offset, 0
                size += max(0, offset + length - end)
                end = max(end, offset + length)
                run.append(row)
        if run:
            yield out()
        if stream is not None:
            stream.close()

    rows = selected.select("path", "offset", "length", "page_id", "url", "digest")
    placed = rows.repartition("path", F.floor(F.col("offset") / SPLIT)).sortWithinPartitions("path", "offset")
    return placed.mapInArrow(read, "page_id long, url string, digest string, html string")


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) of one page of each payload, the one of the least (page_id, url): archived, indexed, selected and read back."""
    found = written(index(archive(pages)), "index")
    one = Window.partitionBy("digest").orderBy(F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_last(), "path", "offset")
    return fetch(found.withColumn("_r", F.row_number().over(one)).filter("_r = 1")).select("page_id", "url", "html")


#: DuckDB SQL for distinct_pages, where pages of one digest are those of one payload.
ORACLE = """
select page_id, url, html from (
  select page_id, regexp_replace(url, ' ', '%20', 'g') as url, html, row_number() over (partition by html order by page_id nulls last, url nulls last) as r
  from pages where html is not null
) where r = 1
"""
