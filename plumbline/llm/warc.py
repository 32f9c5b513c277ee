"""WARC archives: writing with revisit records, and a splittable reader.

Every record is a gzip member of its own. Writing tasks put each archive under a name that holds the attempt, and the
manifest (a table in the shared folder) lists those of the successful attempts alone, so a repeated or lost task leaves at
most files that nobody reads. Reading tasks get byte ranges: each looks for the gzip magic in its range, takes a candidate
for a record only if it unpacks to a WARC header, and reads the records that start in its range to their end, wherever
that is. Archives are opened through Arrow's file systems, so the shared folder can be any store these know.

Of equal payloads the one with the smallest id is stored as a response and the others as revisits of it. Equal payloads
are found from digests that are counted before the shuffle; the table of ids meets the pages salted, so a payload that a
third of all pages share is spread over SALTS tasks.

Defined cases: a null payload is empty; rows that repeat the smallest id are responses, too; a null id counts as greater than
any other and has an empty name; a null url has no header; control characters and blanks in urls are percent-encoded;
extra columns are ignored; without pages there is no archive and no record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import shared_folder, written

MAGIC = b"\x1f\x8b\x08"
SALTS = 16
RANGE_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 512 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to string"


def _store(uri: str):
    """File system and path of a location."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """``pages`` reduced to key, url, payload and ``refers_to``: the least key with an equal payload if that is another."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.sha1(F.col("payload").cast("binary"))))
    first = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    later = F.col("key").isNull() | (F.col("key") > F.col("first"))
    found = salted.join(first, ["digest", "salt"], "left").withColumn("refers_to", F.when(later, F.col("first")))
    return found.select("key", "url", "payload", "refers_to")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(key) -> str:
    return f"<urn:x-page:{'' if key is None else key}>"


def record(key, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(key)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the rows of ``with_revisits``; the manifest (path, bytes, records) of the archives."""
    folder = folder or shared_folder(rows.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, out = TaskContext.get(), [], None
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        try:
            for batch in batches:
                for key, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made)}.warc.gz"
                        out, size, n = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                    packed = record(key, url, payload.encode(), refers_to)
                    out.write(packed)
                    size, n = size + len(packed), n + 1
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        made.append((f"{folder.rstrip('/')}/{name}", size, n))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            made.append((f"{folder.rstrip('/')}/{name}", size, n))
        columns = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "bytes", "records"])

    return written(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def parsed(member: bytes, with_payload: bool = True) -> tuple | None:
    """Row of RECORD from an unpacked record, or None for other kinds of records."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    response = kind == "response"
    digest = digest_of(payload) if response else fields.get("warc-payload-digest", "").removeprefix("sha1:")
    size = len(payload) if response else stated
    return (
        fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), payload if response and with_payload else None,
        size, digest, fields.get("warc-refers-to"),
    )


def _unpacked(source, at: int, held: bytes) -> tuple[bytes, int] | None:
    """The member that starts at ``at`` (whose first bytes are ``held``) and its packed length; None if it is no record."""
    packer, parts, position, known = zlib.decompressobj(31), [], at + len(held), False
    chunk, used = held, 0
    try:
        while True:
            parts.append(packer.decompress(chunk))
            used += len(chunk)
            if not known and sum(map(len, parts)) >= 7:
                if not b"".join(parts).startswith(b"WARC/1."):
                    return None
                known = True
            if packer.eof:
                return (b"".join(parts), used - len(packer.unused_data)) if known else None
            chunk = source.read_at(CHUNK_BYTES, position)
            if not chunk:
                return None
            position += len(chunk)
    except zlib.error:
        return None


def records_from(source, start: int, end: int) -> Iterator[bytes]:
    """Unpacked records that start in the bytes [start, end) of a random-access file."""
    at, held, base = start, b"", start  # held: the bytes of the file from base on
    while at < end:
        if at - base + len(MAGIC) > len(held):
            held, base = held[at - base :], at
            held += source.read_at(CHUNK_BYTES, base + len(held))
            if len(held) < len(MAGIC):
                return
        found = held.find(MAGIC, at - base)
        if found < 0:
            at = base + len(held) - len(MAGIC) + 1
            more = source.read_at(CHUNK_BYTES, base + len(held))
            if not more:
                return
            held, base = held[at - base :] + more, at
            continue
        at = base + found
        if at >= end:
            return
        member = _unpacked(source, at, held[found:])
        if member is None:
            at += 1
        else:
            yield member[0]
            at += member[1]
            if at - base > len(held):
                held, base = b"", at


def read_archives(spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """Records (RECORD) of the archives that ``manifest`` (path, bytes) lists, read by byte ranges."""
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = manifest.select("path", "bytes", F.explode(starts).alias("start"))
    ranges = ranges.repartition(int(1 + total // range_bytes), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in RECORD.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = _store(path)
                rows, held = [], 0
                with store.open_input_file(place) as source:
                    for member in records_from(source, start, min(size, start + range_bytes)):
                        if row := parsed(member, with_payload):
                            rows.append(row)
                            held += len(row[3] or b"") + 500
                        if held >= CHUNK_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.mapInArrow(run, RECORD)


def page_key(name: str) -> Column:
    """Key of a record's name."""
    return F.regexp_extract(F.col(name), "^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("long")


def query(spark, sf_dir: str) -> DataFrame:
    """Registered query op8: all pages written to archives and read back."""
    from plumbline.llm.common import table

    manifest = write_archives(with_revisits(table(spark, sf_dir, "pages")))
    rows = read_archives(spark, manifest, with_payload=False)
    return rows.select(
        page_key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_key("refers_to").alias("refers_to")
    )
