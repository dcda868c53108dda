"""WARC archives: a writer with identical-payload revisits, and a sequential reader.

The writer gives every task a file of its own in the shared folder (more, beyond ``FILE_BYTES``), one gzip member per
record. File names are fresh for each attempt and only those of finished tasks are in the manifest, so a lost executor
leaves nothing that is read. The reader goes through a file once with incremental zlib decompression, frames each
record by its content length, and verifies payload and block digests; it holds one record at a time.

Of records with equal payloads of at least ``LEAST_BYTES`` bytes, the one of largest id is the response and the others
revisit it; their owner comes from counts by SHA-1 with partial aggregation, joined back by broadcast up to
``BROADCAST_OWNERS`` repeated payloads, else by a shuffle in which AQE splits hot payloads.

Cases: a null payload is empty; a null id is written as ``null``, is never an owner and revisits like others; rows that
share the owner's id and payload are all responses; a null url gives the record's own URN as target; an empty table gives
an empty manifest; only the three named columns are read, so others may have any name. A record that is
cut off, lacks a length or fails a digest comes back with ``error`` set; reading goes on at the next member, if any.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import save, shared_dir, ship_package, table

LEAST_BYTES = 1000
FILE_BYTES = 64 << 20
CHUNK = 1 << 16
BROADCAST_OWNERS = 1_000_000
URN = "urn:x-record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(ident: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record, not compressed: a response with its payload, or a revisit with HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"{URN}{ident}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{ident}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    error: str | None = None

    def ident(self, name: str) -> str | None:
        return self.headers.get(name, "").strip("<>").removeprefix(URN) or None


#: How a gzip member begins, and how many of its bytes show whether a record stands in it.
MAGIC, PROBE = b"\x1f\x8b\x08", 4096


class _Members:
    """The gzip members of a stream, one after another, each as an iterator of decompressed chunks.

    The compressed bytes of the member at hand are kept, so that after damage ``resume`` finds the next member that holds
    a record, wherever the damage led the decompressor.
    """

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.rest, self.over = stream, b"", False
        self.seen: list[bytes] = []

    def _more(self) -> bytes:
        data, self.rest = self.rest or self.stream.read(CHUNK), b""
        return data

    def __iter__(self) -> Iterator[Iterator[bytes]]:
        while not self.over:
            self.rest = self._more()
            if not self.rest:
                return
            self.seen = []
            member = self._member()
            yield member
            if not self.over:
                for _ in member:  # what the reader of the member has left
                    pass

    def _member(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            data = self._more()
            if not data:
                raise EOFError("the archive ends within a member")
            self.seen.append(data)
            yield z.decompress(data)
        self.rest = z.unused_data

    def resume(self) -> None:
        """Go on at the next place after the damaged member's begin where a member with a record begins, or end."""
        data, at = b"".join(self.seen) + self.rest, 1
        self.seen, self.rest = [], b""
        while True:
            at = data.find(MAGIC, at)
            if at < 0:
                at = max(1, len(data) - len(MAGIC) + 1)
            elif len(data) >= at + PROBE or self.over:
                try:
                    begins = zlib.decompressobj(31).decompress(data[at : at + PROBE], 5)
                except zlib.error:
                    begins = b""
                if begins == b"WARC/":
                    self.rest, self.over = data[at:], False
                    return
                at += 1
                continue
            if self.over:
                return
            more = self.stream.read(CHUNK)
            self.over = not more
            data, at = data[at - 1 :] + more, 1


def _read_record(member: Iterator[bytes]) -> Record:
    out, held = Record(), b""
    for chunk in member:
        held += chunk
        if b"\r\n\r\n" in held:
            break
    head, found, held = held.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        out.error = "no record header"
        return out
    out.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = out.headers.get("content-length", "")
    if not length.isdigit():
        out.error = "no content length"
        return out
    parts, size, n = [held], len(held), int(length)
    while size < n + 4:
        chunk = next(member, None)
        if chunk is None:
            break
        parts.append(chunk)
        size += len(chunk)
    whole = b"".join(parts)
    block, tail = whole[:n], whole[n:]
    if len(block) < n or tail != b"\r\n\r\n":
        out.error = "content length"
    elif out.headers.get("warc-block-digest", _sha1(block)) != _sha1(block):
        out.error = "block digest"
    _, _, out.payload = block.partition(b"\r\n\r\n")
    if not out.error and out.headers.get("warc-type") != "revisit" and out.headers.get("warc-payload-digest", _sha1(out.payload)) != _sha1(out.payload):
        out.error = "payload digest"
    return out


def read_records(stream: BinaryIO) -> Iterator[Record]:
    """Every record of an archive; one with ``error`` set for what can't be read, after which the next whole member follows."""
    members = _Members(stream)
    for member in members:
        try:
            out = _read_record(member)
            for _ in member:
                pass
        except (EOFError, zlib.error) as e:
            out = Record(error=str(e))
            members.resume()
        yield out


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem and path of a URI as ``shared_dir`` gives it; a path without a scheme is a local one."""
    return pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1)) if "://" in folder else (pafs.LocalFileSystem(), folder)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write a record per row; returns the manifest (file, records), kept in the shared folder."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= LEAST_BYTES)
    owners = save(large.groupBy("digest").agg(F.max("id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1 and owner is not null").select("digest", "owner"), "owners")
    if owners.count() <= BROADCAST_OWNERS:
        owners = F.broadcast(owners)
    placed = rows.join(owners, "digest", "left").select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("owner")), F.col("owner")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        out, name, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for row in range(batch.num_rows):
                ident, url, payload, to = (batch.column(k)[row].as_py() for k in range(4))
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = z.compress(record("null" if ident is None else str(ident), url, payload, None if to is None else str(to), date)) + z.flush()
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], ["file", "records"])

    return save(placed.mapInArrow(write, "file string, records long"), "manifest")


RECORDS = "file string, id string, type string, url string, refers_to string, payload_bytes long, payload_digest string, error string, payload binary"


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the manifest's files; digests as lower-case hex, taken from the payload itself where there is one."""
    ship_package(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in RECORDS.split(", "))])

        def rows(name: str) -> Iterator[tuple]:
            with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                for r in read_records(stream):
                    kind = r.headers.get("warc-type")
                    told = r.headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    digest = base64.b32decode(told).hex() if kind == "revisit" and told else hashlib.sha1(r.payload).hexdigest()
                    size = None if kind == "revisit" else len(r.payload)
                    yield name, r.ident("warc-record-id"), kind, r.headers.get("warc-target-uri"), r.ident("warc-refers-to"), size, digest, r.error, r.payload if payloads and kind != "revisit" else None

        held: list[tuple] = []
        weight = 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for r in rows(name):
                    held.append(r)
                    weight += 256 + len(r[-1] or b"")
                    if weight > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    files = manifest.select("file").repartition(max(1, manifest.count()))
    return files.mapInArrow(read, RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with the payload size of revisits taken from the response that they refer to; an error where there is none."""
    referred = records.filter("type = 'revisit'").select(F.col("refers_to").alias("r")).distinct()
    responses = records.filter("type = 'response'").select(F.col("id").alias("r"), F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("d"))
    known = save(responses.join(referred, "r", "left_semi").groupBy("r", "d").agg(F.max("size").alias("size")), "responses")
    if known.count() <= BROADCAST_OWNERS:
        known = F.broadcast(known)
    joined = records.join(known, (F.col("refers_to") == F.col("r")) & (F.col("payload_digest") == F.col("d")), "left")
    lost = (F.col("type") == "revisit") & F.col("size").isNull()
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "size")).withColumn("error", F.coalesce("error", F.when(lost, "no such response"))).drop("r", "d", "size")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, error."""
    folder = shared_dir(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    records = save(read_archives(manifest, folder, payloads=False).drop("payload"), "records")
    out = resolve_revisits(records)
    return out.select(F.expr("try_cast(id as bigint)").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.expr("try_cast(refers_to as bigint)").alias("refers_to"), "error")


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(t) AS h FROM p),
o AS (SELECT h, max(page_id) AS owner FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN owner IS NULL OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to, NULL::VARCHAR AS error
FROM d LEFT JOIN o USING (h)
"""
