"""WARC archives in seekable Zstandard bundles.

A bundle is a row of a written table: whole records are grouped into independent Zstandard frames of
about ``frame_bytes`` before compression, and after the frames stands the seek table of the public
seekable format (a skippable frame of compressed and decompressed frame sizes, with its footer). The
index of a bundle maps each record identifier to its frame, its offset within the decompressed frame
and its length, so reading a record decompresses one frame.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest page id is a
response and the others are revisits that refer to it. Smaller payloads are all responses.

A null payload is empty. A null page id comes before all others. Rows that repeat a page id and
payload are all written: as responses if they are the newest, as revisits otherwise. A null URL is
written as ``urn:missing``. An empty table gives an empty result. Other columns are ignored.

The newest record of a payload is found on digests and ids alone, with the pages of a frequent digest
dealt over many tasks. Payloads move once, by page id, so a payload that a third of all pages share
does not meet in one task.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.llm.skew import spread_join
from lexshoal.storage import materialize, read_table

FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
#: Fixed values of the public seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
DATE = "2020-01-01T00:00:00Z"
_INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))


class BundleWriter:
    """Collects records into frames; ``close`` returns the bundle's bytes and its index."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[dict] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0

    def add(self, record_id: str, record: bytes) -> None:
        if self.open and self.open_bytes + len(record) > self.frame_bytes:
            self._end_frame()
        self.index.append({"record_id": record_id, "frame": len(self.frames), "offset": self.open_bytes, "length": len(record)})
        self.open.append(record)
        self.open_bytes += len(record)

    def _end_frame(self) -> None:
        frame = self.packer.compress(b"".join(self.open))
        self.frames.append(frame)
        self.sizes.append((len(frame), self.open_bytes))
        self.bytes += len(frame)
        self.open, self.open_bytes = [], 0

    def close(self) -> tuple[bytes, list[dict]]:
        if self.open:
            self._end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table, self.index


class BundleReader:
    """Reads records of a bundle by frame and offset; the last frame stays decompressed."""

    def __init__(self, bundle: bytes) -> None:
        self.bundle, self.unpacker = bundle, zstandard.ZstdDecompressor()
        frames, flags, magic = struct.unpack("<IBI", bundle[-9:])
        if magic != SEEKABLE_MAGIC:
            raise ValueError("the bundle has no seek table")
        entry = 12 if flags & 0x80 else 8
        table = bundle[len(bundle) - 9 - frames * entry : len(bundle) - 9]
        self.starts, self.sizes, at = [], [], 0
        for i in range(frames):
            packed, plain = struct.unpack_from("<II", table, i * entry)
            self.starts.append((at, at + packed))
            self.sizes.append(plain)
            at += packed
        self.held: tuple[int, bytes] = (-1, b"")

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if self.held[0] != frame:
            a, b = self.starts[frame]
            self.held = (frame, self.unpacker.decompress(self.bundle[a:b], max_output_size=self.sizes[frame]))
        return self.held[1][offset : offset + length]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _page_of(identifier: str) -> int | None:
    page = identifier.split(":")[2]
    return int(page) if page else None


def make_record(page_id: int | None, url: str | None, payload: bytes, refers: bool, refers_to: int | None) -> tuple[str, bytes]:
    """The identifier and the bytes of a response, or of a revisit without its payload."""
    digest = payload_digest(payload)
    name = record_id(page_id, digest)
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "urn:missing"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Page id, payload size and digest, type and reference, from a record's own bytes."""
    head, rest = record.split(b"\r\n\r\n", 1)
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if not first.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (payload_digest(payload) != stated or len(payload) != size):
        raise ValueError("a payload does not match its digest")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": stated,
        "record_type": fields["WARC-Type"],
        "refers_to": _page_of(fields["WARC-Refers-To"]) if revisit else None,
    }


def mark_revisits(pages: DataFrame, page: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, revisit, refers_to) with payloads as text, nulls replaced."""
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    ids = rows.select("page_id", F.sha1(F.encode("payload", "utf-8")).alias("digest"), F.octet_length("payload").alias("bytes"))
    ids = materialize(ids.where(F.col("bytes") >= min_bytes).select("page_id", "digest"), "payload-digests")
    newest = ids.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
    newest = materialize(newest.where("n > 1").select("digest", "newest"), "repeated-payloads")
    older = spread_join(ids, newest, "digest", "page_id").where(~F.col("page_id").eqNullSafe(F.col("newest")))
    older = older.select(F.col("page_id").alias("older"), F.col("digest").alias("older_digest"), "newest").distinct()
    keyed = rows.withColumn("digest", F.sha1(F.encode("payload", "utf-8")))
    on = keyed["page_id"].eqNullSafe(older["older"]) & (keyed["digest"] == older["older_digest"])
    return keyed.join(older, on, "left").select("page_id", "url", "payload", F.col("older_digest").isNotNull().alias("revisit"), F.col("newest").alias("refers_to"))


def write_bundles(marked: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(bundle, index): archives of whole records, each of about ``bundle_bytes`` after compression."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(writer: BundleWriter) -> pa.RecordBatch:
            bundle, index = writer.close()
            return pa.RecordBatch.from_arrays([pa.array([bundle], pa.binary()), pa.array([index], _INDEX)], ["bundle", "index"])

        writer = BundleWriter(frame_bytes)
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "revisit", "refers_to")]
            for row in zip(*columns, strict=True):
                page_id, url, payload, revisit, refers_to = (x.as_py() for x in row)
                writer.add(*make_record(page_id, url, payload.encode(), revisit, refers_to))
                if writer.bytes >= bundle_bytes:
                    yield done(writer)
                    writer = BundleWriter(frame_bytes)
        if writer.index:
            yield done(writer)

    schema = "bundle binary, index array<struct<record_id:string,frame:int,offset:long,length:long>>"
    return marked.mapInArrow(write, schema)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """One row for each record, found through its bundle's index and parsed from the archive's bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "record_id": pa.string(), "frame": pa.int32(), "frame_offset": pa.int64()}
        for batch in batches:
            for bundle, index in zip(batch.column(0), batch.column(1), strict=True):
                reader = BundleReader(bundle.as_py())
                rows = [parse_record(reader.read(x["frame"], x["offset"], x["length"])) | {"record_id": x["record_id"], "frame": x["frame"], "frame_offset": x["offset"]} for x in index.as_py()]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, frame int, frame_offset long"
    return bundles.select("bundle", "index").mapInArrow(read, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written to archives and read back."""
    bundles = materialize(write_bundles(mark_revisits(read_table(spark, sf_dir, "pages"))), "warc", codec="uncompressed")
    return read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), n AS (SELECT hex, max(page_id) AS newest FROM p GROUP BY hex)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM p JOIN n USING (hex)
"""

QUERIES = {"op8_warc": op8_warc}
ORACLES = {"op8_warc": OP8_SQL}
