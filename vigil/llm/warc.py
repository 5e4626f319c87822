"""WARC bundles as seekable Zstandard: independent frames, a footer seek table, an index of records.

A bundle holds the records of a part of a task's rows. Records are grouped into frames of
about ``frame_bytes``, each compressed alone; the last frame is skippable and holds the seek
table (sizes of every frame, then the number of frames, a descriptor and the magic
number, as in the public seekable format). The index maps a record's identifier to its
bundle, frame, place within the frame and length, so one record is read by decompressing
one frame.

Bundles are rows with a binary column, written by Spark to any store that it can write;
``export`` puts one into a file. Memory is bounded by one bundle (``bundle_bytes`` of
records) or one record, whichever is larger.

Of records with equal payloads the one with the smallest identifier is a response and
the others revisit it; payloads below ``min_revisit_bytes`` are always responses.
Rows that repeat both identifier and payload are all responses. Null payloads are empty;
a null identifier is never the smallest, unless all are null, when all are responses. A
null URL is written as ``urn:x-none``. An empty table gives no bundles.

A record's URI holds its row's identifier, so identifiers and what a revisit refers to are read from the
standard fields; records without identifier have the URI of their place. A payload is read back only if
its own SHA-1 is the record's digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, cut, spread_join

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 23
#: Fixed values of the seekable format: the skippable frame's magic number, and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
#: Name spaces of record URIs: rows by identifier, and records without one by their place.
ROW, PLACE = "urn:x-vigil:row:", "urn:x-vigil:place:"

BUNDLE = "bundle string, n_records long, data binary, records array<struct<record:string,frame:int,offset:long,length:long>>"
RECORD = "id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def record_uri(name: str) -> str:
    return f"<{ROW}{quote(name, safe='')}>"


def row_of(uri: str) -> str | None:
    """The identifier in a record's URI; null for one that stands for a place."""
    inner = uri.strip("<>")
    return unquote(inner.removeprefix(ROW)) if inner.startswith(ROW) else None


def base32_digest(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def write_record(uri: str, url: str | None, payload: bytes, sha1_hex: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit of the row ``refers_to`` keeps the HTTP headers (with the full length) and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {uri}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or 'urn:x-none').split())}",
        f"WARC-Payload-Digest: sha1:{base32_digest(sha1_hex)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_uri(refers_to)}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; payload_bytes is the full payload's also for a revisit. A damaged payload is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and len(payload) != length:
        raise ValueError("payload is cut short")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (own := base32_digest(hashlib.sha1(payload).hexdigest())) != digest:
        raise ValueError(f"payload is damaged: its digest is {own}, the record says {digest}")
    return {
        "id": row_of(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": row_of(fields["WARC-Refers-To"]) if revisit else None,
        "payload_digest": digest,
        "payload_bytes": length,
        "payload": None if revisit else payload,
    }


class Bundle:
    """A bundle in the making."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes = frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.filled = 0
        self.total = 0
        self.records: list[dict] = []

    def add(self, name: str | None, raw: bytes) -> None:
        self.records.append({"record": name, "frame": len(self.frames), "offset": self.filled, "length": len(raw)})
        self.open.append(raw)
        self.filled += len(raw)
        self.total += len(raw)
        if self.filled >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            frame = self.zstd.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.filled))
            self.open, self.filled = [], 0

    def finish(self) -> bytes:
        self._close()
        entries = b"".join(struct.pack("<II", a, b) for a, b in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, uncompressed) of every frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        a, b = struct.unpack_from("<II", data, len(data) - 9 - 8 * (n - i))
        out.append((at, a, b))
        at += a
    return out


def read_frame(data: bytes, table: list[tuple[int, int, int]], frame: int) -> bytes:
    at, size, full = table[frame]
    return zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=full)


def plan_records(df: DataFrame, id_col: str, url: str, payload: str, min_revisit_bytes: int = 0) -> DataFrame:
    """id, url, payload (binary), sha1 (hex) and refers_to, which is null for responses.

    The smallest identifier of each payload comes from a partial aggregation. Payloads
    that occur once aren't joined at all in effect, and those that hold a large part of all
    rows are salted by identifier, so that one payload with a third of all rows is dealt over many tasks.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    firsts = rows.filter(F.length("payload") >= min_revisit_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = cut(firsts.filter("n > 1 AND first IS NOT NULL"))
    joined = spread_join(rows, firsts, ["sha1"], "n", df.count(), ["id"], "left")
    later = F.col("id").isNull() | (F.col("id") != F.col("first"))
    return joined.select("id", "url", "payload", "sha1", F.when(F.col("first").isNotNull() & later, F.col("first")).alias("refers_to"))


def bundle(records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = DATE) -> DataFrame:
    """Bundles of the rows of plan_records, with the index of their records; each task fills its own."""
    bounded_batches(records.sparkSession)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, now = TaskContext.get().partitionId(), 0, Bundle(frame_bytes)

        def out() -> pa.RecordBatch:
            where = pa.list_(pa.struct([("record", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{task:06d}-{made:06d}"]), pa.array([len(now.records)], pa.int64()), pa.array([now.finish()], pa.binary()), pa.array([now.records], where)],
                ["bundle", "n_records", "data", "records"],
            )

        for batch in batches:
            for name, url, body, sha1, first in zip(*(batch.column(i) for i in range(5)), strict=True):
                name = name.as_py()
                uri = record_uri(name) if name is not None else f"<{PLACE}{task:06d}-{made:06d}-{len(now.records)}>"
                now.add(name, write_record(uri, url.as_py(), body.as_py(), sha1.as_py(), first.as_py(), date))
                if now.total >= bundle_bytes:
                    yield out()
                    made, now = made + 1, Bundle(frame_bytes)
        if now.records:
            yield out()

    rows = records.select(F.col("id").cast("string"), "url", "payload", "sha1", F.col("refers_to").cast("string"))
    return rows.mapInArrow(fill, BUNDLE)


_RECORDS = pa.schema([("id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of bundles (columns data and records), read through the seek tables, a frame at a time."""
    bounded_batches(bundles.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, records in zip(batch.column(0), batch.column(1), strict=True):
                data = data.as_py()
                table, rows, held, frame = seek_table(data), [], -1, b""
                for r in records.as_py():
                    if r["frame"] != held:
                        if rows:
                            yield pa.RecordBatch.from_pylist(rows, _RECORDS)
                        held, frame, rows = r["frame"], read_frame(data, table, r["frame"]), []
                    rows.append(parse_record(frame[r["offset"] : r["offset"] + r["length"]]))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    return bundles.select("data", "records").mapInArrow(read, RECORD)


def fetch(bundles: DataFrame, names: DataFrame) -> DataFrame:
    """The records whose identifier is in the first column of ``names``; only their frames are decompressed."""
    wanted = names.select(F.col(names.columns[0]).cast("string").alias("record")).distinct()
    spots = bundles.select("bundle", F.inline("records")).join(wanted, "record", "left_semi")
    spots = spots.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "length", "record"))).alias("hits"))
    found = bundles.select("bundle", "data").join(spots, "bundle")
    return read_bundles(found.select("data", F.expr("transform(hits, h -> struct(h.record AS record, h.frame AS frame, h.offset AS offset, h.length AS length))").alias("records")))


def export(bundles: DataFrame, name: str, path: str) -> None:
    """One bundle as a .warc.zst file that any zstd tool reads."""
    with open(path, "wb") as f:
        f.write(bundles.filter(F.col("bundle") == name).select("data").first().data)
