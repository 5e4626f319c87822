"""Captures and data sets from tables."""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.params import TCP, UDP

#: Fixed values of the classic format: magic number of microsecond captures in little-endian order, version, Ethernet.
PCAP_HEADER = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 0xFFFF, 1)
ETHERNET = b"\x02" + b"\0" * 4 + b"\x01\x02" + b"\0" * 4 + b"\x02"


def _sum16(data: bytes) -> int:
    """Checksum of the internet protocols."""
    data += b"\0" * (len(data) % 2)
    total = sum(struct.unpack(f">{len(data) // 2}H", data))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def frame(src: str, dst: str, sport: int, dport: int, proto: int, ttl: int, flags: int, payload: bytes) -> bytes:
    """One packet as an Ethernet frame, with right checksums."""
    six = ":" in src
    a, b = (socket.inet_pton(socket.AF_INET6 if six else socket.AF_INET, x) for x in (src, dst))

    def layer(check: int) -> bytes:
        if proto == TCP:
            return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 0xFFFF, check, 0) + payload
        return struct.pack(">HHHH", sport, dport, 8 + len(payload), check) + payload

    body = layer(0) if proto in (TCP, UDP) else payload
    if proto in (TCP, UDP):
        body = layer(_sum16(a + b + struct.pack(">II", len(body), proto) + body))
    if six:
        return ETHERNET + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, len(body), proto, ttl) + a + b + body
    head = lambda check: struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, ttl, proto, check) + a + b
    return ETHERNET + b"\x08\x00" + head(_sum16(head(0))) + body


def captures(packets: DataFrame, files: int = 1) -> DataFrame:
    """(part, n, content) of ``files`` pcap files that hold the packets in order of (ts, seq), each a range of the order.

    packets: ts, seq, src_ip, dst_ip, src_port, dst_port, proto, ttl, tcp_flags, payload. A file is held whole by its task, so
    give as many files as keep them small.
    """
    cols = ["ts", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "ttl", "tcp_flags", "payload"]
    rows = packets.repartitionByRange(files, "ts", "seq").sortWithinPartitions("ts", "seq").withColumn("part", F.spark_partition_id()).select("part", *cols)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = None, []
        for batch in batches:
            for part, ts, src, dst, sport, dport, proto, ttl, flags, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, at = frame(src, dst, sport, dport, proto, ttl, flags, bytes(payload or b"")), round(ts * 1e6)
                out.append(struct.pack("<IIII", at // 1_000_000, at % 1_000_000, len(data), len(data)) + data)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(out)], pa.int64()), pa.array([PCAP_HEADER + b"".join(out)], pa.binary())], ["part", "n", "content"])

    return rows.mapInArrow(write, "part int, n long, content binary")


def write_dataset(rows: DataFrame, path: str, source: str, kind: str = "csv") -> None:
    """A labelled set as CSV or Parquet, and beside it how many rows of each label it has and where they come from."""
    rows.write.mode("overwrite").option("header", True).format(kind).save(path)
    rows.groupBy("label").agg(F.count("*").alias("rows")).withColumn("source", F.lit(source)).coalesce(1).write.mode("overwrite").json(f"{path}-provenance")
