"""Packets to flow records: conversations with periodic exports, and the payloads that metadata is read from."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.net import community_id
from vigil.functions.tls import ja3, ja4, looks_like_client_hello, version_label
from vigil.params import DNS_PORT, TCP, UDP, FlowMeter
from vigil.sources.readers import parse_client_hello, parse_dns

SYN, RST, FIN, ACK = 0x02, 0x04, 0x01, 0x10
RECORD = "kind string, src_ip string, dst_ip string, src_port int, dst_port int, proto int, first_ts double, last_ts double, bytes_fwd long, bytes_bwd long, pkts_fwd long, pkts_bwd long, syn_seen boolean, synack_seen boolean, rst_seen boolean, export_index int, is_final boolean, min_ttl int, max_ttl int, splt array<int>, payload binary"
_KIND = pa.schema([("kind", pa.string()), ("src_ip", pa.string()), ("dst_ip", pa.string()), ("src_port", pa.int32()), ("dst_port", pa.int32()), ("proto", pa.int32()), ("first_ts", pa.float64()), ("last_ts", pa.float64()), ("bytes_fwd", pa.int64()), ("bytes_bwd", pa.int64()), ("pkts_fwd", pa.int64()), ("pkts_bwd", pa.int64()), ("syn_seen", pa.bool_()), ("synack_seen", pa.bool_()), ("rst_seen", pa.bool_()), ("export_index", pa.int32()), ("is_final", pa.bool_()), ("min_ttl", pa.int32()), ("max_ttl", pa.int32()), ("splt", pa.list_(pa.int32())), ("payload", pa.binary())])


@dataclass
class Conversation:
    """State of one conversation; forward is the direction of its first packet."""

    src_ip: str
    dst_ip: str
    src_port: int
    dst_port: int
    proto: int
    first_ts: float
    last_ts: float
    exported: float
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])  # bytes and packets, forward and back, since the last export
    answers: int = 0
    syn: bool = False
    synack: bool = False
    rst: bool = False
    fins: int = 0
    low: int = 255
    high: int = 0
    exports: int = 0
    splt: list[int] = field(default_factory=list)
    client_spoke: bool = False

    def timeout(self, p: FlowMeter) -> float:
        return p.short_idle_s if not self.answers or self.rst or self.fins == 3 else p.idle_s

    def add(self, ts: float, src: str, sport: int, size: int, ttl: int, flags: int, payload: bytes, p: FlowMeter) -> list[dict]:
        """Records that this packet gives: a first client payload, and an export that is due."""
        out = []
        forward = src == self.src_ip and sport == self.src_port
        self.last_ts = max(self.last_ts, ts)
        self.low, self.high = min(self.low, ttl), max(self.high, ttl)
        side = 0 if forward else 1
        self.counts[side] += size
        self.counts[2 + side] += 1
        self.answers += side
        if self.proto == TCP:
            if flags & SYN:
                if flags & ACK:
                    self.synack |= not forward
                else:
                    self.syn |= forward
            self.rst |= bool(flags & RST)
            if flags & FIN:
                self.fins |= 1 << side
        if payload:
            if len(self.splt) < p.splt:
                self.splt.append(len(payload) if forward else -len(payload))
            if forward and self.proto == TCP and not self.client_spoke:
                self.client_spoke = True
                out.append(self.record("hello", ts, payload))
        if ts - self.exported >= p.active_s:
            out.append(self.export(False))
        return out

    def record(self, kind: str, ts: float, payload: bytes | None = None, final: bool = False) -> dict:
        a, b, c, d = self.counts
        return {
            "kind": kind, "src_ip": self.src_ip, "dst_ip": self.dst_ip, "src_port": self.src_port, "dst_port": self.dst_port, "proto": self.proto, "first_ts": self.first_ts, "last_ts": ts,
            "bytes_fwd": a, "bytes_bwd": b, "pkts_fwd": c, "pkts_bwd": d, "syn_seen": self.syn, "synack_seen": self.synack, "rst_seen": self.rst, "export_index": self.exports, "is_final": final,
            "min_ttl": self.low, "max_ttl": self.high, "splt": list(self.splt), "payload": payload,
        }

    def export(self, final: bool) -> dict:
        out = self.record("flow", self.last_ts, final=final)
        self.counts, self.exported = [0, 0, 0, 0], self.last_ts
        self.exports += 1
        return out


def keyed(packets: DataFrame) -> DataFrame:
    """Packets with the key of their conversation, the same for both directions."""
    a, b = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    end = lambda s: F.concat_ws("|", s["ip"], s["port"].cast("string"))
    return packets.withColumn("key", F.concat_ws("/", F.col("proto").cast("string"), end(F.least(a, b)), end(F.greatest(a, b))))


def meter(packets: DataFrame, p: FlowMeter = FlowMeter()) -> DataFrame:
    """Records (kind flow or hello) of all conversations.

    Packets are dealt by conversation and sorted by time, and a task walks through them
    with the state of one conversation at a time, however many packets that has. A gap of
    the conversation's timeout ends it.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, out = None, None, []
        for batch in batches:
            for k, ts, src, dst, sport, dport, proto, size, ttl, flags, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key or (now and ts - now.last_ts >= now.timeout(p)):
                    if now:
                        out.append(now.export(True))
                    key, now = k, Conversation(src, dst, sport, dport, proto, ts, ts, ts)
                out += now.add(ts, src, sport, size, ttl, flags, payload, p)
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, _KIND)
                out = []
        if now:
            out.append(now.export(True))
        if out:
            yield pa.RecordBatch.from_pylist(out, _KIND)

    rows = keyed(packets)
    order = ["key", "ts", *(["n"] if "n" in packets.columns else [])]
    rows = rows.repartition("key").sortWithinPartitions(*order)
    cols = ["key", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "ip_len", "ttl", "tcp_flags", "payload"]
    return rows.select(*cols).mapInArrow(walk, RECORD)


def events(packets: DataFrame, p: FlowMeter = FlowMeter()) -> dict[str, DataFrame]:
    """flows, dns and tls of packets, each with an order (seq) by time."""
    records = meter(packets, p)
    named = records.withColumn("flow_id", community_id(F.col("src_ip"), F.col("dst_ip"), F.col("src_port"), F.col("dst_port"), F.col("proto"), v6=True))
    seq = lambda ts, *more: (F.round(ts * 1e6).cast("long") * 4096 + F.pmod(F.xxhash64(*more), F.lit(4096))).alias("seq")
    flows = named.filter("kind = 'flow'").select(seq(F.col("last_ts"), "flow_id", "export_index"), "*", F.lit("pcap").alias("mode")).drop("kind", "payload")
    return {"flows": flows, "tls": tls_events(named.filter("kind = 'hello'"), seq), "dns": dns_events(packets, seq)}


def tls_events(hellos: DataFrame, seq) -> DataFrame:
    h = hellos.filter(looks_like_client_hello(F.col("payload"))).withColumn("h", parse_client_hello(F.col("payload"))).filter("h IS NOT NULL")
    h = h.select("*", F.col("h.legacy_version").alias("v"), *[F.col(f"h.{c}").alias(c) for c in ("ciphers", "extensions", "groups", "point_formats", "sig_algs", "supported_versions", "sni")], F.col("h.alpn").alias("protocols"))
    return h.select(
        seq(F.col("last_ts"), "flow_id"), F.col("last_ts").alias("ts"), "flow_id", F.col("src_ip").alias("client_ip"), F.col("dst_ip").alias("server_ip"), F.col("dst_port").alias("server_port"), version_label(F.col("v"), F.col("supported_versions")).alias("version"), "sni",
        ja3(F.col("v"), F.col("ciphers"), F.col("extensions"), F.col("groups"), F.col("point_formats")).alias("ja3"), ja4(F.col("v"), F.col("ciphers"), F.col("extensions"), F.col("sig_algs"), F.col("supported_versions"), F.col("sni"), F.col("protocols")).alias("ja4"),
        F.try_element_at("protocols", F.lit(1)).alias("alpn"),
    )


def dns_events(packets: DataFrame, seq) -> DataFrame:
    port = (F.col("src_port") == DNS_PORT) | (F.col("dst_port") == DNS_PORT)
    rows = packets.filter((F.col("proto") == UDP) & port).withColumn("m", parse_dns(F.col("payload"))).filter("m IS NOT NULL")
    response = F.col("m.is_response")
    rows = rows.withColumn("flow_id", community_id(F.col("src_ip"), F.col("dst_ip"), F.col("src_port"), F.col("dst_port"), F.col("proto"), v6=True))
    return rows.select(
        seq(F.col("ts"), "flow_id", "m.query", "m.is_response"), "ts", "flow_id", F.when(response, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("client_ip"), F.when(response, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("resolver_ip"),
        F.col("m.query").alias("query"), F.col("m.qtype").alias("qtype"), response.alias("is_response"), F.col("m.rcode").alias("rcode"), F.when(response, F.col("m.size")).otherwise(0).alias("answer_bytes"),
    )
