"""Readers that give events as DataFrames."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.net import community_id
from vigil.params import INTERNAL_NETWORKS
from vigil.schema import HELLO
from vigil.sources import parsers

# ---- packets and payloads

_PACKETS = pa.schema([("file", pa.string()), ("n", pa.int64()), ("ts", pa.float64()), ("src_ip", pa.string()), ("dst_ip", pa.string()), ("src_port", pa.int32()), ("dst_port", pa.int32()), ("proto", pa.int32()), ("ip_len", pa.int32()), ("ttl", pa.int32()), ("tcp_flags", pa.int32()), ("payload", pa.binary())])


def decode_captures(files: DataFrame) -> DataFrame:
    """Packets of capture files given as rows (path, content); n counts a file's packets. Other packets than IP TCP/UDP are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for n, (ts, link, frame) in enumerate(parsers.frames(content)):
                    got = parsers.packet(ts, frame, link)
                    if got:
                        rows.append((path, n, *got))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PACKETS, strict=True)], schema=_PACKETS)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PACKETS, strict=True)], schema=_PACKETS)

    kind = "file string, n long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, proto int, ip_len int, ttl int, tcp_flags int, payload binary"
    return files.select("path", "content").mapInArrow(run, kind)


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """Packets of one capture, a folder of them, or a pattern."""
    return decode_captures(spark.read.format("binaryFile").option("pathGlobFilter", "*.{pcap,pcapng,cap}").load(path))


def stream_pcap(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Packets of captures as they arrive in a folder; back-pressure takes the place of dropping."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return decode_captures(files.option("maxFilesPerTrigger", files_per_trigger).load(path))


def parse_dns(payload: Column) -> Column:
    """struct(query, qtype, is_response, rcode, size) of a DNS payload; null if it can't be read."""

    @F.arrow_udf("struct<query:string,qtype:int,is_response:boolean,rcode:int,size:int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("query", pa.string()), ("qtype", pa.int32()), ("is_response", pa.bool_()), ("rcode", pa.int32()), ("size", pa.int32())])
        for payloads in batches:
            yield pa.array([_or_none(parsers.dns_message, x) for x in payloads.to_pylist()], kind)

    return run(payload)


def parse_client_hello(payload: Column) -> Column:
    """struct of a ClientHello's fields; null if it can't be read."""

    @F.arrow_udf(f"struct<{HELLO.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ints = pa.list_(pa.int32())
        kind = pa.struct([("legacy_version", pa.int32()), *((n, ints) for n in ("ciphers", "extensions", "groups", "point_formats", "sig_algs", "supported_versions")), ("sni", pa.string()), ("alpn", pa.list_(pa.string()))])
        for payloads in batches:
            yield pa.array([_or_none(parsers.client_hello, x) for x in payloads.to_pylist()], kind)

    return run(payload)


def _or_none(parse, data: bytes | None) -> dict | None:
    try:
        return parse(data or b"")
    except parsers.ParseError:
        return None


# ---- flow records


def _flow_columns(df: DataFrame, seq: Column, flags: Column) -> DataFrame:
    syn, ack, rst = (flags.bitwiseAND(F.lit(b)) != 0 for b in (parsers.SYN, parsers.ACK, parsers.RST))
    null = F.lit(None)
    return df.select(
        seq.alias("seq"), community_id(F.col("src_ip"), F.col("dst_ip"), F.col("src_port"), F.col("dst_port"), F.col("proto"), v6=True).alias("flow_id"),
        "src_ip", "dst_ip", "src_port", "dst_port", "proto", "first_ts", "last_ts", "bytes_fwd", F.lit(0).cast("long").alias("bytes_bwd"), "pkts_fwd", F.lit(0).cast("long").alias("pkts_bwd"),
        syn.alias("syn_seen"), (syn & ack).alias("synack_seen"), rst.alias("rst_seen"), F.lit(0).alias("export_index"), F.lit(True).alias("is_final"),
        F.lit(0).alias("min_ttl"), F.lit(0).alias("max_ttl"), null.cast("array<int>").alias("splt"), F.lit("flow").alias("mode"),
    )


def decode_netflow(datagrams: DataFrame, column: str = "datagram", seq: str = "seq") -> DataFrame:
    """Flows of NetFlow v5 datagrams (binary column); ones that can't be read give none. Order: datagram, then record."""

    @F.arrow_udf("array<struct<src_ip:string,dst_ip:string,src_port:int,dst_port:int,proto:int,first_ts:double,last_ts:double,bytes_fwd:bigint,pkts_fwd:bigint,flags:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        i, f, n, s = pa.int32(), pa.float64(), pa.int64(), pa.string()
        kind = pa.list_(pa.struct([("src_ip", s), ("dst_ip", s), ("src_port", i), ("dst_port", i), ("proto", i), ("first_ts", f), ("last_ts", f), ("bytes_fwd", n), ("pkts_fwd", n), ("flags", i)]))
        for data in batches:
            yield pa.array([_or_none(parsers.netflow_v5, x) for x in data.to_pylist()], kind)

    rows = datagrams.select(F.col(seq).alias("seq"), F.posexplode(run(F.col(column))).alias("nth", "r")).select("seq", "nth", "r.*")
    return _flow_columns(rows, F.col("seq") * 64 + F.col("nth"), F.col("flags"))


def read_netflow(spark: SparkSession, path: str) -> DataFrame:
    """Flows of a folder of NetFlow v5 datagrams, one a file, in the order in which they were landed."""
    files = spark.read.format("binaryFile").load(path)
    seq = F.unix_micros("modificationTime") * 64 + F.pmod(F.xxhash64("path"), F.lit(64))
    return decode_netflow(files.select(seq.alias("seq"), F.col("content").alias("datagram")))


def stream_netflow(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Flows of NetFlow v5 datagrams that a collector lands as files, one each."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path)
    seq = F.unix_micros("modificationTime") * 64 + F.pmod(F.xxhash64("path"), F.lit(64))
    return decode_netflow(files.select(seq.alias("seq"), F.col("content").alias("datagram")))


_JSON = "SrcAddr string, DstAddr string, SrcPort int, DstPort int, Proto int, Bytes long, Packets long, TcpFlags int, TimeFlowStartNs long, TimeFlowEndNs long, TimeFlowStart double, TimeFlowEnd double, src_addr string, dst_addr string, src_port int, dst_port int, proto int, bytes long, packets long, tcp_flags int, time_flow_start_ns long, time_flow_end_ns long, time_flow_start double, time_flow_end double"


def flows_from_json(lines: DataFrame, column: str = "value", seq: Column | None = None) -> DataFrame:
    """Flows of JSON lines with either spelling of the keys; lines that lack an address or aren't JSON are left out."""
    raw, chosen = F.from_json(F.col(column), _JSON.split(", src_addr")[0]), F.from_json(F.col(column), "src_addr" + _JSON.split(", src_addr")[1])
    rows = lines.select((seq if seq is not None else F.monotonically_increasing_id()).alias("seq"), raw.alias("a"), chosen.alias("b"))

    def pick(a: str, b: str, default=None) -> Column:
        return F.coalesce(F.col(f"a.{a}"), F.col(f"b.{b}"), F.lit(default))

    start = F.coalesce(pick("TimeFlowStartNs", "time_flow_start_ns") / 1e9, pick("TimeFlowStart", "time_flow_start", 0.0))
    rows = rows.select(
        "seq", pick("SrcAddr", "src_addr").alias("src_ip"), pick("DstAddr", "dst_addr").alias("dst_ip"), pick("SrcPort", "src_port", 0).alias("src_port"), pick("DstPort", "dst_port", 0).alias("dst_port"),
        pick("Proto", "proto", 0).alias("proto"), start.alias("first_ts"), F.coalesce(pick("TimeFlowEndNs", "time_flow_end_ns") / 1e9, pick("TimeFlowEnd", "time_flow_end"), start).alias("end"),
        pick("Bytes", "bytes", 0).cast("long").alias("bytes_fwd"), pick("Packets", "packets", 0).cast("long").alias("pkts_fwd"), pick("TcpFlags", "tcp_flags", 0).alias("flags"),
    )
    rows = rows.filter((F.length("src_ip") > 0) & (F.length("dst_ip") > 0)).withColumn("last_ts", F.greatest("end", "first_ts"))
    return _flow_columns(rows, F.col("seq"), F.col("flags"))


def read_json_flows(spark: SparkSession, path: str) -> DataFrame:
    return flows_from_json(spark.read.text(path))


def stream_json_flows(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return flows_from_json(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


# ---- labelled flows

#: Spellings of the columns of labelled flow sets.
LABELLED = {
    "duration_us": ("flow duration",),
    "fwd_packets": ("total fwd packets", "total fwd packet", "tot fwd pkts"),
    "bwd_packets": ("total backward packets", "total bwd packets", "tot bwd pkts"),
    "fwd_bytes": ("total length of fwd packets", "total length of fwd packet", "totlen fwd pkts", "fwd packets length total"),
    "bwd_bytes": ("total length of bwd packets", "total length of bwd packet", "totlen bwd pkts", "bwd packets length total"),
    "proto": ("protocol",),
    "syn": ("syn flag count", "syn flag cnt"),
    "rst": ("rst flag count", "rst flag cnt"),
    "label": ("label",),
}


def labelled_flows(raw: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Numeric columns and mapped label of a labelled set; rows with unknown labels or numbers that can't be read are left out."""
    names = {c.strip().lower(): c for c in raw.columns}
    found = {}
    for name, spellings in LABELLED.items():
        at = next((names[s] for s in (*spellings, name) if s in names), None)
        if at is not None:
            found[name] = F.col(f"`{at}`")
        elif name in ("syn", "rst", "proto"):
            found[name] = F.lit("0")
        else:
            raise ValueError(f"no column for {name}")
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    numbers = [c.cast("string").try_cast("double").alias(n) for n, c in found.items() if n != "label"]
    out = raw.select(*numbers, F.try_element_at(table, F.trim(found["label"])).alias("label"))
    finite = [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) != float("inf")) for n in found if n != "label"]
    for c in finite:
        out = out.filter(c)
    return out.filter("label IS NOT NULL")


def read_labelled(spark: SparkSession, path: str, labels: dict[str, str]) -> DataFrame:
    reader = spark.read.option("encoding", "ISO-8859-1").option("header", True)
    return labelled_flows(spark.read.parquet(path) if path.endswith(".parquet") else reader.csv(path), labels)


def read_features(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A CSV of exactly these feature columns and label; rows with gaps are left out."""
    raw = spark.read.option("header", True).csv(path)
    missing = [n for n in (*names, "label") if n not in raw.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return raw.select(*[F.col(n).try_cast("double").alias(n) for n in names], "label").na.drop()


# ---- configuration and intelligence


@dataclass
class Settings:
    sensor_id: str = "sensor"
    internal_networks: tuple[str, ...] = INTERNAL_NETWORKS
    allowlist: tuple[str, ...] = ()
    assets: list[dict] = field(default_factory=list)
    intel_dir: str | None = None
    model_dir: str | None = None

    @staticmethod
    def load(path: str) -> Settings:
        raw = json.loads(Path(path).read_text())
        unknown = set(raw) - set(Settings.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        for a in raw.get("assets", []):
            if not 1 <= int(a.get("criticality", 3)) <= 5:
                raise ValueError("criticality must lie from 1 to 5")
        return Settings(**{k: tuple(v) if k in ("internal_networks", "allowlist") else v for k, v in raw.items()})

    def asset_table(self, spark: SparkSession) -> DataFrame:
        rows = [(a["ip"], a.get("name", ""), a.get("zone", ""), int(a.get("criticality", 3))) for a in self.assets]
        return spark.createDataFrame(rows, "ip string, name string, zone string, criticality int")

    def allow_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(x,) for x in self.allowlist], "ip string")


def blocklist(text: str) -> set[str]:
    """First token of each line in lower case; # starts a comment."""
    return {w[0].lower() for line in text.splitlines() if (w := line.split("#")[0].split())}


def write_manifest(folder: str) -> Path:
    out = Path(folder, "manifest.json")
    sums = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(Path(folder).iterdir()) if p.is_file() and p != out}
    out.write_text(json.dumps(sums, indent=2, sort_keys=True))
    return out


@dataclass
class Intel:
    ja3: set[str] = field(default_factory=set)
    ja4: set[str] = field(default_factory=set)
    domains: set[str] = field(default_factory=set)

    @staticmethod
    def load(folder: str) -> Intel:
        """Blocklists of a folder whose files match its manifest; empty without a manifest, refused on a mismatch."""
        manifest = Path(folder, "manifest.json")
        if not manifest.exists():
            return Intel()
        for name, digest in json.loads(manifest.read_text()).items():
            p = Path(folder, name)
            if not p.exists() or hashlib.sha256(p.read_bytes()).hexdigest() != digest:
                raise ValueError(f"{name} does not match the manifest")
        read = lambda n: blocklist(p.read_text()) if (p := Path(folder, n)).exists() else set()
        return Intel(read("ja3_blocklist.txt"), read("ja4_blocklist.txt"), read("domain_blocklist.txt"))


def check_upload(name: str, size: int, most: int = 64 << 20) -> None:
    """Refuse files that aren't captures or are too large."""
    if Path(name).suffix.lower() not in (".pcap", ".pcapng", ".cap"):
        raise ValueError("only captures can be analysed")
    if size > most:
        raise ValueError("the capture is too large")
