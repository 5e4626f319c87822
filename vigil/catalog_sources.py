"""Registered queries of the sources: events written in each wire format by column expressions, then read by the library.

A capture of one packet for each event, NetFlow v5 datagrams of one record, JSON flow lines and DNS messages; the
SQL gives the values that went in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.catalog import FLOWS_SQL, HOSTS_SQL, addressed, flows, host_name, hosts, query
from vigil.sources.readers import decode_captures, decode_netflow, flows_from_json, parse_dns

MICROS = "epoch_us(ts)"


def number(value: Column, size: int) -> Column:
    """Hex digits of an unsigned number of so many bytes; one that doesn't fit is an error."""
    digits = F.lower(F.hex(value.cast("long")))
    return F.when(F.length(digits) > 2 * size, F.raise_error(F.concat(F.lit(f"more than {size} bytes: "), digits))).otherwise(F.lpad(digits, 2 * size, "0"))


def wire(*parts: Column | str) -> Column:
    """Bytes of hex digits."""
    return F.unhex(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def ip(column: str) -> Column:
    return F.concat(*[number(F.split(column, r"\.")[i], 1) for i in range(4)])


def micros() -> Column:
    return F.round(F.col("first_ts") * 1e6).cast("long")


@query("json_flows", f"""WITH {FLOWS_SQL} SELECT f.seq, src_ip, dst_ip, 40000 AS src_port, port AS dst_port, 6 AS proto, bytes_fwd, 3::BIGINT AS pkts_fwd, {MICROS} * 1000 / 1e9 AS first_ts, ({MICROS} + 250000) * 1000 / 1e9 AS last_ts, true AS syn_seen, ok AS synack_seen
FROM flows f JOIN events ON event_id = f.seq""")
def json_flows(spark, sf):
    line = F.to_json(F.struct(
        F.col("src_ip").alias("SrcAddr"), F.col("dst_ip").alias("DstAddr"), F.col("src_port").alias("SrcPort"), F.col("dst_port").alias("DstPort"), F.col("proto").alias("Proto"), F.col("bytes_fwd").alias("Bytes"), F.lit(3).alias("Packets"),
        F.when(F.col("synack_seen"), 18).otherwise(2).alias("TcpFlags"), (micros() * 1000).alias("TimeFlowStartNs"), ((micros() + 250_000) * 1000).alias("TimeFlowEndNs"),
    ))
    got = flows_from_json(flows(spark, sf).select("seq", line.alias("value")), seq=F.col("seq"))
    return got.select("seq", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "bytes_fwd", "pkts_fwd", "first_ts", "last_ts", "syn_seen", "synack_seen")


@query("netflow_records", f"""WITH {FLOWS_SQL} SELECT f.seq, src_ip, dst_ip, 40000 AS src_port, port AS dst_port, 6 AS proto, bytes_fwd, 3::BIGINT AS pkts_fwd, round({MICROS} / 1e6 - 1.0, 6)::DOUBLE AS first_ts, round({MICROS} / 1e6 - 0.5, 6)::DOUBLE AS last_ts, ok AS synack_seen
FROM flows f JOIN events ON event_id = f.seq""")
def netflow_records(spark, sf):
    head = [number(F.lit(5), 2), number(F.lit(1), 2), number(F.lit(10_000), 4), number(F.floor(micros() / 1_000_000), 4), number(micros() % 1_000_000 * 1000, 4), "00" * 8]
    record = [ip("src_ip"), ip("dst_ip"), "00" * 8, number(F.lit(3), 4), number(F.col("bytes_fwd"), 4), number(F.lit(9_000), 4), number(F.lit(9_500), 4), number(F.col("src_port"), 2), number(F.col("dst_port"), 2), "00", F.when(F.col("synack_seen"), "12").otherwise("02"), "06", "00" * 9]
    got = decode_netflow(addressed(spark, sf).select("seq", wire(*head, *record).alias("datagram")))
    times = [F.round(c, 6).alias(c) for c in ("first_ts", "last_ts")]
    return got.select(F.expr("seq div 64").alias("seq"), host_name(F.col("src_ip")).alias("src_ip"), "dst_ip", "src_port", "dst_port", "proto", "bytes_fwd", "pkts_fwd", *times, "synack_seen")


@query("captured_packets", f"""WITH {FLOWS_SQL} SELECT f.seq::VARCHAR AS file, 0::BIGINT AS n, {MICROS} / 1e6 AS ts, src_ip, dst_ip, 40000 AS src_port, port AS dst_port, 6 AS proto, 44 AS ip_len, 61 AS ttl, CASE WHEN ok THEN 18 ELSE 2 END AS tcp_flags, 'wxyz' AS payload
FROM flows f JOIN events ON event_id = f.seq""")
def captured_packets(spark, sf):
    frame = ["02" * 12, "0800", "4500002c", "00000000", "3d060000", ip("src_ip"), ip("dst_ip"), number(F.col("src_port"), 2), number(F.col("dst_port"), 2), "00" * 8, "50", F.when(F.col("synack_seen"), "12").otherwise("02"), "0000" * 3, "7778797a"]
    file = ["a1b2c3d4", "00020004", "00" * 8, "0000ffff", "00000001", number(F.floor(micros() / 1_000_000), 4), number(micros() % 1_000_000, 4), number(F.lit(58), 4), number(F.lit(58), 4)]
    got = decode_captures(addressed(spark, sf).select(F.col("seq").cast("string").alias("path"), wire(*file, *frame).alias("content")))
    return got.withColumns({"src_ip": host_name(F.col("src_ip")), "payload": F.col("payload").cast("string")})


@query("dns_messages", f"WITH {HOSTS_SQL} SELECT host, host AS query, 16 AS qtype, length(host) % 2 = 0 AS is_response, CASE WHEN length(host) % 2 = 0 THEN 3 END::INTEGER AS rcode FROM hosts")
def dns_messages(spark, sf):
    answer = F.length("host") % 2 == 0
    labels = F.array_join(F.transform(F.split("host", r"\."), lambda x: F.concat(number(F.length(x), 1), F.lower(F.hex(x.cast("binary"))))), "")
    payload = wire("0001", F.when(answer, "8183").otherwise("0100"), "0001", "00" * 6, labels, "00", "0010", "0001")
    rows = hosts(spark, sf).select("host", parse_dns(payload).alias("m"))
    return rows.select("host", "m.query", "m.qtype", "m.is_response", F.when(F.col("m.is_response"), F.col("m.rcode")).alias("rcode"))
