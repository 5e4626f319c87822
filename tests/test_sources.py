import json
import struct

import pytest

from vigil.operators.flowmeter import events
from vigil.operators.registry import Context, available
from vigil.sources import parsers
from vigil.sources.readers import Intel, Settings, check_upload, decode_captures, decode_netflow, flows_from_json, labelled_flows, write_manifest


def ipv4(src, dst, proto, body, ttl=64):
    addr = lambda s: bytes(map(int, s.split(".")))
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, ttl, proto, 0) + addr(src) + addr(dst) + body


def tcp(sp, dp, flags, payload=b""):
    return struct.pack(">HHIIBBHHH", sp, dp, 0, 0, 0x50, flags, 0, 0, 0) + payload


def udp(sp, dp, payload):
    return struct.pack(">HHHH", sp, dp, 8 + len(payload), 0) + payload


def pcap(packets):
    out = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for ts, ip in packets:
        frame = b"\0" * 12 + b"\x08\x00" + ip
        out += struct.pack("<IIII", int(ts), round(ts % 1 * 1e6), len(frame), len(frame)) + frame
    return out


def dns(name, qtype=1, flags=0):
    q = b"".join(bytes([len(p)]) + p.encode() for p in name.split(".")) + b"\0"
    return struct.pack(">HHHHHH", 1, flags, 1, 0, 0, 0) + q + struct.pack(">HH", qtype, 1)


def hello(sni="example.com"):
    ext = lambda k, b: struct.pack(">HH", k, len(b)) + b
    names = struct.pack(">HBH", len(sni) + 3, 0, len(sni)) + sni.encode()
    exts = ext(0x0A0A, b"") + ext(0, names) + ext(10, struct.pack(">HH", 2, 29)) + ext(11, b"\x01\0") + ext(16, b"\0\x03\x02h2") + ext(43, b"\x02\x03\x04")
    body = b"\x03\x03" + b"\0" * 32 + b"\0" + struct.pack(">HHH", 4, 0x1301, 0xC02B) + b"\x01\0" + struct.pack(">H", len(exts)) + exts
    return b"\x16\x03\x01" + struct.pack(">H", len(body) + 4) + b"\x01" + len(body).to_bytes(3, "big") + body


def test_dns_and_hello():
    got = parsers.dns_message(dns("Bad.Test", 16))
    assert (got["query"], got["qtype"], got["is_response"], got["rcode"]) == ("bad.test", 16, False, None)
    assert parsers.dns_message(dns("bad.test", 16, 0x8003))["rcode"] == 3
    got = parsers.client_hello(hello())
    assert (got["sni"], got["alpn"], got["groups"], got["supported_versions"]) == ("example.com", ["h2"], [29], [0x0304])
    for parse in (parsers.dns_message, parsers.client_hello, parsers.netflow_v5):
        with pytest.raises(parsers.ParseError):
            parse(b"\x16\x03garbage")


def capture():
    a, b, dnsd = "10.0.0.1", "198.51.100.7", "10.0.0.53"
    t = 1_789_000_000.0
    return pcap([
        (t, ipv4(a, b, 6, tcp(40000, 443, 2))), (t + 0.1, ipv4(b, a, 6, tcp(443, 40000, 0x12))), (t + 0.2, ipv4(a, b, 6, tcp(40000, 443, 0x18, hello()))),
        (t + 6, ipv4(a, b, 6, tcp(40000, 443, 0x18, b"data"))), (t + 1, ipv4(a, dnsd, 17, udp(5000, 53, dns("a.example.com")))), (t + 1.1, ipv4(dnsd, a, 17, udp(53, 5000, dns("a.example.com", 1, 0x8003)))),
        (t + 60, ipv4(a, b, 6, tcp(40000, 443, 2))), (t + 61, b"\x45"),
    ])


def test_capture_to_events(spark):
    files = spark.createDataFrame([("x.pcap", bytearray(capture()))], "path string, content binary")
    packets = decode_captures(files)
    assert packets.count() == 7
    ev = events(packets)
    flows = ev["flows"].orderBy("last_ts", "export_index").collect()
    tcp_flows = [f for f in flows if f.proto == 6]
    assert [(f.export_index, f.is_final, f.synack_seen) for f in tcp_flows] == [(0, False, True), (1, True, True), (0, True, False)]
    assert tcp_flows[1].bytes_fwd == 0 and tcp_flows[0].pkts_fwd == 3 and tcp_flows[0].splt == [len(hello()), 4]
    t = ev["tls"].first()
    assert (t.sni, t.version, t.alpn, t.client_ip) == ("example.com", "13", "h2", "10.0.0.1") and t.ja4.startswith("t13d0205h2_")
    d = ev["dns"].orderBy("ts").collect()
    assert [(x.query, x.client_ip, x.is_response, x.rcode) for x in d] == [("a.example.com", "10.0.0.1", False, None), ("a.example.com", "10.0.0.1", True, 3)]


def test_pcapng(spark):
    frame = b"\0" * 12 + b"\x08\x00" + ipv4("1.2.3.4", "5.6.7.8", 17, udp(1, 2, b"x"))
    block = lambda kind, b: struct.pack("<II", kind, len(b) + 12) + b + struct.pack("<I", len(b) + 12)
    pad = frame + b"\0" * (-len(frame) % 4)
    data = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0)) + block(6, struct.pack("<IIIII", 0, 0, 2_000_000, len(frame), len(frame)) + pad)
    (ts, link, got), = parsers.frames(data)
    assert (ts, link, got) == (2.0, 1, frame)


def test_netflow(spark):
    rec = bytes([10, 0, 0, 1]) + bytes([10, 0, 0, 2]) + b"\0" * 8 + struct.pack(">IIIIHHBBBB", 3, 300, 1000, 3000, 5555, 80, 0, 0x12, 6, 0) + b"\0" * 8
    data = struct.pack(">HHIIIIBBH", 5, 1, 5000, 1_789_000_000, 0, 0, 0, 0, 0) + rec
    rows = decode_netflow(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"bad"))], "seq long, datagram binary")).collect()
    assert len(rows) == 1
    f = rows[0]
    assert (f.src_ip, f.dst_port, f.bytes_fwd, f.syn_seen, f.synack_seen, f.mode) == ("10.0.0.1", 80, 300, True, True, "flow")
    assert (f.first_ts, f.last_ts) == (1_789_000_000 - 4, 1_789_000_000 - 2)


def test_json_flows(spark):
    a = {"SrcAddr": "10.0.0.1", "DstAddr": "10.0.0.2", "SrcPort": 1, "DstPort": 2, "Proto": 6, "Bytes": 10, "Packets": 1, "TimeFlowStartNs": 1_000_000_000, "TimeFlowEndNs": 3_000_000_000, "TcpFlags": 18}
    b = {"src_addr": "10.0.0.1", "dst_addr": "10.0.0.2", "tcp_flags": 2, "proto": 6, "time_flow_start_ns": 5_000_000_000}
    lines = [json.dumps(a), json.dumps(b), json.dumps({"SrcAddr": "10.0.0.1"}), "not json", ""]
    rows = flows_from_json(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("first_ts").collect()
    assert [(r.first_ts, r.last_ts, r.syn_seen, r.synack_seen) for r in rows] == [(1.0, 3.0, True, True), (5.0, 5.0, True, False)]


def test_labelled_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text(" Flow Duration,Total Fwd Packets,Total Backward Packets,Total Length of Fwd Packets,Total Length of Bwd Packets,Protocol,SYN Flag Count,RST Flag Count, Label\n1000,1,2,3,4,6,1,0,BENIGN\n1,1,1,Infinity,1,6,0,0,BENIGN\n5,1,1,1,1,6,0,0,Other\n7,2,0,80,0,6,1,0,DDoS\n")
    rows = labelled_flows(spark.read.option("header", True).csv(str(p)), {"BENIGN": "benign", "DDoS": "ddos"}).orderBy("duration_us").collect()
    assert [(r.duration_us, r.label) for r in rows] == [(7.0, "ddos"), (1000.0, "benign")]


def test_intel_and_settings(spark, tmp_path):
    assert Intel.load(str(tmp_path)).ja3 == set()
    (tmp_path / "ja3_blocklist.txt").write_text("# list\nABC trojan\n\ndef # x\n")
    write_manifest(str(tmp_path))
    assert Intel.load(str(tmp_path)).ja3 == {"abc", "def"}
    (tmp_path / "ja3_blocklist.txt").write_text("other")
    with pytest.raises(ValueError):
        Intel.load(str(tmp_path))
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"assets": [{"ip": "10.0.0.1", "criticality": 9}]}))
    with pytest.raises(ValueError):
        Settings.load(str(c))
    with pytest.raises(ValueError):
        check_upload("x.exe", 1)
    ready, off = available({"flows"}, Context())
    assert "dns-dga" not in {d.name for d in ready} and {n for n, _ in off} >= {"dns-dga", "dns-tunnel", "tls-meta", "ml-flow", "dga-ml"}


def test_service(spark, tmp_path):
    from vigil.plans import service

    (tmp_path / "x.pcap").write_bytes(capture())
    alerts = service.analyse(spark, str(tmp_path / "x.pcap"))
    assert alerts.count() == 0 and service.alert_list(alerts).count() == 0 and service.alert_metrics(alerts).count() == 0
    assert '"alert_key"' in service.alert_schema(alerts)
    assert service.health({"flows"})["disabled"]["tls-meta"]
    got = service.latency(spark.range(1, 101), "id").first()
    assert (got.n, got.p50, got.p95) == (100, 50, 95)
    with pytest.raises(ValueError):
        service.analyse(spark, __file__)


def test_captures_are_written_in_order(spark):
    from vigil.sources.writers import captures

    rows = [(1_789_000_000.5 - i * 0.25, i, f"172.16.0.{i + 1}" if i % 3 else "2001:db8::7", "172.16.9.9" if i % 3 else "2001:db8::9", 1000 + i, 53 if i % 2 else 443, 17 if i % 2 else 6, 60, 0 if i % 2 else 2, bytearray(b"x" * i)) for i in range(12)]
    df = spark.createDataFrame(rows, "ts double, seq long, src_ip string, dst_ip string, src_port int, dst_port int, proto int, ttl int, tcp_flags int, payload binary").repartition(3)
    for n in (1, 3):
        files = captures(df, n).orderBy("part").collect()
        back = [r for f in files for r in sorted(decode_captures(spark.createDataFrame([("a", bytearray(f.content))], "path string, content binary")).collect(), key=lambda r: r.n)]
        assert sum(f.n for f in files) == 12
        assert [(r.ts, r.src_ip, r.dst_port, r.proto, bytes(r.payload)) for r in back] == [(r[0], r[2], r[5], r[6], bytes(r[9])) for r in reversed(rows)]
