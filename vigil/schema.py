"""Schemas of events, detections, alerts and the ledger."""

from __future__ import annotations

import json

from pyspark.sql import types as T

FLOWS = "seq long, flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, proto int, first_ts double, last_ts double, bytes_fwd long, bytes_bwd long, pkts_fwd long, pkts_bwd long, syn_seen boolean, synack_seen boolean, rst_seen boolean, export_index int, is_final boolean, min_ttl int, max_ttl int, splt array<int>, mode string"
DNS = "seq long, ts double, flow_id string, client_ip string, resolver_ip string, query string, qtype int, is_response boolean, rcode int, answer_bytes int"
TLS = "seq long, ts double, flow_id string, client_ip string, server_ip string, server_port int, version string, sni string, ja3 string, ja4 string, alpn string"
PACKETS = "ts double, src_ip string, dst_ip string, src_port int, dst_port int, proto int, ip_len int, ttl int, tcp_flags int, payload binary"
HELLO = "legacy_version int, ciphers array<int>, extensions array<int>, groups array<int>, point_formats array<int>, sig_algs array<int>, supported_versions array<int>, sni string, alpn array<string>"
EVIDENCE = "map<string,struct<observed:string,observed_num:double,reference:string>>"
FACTORS = "array<struct<feature:string,contribution:double>>"
DETECTIONS = f"threat_class string, sub_type string, entity string, host string, src string, dst string, dst_port string, proto string, flow_id string, event_start double, event_end double, confidence double, evidence {EVIDENCE}, factors {FACTORS}, summary string, action string, mitre array<string>, model string, model_version string, asset_ip string, related array<string>"
LEDGER = "seq long, kind string, prev string, hash string, record string"

_JSON_TYPES = {"string": "string", "double": "number", "float": "number", "long": "integer", "integer": "integer", "boolean": "boolean", "timestamp": "string"}


def json_schema(kind: T.DataType) -> dict:
    """JSON Schema of a Spark type, for consumers of alerts."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "required": [f.name for f in kind.fields if not f.nullable]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    return {"type": _JSON_TYPES.get(kind.typeName(), "string")}


def to_json_schema(kind: T.StructType) -> str:
    return json.dumps(json_schema(kind), sort_keys=True)
