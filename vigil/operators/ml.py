"""Supervised detectors: whole flows and DNS queries under a fitted model."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.features import flow_features
from vigil.functions.lexical import query_features
from vigil.functions.net import in_networks, proto_name
from vigil.functions.scoring import evidence
from vigil.operators.base import detections
from vigil.params import DNS_PORT, INTERNAL_NETWORKS, Ml

#: Wording and technique by label.
FLOW_LABELS = {
    "ddos": ("Volumetric flood (ML)", "T1498", "Have the provider filter what goes to the target."),
    "recon_scan": ("Reconnaissance / scan (ML)", "T1046", "Find out whose machine scans, and let it reach only what it needs."),
    "c2_beacon": ("Botnet C2 (ML)", "T1071", "Cut the channel, and look for the program on the host that keeps it open."),
    "exfiltration": ("Data exfiltration (ML)", "T1041", "Stop the host's uploads, and find out which files went."),
}
DNS_LABELS = {"dga": ("Generated domain (ML)", "T1568.002"), "dns_tunnel": ("DNS tunnelling (ML)", "T1071.004")}


def by_label(label: Column, table: dict, i: int) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(label == k, v[i]).otherwise(out)
    return out


def whole_flows(flows: DataFrame) -> DataFrame:
    """Totals of each flow over its exports up to a final one; a flow id may come back after that."""
    along = W.partitionBy("flow_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = flows.withColumn("epoch", F.coalesce(F.sum(F.col("is_final").cast("int")).over(along), F.lit(0)))
    out = rows.groupBy("flow_id", "epoch").agg(
        F.min_by(F.struct("src_ip", "dst_ip", "dst_port", "proto"), "seq").alias("o"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        *[F.sum(c).alias(c) for c in ("bytes_fwd", "bytes_bwd", "pkts_fwd", "pkts_bwd")],
        F.bool_or("syn_seen").alias("syn"), F.bool_or("rst_seen").alias("rst"), F.bool_or("is_final").alias("done"),
    )
    return out.filter("done").select("flow_id", "o.*", "first_ts", "last_ts", "bytes_fwd", "bytes_bwd", "pkts_fwd", "pkts_bwd", "syn", "rst")


def with_flow_features(whole: DataFrame) -> DataFrame:
    span = F.greatest(F.col("last_ts") - F.col("first_ts"), F.lit(0.0))
    return whole.withColumns(flow_features(span, F.col("pkts_fwd"), F.col("pkts_bwd"), F.col("bytes_fwd"), F.col("bytes_bwd"), F.col("proto"), F.col("syn"), F.col("rst")))


def predicted(rows: DataFrame, model) -> DataFrame:
    """rows with label and p of a model from vigil.ml."""
    got = model.pipeline.transform(rows)
    p = F.array_max(vector_to_array("probability"))
    return got.withColumn("p", p).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("predicted_label", "label")


def _top(model) -> dict:
    """Evidence of the features that the model depends on most."""
    return {f"importance:{name}": (F.lit(value), "of the model's skill") for name, value in model.top_importances()}


def classify_flows(flows: DataFrame, model, networks: tuple[str, ...] = INTERNAL_NETWORKS, p: Ml = Ml()) -> DataFrame:
    rows = predicted(with_flow_features(whole_flows(flows)), model)
    rows = rows.filter((F.col("label") != p.benign) & (F.col("p") >= p.min_confidence) & F.col("label").isin(*FLOW_LABELS))
    host = F.when(F.col("label") == "ddos", F.col("dst_ip")).otherwise(F.col("src_ip"))
    rows = rows.withColumn("host", host)
    asset = F.when(in_networks(F.col("host"), networks), F.col("host")).when(in_networks(F.col("src_ip"), networks), F.col("src_ip")).otherwise(F.col("dst_ip"))
    return detections(
        rows, threat_class=F.col("label"), sub_type=by_label(F.col("label"), FLOW_LABELS, 0), entity=F.col("host"), host=F.col("host"), src=F.col("src_ip"), dst=F.col("dst_ip"), dst_port=F.col("dst_port").cast("string"), proto=proto_name(F.col("proto")), flow_id=F.col("flow_id"),
        event_start=F.col("first_ts"), event_end=F.col("last_ts"), confidence=F.round("p", 4), factors=F.array(F.struct(F.lit("model_probability").alias("feature"), F.round("p", 4).alias("contribution"))),
        summary=F.format_string("The model takes the flow from %s to %s:%d for %s with a chance of %.2f; it moved %,.0f bytes in %.1f s.", "src_ip", "dst_ip", "dst_port", "label", "p", "total_bytes", "duration_s"), action=by_label(F.col("label"), FLOW_LABELS, 2),
        mitre=[by_label(F.col("label"), FLOW_LABELS, 1)], model="ml-flow", model_version=model.version, asset_ip=asset,
        evidence=evidence({k: (F.col(k), None) for k in ("duration_s", "total_bytes", "bytes_per_s", "down_up_ratio", "fwd_bwd_pkt_ratio")} | _top(model), {"model_label": (F.col("label"), F.format_string("p=%.2f", "p"))}),
    )


def classify_queries(dns: DataFrame, model, p: Ml = Ml()) -> DataFrame:
    """Detections by query; equal (query, type) pairs are scored once."""
    kinds = dns.filter(~F.col("is_response")).select("query", F.col("qtype").alias("_qtype")).distinct()
    scored = predicted(kinds.select("query", "_qtype", *[c.alias(n) for n, c in query_features(F.col("query"), F.col("_qtype")).items()]), model)
    scored = scored.filter(F.col("label").isin(*DNS_LABELS) & (F.col("p") >= p.dga_min_confidence)).select("query", "_qtype", "label", "p")
    rows = dns.filter(~F.col("is_response")).join(scored, (dns["query"] == scored["query"]) & (dns["qtype"] == scored["_qtype"])).drop(scored["query"])
    ip = F.col("client_ip")
    return detections(
        rows, threat_class=F.col("label"), sub_type=by_label(F.col("label"), DNS_LABELS, 0), entity=ip, host=ip, src=ip, dst=F.col("resolver_ip"), dst_port=str(DNS_PORT), proto="UDP", flow_id=F.col("flow_id"), event_start=F.col("ts"), event_end=F.col("ts"),
        confidence=F.round("p", 4), factors=F.array(F.struct(F.lit("model_probability").alias("feature"), F.round("p", 4).alias("contribution"))), summary=F.format_string("The model takes the lookup of %s by %s for %s with a chance of %.2f.", "query", ip, "label", "p"),
        action=F.format_string("Look for malware on %s, and have the resolver refuse the name.", ip), mitre=[by_label(F.col("label"), DNS_LABELS, 1)], model="dga-ml", model_version=model.version, asset_ip=ip,
        evidence=evidence({"record_type": (F.col("qtype"), None)} | _top(model), {"query": (F.col("query"), None), "model_label": (F.col("label"), F.format_string("p=%.2f", "p"))}),
    )
