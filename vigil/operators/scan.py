"""Scans: a threshold random walk over the first contacts of a source's session."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.net import probable_reply
from vigil.functions.scoring import Signal, combine, evidence
from vigil.lineage import cut
from vigil.operators.base import detections
from vigil.params import MODBUS_PORT, TCP, Scan


def contacts(flows: DataFrame, p: Scan = Scan(), min_failures: int = 0) -> DataFrame:
    """First contacts of each source's session: src, session, nth, target, ok, and the session's last time so far.

    A session ends when a flow starts more than the gap after the latest end so far. Sources with fewer
    unanswered flows than ``min_failures`` are left out before anything is ordered.
    """
    reply = probable_reply(F.col("mode"), F.col("src_port"), F.col("dst_port"))
    tcp = flows.filter((F.col("proto") == TCP) & (F.col("export_index") == 0) & ~reply)
    if min_failures:
        failing = tcp.groupBy("src_ip").agg(F.count_if(~F.col("synack_seen")).alias("n")).filter(F.col("n") >= min_failures)
        tcp = tcp.join(failing, "src_ip", "left_semi")
    along = W.partitionBy("src_ip").orderBy("seq")
    before = F.max("last_ts").over(along.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("first_ts") - before > p.gap_s), 1).otherwise(0)
    rows = tcp.select("src_ip", "dst_ip", "dst_port", "seq", "first_ts", "last_ts", "synack_seen", "flow_id", fresh.alias("fresh"))
    rows = rows.withColumn("session", F.sum("fresh").over(along))
    rows = rows.withColumn("so_far", F.max("last_ts").over(W.partitionBy("src_ip", "session").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))
    one = F.min_by(F.struct("synack_seen", "so_far", "flow_id", "first_ts"), "seq")
    firsts = rows.groupBy("src_ip", "session", "dst_ip", "dst_port").agg(F.min("seq").alias("seq"), one.alias("c"))
    nth = F.row_number().over(W.partitionBy("src_ip", "session").orderBy("seq"))
    return firsts.select("src_ip", "session", nth.alias("nth"), "seq", "dst_ip", "dst_port", F.col("c.synack_seen").alias("ok"), F.col("c.so_far").alias("so_far"), F.col("c.flow_id").alias("flow_id"), F.col("c.first_ts").alias("first_ts"))


def scans(flows: DataFrame, p: Scan = Scan()) -> DataFrame:
    """Detections as soon as a source is a scanner with enough targets, and at each doubling of them."""
    firsts = cut(contacts(flows, p, math.ceil(p.trw.upper / p.trw.on_failure)))  # no walk gets to its bound with fewer failures

    def step(a, ok):
        moved = a["score"] + F.when(ok, p.trw.on_success).otherwise(p.trw.on_failure)
        score, n = F.when(moved <= p.trw.lower, 0.0).otherwise(moved), a["n"] + 1
        failed = a["failed"] + F.when(ok, 0).otherwise(1)
        hit = (score >= p.trw.upper) & (n >= a["next"])
        fired = F.struct(n.alias("n"), score.alias("score"), failed.alias("failed"))
        return F.struct(score.alias("score"), n.alias("n"), failed.alias("failed"), F.when(hit, 2 * n).otherwise(a["next"]).alias("next"), F.when(hit, F.concat(a["fired"], F.array(fired))).otherwise(a["fired"]).alias("fired"))

    start = F.expr(f"named_struct('score', 0D, 'n', 0, 'failed', 0, 'next', {p.targets}, 'fired', cast(array() as array<struct<n:int,score:double,failed:int>>))")
    walk = firsts.groupBy("src_ip", "session").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("nth", "ok"))), lambda x: x["ok"]).alias("walk"),
        F.min_by(F.struct("flow_id", "first_ts"), "nth").alias("opened"),
    )
    fired = cut(walk.select("src_ip", "session", "opened", F.inline(F.aggregate("walk", start, step, lambda a: a["fired"]))))

    # Shape of the scan when it fired: each firing sees the contacts before it.
    seen = fired.join(firsts, ["src_ip", "session"]).filter("nth <= n")
    keys = ["src_ip", "session", "n"]
    hosts = seen.groupBy(*keys, "dst_ip").agg(F.count("*").alias("c"), F.min("nth").alias("f")).groupBy(*keys).agg(F.count("*").alias("hosts"), F.max_by("dst_ip", F.struct("c", -F.col("f"))).alias("top_host"))
    ports = seen.groupBy(*keys, "dst_port").agg(F.count("*").alias("c"), F.min("nth").alias("f")).groupBy(*keys).agg(F.count("*").alias("ports"), F.max_by("dst_port", F.struct("c", -F.col("f"))).alias("top_port"))
    ends = seen.filter("nth = n").select(*keys, "so_far")
    found = fired.join(hosts, keys).join(ports, keys).join(ends, keys).withColumn("ratio", F.col("failed") / F.col("n"))
    confidence, factors = combine([
        Signal("trw_score", F.col("score"), p.trw.upper, p.w_trw),
        Signal("distinct_targets", F.col("n"), p.targets, p.w_targets),
        Signal("failed_ratio", F.col("ratio"), p.failed, p.w_failed),
    ])
    found = found.withColumn("confidence", confidence).filter(F.col("confidence") >= p.min_confidence)
    vertical, sweep = F.col("ports") >= p.shape * F.col("hosts"), F.col("hosts") >= p.shape * F.col("ports")
    n_hosts, n_ports = F.format_string("%d hosts", "hosts"), F.format_string("%d ports", "ports")
    return detections(
        found, threat_class="recon_scan", sub_type=F.when(vertical, "Vertical port scan").when(sweep, "Horizontal host sweep").otherwise("Block scan"), entity=F.col("src_ip"), host=F.col("src_ip"), src=F.col("src_ip"),
        dst=F.when(vertical, F.col("top_host")).otherwise(n_hosts), dst_port=F.when(vertical, n_ports).when(sweep, F.col("top_port").cast("string")).otherwise(n_ports), proto="TCP", flow_id=F.col("opened.flow_id"),
        event_start=F.col("opened.first_ts"), event_end=F.col("so_far"), confidence=F.col("confidence"), factors=factors,
        summary=F.format_string("%s tried %,d targets on %d hosts and %d ports within %.0f s, and %.0f%% of them did not answer.", "src_ip", "n", "hosts", "ports", F.col("so_far") - F.col("opened.first_ts"), F.col("ratio") * 100),
        action=F.format_string("Find out whose machine %s is, and let it reach only what it needs.", "src_ip"),
        mitre=F.when(F.col("top_port") == MODBUS_PORT, F.array(F.lit("T1046"), F.lit("T0846"))).otherwise(F.array(F.lit("T1046"))), model="scan-trw", model_version="1.0", asset_ip=F.col("top_host"),
        evidence=evidence({
            "distinct_targets": (F.col("n"), f"alert at {p.targets}"), "distinct_hosts": (F.col("hosts"), None), "distinct_ports": (F.col("ports"), None), "failed_connection_ratio": (F.col("ratio"), f"alert at {p.failed}"),
            "trw_log_likelihood": (F.col("score"), f"alert at {p.trw.upper:.2f}"), "most_probed_port": (F.col("top_port"), None),
        }),
    )
