"""Floods: rate, source entropy, unfinished handshakes and amplification of each target in short windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.net import probable_reply
from vigil.functions.scoring import Signal, combine, evidence, strength
from vigil.functions.stats import zscore
from vigil.lineage import cut
from vigil.operators.base import detections, together, tumbling
from vigil.params import AMPLIFIERS, TCP, Ddos


def touched(flows: DataFrame, p: Ddos = Ddos()) -> DataFrame:
    """A row for each target that a flow touches: as the end of amplified traffic, and of a new flow."""
    reply = probable_reply(F.col("mode"), F.col("src_port"), F.col("dst_port"))
    kept = ["seq", "src_ip", "dst_port", "proto", "flow_id", "first_ts", "last_ts", "syn_seen", "synack_seen", "min_ttl", "max_ttl"]

    def branch(rows: DataFrame, nth: int, target: str, into: str, out: str) -> DataFrame:
        parts = [F.col(target).alias("target"), F.col(into).alias("into"), F.col(out).alias("out"), F.lit(nth == 2).alias("new"), F.lit(nth).alias("_nth")]
        return rows.select(*kept, *parts, tumbling(F.col("last_ts"), p.window_s).alias("win"))

    return together([
        branch(flows.filter(F.col("src_port").isin(*AMPLIFIERS)), 0, "dst_ip", "bytes_fwd", "bytes_bwd"),
        branch(flows.filter(F.col("dst_port").isin(*AMPLIFIERS)), 1, "src_ip", "bytes_bwd", "bytes_fwd"),
        branch(flows.filter((F.col("export_index") == 0) & ~reply), 2, "dst_ip", "bytes_fwd", "bytes_bwd"),
    ])


def ddos_windows(flows: DataFrame, p: Ddos = Ddos()) -> DataFrame:
    """Counts of each (target, window). Sources are counted first, so a target that everybody floods is summed in parallel.

    All sums are numbers, which keeps the aggregation hashed; what the first flow looked like is fetched for floods only.
    """
    rows = touched(flows, p)
    new, tcp = F.col("new"), F.col("proto") == TCP
    by_source = rows.groupBy("target", "win", F.when(new, F.col("src_ip")).alias("source")).agg(
        F.count_if(new).alias("n"),
        F.count_if(new & tcp).alias("tcp"),
        F.count_if(new & tcp & F.col("syn_seen") & ~F.col("synack_seen")).alias("syn"),
        F.sum(F.when(~new, F.col("into"))).alias("into"),
        F.sum(F.when(~new, F.col("out"))).alias("out"),
        F.min(F.when(new & (F.col("min_ttl") > 0), F.col("min_ttl"))).alias("low"),
        F.max(F.when(new & (F.col("min_ttl") > 0), F.col("max_ttl"))).alias("high"),
        F.min("seq").alias("at"),
        F.max("last_ts").alias("last"),
    )
    total = F.sum("n")
    spread = F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2("n")))
    return by_source.groupBy("target", "win").agg(
        total.alias("new_flows"),
        F.count("source").alias("sources"),
        F.when(total > 0, F.greatest(F.log2(total) - F.coalesce(spread, F.lit(0.0)) / total, F.lit(0.0))).otherwise(0.0).alias("entropy"),
        F.sum("tcp").alias("tcp_new"),
        F.sum("syn").alias("syn_only"),
        F.coalesce(F.sum("into"), F.lit(0)).alias("amp_in"),
        F.coalesce(F.sum("out"), F.lit(0)).alias("amp_out"),
        F.greatest(F.coalesce(F.max("high") - F.min("low"), F.lit(0)), F.lit(0)).alias("ttl_spread"),
        F.min("at").alias("at"),
        F.max("last").alias("last_ts"),
    )


def ddos(flows: DataFrame, p: Ddos = Ddos()) -> DataFrame:
    """Detections of flooded windows; the baseline of a target learns from its quiet and suppressed windows only."""
    w = cut(ddos_windows(flows, p))  # small beside the flows, and read several times
    w = w.withColumn("rate", F.col("new_flows") / p.window_s).withColumn("amp_rate", F.col("amp_in") / p.window_s)
    w = w.withColumn("by_bytes", F.col("amp_rate") >= p.amp_bytes_per_s).withColumn("flood", (F.col("rate") >= p.flows_per_s) | F.col("by_bytes"))
    w = w.withColumn("syn_ratio", F.when(F.col("tcp_new") > 0, F.col("syn_only") / F.col("tcp_new")).otherwise(0.0))
    w = w.withColumn("amp_ratio", F.col("amp_in") / F.greatest("amp_out", F.lit(1)))
    flooded = w.filter("flood").select("target").distinct()

    def step(a, x):
        z = F.coalesce(zscore(x["rate"], a["base"], p.baseline), p.rate_z * x["rate"] / p.flows_per_s)
        main = F.when(x["by_bytes"], strength(x["amp_rate"], p.amp_bytes_per_s)).otherwise(strength(F.greatest(z, F.lit(0.0)), p.rate_z))
        other = p.w_entropy * strength(x["entropy"], p.entropy_bits)
        syn = F.when(x["tcp_new"] > 0, p.w_syn * strength(x["syn_ratio"], p.syn_only)).otherwise(0.0)
        amp = F.when(x["by_bytes"], p.w_amp * strength(x["amp_ratio"], p.amp_ratio)).otherwise(0.0)
        weight = p.w_rate + p.w_entropy + F.when(x["tcp_new"] > 0, p.w_syn).otherwise(0.0) + F.when(x["by_bytes"], p.w_amp).otherwise(0.0)
        hit = x["flood"] & (F.round((p.w_rate * main + other + syn + amp) / weight, 4) >= p.min_confidence)
        d = x["rate"] - a["base"]["mean"]
        first = a["base"]["n"] == 0
        learned = F.struct(
            (a["base"]["n"] + 1).alias("n"),
            F.when(first, x["rate"]).otherwise(a["base"]["mean"] + p.baseline.alpha * d).alias("mean"),
            F.when(first, 0.0).otherwise((1 - p.baseline.alpha) * (a["base"]["var"] + d * d * p.baseline.alpha)).alias("var"),
        )
        return F.struct(
            F.when(hit, a["base"]).otherwise(learned).alias("base"),
            F.when(hit, F.concat(a["hits"], F.array(F.struct(x["win"].alias("win"), z.alias("z"), a["base"].alias("base"))))).otherwise(a["hits"]).alias("hits"),
        )

    start = F.expr("named_struct('base', named_struct('n', 0, 'mean', 0D, 'var', 0D), 'hits', cast(array() as array<struct<win:double,z:double,base:struct<n:int,mean:double,var:double>>>))")
    needed = F.struct("win", "rate", "amp_rate", "by_bytes", "flood", "entropy", "tcp_new", "syn_ratio", "amp_ratio")
    series = w.join(flooded, "target", "left_semi").groupBy("target").agg(F.sort_array(F.collect_list(needed)).alias("s"))
    hits = series.select("target", F.inline(F.aggregate("s", start, step, lambda a: a["hits"])))
    found = cut(w.join(hits, ["target", "win"]))
    first = touched(flows, p).join(found.select("target", "win", "at"), ["target", "win"]).filter("seq = at")
    first = first.groupBy("target", "win").agg(F.min_by(F.struct("dst_port", "proto", "flow_id", "first_ts"), "_nth").alias("opened"))
    found = found.join(first, ["target", "win"])
    rated = F.when(F.col("by_bytes"), F.col("amp_rate") / p.amp_bytes_per_s * p.rate_z).otherwise(F.greatest("z", F.lit(0.0)))
    confidence, factors = combine([
        Signal("flow_rate_z", rated, p.rate_z, p.w_rate),
        Signal("src_ip_entropy", F.col("entropy"), p.entropy_bits, p.w_entropy),
        Signal("syn_only_ratio", F.col("syn_ratio"), p.syn_only, p.w_syn, present=F.col("tcp_new") > 0),
        Signal("amp_ratio", F.col("amp_ratio"), p.amp_ratio, p.w_amp, present=F.col("by_bytes")),
    ])
    amplified = F.col("by_bytes") & (F.col("amp_ratio") >= p.amp_ratio)
    half_open = (F.col("tcp_new") > 0) & (F.col("syn_ratio") >= p.syn_only)
    kind = F.when(amplified, "UDP reflection / amplification").when(half_open & (F.col("entropy") >= p.entropy_bits), "Spoofed SYN flood").when(half_open, "SYN flood").otherwise("Volumetric flood")
    mbps = F.col("amp_rate") * 8 / 1e6
    base = F.when(F.col("base.n") >= p.baseline.ready, F.format_string("baseline %.1f/s", "base.mean")).otherwise("no baseline yet")
    words = F.when(
        F.col("by_bytes"), F.format_string("%s: %s gets %,.1f Mbit/s of answers that it did not ask for, from %,d servers, %,.0f bytes for each one it sent.", kind, "target", mbps, "sources", "amp_ratio")
    ).otherwise(F.format_string("%s: %s sees %,.0f new flows a second from %,d addresses (%.1f bits of entropy); %.0f%% of the TCP ones stay half open.", kind, "target", "rate", "sources", "entropy", F.col("syn_ratio") * 100))
    return detections(
        found, threat_class="ddos", sub_type=kind, entity=F.col("target"), host=F.col("target"), src=F.concat(F.col("sources").cast("string"), F.lit(" sources")), dst=F.col("target"),
        dst_port=F.col("opened.dst_port").cast("string"), proto=F.when(F.col("tcp_new") > 0, "TCP").otherwise("UDP"), flow_id=F.col("opened.flow_id"), event_start=F.col("opened.first_ts"), event_end=F.col("last_ts"),
        confidence=confidence, factors=factors, summary=words, action=F.format_string("Have the provider filter or slow down what goes to %s.", "target"),
        mitre=[F.when(amplified, "T1498.002").otherwise("T1498.001")], model="ddos-stat", model_version="1.0", asset_ip=F.col("target"),
        evidence=evidence({
            "new_flows_per_s": (F.col("rate"), base), "unique_sources": (F.col("sources"), None), "src_ip_entropy_bits": (F.col("entropy"), f"alert at {p.entropy_bits}"),
            "syn_only_ratio": (F.col("syn_ratio"), f"alert at {p.syn_only}"), "amplification_ratio": (F.col("amp_ratio"), f"alert at {p.amp_ratio}x"), "unsolicited_mbps": (mbps, None), "ttl_spread": (F.col("ttl_spread"), None),
        }),
    )
