"""The seventeen features of a flow, in the model's order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.params import TCP, UDP, Ml


def flow_features(duration: Column, fwd_pkts: Column, bwd_pkts: Column, fwd_bytes: Column, bwd_bytes: Column, proto: Column, syn: Column, rst: Column, p: Ml = Ml()) -> dict[str, Column]:
    d = lambda c: c.cast("double")
    one = lambda c: F.greatest(d(c), F.lit(1.0))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    span = F.greatest(d(duration), F.lit(p.epsilon_s))
    packets, volume = d(fwd_pkts) + d(bwd_pkts), d(fwd_bytes) + d(bwd_bytes)
    return {
        "duration_s": d(duration),
        "total_packets": packets,
        "total_bytes": volume,
        "fwd_packets": d(fwd_pkts),
        "bwd_packets": d(bwd_pkts),
        "fwd_bytes": d(fwd_bytes),
        "bwd_bytes": d(bwd_bytes),
        "bytes_per_s": volume / span,
        "packets_per_s": packets / span,
        "fwd_pkt_len_mean": d(fwd_bytes) / one(fwd_pkts),
        "bwd_pkt_len_mean": d(bwd_bytes) / one(bwd_pkts),
        "down_up_ratio": d(bwd_bytes) / one(fwd_bytes),
        "fwd_bwd_pkt_ratio": d(fwd_pkts) / one(bwd_pkts),
        "syn_flag": flag(syn),
        "rst_flag": flag(rst),
        "is_tcp": flag(proto == TCP),
        "is_udp": flag(proto == UDP),
    }
