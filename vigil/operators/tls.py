"""TLS clients: blocklisted or rare fingerprints and missing server names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.scoring import Signal, combine, evidence
from vigil.operators.base import detections, first_values
from vigil.params import Tls


#: Characters of a list's tokens up to which it is broadcast.
SMALL_LIST = 8 << 20


def _on_list(rows: DataFrame, column: str, tokens: set[str]) -> DataFrame:
    """rows with the column on_<column>: whether its value is one of the tokens. Long lists are joined by shuffling."""
    name = f"on_{column}"
    if not tokens:
        return rows.withColumn(name, F.lit(False))
    table = rows.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "_token string")
    table = F.broadcast(table) if sum(map(len, tokens)) <= SMALL_LIST else table
    return rows.join(table, F.col(column) == F.col("_token"), "left").withColumn(name, F.col("_token").isNotNull()).drop("_token")


def tls_clients(tls: DataFrame, ja3_list: set[str] = frozenset(), ja4_list: set[str] = frozenset(), p: Tls = Tls(), source: str = "offline lists") -> DataFrame:
    """A detection for each blocklisted handshake, and for others whose confidence reaches the limit.

    The warm-up looks for the seq of the last handshake in it, a top-k, so no task numbers all rows.
    """
    warm = tls.orderBy("seq").limit(p.warmup).agg(F.count("*").alias("n"), F.max("seq").alias("last")).first()
    warmed = (F.col("seq") > warm["last"]) if warm["n"] >= p.warmup else F.lit(False)
    prior = first_values(tls, "ja4", "client_ip", "seq", p.rare_hosts + 2, "users")
    rows = tls.join(prior, "ja4", "left").withColumn("prior", F.expr("size(filter(users, u -> u.first < seq AND u.value <> client_ip))"))
    rows = _on_list(_on_list(rows, "ja3", ja3_list), "ja4", ja4_list)
    named = F.length("sni") > 0
    rows = rows.withColumn("listed", F.col("on_ja3") | F.col("on_ja4")).withColumn("named", F.coalesce(named, F.lit(False))).withColumn("warmed", warmed)
    confidence, factors = combine([
        Signal("blocklist_match", F.col("listed").cast("int"), p.present, p.w_blocklist),
        Signal("sni_absent", (~F.col("named")).cast("int"), p.present, p.w_sni),
        Signal("fingerprint_rarity", F.col("prior"), p.rare_hosts, p.w_rarity, higher_is_worse=False, present=F.col("warmed")),
    ])
    rows = rows.withColumn("confidence", confidence).withColumn("factors", factors).filter(F.col("listed") | (F.col("confidence") >= p.min_confidence))
    rare = F.when(F.col("prior") == 0, "new here").otherwise(F.format_string("used by %d other hosts", "prior"))
    ip = F.col("client_ip")
    return detections(
        rows, threat_class="encrypted_malware", sub_type=F.when(F.col("listed"), "Known-bad TLS fingerprint").otherwise("Anomalous TLS client"), entity=F.concat(ip, F.lit(">"), F.col("ja4")), host=ip, src=ip, dst=F.col("server_ip"),
        dst_port=F.col("server_port").cast("string"), proto="TCP", flow_id=F.col("flow_id"), event_start=F.col("ts"), event_end=F.col("ts"), confidence=F.col("confidence"), factors=F.col("factors"),
        summary=F.concat(F.format_string("The TLS client of %s that called %s:%d has the fingerprint %s (", ip, "server_ip", "server_port", "ja4"), F.when(F.col("listed"), "a listed one").otherwise(rare), F.when(F.col("named"), "").otherwise("; it named no server"), F.lit("). Only the handshake was looked at.")),
        action=F.format_string("Take %s off the network, and look for other hosts with this fingerprint.", ip), mitre=["T1573.002", "T1071.001"], model="tls-meta", model_version="1.0", asset_ip=ip,
        evidence=evidence({"fingerprint_prevalence": (F.col("prior"), F.when(F.col("warmed"), rare).otherwise("warming up"))}, {
            "ja3": (F.col("ja3"), None), "ja4": (F.col("ja4"), None), "offline_blocklist_match": (F.when(F.col("listed"), "yes").otherwise("no"), source),
            "sni": (F.when(F.col("named"), F.col("sni")).otherwise("(absent)"), "most clients send one"), "tls_version": (F.col("version"), None), "alpn": (F.coalesce("alpn", F.lit("(none)")), None),
        }),
    )
