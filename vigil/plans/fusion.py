"""Detections to alerts: allowlist, merging, severity, campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.scoring import severity, severity_score
from vigil.lineage import cut
from vigil.operators.base import detections
from vigil.params import STAGES, Fusion
from vigil.plans.ordered import numbered_rows

ORDER = ["event_end", "event_start", "threat_class", "entity", "confidence", "sub_type", "flow_id"]


def allowed_out(found: DataFrame, allow: DataFrame | None) -> DataFrame:
    """Detections with neither end on the allowlist (a table with the column ip)."""
    if allow is None:
        return found
    ips = allow.select(F.col("ip").alias("_ip")).distinct()
    return found.join(ips, F.col("src") == F.col("_ip"), "left_anti").join(ips, F.col("dst") == F.col("_ip"), "left_anti")


def merged(found: DataFrame, p: Fusion = Fusion()) -> DataFrame:
    """One row for each run of detections of the same class and entity that lie within the merging time.

    The first gives the lasting fields; the best so far gives confidence, sub-type, evidence, factors and wording.
    """
    key = ["threat_class", "entity"]
    along = W.partitionBy(*key).orderBy(*[c for c in ORDER if c not in key])
    before = F.max("event_end").over(along.rowsBetween(W.unboundedPreceding, -1))
    rows = found.withColumn("_fresh", F.when(before.isNull() | (F.col("event_start") - before > p.dedup_s), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_fresh").over(along)).withColumn("_nth", F.row_number().over(along))
    # What replaces what only needs confidences: >= the held one, which is kept to three places.
    start = F.expr("named_struct('held', cast(null as double), 'nth', 0)")
    best = F.aggregate(
        F.sort_array(F.collect_list(F.struct(F.col("_nth").alias("n"), F.col("confidence").alias("c")))),
        start,
        lambda a, x: F.when(a["held"].isNull() | (x["c"] >= a["held"]), F.struct(F.round(x["c"], 3).alias("held"), x["n"].alias("nth"))).otherwise(a),
        lambda a: a["nth"],
    )
    island = [*key, "_island"]
    runs = rows.groupBy(*island).agg(F.count("*").alias("events_merged"), F.max("event_end").alias("_end"), F.min("_nth").alias("_first"), best.alias("_best"))
    changed = ["confidence", "sub_type", "evidence", "factors", "summary", "asset_ip", "related"]
    kept = [c for c in found.columns if c not in (*key, *changed, "event_end")]
    first = runs.join(rows.select(*island, F.col("_nth").alias("_first"), *kept, F.col("asset_ip").alias("first_asset"), F.col("event_end").alias("detected_at")), [*island, "_first"])
    out = first.join(rows.select(*island, F.col("_nth").alias("_best"), *changed), [*island, "_best"])
    return out.withColumnRenamed("_end", "event_end").drop("_first", "_best", "_island")


def updates(found: DataFrame, p: Fusion = Fusion()) -> DataFrame:
    """The records of an alert as its detections come: the first one in full (``alert``), then how it stands after each (``update``).

    kind, nth (from 1 within the alert), confidence, event_end and events_merged as they stand, flow_id of the detection.
    """
    key = ["threat_class", "entity"]
    along = W.partitionBy(*key).orderBy(*[c for c in ORDER if c not in key])
    before = F.max("event_end").over(along.rowsBetween(W.unboundedPreceding, -1))
    rows = found.withColumn("_fresh", F.when(before.isNull() | (F.col("event_start") - before > p.dedup_s), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_fresh").over(along)).withColumn("_nth", F.row_number().over(along))
    item = F.struct(F.col("_nth").alias("n"), F.col("confidence").alias("c"), F.col("event_end").alias("e"), F.col("flow_id").alias("f"))
    runs = rows.groupBy(*key, "_island").agg(F.min_by("event_start", "_nth").alias("event_start"), F.sort_array(F.collect_list(item)).alias("items"))
    start = F.expr("cast(array() as array<struct<confidence:double,event_end:double,flow_id:string>>)")

    def step(a, x):
        held, end = F.element_at(a, -1)["confidence"], F.element_at(a, -1)["event_end"]
        better = (F.size(a) == 0) | (x["c"] >= held)
        now = F.struct(F.when(better, F.round(x["c"], 3)).otherwise(held).alias("confidence"), F.greatest(x["e"], end).alias("event_end"), x["f"].alias("flow_id"))
        return F.concat(a, F.array(now))

    safe = lambda a, x: F.when(F.size(a) == 0, F.array(F.struct(F.round(x["c"], 3).alias("confidence"), x["e"].alias("event_end"), x["f"].alias("flow_id")))).otherwise(step(a, x))
    told = runs.select(*key, "event_start", F.posexplode(F.aggregate("items", start, safe)).alias("i", "r"))
    return told.select(F.when(F.col("i") == 0, "alert").otherwise("update").alias("kind"), *key, "event_start", (F.col("i") + 1).alias("nth"), "r.confidence", "r.event_end", (F.col("i") + 1).cast("long").alias("events_merged"), "r.flow_id")


def with_severity(alerts: DataFrame, assets: DataFrame | None, p: Fusion = Fusion()) -> DataFrame:
    """Alerts with their asset and severity; addresses that no asset has get the default criticality."""
    if assets is None:
        out = alerts.withColumns({"asset_name": F.lit(None).cast("string"), "asset_zone": F.lit(None).cast("string"), "criticality": F.lit(None).cast("int")})
    else:
        dim = assets.select(F.col("ip").alias("asset_ip"), F.col("name").alias("asset_name"), F.col("zone").alias("asset_zone"), "criticality").dropDuplicates(["asset_ip"])
        out = alerts.join(dim, "asset_ip", "left")
    score = severity_score(F.col("confidence"), F.col("threat_class"), F.coalesce("criticality", F.lit(p.criticality)), p)
    out = out.withColumn("severity_score", score).withColumn("severity", severity(F.col("severity_score"), p))
    asset = F.struct(F.col("asset_ip").alias("address"), F.coalesce("asset_name", F.lit("unregistered")).alias("name"), F.coalesce("asset_zone", F.lit("unknown")).alias("zone"), F.coalesce("criticality", F.lit(p.criticality)).alias("criticality"))
    return out.withColumn("asset", asset).withColumn("top_factors", F.slice("factors", 1, p.top_factors)).drop("asset_name", "asset_zone", "criticality")


def campaigns(alerts: DataFrame, p: Fusion = Fusion()) -> DataFrame:
    """Detections of hosts whose alerts show several stages within the correlation time.

    Each alert (in time order) refreshes its stage; one is reported when the recent stages outnumber those reported before.
    """
    names = [s for s, _ in STAGES]
    rank = F.array_position(F.array(*[F.lit(s) for s in names]), F.col("threat_class"))
    rows = alerts.filter(F.col("threat_class").isin(*names)).select("host", F.struct(F.col("detected_at").alias("t"), rank.alias("s"), F.col("alert_key").alias("id"), F.col("flow_id").alias("flow")).alias("e"))
    hosts = rows.groupBy("host").agg(F.sort_array(F.collect_list("e")).alias("es"), F.count_distinct("e.s").alias("kinds")).filter(F.col("kinds") >= p.min_stages)

    def step(a, e):
        others = F.filter(a["live"], lambda x: (x["s"] != e["s"]) & (e["t"] - x["t"] <= p.correlation_s))
        live = F.concat(others, F.array(e))
        n, told = F.size(live), F.least(a["told"], F.size(live))
        hit = (n >= p.min_stages) & (n > told)
        return F.struct(live.alias("live"), F.when(hit, n).otherwise(told).alias("told"), F.when(hit, F.concat(a["out"], F.array(F.struct(F.array_sort(live).alias("live"), e["t"].alias("t"), e["flow"].alias("flow"))))).otherwise(a["out"]).alias("out"))

    kind = "array<struct<t:double,s:bigint,id:string,flow:string>>"
    start = F.expr(f"named_struct('live', cast(array() as {kind}), 'told', 0, 'out', cast(array() as array<struct<live:{kind},t:double,flow:string>>))")
    hits = hosts.select("host", F.inline(F.aggregate("es", start, step, lambda a: a["out"])))
    labels = F.array(*[F.lit(x) for _, x in STAGES])
    chain = F.array_join(F.transform("live", lambda x: F.element_at(labels, x["s"].cast("int"))), " -> ")
    hits = hits.withColumn("chain", chain).withColumn("n", F.size("live")).withColumn("begin", F.col("live")[0]["t"])
    confidence = F.least(F.lit(p.max_confidence), p.confidence + p.stage_bonus * (F.col("n") - p.min_stages))
    hits = hits.withColumn("confidence", F.round(confidence, 4))
    number = lambda c: F.struct(c.cast("string").alias("observed"), c.cast("double").alias("observed_num"), F.lit(None).cast("string").alias("reference"))
    return detections(
        hits, threat_class="campaign", sub_type=F.concat(F.lit("Multi-stage activity: "), F.col("chain")), entity=F.col("host"), host=F.col("host"), src=F.col("host"), dst="multiple", dst_port="-", proto="mixed", flow_id=F.col("flow"),
        event_start=F.col("begin"), event_end=F.col("t"), confidence=F.col("confidence"), factors=F.array(F.struct(F.lit("linked_stages").alias("feature"), F.col("confidence").alias("contribution"))),
        evidence=F.create_map(F.lit("linked_stages"), number(F.col("n")), F.lit("stage_chain"), F.struct(F.col("chain").alias("observed"), F.lit(None).cast("double").alias("observed_num"), F.lit(None).cast("string").alias("reference")), F.lit("time_span_s"), number(F.round(F.col("t") - F.col("begin"), 1))),
        summary=F.format_string("On %s, %d stages of an attack follow each other: %s. They belong together.", "host", "n", "chain"), action=F.format_string("Handle the alerts of %s as one case, and cut it off before anything is cleaned.", "host"),
        mitre=["TA0011", "TA0010"], model="correlator", model_version="1.0", asset_ip=F.col("host"), related=F.transform("live", lambda x: x["id"]),
    )


def alert_key(df: DataFrame) -> Column:
    """What names an alert whatever else is in the table: its class, entity and start."""
    return F.substring(F.sha2(F.concat_ws("|", "threat_class", "entity", F.col("event_start").cast("string")), 256), 1, 16)


def fuse(found: DataFrame, assets: DataFrame | None = None, allow: DataFrame | None = None, p: Fusion = Fusion(), sensor: str = "sensor", mode: str = "pcap") -> DataFrame:
    """Alerts of detections and of the campaigns among them."""
    base = merged(cut(allowed_out(found, allow)), p)
    base = cut(base.withColumn("alert_key", alert_key(base)))
    more = merged(cut(allowed_out(campaigns(base, p), allow)), p)
    more = more.withColumn("alert_key", alert_key(more))
    out = with_severity(base.unionByName(more), assets, p)
    return out.withColumns({"confidence": F.round("confidence", 3), "sensor_id": F.lit(sensor), "input_mode": F.lit(mode), "event_time": F.timestamp_micros(F.round(F.col("event_end") * 1e6).cast("long"))})


def numbered(alerts: DataFrame, sensor: str = "sensor", after: int = 0) -> DataFrame:
    """Alerts with running identifiers in order of detection, numbered by ranges."""
    out = numbered_rows(alerts, ["detected_at", "event_start", "threat_class", "entity"], "_nth")
    return out.withColumn("alert_id", F.format_string(f"{sensor}-%07d", F.col("_nth") + after)).drop("_nth")


def recent(alerts: DataFrame, limit: int = 100, severity_is: str | None = None, threat_class: str | None = None) -> DataFrame:
    """The latest alerts, newest first."""
    if severity_is:
        alerts = alerts.filter(F.col("severity") == severity_is)
    if threat_class:
        alerts = alerts.filter(F.col("threat_class") == threat_class)
    return alerts.orderBy(F.desc("event_end"), "alert_key").limit(max(1, min(limit, 1000)))


def by_key(alerts: DataFrame, key: str) -> DataFrame:
    return alerts.filter(F.col("alert_key") == key)


def metrics(alerts: DataFrame) -> DataFrame:
    """Counts by class and severity."""
    return alerts.groupBy("threat_class", "severity").agg(F.count("*").alias("alerts"), F.sum("events_merged").alias("events"))
