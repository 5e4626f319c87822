"""What an analyst asks: health, metrics, alerts, one alert, the schema, and the analysis of one capture."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.flowmeter import events
from vigil.operators.registry import DETECTORS, Context, available, detect
from vigil.plans.fusion import by_key, fuse, metrics, recent
from vigil.schema import to_json_schema
from vigil.sources.readers import check_upload, read_pcap


def health(kinds: set[str], context: Context | None = None) -> dict:
    """Which detectors run, and why the others don't."""
    ready, off = available(kinds, context or Context())
    return {"status": "ok", "detectors": {d.name: d.purpose for d in ready}, "disabled": dict(off), "known": len(DETECTORS)}


def alert_list(alerts: DataFrame, limit: int = 100, severity: str | None = None, threat_class: str | None = None) -> DataFrame:
    return recent(alerts, limit, severity, threat_class)


def alert(alerts: DataFrame, key: str) -> DataFrame:
    return by_key(alerts, key)


def alert_metrics(alerts: DataFrame) -> DataFrame:
    return metrics(alerts)


def latency(samples: DataFrame, column: str) -> DataFrame:
    """Median and 95th percentile of a latency column, from a sketch of bounded size."""
    p50, p95 = (F.percentile_approx(column, q, 10_000).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95")))
    return samples.agg(F.count(column).alias("n"), p50, p95)


def smoothed_rates(events: DataFrame, ts: str = "ts", alpha: float = 0.2) -> DataFrame:
    """(second, events, rate) for every second from the first to the last: counts and their exponentially smoothed rate.

    The fold goes over one number a second, not over events.
    """
    counts = events.groupBy(F.floor(ts).alias("second")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("second").alias("lo"), F.max("second").alias("hi"))
    every = ends.filter("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("second"))
    whole = every.join(counts, "second", "left").select("second", F.coalesce("n", F.lit(0)).alias("n"))
    items = whole.agg(F.sort_array(F.collect_list(F.struct("second", "n"))).alias("s"))
    start = F.expr("cast(array() as array<struct<second:bigint,events:bigint,rate:double>>)")

    def step(a, x):
        last = F.when(F.size(a) == 0, x["n"].cast("double")).otherwise(F.try_element_at(a, F.lit(-1))["rate"])
        return F.concat(a, F.array(F.struct(x["second"].alias("second"), x["n"].alias("events"), (last + alpha * (x["n"] - last)).alias("rate"))))

    return items.select(F.inline(F.aggregate("s", start, step)))


def alert_schema(alerts: DataFrame) -> str:
    return to_json_schema(alerts.schema)


def analyse(spark: SparkSession, path: str, context: Context | None = None) -> DataFrame:
    """Alerts of one uploaded capture."""
    p = Path(path)
    check_upload(p.name, p.stat().st_size)
    return fuse(detect(events(read_pcap(spark, path)), context))
