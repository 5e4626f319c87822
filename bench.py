"""Benchmark: headline queries over $BENCH_SF_DIR, and the detection plan in flows per second; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from vigil.catalog import QUERIES  # noqa: E402
from vigil.gen.scenarios import bench_flows  # noqa: E402
from vigil.operators.beacon import beacons  # noqa: E402
from vigil.operators.ddos import ddos  # noqa: E402
from vigil.operators.exfil import uploads  # noqa: E402
from vigil.operators.registry import detect  # noqa: E402
from vigil.operators.scan import scans  # noqa: E402
from vigil.plans.fusion import fuse  # noqa: E402
from vigil.streaming.runner import alert_stream, replay  # noqa: E402

HEADLINE = ["window_entropy", "scan_sessions", "ewma_zscore", "upload_top_dst", "running_prevalence", "dns_features", "community_id", "ja3_md5", "dedup_islands", "campaign_alerts", "nearest_rank_p95", "scan_alerts", "upload_alerts", "alerts_fused"]
FLOWS = int(os.environ.get("BENCH_FLOWS", "1000000"))
STREAM_FLOWS = int(os.environ.get("BENCH_STREAM_FLOWS", "100000"))


def seconds(run) -> float:
    t = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t, 3)


def batch_seconds(flows: DataFrame, parts: int = 4) -> list[float]:
    """Seconds that each micro-batch of a stream of flows takes from its files to the ledger, in order of length."""
    with tempfile.TemporaryDirectory() as folder:
        flows.repartitionByRange(parts, "seq").write.parquet(f"{folder}/in/flows")
        query = alert_stream(replay(flows.sparkSession, f"{folder}/in", "flows", flows.schema), "flows", f"{folder}/ledger.jsonl", f"{folder}/checkpoint", f"{folder}/history")
        query.awaitTermination(600)
        return sorted(round(p.durationMs["triggerExecution"] / 1000, 3) for p in query.recentProgress if p.numInputRows)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()  # compiles its code
        times[name] = seconds(lambda: QUERIES[name](spark, sf))

    # Throughput as the baseline measures it: records are made beforehand, all statistical flow detectors run and their
    # detections are fused to alerts with severity and campaigns, and results are thrown away.
    flows = bench_flows(spark, FLOWS).cache()
    n = flows.count()
    for name, find in {"flows_ddos": ddos, "flows_scan": scans, "flows_beacon": beacons, "flows_exfil": uploads}.items():
        times[name] = seconds(lambda: find(flows))
    times["flows_fused"] = seconds(lambda: fuse(detect({"flows": flows})))
    flows.unpersist(blocking=True)
    batches = batch_seconds(bench_flows(spark, STREAM_FLOWS))
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "flows_per_s": round(n / times["flows_fused"]), "flows_per_s_per_core": round(n / times["flows_fused"] / int(cpus)), "flows": n, "sf": sf, "stream_flows": STREAM_FLOWS, "stream_batch_s": batches,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
