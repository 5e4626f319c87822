"""Command line: synth, replay, flow-json, netflow, verify-log, intel-manifest, bench, schema."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from vigil.gen.scenarios import SCENARIOS, bench_flows, mixed
from vigil.operators.flowmeter import events
from vigil.operators.registry import Context, detect
from vigil.plans.fusion import fuse, metrics
from vigil.plans.ledger import Ledger, verify_file
from vigil.schema import to_json_schema
from vigil.sources.readers import Intel, Settings, read_json_flows, read_netflow, read_pcap, write_manifest


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="vigil")
    verbs = top.add_subparsers(dest="verb", required=True)
    for name, args in {
        "synth": ["out"], "replay": ["path", "ledger"], "flow-json": ["path", "ledger"], "netflow": ["path", "ledger"], "verify-log": ["path"], "intel-manifest": ["folder"], "bench": ["flows"], "schema": [],
    }.items():
        p = verbs.add_parser(name)
        for a in args:
            p.add_argument(a)
        if name in ("replay", "flow-json", "netflow"):
            p.add_argument("--config")
    a = top.parse_args(argv)
    if a.verb == "verify-log":
        ok, n = verify_file(a.path)
        print("intact" if ok else "broken", n)
        return 0 if ok else 1
    if a.verb == "intel-manifest":
        print(write_manifest(a.folder))
        return 0
    spark = session()
    if a.verb == "synth":
        for name in SCENARIOS:
            for kind, df in mixed(spark, [name]).items():
                df.write.mode("overwrite").parquet(f"{a.out}/{name}/{kind}")
    elif a.verb in ("replay", "flow-json", "netflow"):
        s = Settings.load(a.config) if a.config else Settings()
        context = Context(s.internal_networks, Intel.load(s.intel_dir) if s.intel_dir else None)
        read = {"replay": lambda: events(read_pcap(spark, a.path)), "flow-json": lambda: {"flows": read_json_flows(spark, a.path)}, "netflow": lambda: {"flows": read_netflow(spark, a.path)}}
        found = detect(read[a.verb](), context)
        alerts = fuse(found, s.asset_table(spark) if s.assets else None, s.allow_table(spark) if s.allowlist else None, sensor=s.sensor_id, mode="pcap" if a.verb == "replay" else "flow").cache()
        Ledger(a.ledger).write(alerts, ["event_end", "alert_key"])
        metrics(alerts).show()
    elif a.verb == "bench":
        flows = bench_flows(spark, int(a.flows)).cache()
        n = flows.count()
        t = time.time()
        detect({"flows": flows}).write.format("noop").mode("overwrite").save()
        print(json.dumps({"flows": n, "seconds": time.time() - t, "flows_per_s": n / (time.time() - t)}))
    elif a.verb == "schema":
        print(to_json_schema(fuse(detect(mixed(spark, ["benign"]))).schema))
    return 0


if __name__ == "__main__":
    sys.exit(main())
