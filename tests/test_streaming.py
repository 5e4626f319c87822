from pyspark.sql import functions as F

from vigil.gen.scenarios import SCENARIOS
from vigil.operators.flowmeter import meter
from vigil.operators.scan import scans
from vigil.plans.ledger import verify_file
from vigil.schema import FLOWS
from vigil.streaming.runner import alert_stream, replay
from vigil.streaming.stateful import flood_windows, meter_stream, scan_stream

PACKETS = "ts double, src_ip string, dst_ip string, src_port int, dst_port int, proto int, ip_len int, ttl int, tcp_flags int, payload binary"


def collect(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_scan_stream_equals_batch(spark, tmp_path):
    flows = SCENARIOS["host_sweep"][0](spark)["flows"]
    flows.orderBy("seq").repartitionByRange(3, "seq").write.parquet(str(tmp_path / "in/flows"))
    rows = collect(scan_stream(replay(spark, str(tmp_path / "in"), "flows", FLOWS)), "scan_out", tmp_path)
    batch = scans(flows).select(F.col("evidence")["distinct_targets"]["observed_num"].cast("int")).collect()
    assert sorted(r.n for r in rows) == sorted(r[0] for r in batch)


def test_meter_stream(spark, tmp_path):
    t = 1_789_000_000.0
    rows = [(t + i, "10.0.0.1", "10.0.0.2", 1000, 80, 6, 60, 64, 2 if i == 0 else 16, bytearray()) for i in range(8)]
    rows += [(t + 200, "10.0.0.9", "10.0.0.2", 1, 80, 6, 60, 64, 2, bytearray())]
    rows += [(t + 400, "10.0.0.8", "10.0.0.2", 1, 80, 6, 60, 64, 2, bytearray())]
    for i, part in enumerate((rows[:8], rows[8:9], rows[9:])):
        spark.createDataFrame(part, PACKETS).coalesce(1).write.parquet(str(tmp_path / f"p/packets/batch{i}"))
    stream = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "p/packets"))
    got = collect(meter_stream(stream), "meter_out", tmp_path)
    want = meter(spark.createDataFrame(rows, PACKETS)).filter("src_ip = '10.0.0.1'").collect()
    key = lambda r: (r.export_index, r.pkts_fwd, r.is_final, r.first_ts, r.last_ts)
    assert sorted(key(r) for r in got if r.src_ip == "10.0.0.1") == sorted(key(r) for r in want)


def test_windows_and_ledger(spark, tmp_path):
    flows = SCENARIOS["syn_flood"][0](spark, 4000)["flows"]
    flows.repartitionByRange(2, "seq").write.parquet(str(tmp_path / "in/flows"))
    stream = replay(spark, str(tmp_path / "in"), "flows", FLOWS)
    rows = collect(flood_windows(stream, window_s=2, late="1 seconds"), "flood_out", tmp_path)
    assert rows and all(r.target == "10.10.0.5" for r in rows)
    ledger = str(tmp_path / "ledger.jsonl")
    q = alert_stream(replay(spark, str(tmp_path / "in"), "flows", FLOWS), "flows", ledger, str(tmp_path / "cp"), str(tmp_path / "history"))
    q.awaitTermination(240)
    assert q.exception() is None
    ok, n = verify_file(ledger)
    assert ok and n >= 1
