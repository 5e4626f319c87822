import json

import pytest
from pyspark.sql import functions as F

from vigil.gen.scenarios import BAD_JA3, SCENARIOS, START, flows_of, labelled_flows, labelled_names
from vigil.ml import train as T
from vigil.operators.ddos import ddos
from vigil.operators.beacon import beacons
from vigil.operators.ml import classify_queries
from vigil.operators.registry import Context, detect
from vigil.operators.scan import scans
from vigil.plans.fusion import fuse, numbered, recent
from vigil.plans.ledger import Ledger, verify, verify_file
from vigil.sources.readers import Intel


@pytest.mark.parametrize("name", list(SCENARIOS))
def test_each_threat_alone(spark, name):
    make, want = SCENARIOS[name]
    got = detect(make(spark), Context(intel=Intel(ja3={BAD_JA3})))
    rows = got.collect()
    assert {r.threat_class for r in rows} == want
    assert all(r.evidence and r.factors and 0.5 <= r.confidence <= 1 for r in rows)


def seq(spark, rows):
    df = spark.createDataFrame(rows, "src string, dst string, sp int, dp int, ts double, ok boolean, back long")
    return flows_of(df, src_ip=F.col("src"), dst_ip=F.col("dst"), src_port=F.col("sp"), dst_port=F.col("dp"), first_ts=F.col("ts") + START, synack_seen=F.col("ok"), bytes_bwd=F.col("back"), seq=F.round(F.col("ts") * 1e6))


def test_quiet_sequences(spark):
    answered = [("172.16.3.7", f"172.16.9.{1 + i % 40}", 5000 + i, 25 + i % 4, 1.7 * i, True, 640) for i in range(120)]
    assert scans(seq(spark, answered)).count() == 0
    crowd = [("198.18.7.1", "172.16.1.80", 2000 + i, 8443, i / 900, True, 9000) for i in range(2700)]
    assert ddos(seq(spark, crowd)).count() == 0
    times = [0.0]
    for i in range(11):
        times.append(times[-1] + (4.0, 95.0, 17.0, 260.0)[i % 4])
    assert beacons(seq(spark, [("172.16.3.8", "198.18.7.2", 3000 + i, 443, t, True, 100 + 977 * (i % 5)) for i, t in enumerate(times)])).count() == 0
    assert beacons(seq(spark, [("172.16.3.8", "198.18.7.2", 3000 + i, 443, 41.0 * i, True, 700) for i in range(11)])).count() == 6


def test_order_of_partitions_does_not_matter(spark):
    flows = SCENARIOS["port_scan"][0](spark)["flows"]
    a = scans(flows).select("confidence", "summary").collect()
    b = scans(flows.repartition(7, "dst_port")).select("confidence", "summary").collect()
    assert sorted(a) == sorted(b)


def test_fusion_and_ledger(spark, tmp_path):
    events = {}
    for n in ("port_scan", "beacon", "generated", "exfiltration"):
        for k, v in SCENARIOS[n][0](spark).items():
            v = v.withColumn("src_ip", F.lit("10.30.2.41")) if n == "port_scan" else v
            events[k] = events[k].unionByName(v) if k in events else v
    assets = spark.createDataFrame([("10.30.2.41", "hmi", "ot", 5)], "ip string, name string, zone string, criticality int")
    found = detect(events)
    alerts = fuse(found, assets).cache()
    by = {r.threat_class: r for r in alerts.collect()}
    assert {"recon_scan", "c2_beacon", "dga", "exfiltration", "campaign"} <= set(by)
    assert by["recon_scan"].events_merged > 1 and by["campaign"].asset.criticality == 5 and len(by["campaign"].related) >= 2
    assert "reconnaissance" in by["campaign"].sub_type
    allow = spark.createDataFrame([("10.30.2.41",)], "ip string")
    assert fuse(found, assets, allow).filter("src = '10.30.2.41'").count() == 0
    assert recent(alerts, 2).count() == 2 and recent(alerts, 10, threat_class="dga").count() == 1
    assert numbered(alerts).filter("alert_id = 'sensor-0000001'").count() == 1

    path = str(tmp_path / "ledger.jsonl")
    book = Ledger(path)
    n = book.write(alerts.select("alert_key", "confidence"), ["alert_key"], batch=1)
    assert book.write(alerts.select("alert_key", "confidence"), ["alert_key"], batch=1) == 0
    assert verify_file(path) == (True, n) and Ledger(path).head == book.head and Ledger(path).height == n
    lines = open(path).read().splitlines()
    row = json.loads(lines[2])
    row["record"]["confidence"] = 0.1
    open(path, "w").write("\n".join([*lines[:2], json.dumps(row), *lines[3:]]) + "\n")
    assert verify_file(path) == (False, 2)


def test_a_batch_that_broke_off_goes_on(spark, tmp_path):
    path = str(tmp_path / "ledger.jsonl")
    rows = spark.range(25).selectExpr("id", "id * 2 AS v")

    class Broken(Ledger):
        def _lines(self, kind, records, batch):
            if self.height >= 20:
                raise OSError("no more")
            return super()._lines(kind, records, batch)

    with pytest.raises(OSError):
        Broken(path, chunk=10).write(rows, ["id"], batch=4)
    assert verify_file(path) == (True, 20)
    book = Ledger(path, chunk=10)
    assert book.height == 20 and book.write(rows, ["id"], batch=4) == 5 and book.write(rows, ["id"], batch=4) == 0
    assert verify_file(path) == (True, 25) and [json.loads(x)["record"]["id"] for x in open(path)] == list(range(25))
    assert Ledger(path).head == book.head and Ledger(path).batches == {4}


def test_orders_by_ranges(spark):
    from vigil.plans.ordered import nearest_ranks, numbered_rows, value_at_rank, with_previous

    df = spark.range(500).selectExpr("pmod(id * 37, 1009) AS x", "id % 3 AS k").repartition(5)
    values = sorted(r.x for r in df.collect())
    assert [r.n for r in numbered_rows(df, ["x"], "n").orderBy("x").collect()] == list(range(1, 501))
    assert [value_at_rank(df, "x", i) for i in (0, 1, 250, 500, 501)] == [None, values[0], values[249], values[-1], None]
    got = with_previous(df, ["x"], "x", "p", F.lit(-1)).orderBy("x").collect()
    assert [r.p for r in got] == [-1, *values[:-1]]
    for r in nearest_ranks(df, "k", "x", {"p50": 0.5, "p95": 0.95}, 10.0).collect():
        own = sorted(x.x for x in df.filter(F.col("k") == r.k).collect())
        assert (r.p50, r.p95) == (own[int(len(own) * 0.5)], own[int(len(own) * 0.95)])
    assert value_at_rank(df.limit(0), "x", 1) is None and numbered_rows(df.limit(0), ["x"], "n").count() == 0


def test_ledger_table(spark):
    from vigil.plans.ledger import GENESIS, link

    rows, prev = [], GENESIS
    for i in range(5):
        rows.append((i, prev, link(prev, f"r{i}"), f"r{i}"))
        prev = rows[-1][2]
    df = spark.createDataFrame(rows, "seq long, prev string, hash string, record string")
    assert verify(df).first().first_bad is None
    assert verify(df.withColumn("record", F.when(F.col("seq") == 3, "x").otherwise(F.col("record")))).first().first_bad == 3


def test_models(spark, tmp_path):
    rows = T.flow_rows(labelled_flows(spark, 120)).cache()
    a, b = T.split(rows)
    model = T.fit(a, T.FLOW_FEATURES, trees=10)
    assert T.macro_f1(model.pipeline.transform(b)) > 0.9
    t1, t2 = T.split(rows, how="temporal")
    assert t1.count() + t2.count() == rows.count() and t1.agg(F.max("seq")).first()[0] < t2.agg(F.min("seq")).first()[0]
    assert T.augmented(rows.filter("label = 'benign'"), rows.filter("label <> 'benign'"), 50).groupBy("label").count().filter("count < 50").count() == 0
    assert T.hybrid(rows, rows, 30, 20).count() == 30 + 4 * 20
    model.benign_means = T.benign_means(b, T.FLOW_FEATURES)
    own = [r.total_bytes for r in b.filter("label = 'benign'").collect()]
    assert model.benign_means["total_bytes"] == pytest.approx(sum(own) / len(own), abs=1e-4) and T.benign_means(b.limit(0), T.FLOW_FEATURES) == {}
    model.importances = {"duration_s": 0.1, "total_bytes": 0.5, "bytes_per_s": 0.2, "is_tcp": 0.0, "syn_flag": 0.05, "rst_flag": 0.15}
    T.save(model, str(tmp_path / "m"))
    assert [f for f, _ in T.load(str(tmp_path / "m")).top_importances()] == ["total_bytes", "bytes_per_s", "rst_flag", "duration_s", "syn_flag"]
    assert T.load(str(tmp_path / "none")) is None and T.load(str(tmp_path / "m")).labels == model.labels
    card = json.loads((tmp_path / "m/card.json").read_text())
    card["sha256"] = "0"
    (tmp_path / "m/card.json").write_text(json.dumps(card))
    with pytest.raises(ValueError):
        T.load(str(tmp_path / "m"))
    got = detect(SCENARIOS["exfiltration"][0](spark), Context(flow_model=model)).select("model", "threat_class", "evidence").collect()
    assert ("ml-flow", "exfiltration") in {(r.model, r.threat_class) for r in got}
    assert all(r.evidence["importance:total_bytes"].observed_num == 0.5 for r in got if r.model == "ml-flow")


def test_dns_model(spark):
    rows = T.dns_rows(labelled_names(spark, 120))
    a, b = T.split(rows)
    model = T.fit(a, T.DNS_FEATURES, trees=10)
    assert T.macro_f1(model.pipeline.transform(b)) > 0.9
    found = classify_queries(SCENARIOS["tunnel"][0](spark)["dns"], model).select("threat_class").distinct().collect()
    assert [r[0] for r in found] == ["dns_tunnel"]
