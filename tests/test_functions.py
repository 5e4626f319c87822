import hashlib
import math

import pytest
from pyspark.sql import functions as F

from vigil.functions import lexical, net, stats, tls
from vigil.functions.scoring import Signal, combine, severity, severity_score, strength
from vigil.params import Trw


def one(spark, *cols):
    row = spark.range(1).select(*cols).first()
    return row[0] if len(row) == 1 else tuple(row)


def doubles(*v):
    return F.array(*[F.lit(float(x)) for x in v]) if v else F.array().cast("array<double>")


def test_entropy_and_variation(spark):
    assert one(spark, stats.entropy(doubles())) == 0
    assert one(spark, stats.entropy(doubles(5))) == 0
    assert one(spark, stats.entropy(doubles(1, 1))) == 1
    assert one(spark, stats.entropy(F.transform(F.sequence(F.lit(1), F.lit(1024)), lambda x: F.lit(1.0)))) == pytest.approx(10)
    assert one(spark, stats.string_entropy(F.lit("google"))) == pytest.approx(1.9183, abs=1e-4)
    v = doubles(60, 60, 60, 60)
    assert one(spark, stats.cv(stats.array_std(v), stats.array_mean(v))) == 0
    assert one(spark, stats.cv(F.lit(0.0), F.lit(0.0))) == math.inf
    assert [one(spark, stats.pcr(F.lit(a), F.lit(b))) for a, b in ((100, 0), (0, 100), (50, 50), (0, 0))] == [1, -1, 0, 0]


def test_random_walk(spark):
    fails, wins = F.array(*[F.lit(False)] * 5), F.array(*[F.lit(True)] * 20)
    assert one(spark, stats.trw(fails)) >= Trw().upper
    assert one(spark, stats.trw(wins)) < Trw().upper


def test_folds(spark):
    up = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda x: x.cast("double"))
    assert one(spark, stats.doubling(up, 20)) == [20, 40, 80]
    assert one(spark, stats.doubling(doubles(30, 50, 60, 200), 20)) == [30, 60, 200]
    assert one(spark, stats.anchors(doubles(0, 30, 61, 100, 130), 60)) == [0, 61, 130]
    e = one(spark, stats.ewma(doubles(10, 20)))
    assert (e["n"], e["mean"], e["var"]) == (2, 11.0, pytest.approx(9.0))
    assert one(spark, stats.nearest_rank(doubles(*range(1, 101)), 0.95)) == 96


def test_scoring_goldens(spark):
    def conf(*signals):
        return one(spark, combine([Signal(f"s{i}", F.lit(float(v)), t, w, h) for i, (v, t, w, h) in enumerate(signals)])[0])

    assert conf((1, 0.5, 0.5, True), (1, 0.5, 0.2, True)) == pytest.approx(0.98201, abs=1e-4)
    assert conf((0, 0.5, 0.5, True), (1, 0.5, 0.2, True), (0, 1, 0.3, False)) == pytest.approx(0.50540, abs=1e-4)
    assert conf((0, 0.2, 0.45, False), (0, 0.5, 0.25, False), (6, 6, 0.2, True), (1, 3, 0.1, False)) == pytest.approx(0.89997, abs=1e-4)
    assert conf((20, 20, 0.35, True), (1, 0.5, 0.35, True), (0.8, 0.6, 0.3, True)) == pytest.approx(0.75612, abs=1e-4)
    assert one(spark, strength(F.lit(math.inf), 1.0)) == 1
    assert one(spark, strength(F.lit(math.inf), 1.0, False)) == 0
    for c, k, a, want in ((0.9, "ddos", 3, (81, "critical")), (0.9, "recon_scan", 1, (44, "medium")), (0.5, "recon_scan", 3, (32, "low"))):
        s = severity_score(F.lit(c), F.lit(k), F.lit(a))
        assert one(spark, s, severity(s)) == want


def test_names(spark):
    def parts(name):
        s = lexical.split_name(F.lit(name))
        return one(spark, s["registered"], s["label"], s["subdomain"])

    assert parts("a.b.Example.co.in.") == ("example.co.in", "example", "a.b")
    assert parts("www.example.com") == ("example.com", "example", "www")
    assert parts("co.uk") == ("co.uk", "co", "")
    assert parts("localhost") == ("localhost", "localhost", "")
    score = lambda x: one(spark, lexical.dga_score(F.lit(x)))
    assert score("cloud") == 0
    assert score("kj3xq9zvm2lppqr7wd") > 0.8 > 0.6 > score("information")
    assert one(spark, lexical.rare_pairs(F.lit("1234"))) == 1
    assert one(spark, lexical.rare_pairs(F.lit("a"))) == 0


def test_addresses(spark):
    inside = lambda ip, nets=("10.0.0.0/8", "fd00::/8"): one(spark, net.in_networks(F.lit(ip), nets))
    assert inside("10.2.3.4") and inside("fd00::1")
    assert not inside("11.0.0.1") and not inside("nonsense") and not inside("300.1.1.1") and not inside("2001:db8::1")

    def cid(a, b, sp, dp, proto):
        return one(spark, net.community_id(F.lit(a), F.lit(b), F.lit(sp), F.lit(dp), F.lit(proto), v6=True))

    assert cid("128.232.110.120", "66.35.250.204", 34855, 80, 6) == "1:LQU9qZlK+B5F3KDmev6m5PMibrg="
    assert cid("66.35.250.204", "128.232.110.120", 80, 34855, 6) == "1:LQU9qZlK+B5F3KDmev6m5PMibrg="
    assert cid("fe80::1", "fe80::2", 1, 2, 17) == cid("fe80::2", "fe80::1", 2, 1, 17)


def test_fingerprints(spark):
    ints = lambda *v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<int>")
    assert one(spark, tls.plain(ints(0x0A0A, 0x1301, 0xFAFA, 0x0A1A))) == [0x1301, 0x0A1A]
    want = hashlib.md5(b"771,4865-49195,0-16,29,0").hexdigest()
    assert one(spark, tls.ja3(F.lit(771), ints(0x0A0A, 4865, 49195), ints(0, 16), ints(29), ints(0))) == want
    got = one(spark, tls.ja4(F.lit(771), ints(4865, 49195), ints(0, 16, 43), ints(1027), ints(0x0304), F.lit("a.com"), F.array(F.lit("h2"))))
    a = hashlib.sha256(b"1301,c02b").hexdigest()[:12]
    b = hashlib.sha256(b"002b_0403").hexdigest()[:12]
    assert got == f"t13d0203h2_{a}_{b}"
