"""Registered queries of the engine over the driver's tables, each with the SQL that checks it.

The tables hold no network data, so one adapter reads ``events`` as flows, the host names of
``pages`` as lookups, and orders and customers as dimensions. Windows and thresholds are
parameters; they are wider here than the defaults, so that the queries have something to find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions import lexical, net, stats, tls
from vigil.functions.features import flow_features
from vigil.functions.scoring import Signal, combine, severity, severity_score
from vigil.gen.scenarios import mixed
from vigil.lineage import cut
from vigil.ml.train import report, split
from vigil.operators.base import anchored, doubled, first_values
from vigil.operators.ddos import ddos_windows
from vigil.operators.exfil import oriented, uploads
from vigil.operators.registry import Context, detect
from vigil.operators.scan import contacts, scans
from vigil.params import Baseline, Ddos, Exfil, Fusion, Scan
from vigil.plans.fusion import allowed_out, fuse, merged, recent
from vigil.plans.ledger import chain
from vigil.plans.ordered import nearest_ranks
from vigil.sources.readers import Intel, labelled_flows

DAY = 86_400.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The adapter, once more as SQL.
FLOWS_SQL = """flows AS (
  SELECT event_id AS seq, user_id, event_type, epoch_us(ts) / 1e6 AS t, floor(epoch_us(ts) / 1e6 / 86400) * 86400 AS day,
         '10.0.' || (user_id // 250) || '.' || (user_id % 250 + 1) AS src_ip,
         CASE event_type WHEN 'click' THEN '203.0.113.1' WHEN 'view' THEN '203.0.113.2' WHEN 'purchase' THEN '203.0.113.3'
              WHEN 'signup' THEN '198.51.100.4' ELSE '198.51.100.5' END AS dst_ip,
         json_extract_string(props, '$.k')::INTEGER AS port, floor(value * 100)::BIGINT AS bytes_fwd,
         event_type <> 'error' AS ok
  FROM events)"""
#: Least number of addresses and dictionary of the lexical queries.
HOSTS_SQL = "hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as flow records."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    target = F.when(F.col("event_type") == "click", "203.0.113.1").when(F.col("event_type") == "view", "203.0.113.2").when(F.col("event_type") == "purchase", "203.0.113.3").when(F.col("event_type") == "signup", "198.51.100.4").otherwise("198.51.100.5")
    ok = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("e"), F.col("event_id")).alias("flow_id"), F.concat(F.lit("10.0."), F.expr("user_id div 250"), F.lit("."), F.col("user_id") % 250 + 1).alias("src_ip"), target.alias("dst_ip"),
        F.lit(40_000).alias("src_port"), F.get_json_object("props", "$.k").cast("int").alias("dst_port"), F.lit(6).alias("proto"), t.alias("first_ts"), t.alias("last_ts"), F.floor(F.col("value") * 100).alias("bytes_fwd"), F.lit(0).cast("long").alias("bytes_bwd"),
        F.lit(1).cast("long").alias("pkts_fwd"), F.when(ok, 1).otherwise(0).cast("long").alias("pkts_bwd"), F.lit(True).alias("syn_seen"), ok.alias("synack_seen"), F.lit(False).alias("rst_seen"), F.lit(0).alias("export_index"), F.lit(True).alias("is_final"),
        F.lit(64).alias("min_ttl"), F.lit(64).alias("max_ttl"), F.array().cast("array<int>").alias("splt"), F.lit("pcap").alias("mode"), "user_id", "event_type", (F.floor(t / DAY) * DAY).alias("day"),
    )


def address(user: str) -> Column:
    """The IPv4 address of a user's host. FLOWS_SQL names it 10.0.N.M, and N passes 255 from user 64,000 on; what is above carries into the group before, as in the SQL of community_id."""
    held = F.expr(f"concat('10.', {user} div 64000, '.', {user} div 250 % 256, '.', {user} % 250 + 1)")
    return F.when(F.col(user) >= 16_384_000, F.raise_error(F.lit("10.0.0.0/8 holds 16,384,000 users"))).otherwise(held)


def host_name(ip: Column) -> Column:
    """The name that FLOWS_SQL has for an address()."""
    groups = F.split(ip, r"\.")
    return F.concat(F.lit("10.0."), (groups[1].cast("int") * 256 + groups[2].cast("int")).cast("string"), F.lit("."), groups[3])


def addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flows() with real source addresses, for what puts them on a wire or asks for internal ones."""
    return flows(spark, sf_dir).withColumn("src_ip", address("user_id"))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)).alias("host")).distinct()


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


@query("window_entropy", f"""WITH {FLOWS_SQL}, n AS (SELECT day, dst_ip, src_ip, count(*) AS c FROM flows GROUP BY ALL)
SELECT day, dst_ip AS target, sum(c)::BIGINT AS new_flows, count(*) AS sources,
       round(greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0), 6) AS entropy FROM n GROUP BY day, dst_ip""")
def window_entropy(spark, sf):
    w = ddos_windows(flows(spark, sf), Ddos(window_s=DAY))
    return w.filter("new_flows > 0").select(F.col("win").alias("day"), "target", "new_flows", "sources", r6("entropy").alias("entropy"))


@query("tumbling_rate", f"""WITH {FLOWS_SQL} SELECT dst_ip AS target, floor(t / 3600) * 3600 AS start, count(*) AS new_flows,
  count(*) FILTER (NOT ok) AS syn_only, round(count(*) / 3600.0, 8)::DOUBLE AS rate FROM flows GROUP BY ALL""")
def tumbling_rate(spark, sf):
    w = ddos_windows(flows(spark, sf), Ddos(window_s=3600.0))
    return w.filter("new_flows > 0").select("target", F.col("win").alias("start"), "new_flows", "syn_only", F.round(F.col("new_flows") / 3600.0, 8).alias("rate"))


@query("scan_sessions", f"""WITH {FLOWS_SQL}, g AS (
  SELECT *, CASE WHEN t - max(t) OVER (PARTITION BY src_ip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 40000
            THEN 0 ELSE 1 END AS fresh FROM flows),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY src_ip ORDER BY seq) AS session FROM g),
f AS (SELECT src_ip, session, dst_ip, port, min(seq) AS seq, arg_min(ok, seq) AS ok FROM s GROUP BY ALL)
SELECT src_ip, session::BIGINT AS session, count(*) AS targets, count(*) FILTER (NOT ok) AS failures FROM f GROUP BY ALL""")
def scan_sessions(spark, sf):
    c = contacts(flows(spark, sf), Scan(gap_s=40_000.0))
    return c.groupBy("src_ip", "session").agg(F.count("*").alias("targets"), F.count_if(~F.col("ok")).alias("failures"))


@query("trw_score", f"""WITH {FLOWS_SQL} SELECT src_ip, round(list_reduce(list(CASE WHEN ok THEN -ln(4.0::DOUBLE) ELSE ln(4.0::DOUBLE) END ORDER BY seq),
  lambda a, x: CASE WHEN a + x <= -ln(99.0::DOUBLE) THEN 0.0::DOUBLE ELSE a + x END, 0.0::DOUBLE), 6) AS score FROM flows GROUP BY src_ip""")
def trw_score(spark, sf):
    rows = flows(spark, sf).groupBy("src_ip").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "synack_seen"))), lambda x: x["synack_seen"]).alias("w"))
    return rows.select("src_ip", r6(stats.trw(F.col("w"))).alias("score"))


@query("ewma_zscore", f"""WITH {FLOWS_SQL}, d AS (SELECT dst_ip, day, sum(bytes_fwd)::DOUBLE AS v FROM flows GROUP BY ALL),
p AS (SELECT dst_ip, day, v, coalesce(list(v) OVER (PARTITION BY dst_ip ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []::DOUBLE[]) AS past FROM d),
e AS (SELECT *, list_reduce(past, lambda a, x: a, NULL::DOUBLE) AS ignored,
  list_reduce(list_transform(past, lambda x: {{'n': 0, 'm': x, 'v': 0.0::DOUBLE}}),
    lambda a, x: {{'n': a.n + 1, 'm': CASE WHEN a.n = 0 THEN x.m ELSE a.m + 0.1::DOUBLE * (x.m - a.m) END,
                   'v': CASE WHEN a.n = 0 THEN 0.0::DOUBLE ELSE 0.9::DOUBLE * (a.v + (x.m - a.m) * (0.1::DOUBLE * (x.m - a.m))) END}},
    {{'n': 0, 'm': 0.0::DOUBLE, 'v': 0.0::DOUBLE}}) AS s FROM p)
SELECT dst_ip, day, CASE WHEN s.n >= 5 THEN round((v - s.m) / greatest(sqrt(s.v), 0.1 * abs(s.m), 1.0), 5) END AS z FROM e""")
def ewma_zscore(spark, sf):
    d = flows(spark, sf).groupBy("dst_ip", "day").agg(F.sum("bytes_fwd").cast("double").alias("v"))
    past = F.collect_list("v").over(W.partitionBy("dst_ip").orderBy("day").rowsBetween(W.unboundedPreceding, -1))
    return d.withColumn("past", past).select("dst_ip", "day", F.round(stats.zscore(F.col("v"), stats.ewma(F.col("past"), Baseline())), 5).alias("z"))


@query("doubling_trigger", f"""WITH {FLOWS_SQL}, c AS (SELECT src_ip, seq, row_number() OVER (PARTITION BY src_ip ORDER BY seq) AS n FROM flows)
SELECT src_ip, seq, n FROM c WHERE n IN (8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096)""")
def doubling_trigger(spark, sf):
    n = F.row_number().over(W.partitionBy("src_ip").orderBy("seq"))
    return flows(spark, sf).select("src_ip", "seq", n.cast("long").alias("n")).filter(doubled(F.col("n"), 8))


@query("doubling_bytes", f"""WITH {FLOWS_SQL}, r AS (SELECT src_ip, seq, sum(bytes_fwd) OVER (PARTITION BY src_ip ORDER BY seq)::DOUBLE AS v FROM flows),
f AS (SELECT src_ip, list_reduce(list_transform(list(v ORDER BY seq), lambda x: {{'next': x, 'fired': []::DOUBLE[]}}),
  lambda a, x: CASE WHEN x.next >= a.next THEN {{'next': 2 * x.next, 'fired': list_append(a.fired, x.next)}} ELSE a END,
  {{'next': 5000.0::DOUBLE, 'fired': []::DOUBLE[]}}).fired AS fired FROM r GROUP BY src_ip)
SELECT src_ip, unnest(fired)::BIGINT AS fired FROM f""")
def doubling_bytes(spark, sf):
    total = F.sum("bytes_fwd").over(W.partitionBy("src_ip").orderBy("seq"))
    rows = flows(spark, sf).select("src_ip", "seq", total.alias("v")).groupBy("src_ip").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "v"))), lambda x: x["v"]).alias("v"))
    return rows.select("src_ip", F.explode(stats.doubling(F.col("v"), 5000.0).cast("array<bigint>")).alias("fired"))


@query("anchored_window", f"""WITH {FLOWS_SQL}, a AS (SELECT src_ip, list_reduce(list_transform(list(t ORDER BY t), lambda x: [x]),
  lambda a, x: CASE WHEN len(a) = 0 OR x[1] - a[-1] > 200000 THEN list_concat(a, x) ELSE a END, []::DOUBLE[]) AS starts FROM flows GROUP BY src_ip),
s AS (SELECT src_ip, unnest(starts) AS anchor FROM a),
m AS (SELECT f.src_ip, f.seq, max(s.anchor) AS anchor FROM flows f JOIN s ON f.src_ip = s.src_ip AND s.anchor <= f.t GROUP BY ALL)
SELECT src_ip, anchor, count(*) AS n FROM m GROUP BY ALL""")
def anchored_window(spark, sf):
    return anchored(flows(spark, sf).select("src_ip", "seq", F.col("first_ts").alias("ts")), ["src_ip"], 200_000.0).groupBy("src_ip", "anchor").agg(F.count("*").alias("n"))


@query("beacon_cv", f"""WITH {FLOWS_SQL}, h AS (SELECT src_ip, dst_ip, seq, t, t - lag(t) OVER w AS gap, bytes_fwd, row_number() OVER w AS n FROM flows WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY seq))
SELECT src_ip, dst_ip, count(*) AS connections, round(avg(gap), 4) AS interval, round(stddev_pop(gap) / avg(gap), 6) AS interval_cv,
       round(stddev_pop(bytes_fwd) / avg(bytes_fwd), 6) AS size_cv FROM h GROUP BY ALL HAVING count(*) >= 3""")
def beacon_cv(spark, sf):
    w = W.partitionBy("src_ip", "dst_ip").orderBy("seq")
    rows = flows(spark, sf).withColumn("gap", F.col("first_ts") - F.lag("first_ts").over(w))
    out = rows.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("connections"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("s"), F.avg("bytes_fwd").alias("bm"), F.stddev_pop("bytes_fwd").alias("bs")).filter("connections >= 3")
    return out.select("src_ip", "dst_ip", "connections", F.round("m", 4).alias("interval"), r6(stats.cv(F.col("s"), F.col("m"))).alias("interval_cv"), r6(stats.cv(F.col("bs"), F.col("bm"))).alias("size_cv"))


@query("upload_top_dst", f"""WITH {FLOWS_SQL}, d AS (SELECT src_ip AS host, day, dst_ip, sum(bytes_fwd) AS b, min(seq) AS f FROM flows GROUP BY ALL)
SELECT host, day, sum(b)::BIGINT AS sent, arg_max(dst_ip, {{'b': b, 'f': -f}}) AS top_dst, max(b)::BIGINT AS top_bytes FROM d GROUP BY host, day""")
def upload_top_dst(spark, sf):
    o = oriented(addressed(spark, sf), Exfil(window_s=DAY))
    d = o.groupBy("host", "win", "remote").agg(F.sum("out").alias("b"), F.min("seq").alias("f"))
    return d.groupBy(host_name(F.col("host")).alias("host"), F.col("win").alias("day")).agg(F.sum("b").alias("sent"), F.max_by("remote", F.struct("b", -F.col("f"))).alias("top_dst"), F.max("b").alias("top_bytes"))


@query("producer_consumer", f"""WITH {FLOWS_SQL} SELECT src_ip, round(CASE WHEN sum(bytes_fwd) = 0 THEN 0 ELSE
  (sum(bytes_fwd) FILTER (ok) - coalesce(sum(bytes_fwd) FILTER (NOT ok), 0)) / sum(bytes_fwd)::DOUBLE END, 6) AS pcr FROM flows GROUP BY src_ip HAVING count(*) FILTER (ok) > 0""")
def producer_consumer(spark, sf):
    rows = flows(spark, sf).groupBy("src_ip").agg(F.sum(F.when(F.col("synack_seen"), F.col("bytes_fwd"))).alias("o"), F.coalesce(F.sum(F.when(~F.col("synack_seen"), F.col("bytes_fwd"))), F.lit(0)).alias("i"))
    return rows.filter("o IS NOT NULL").select("src_ip", r6(stats.pcr(F.col("o"), F.col("i"))).alias("pcr"))


@query("first_contact", f"""WITH {FLOWS_SQL}, d AS (SELECT src_ip AS host, dst_ip, day, min(day) OVER (PARTITION BY src_ip, dst_ip) AS since FROM flows)
SELECT host, day, count(DISTINCT dst_ip) FILTER (since = day) AS fresh, count(DISTINCT dst_ip) AS contacts FROM d GROUP BY ALL""")
def first_contact(spark, sf):
    o = oriented(addressed(spark, sf), Exfil(window_s=DAY)).groupBy("host", "remote", "win").agg(F.count("*").alias("n"))
    o = o.withColumn("since", F.min("win").over(W.partitionBy("host", "remote")))
    return o.groupBy(host_name(F.col("host")).alias("host"), F.col("win").alias("day")).agg(F.count_if(F.col("since") == F.col("win")).alias("fresh"), F.count("*").alias("contacts"))


@query("running_prevalence", f"""WITH {FLOWS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY dst_ip, src_ip ORDER BY seq) = 1 AS new FROM flows)
SELECT seq, least(4, sum(new::INTEGER) OVER (PARTITION BY dst_ip ORDER BY seq))::INTEGER AS callers FROM f""")
def running_prevalence(spark, sf):
    rows = flows(spark, sf)
    few = first_values(rows, "dst_ip", "src_ip", "seq", 4, "firsts")
    return rows.join(few, "dst_ip").select("seq", F.expr("size(filter(firsts, c -> c.first <= seq))").alias("callers"))


_PAIRS = lexical.common_pairs()
_ENTROPY_SQL = "CASE WHEN length({x}) = 0 THEN 0.0::DOUBLE ELSE -list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: (len(list_filter(string_split({x}, ''), lambda y: y = c)) / length({x})::DOUBLE) * log2(len(list_filter(string_split({x}, ''), lambda y: y = c)) / length({x})::DOUBLE))) END"
_SUFFIXES = ", ".join(f"'{s}'" for s in lexical.TWO_LABEL_SUFFIXES)
NAMES_SQL = f"""{HOSTS_SQL}, parts AS (SELECT host, string_split(host, '.') AS p FROM hosts),
kept AS (SELECT host, p, least(len(p), CASE WHEN len(p) >= 3 AND p[-2] || '.' || p[-1] IN ({_SUFFIXES}) THEN 3 ELSE 2 END) AS k FROM parts),
names AS (SELECT host, array_to_string(p[len(p) - k + 1 :], '.') AS registered, p[len(p) - k + 1] AS label, array_to_string(p[1 : len(p) - k], '.') AS subdomain, len(p) AS n FROM kept),
pairs AS (SELECT *, list_filter(list_transform(range(1, greatest(length(label), 2)), lambda i: substr(label, i, 2)), lambda x: regexp_full_match(x, '[a-z][a-z]')) AS letter_pairs FROM names),
feats AS (SELECT *, {_ENTROPY_SQL.format(x="label")} AS entropy, length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label)::DOUBLE AS digits,
  CASE WHEN length(label) < 2 THEN 0.0::DOUBLE WHEN len(letter_pairs) = 0 THEN 1.0::DOUBLE
       ELSE len(list_filter(letter_pairs, lambda x: NOT list_contains([{", ".join(f"'{p}'" for p in _PAIRS)}], x))) / len(letter_pairs)::DOUBLE END AS rare FROM pairs)"""


@query("dns_features", f"""WITH {NAMES_SQL} SELECT host, registered, label, subdomain, round(entropy, 6) AS entropy, round(digits, 6) AS digits, round(rare, 6) AS rare,
  coalesce(list_max(list_transform(string_split(subdomain, '.'), lambda x: length(x))), 0)::INTEGER AS longest, n::INTEGER AS labels FROM feats""")
def dns_features(spark, sf):
    h = F.col("host")
    s, f = lexical.split_name(h), lexical.query_features(h, F.lit(1))
    return hosts(spark, sf).select("host", s["registered"].alias("registered"), s["label"].alias("label"), s["subdomain"].alias("subdomain"), r6(f["label_entropy"]).alias("entropy"), r6(f["digit_ratio"]).alias("digits"), r6(f["rare_bigram_ratio"]).alias("rare"), lexical.max_label_length(s["subdomain"]).alias("longest"), F.size(lexical.labels(h)).alias("labels"))


@query("dga_score", f"""WITH {NAMES_SQL} SELECT host, CASE WHEN length(label) < 8 THEN 0.0::DOUBLE ELSE round(
  0.35 / (1 + exp(-4 * (entropy / 3.3 - 1))) + 0.35 / (1 + exp(-4 * (rare / 0.5 - 1))) + 0.15 / (1 + exp(-4 * (digits / 0.2 - 1))) + 0.15 / (1 + exp(-4 * (length(label) / 12.0 - 1))), 3) END AS score FROM feats""")
def dga_score(spark, sf):
    return hosts(spark, sf).select("host", F.round(lexical.dga_score(lexical.split_name(F.col("host"))["label"]), 3).alias("score"))


@query("community_id", f"""WITH {FLOWS_SQL}, e AS (SELECT seq, lpad(lower(hex((string_split(src_ip, '.')[1]::BIGINT << 24) + (string_split(src_ip, '.')[2]::BIGINT << 16) + (string_split(src_ip, '.')[3]::BIGINT << 8) + string_split(src_ip, '.')[4]::BIGINT)), 8, '0') AS a,
  lpad(lower(hex((string_split(dst_ip, '.')[1]::BIGINT << 24) + (string_split(dst_ip, '.')[2]::BIGINT << 16) + (string_split(dst_ip, '.')[3]::BIGINT << 8) + string_split(dst_ip, '.')[4]::BIGINT)), 8, '0') AS b,
  lpad(lower(hex(port)), 4, '0') AS port FROM flows)
SELECT seq, '1:' || to_base64(unhex(sha1(unhex('0000' || CASE WHEN a <= b THEN a || b ELSE b || a END || '0600' || CASE WHEN a <= b THEN '9c40' || port ELSE port || '9c40' END)))) AS community FROM e""")
def community_id(spark, sf):
    return addressed(spark, sf).select("seq", net.community_id(*[F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "proto")]).alias("community"))


@query("ja3_md5", """WITH o AS (SELECT l_orderkey, list((l_partkey % 65536)::INTEGER ORDER BY l_linenumber, l_partkey) AS c, list((l_suppkey % 65536)::INTEGER ORDER BY l_linenumber, l_suppkey) AS e FROM lineitem GROUP BY l_orderkey),
g AS (SELECT l_orderkey, list_filter(c, lambda v: NOT ((v & 3855) = 2570 AND (v & 255) = (v >> 8))) AS c, list_filter(e, lambda v: NOT ((v & 3855) = 2570 AND (v & 255) = (v >> 8))) AS e FROM o)
SELECT l_orderkey, md5('771,' || array_to_string(c, '-') || ',' || array_to_string(e, '-') || ',,') AS ja3 FROM g""")
def ja3_md5(spark, sf):
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col(c).alias("k")))), lambda x: (x["k"] % 65_536).cast("int"))
    none = F.array().cast("array<int>")
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(ordered("l_partkey").alias("c"), ordered("l_suppkey").alias("e"))
    return rows.select("l_orderkey", tls.ja3(F.lit(771), F.col("c"), F.col("e"), none, none).alias("ja3"))


@query("ja4_hash", """WITH o AS (SELECT l_orderkey, list(lpad(lower(hex((l_partkey % 65536)::BIGINT)), 4, '0')) AS c FROM lineitem WHERE NOT (((l_partkey % 65536)::INTEGER & 3855) = 2570 AND ((l_partkey % 65536)::INTEGER & 255) = ((l_partkey % 65536)::INTEGER >> 8)) GROUP BY l_orderkey)
SELECT l_orderkey, 't12i' || lpad(least(len(c), 99)::VARCHAR, 2, '0') || '0000_' || substr(sha256(array_to_string(list_sort(c), ',')), 1, 12) || '_000000000000' || CASE WHEN false THEN '' ELSE '' END AS ja4
FROM o""")
def ja4_hash(spark, sf):
    none, text = F.array().cast("array<int>"), F.lit(None).cast("string")
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_partkey") % 65_536).cast("int")).alias("c"))
    return rows.filter(F.size(tls.plain(F.col("c"))) > 0).select("l_orderkey", tls.ja4(F.lit(771), F.col("c"), none, none, none, text, F.array().cast("array<string>")).alias("ja4"))


@query("signal_combine", f"""WITH {FLOWS_SQL}, d AS (SELECT src_ip, day, count(*) AS n, count(*) FILTER (NOT ok) / count(*)::DOUBLE AS failed FROM flows GROUP BY ALL),
s AS (SELECT src_ip, day, 1 / (1 + exp(-4 * (n / 3.0 - 1))) AS a, 1 / (1 + exp(-4 * (failed / 0.5 - 1))) AS b, CASE WHEN n <= 0 THEN 1.0 ELSE 1 / (1 + exp(-4 * (2.0 / n - 1))) END AS c, n > 1 AS has FROM d)
SELECT src_ip, day, round(round((0.5 * a + 0.3 * b + CASE WHEN has THEN 0.2 * c ELSE 0 END) / (0.8 + CASE WHEN has THEN 0.2 ELSE 0 END), 4), 3) AS confidence, CASE WHEN 0.5 * a >= 0.3 * b AND (NOT has OR 0.5 * a >= 0.2 * c) THEN 'n' WHEN NOT has OR 0.3 * b >= 0.2 * c THEN 'failed' ELSE 'few' END AS main FROM s""")
def signal_combine(spark, sf):
    d = flows(spark, sf).groupBy("src_ip", "day").agg(F.count("*").alias("n"), (F.count_if(~F.col("synack_seen")) / F.count("*")).alias("failed"))
    confidence, factors = combine([Signal("n", F.col("n"), 3.0, 0.5), Signal("failed", F.col("failed"), 0.5, 0.3), Signal("few", F.col("n"), 2.0, 0.2, higher_is_worse=False, present=F.col("n") > 1)])
    return d.select("src_ip", "day", F.round(confidence, 3).alias("confidence"), F.element_at(factors, 1)["feature"].alias("main"))


@query("severity", """SELECT c_custkey, round_even(least(100.0::DOUBLE, 100 * ((c_custkey % 100) / 100.0::DOUBLE) * CASE c_mktsegment WHEN 'BUILDING' THEN 0.7::DOUBLE ELSE 1.0 END * (0.6::DOUBLE + 0.1::DOUBLE * (n_regionkey + 1))), 0)::INTEGER AS score
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def severity_query(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "recon_scan").otherwise("ddos")
    return c.select("c_custkey", severity_score((F.col("c_custkey") % 100) / 100, kind, F.col("n_regionkey") + 1).alias("score"))


@query("severity_levels", """WITH s AS (SELECT o_orderkey, (o_orderkey % 101)::INTEGER AS score FROM orders) SELECT CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM s GROUP BY 1""")
def severity_levels(spark, sf):
    return table(spark, sf, "orders").select(severity((F.col("o_orderkey") % 101).cast("int")).alias("severity")).groupBy("severity").agg(F.count("*").alias("n"))


@query("allowlist_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def allowlist_anti(spark, sf):
    allow = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("ip"))
    found = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").cast("string").alias("src"), F.lit("-").alias("dst"))
    return allowed_out(found, allow).select("o_orderkey", "o_custkey")


@query("cidr_join", f"""WITH {FLOWS_SQL} SELECT dst_ip LIKE '203.0.113.%' AS test_net, count(*) AS n, sum(bytes_fwd)::BIGINT AS bytes FROM flows GROUP BY ALL""")
def cidr_join(spark, sf):
    return flows(spark, sf).groupBy(net.in_networks(F.col("dst_ip"), ("203.0.113.0/24",)).alias("test_net")).agg(F.count("*").alias("n"), F.sum("bytes_fwd").alias("bytes"))


@query("dedup_islands", f"""WITH {FLOWS_SQL}, g AS (SELECT *, CASE WHEN t - max(t) OVER (PARTITION BY src_ip, dst_ip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 100000 THEN 0 ELSE 1 END AS fresh FROM flows),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY src_ip, dst_ip ORDER BY seq) AS island FROM g)
SELECT src_ip, dst_ip, min(t) AS start, max(t) AS ends, count(*) AS merged FROM i GROUP BY src_ip, dst_ip, island""")
def dedup_islands(spark, sf):
    return merged(_findings(flows(spark, sf)), Fusion(dedup_s=100_000.0)).select(F.col("host").alias("src_ip"), F.col("dst").alias("dst_ip"), F.col("event_start").alias("start"), F.col("event_end").alias("ends"), F.col("events_merged").alias("merged"))


def _findings(rows: DataFrame, confidence: Column | None = None) -> DataFrame:
    """Every flow as a detection."""
    from vigil.operators.base import detections

    return detections(
        rows, threat_class=F.col("event_type"), sub_type="flow", entity=F.concat("src_ip", F.lit(">"), "dst_ip"), host=F.col("src_ip"), src=F.col("src_ip"), dst=F.col("dst_ip"), dst_port=F.col("dst_port").cast("string"), proto="TCP", flow_id=F.col("flow_id"),
        event_start=F.col("first_ts"), event_end=F.col("last_ts"), confidence=F.lit(0.9) if confidence is None else confidence, evidence=F.expr("cast(map() as map<string,struct<observed:string,observed_num:double,reference:string>>)"), factors=F.expr("cast(array() as array<struct<feature:string,contribution:double>>)"),
        summary="", action="", mitre=[F.lit("T0000")], model="adapter", model_version="1.0", asset_ip=F.col("src_ip"),
    )


@query("recent_alerts", f"WITH {FLOWS_SQL} SELECT seq, src_ip, t FROM flows WHERE event_type = 'error' ORDER BY t DESC, seq LIMIT 50")
def recent_alerts(spark, sf):
    alerts = flows(spark, sf).withColumns({"event_end": F.col("last_ts"), "alert_key": F.col("seq"), "threat_class": F.col("event_type")})
    return recent(alerts, 50, threat_class="error").select("seq", "src_ip", F.col("last_ts").alias("t"))


@query("nearest_rank_p95", "SELECT l_returnflag, list_sort(list(l_extendedprice))[least(count(*), floor(count(*) * 0.95)::BIGINT + 1)] AS p95, list_sort(list(l_extendedprice))[least(count(*), floor(count(*) * 0.5)::BIGINT + 1)] AS p50 FROM lineitem GROUP BY l_returnflag")
def nearest_rank_p95(spark, sf):
    return nearest_ranks(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", {"p95": 0.95, "p50": 0.5}, 500.0)


@query("hash_chain", "SELECT list_reduce(list(n_name || '|' || n_regionkey ORDER BY n_nationkey), lambda h, r: sha256(h || r), repeat('0', 64)) AS head, count(*) AS height FROM nation")
def hash_chain(spark, sf):
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", F.concat("n_name", F.lit("|"), F.col("n_regionkey").cast("string")).alias("r")))), lambda x: x["r"])
    return table(spark, sf, "nation").agg(chain(rows).alias("head"), F.count("*").alias("height"))


@query("flow_features", f"""WITH {FLOWS_SQL} SELECT seq, bytes_fwd::DOUBLE AS fwd_pkt_len_mean, bytes_fwd / 0.001::DOUBLE AS bytes_per_s, (1 + ok::INTEGER)::DOUBLE AS total_packets, (1 + ok::INTEGER) / 0.001::DOUBLE AS packets_per_s,
  1.0::DOUBLE AS fwd_bwd_pkt_ratio, 1.0::DOUBLE AS is_tcp FROM flows""")
def flow_features_query(spark, sf):
    f = flow_features(F.col("last_ts") - F.col("first_ts"), *[F.col(c) for c in ("pkts_fwd", "pkts_bwd", "bytes_fwd", "bytes_bwd", "proto", "syn_seen", "rst_seen")])
    return flows(spark, sf).select("seq", *[f[n].alias(n) for n in ("fwd_pkt_len_mean", "bytes_per_s", "total_packets", "packets_per_s", "fwd_bwd_pkt_ratio", "is_tcp")])


@query("temporal_split", f"WITH {FLOWS_SQL}, r AS (SELECT event_type, row_number() OVER (ORDER BY seq) AS n, count(*) OVER () AS total FROM flows) SELECT event_type, count(*) FILTER (n <= floor(total * 0.7)) AS train, count(*) FILTER (n > floor(total * 0.7)) AS test FROM r GROUP BY event_type")
def temporal_split(spark, sf):
    train, test = split(flows(spark, sf).select("seq", "event_type"), how="temporal")
    both = train.withColumn("early", F.lit(True)).unionByName(test.withColumn("early", F.lit(False)))
    return both.groupBy("event_type").agg(F.count_if("early").alias("train"), F.count_if(~F.col("early")).alias("test"))


@query("confusion_f1", """WITH c AS (SELECT quality AS label, toxic AS predicted FROM labels), l AS (SELECT DISTINCT label FROM c)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support FROM (
  SELECT label, CASE WHEN (SELECT count(*) FROM c WHERE predicted = l.label) > 0 THEN (SELECT count(*) FROM c WHERE label = l.label AND predicted = l.label) / (SELECT count(*) FROM c WHERE predicted = l.label)::DOUBLE ELSE 0 END AS p,
         (SELECT count(*) FROM c WHERE label = l.label AND predicted = l.label) / (SELECT count(*) FROM c WHERE label = l.label)::DOUBLE AS r, (SELECT count(*) FROM c WHERE label = l.label) AS support FROM l)""")
def confusion_f1(spark, sf):
    out = report(table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("predicted_label")))
    return out.select("label", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


@query("label_map", "SELECT CASE event_type WHEN 'error' THEN 'recon_scan' WHEN 'purchase' THEN 'exfiltration' WHEN 'view' THEN 'benign' END AS label, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase', 'view') GROUP BY 1")
def label_map(spark, sf):
    raw = table(spark, sf, "events").select(F.col("event_type").alias("Label"), *[F.lit("1").alias(n) for n in ("duration_us", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes")])
    return labelled_flows(raw, {"error": "recon_scan", "purchase": "exfiltration", "view": "benign"}).groupBy("label").agg(F.count("*").alias("n"))


@query("alerts_fused")
def alerts_fused(spark, sf):
    """Flagship: detections over the events table, fused with customers as assets, and the seeded scenarios beside them."""
    held = table(spark, sf, "customer").filter("c_custkey < 16384000")  # a user above is an error, so nothing could meet the others
    assets = held.select(address("c_custkey").alias("ip"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("zone"), (F.col("c_nationkey") % 5 + 1).cast("int").alias("criticality"))
    found = scans(addressed(spark, sf), Scan(gap_s=DAY * 40, targets=3)).unionByName(uploads(addressed(spark, sf), Exfil(window_s=DAY, bytes_out=5000.0)))
    alerts = fuse(found, assets, mode="flow")
    named = host_name(F.col("host"))
    entity = F.concat(named, F.expr("substring(entity, length(host) + 1)"))  # an entity begins with its host
    return alerts.select("alert_key", "threat_class", "sub_type", entity.alias("entity"), named.alias("host"), "confidence", "severity", "severity_score", "events_merged", "event_start", "event_end", F.col("asset.name").alias("asset_name"), F.size("related").alias("related"))


@query("scenario_alerts")
def scenario_alerts(spark, sf):
    """Alerts of all seeded scenarios together with the real limits; the tables aren't read."""
    from vigil.gen.scenarios import BAD_JA3

    alerts = fuse(detect({k: cut(v) for k, v in mixed(spark).items()}, Context(intel=Intel(ja3={BAD_JA3}))))
    return alerts.select("alert_key", "threat_class", "sub_type", "entity", "confidence", "severity", "events_merged")


from vigil import catalog_detect, catalog_sources  # noqa: E402, F401 (register more queries with what is above)
