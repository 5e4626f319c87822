"""Registered queries of whole detectors, campaigns and the alert projection, each with its SQL.

``events`` is read as flows (as in ``vigil.catalog``), as DNS messages and as TLS handshakes: a click looks up a name made
of a hash, a view carries a hash below one of three domains in a TXT query, anything else asks for a plain name, and
errors are answers that no such name exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.catalog import DAY, FLOWS_SQL, NAMES_SQL, HOSTS_SQL, _findings, addressed, flows, host_name, query, table
from vigil.operators.beacon import beacons
from vigil.operators.ddos import ddos
from vigil.operators.dns import generated_names, tunnels
from vigil.operators.exfil import uploads
from vigil.operators.scan import scans
from vigil.operators.tls import tls_clients
from vigil.params import STAGES, Beacon, Ddos, Dga, Exfil, Fusion, Scan, Tls, Trw, Tunnel
from vigil.plans.fusion import campaigns, fuse, updates
from vigil.plans.service import smoothed_rates

WINDOW = 200_000.0
DNS_SQL = f"""{FLOWS_SQL}, dns AS (
  SELECT seq, t AS ts, 'e' || seq AS flow_id, src_ip AS client_ip, event_type = 'error' AS is_response, event_type = 'error' AS nx,
         CASE event_type WHEN 'view' THEN 16 ELSE 1 END AS qtype,
         CASE event_type WHEN 'click' THEN substr(md5(seq::VARCHAR), 1, 16) || '.com' WHEN 'view' THEN substr(md5(seq::VARCHAR), 1, 24) || '.t' || user_id % 3 || '.net'
              ELSE 'www.cloud' || port || '.com' END AS query
  FROM flows)"""
#: Parts of every queried name, as in the lexical queries.
QUERY_NAMES_SQL = NAMES_SQL.replace(HOSTS_SQL, "hosts AS (SELECT DISTINCT query AS host FROM dns)")
#: Base of the factors' order: falling contribution, then the order of the signals.
FACTORS = "array_to_string(list_transform(list_sort([{rows}]), lambda x: x.name), ',')"


def strength_sql(value: str, threshold: float, higher: bool = True) -> str:
    if higher:
        return f"(1 / (1 + exp(-4 * (({value})::DOUBLE / {threshold}::DOUBLE - 1))))"
    return f"(CASE WHEN ({value}) <= 0 THEN 1.0::DOUBLE ELSE 1 / (1 + exp(-4 * ({threshold}::DOUBLE / ({value})::DOUBLE - 1))) END)"


def combine_sql(signals: list[tuple]) -> tuple[str, str]:
    """(confidence, names of the factors in order) of signals (name, value, threshold, weight, higher is worse)."""
    whole = " + ".join(f"{w}::DOUBLE" for _, _, _, w, _ in signals)
    parts = [f"{w}::DOUBLE * {strength_sql(v, th, higher)}" for _, v, th, w, higher in signals]
    rows = ", ".join(f"{{'share': -round({p} / ({whole}), 4), 'place': {i}, 'name': '{s[0]}'}}" for i, (p, s) in enumerate(zip(parts, signals, strict=True)))
    return f"round(({' + '.join(parts)}) / ({whole}), 4)", FACTORS.format(rows=rows)


def dns(spark, sf: str) -> DataFrame:
    """The events table as DNS messages."""
    h, kind = F.md5(F.col("seq").cast("string").cast("binary")), F.col("event_type")
    name = F.when(kind == "click", F.concat(F.substring(h, 1, 16), F.lit(".com"))).when(kind == "view", F.concat(F.substring(h, 1, 24), F.lit(".t"), (F.col("user_id") % 3).cast("string"), F.lit(".net")))
    name = name.otherwise(F.concat(F.lit("www.cloud"), F.col("dst_port").cast("string"), F.lit(".com")))
    failed = kind == "error"
    return flows(spark, sf).select(
        "seq", F.col("first_ts").alias("ts"), "flow_id", F.col("src_ip").alias("client_ip"), F.lit("10.0.99.53").alias("resolver_ip"), name.alias("query"),
        F.when(kind == "view", 16).otherwise(1).alias("qtype"), failed.alias("is_response"), F.when(failed, 3).alias("rcode"), F.lit(0).alias("answer_bytes"),
    )


def tls(spark, sf: str) -> DataFrame:
    """The events table as TLS handshakes."""
    return flows(spark, sf).select(
        "seq", F.col("first_ts").alias("ts"), "flow_id", F.col("src_ip").alias("client_ip"), F.col("dst_ip").alias("server_ip"), F.lit(443).alias("server_port"), F.lit("13").alias("version"),
        F.when(F.col("event_type").isin("view", "purchase", "signup"), "www.example.com").alias("sni"), F.md5((F.col("user_id") % 20).cast("string").cast("binary")).alias("ja3"),
        F.concat(F.lit("t13d_"), (F.col("user_id") % 40).cast("string"), F.lit("_"), "event_type").alias("ja4"), F.lit("h2").alias("alpn"),
    )


def names(factors: str = "factors"):
    return F.array_join(F.transform(factors, lambda x: x["feature"]), ",").alias("factors")


def seen(name: str, alias: str | None = None):
    return F.col("evidence")[name]["observed_num"].alias(alias or name)


def anchored_sql(rows: str, keys: str, match: str) -> str:
    """CTEs starts and windowed: the rows with the start of their window, which opens past the last one's end."""
    return f"""opened AS (SELECT {keys}, unnest(list_reduce(list_transform(list(ts ORDER BY seq), lambda x: [x]),
    lambda a, x: CASE WHEN len(a) = 0 OR x[1] - a[-1] > {WINDOW} THEN list_concat(a, x) ELSE a END, []::DOUBLE[])) AS start FROM {rows} GROUP BY {keys}),
windowed AS (SELECT r.*, (SELECT max(o.start) FROM opened o WHERE {match} AND o.start <= r.ts) AS anchor FROM {rows} r)"""


_DGA = combine_sql([("dga_like_names", "names", 4, 0.35, True), ("nxdomain_ratio", "nx_ratio", 0.5, 0.35, True), ("mean_name_score", "mean", 0.6, 0.3, True)])


@query("dga_alerts", f"""WITH {DNS_SQL}, {QUERY_NAMES_SQL}, {anchored_sql("dns", "client_ip", "o.client_ip = r.client_ip")},
scored AS (SELECT host AS query, registered, CASE WHEN length(label) < 8 THEN 0.0::DOUBLE ELSE round(({" + ".join(f"{w}::DOUBLE * {strength_sql(v, th)}" for v, th, w in (("entropy", 3.3, 0.35), ("rare", 0.5, 0.35), ("digits", 0.2, 0.15), ("length(label)", 12, 0.15)))}) / 1.0::DOUBLE, 4) END AS score FROM feats),
marked AS (SELECT *, NOT is_response AND score >= 0.6 AS looks FROM windowed JOIN scored USING (query)),
firsts AS (SELECT *, looks AND row_number() OVER (PARTITION BY client_ip, anchor, looks, registered ORDER BY seq) = 1 AS new FROM marked),
summed AS (SELECT *, sum(new::INTEGER) OVER w AS names, sum(CASE WHEN new THEN score ELSE 0 END) OVER w AS scores, sum(is_response::INTEGER) OVER w AS responses, sum(nx::INTEGER) OVER w AS nxs
  FROM firsts WINDOW w AS (PARTITION BY client_ip, anchor ORDER BY seq)),
fired AS (SELECT *, CASE WHEN responses > 0 THEN nxs / responses::DOUBLE ELSE 0 END AS nx_ratio, scores / names AS mean FROM summed WHERE new AND names IN (4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048)),
samples AS (SELECT client_ip, anchor, names, array_to_string(list_sort(list(registered))[1:5], ', ') AS samples FROM (
  SELECT f.client_ip, f.anchor, f.names, s.registered FROM fired f JOIN summed s ON s.client_ip = f.client_ip AND s.anchor = f.anchor AND s.new AND s.names <= f.names) GROUP BY ALL)
SELECT client_ip AS entity, flow_id, anchor AS event_start, ts AS event_end, {_DGA[0]} AS confidence, names::DOUBLE AS dga_like_domains, round(nx_ratio, 4) AS nxdomain_ratio, round(mean, 4) AS mean_name_score, samples AS sample_domains, {_DGA[1]} AS factors
FROM fired JOIN samples USING (client_ip, anchor, names) WHERE {_DGA[0]} >= 0.5""")
def dga_alerts(spark, sf):
    found = generated_names(dns(spark, sf), Dga(window_s=WINDOW, names=4))
    return found.select("entity", "flow_id", "event_start", "event_end", "confidence", seen("dga_like_domains"), seen("nxdomain_ratio"), seen("mean_name_score"), F.col("evidence")["sample_domains"]["observed"].alias("sample_domains"), names())


_TUNNEL = combine_sql([("unique_subdomains", "uniques", 4, 0.35, True), ("label_length", "mean_len", 40, 0.35, True), ("txt_null_ratio", "txt_ratio", 0.5, 0.3, True)])


@query("tunnel_alerts", f"""WITH {DNS_SQL}, {QUERY_NAMES_SQL},
asked AS (SELECT d.*, registered, subdomain FROM dns d JOIN feats ON query = host WHERE NOT is_response AND subdomain <> ''),
often AS (SELECT * FROM asked SEMI JOIN (SELECT client_ip, registered FROM asked GROUP BY ALL HAVING count(*) >= 4) USING (client_ip, registered)),
{anchored_sql("often", "client_ip, registered", "o.client_ip = r.client_ip AND o.registered = r.registered")},
firsts AS (SELECT *, row_number() OVER (PARTITION BY client_ip, registered, anchor, subdomain ORDER BY seq) = 1 AS new FROM windowed),
summed AS (SELECT *, sum(new::INTEGER) OVER w AS uniques, count(*) OVER w AS n, sum(list_max(list_transform(string_split(subdomain, '.'), lambda x: length(x)))) OVER w AS long, sum((qtype IN (10, 16))::INTEGER) OVER w AS txt
  FROM firsts WINDOW w AS (PARTITION BY client_ip, registered, anchor ORDER BY seq)),
fired AS (SELECT *, long / n::DOUBLE AS mean_len, txt / n::DOUBLE AS txt_ratio FROM summed WHERE new AND uniques IN (4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048))
SELECT client_ip || '>' || registered AS entity, flow_id, anchor AS event_start, ts AS event_end, {_TUNNEL[0]} AS confidence, uniques::DOUBLE AS unique_subdomains, round(mean_len, 4) AS mean_longest_label, round(txt_ratio, 4) AS txt_null_ratio, n::DOUBLE AS queries, {_TUNNEL[1]} AS factors
FROM fired WHERE {_TUNNEL[0]} >= 0.5""")
def tunnel_alerts(spark, sf):
    found = tunnels(dns(spark, sf), Tunnel(window_s=WINDOW, subdomains=4))
    return found.select("entity", "flow_id", "event_start", "event_end", "confidence", seen("unique_subdomains"), seen("mean_longest_label"), seen("txt_null_ratio"), seen("queries"), names())


_TLS = combine_sql([("blocklist_match", "listed::INTEGER", 0.5, 0.5, True), ("sni_absent", "(NOT named)::INTEGER", 0.5, 0.2, True), ("fingerprint_rarity", "prior", 1, 0.3, False)])
_TLS_COLD = combine_sql([("blocklist_match", "listed::INTEGER", 0.5, 0.5, True), ("sni_absent", "(NOT named)::INTEGER", 0.5, 0.2, True)])


@query("tls_alerts", f"""WITH {FLOWS_SQL}, tls AS (SELECT seq, t, 'e' || seq AS flow_id, src_ip AS client, dst_ip, event_type IN ('view', 'purchase', 'signup') AS named,
  md5((user_id % 20)::VARCHAR) = md5('7') AS listed, 't13d_' || user_id % 40 || '_' || event_type AS ja4 FROM flows),
used AS (SELECT ja4, client, min(seq) AS since FROM tls GROUP BY ALL),
few AS (SELECT * FROM used QUALIFY row_number() OVER (PARTITION BY ja4 ORDER BY since, client) <= 3),
rows AS (SELECT *, (SELECT count(*) FROM few u WHERE u.ja4 = tls.ja4 AND u.since < tls.seq AND u.client <> tls.client) AS prior, seq > (SELECT max(seq) FROM (SELECT seq FROM tls ORDER BY seq LIMIT 200)) AS warm FROM tls),
judged AS (SELECT *, CASE WHEN warm THEN {_TLS[0]} ELSE {_TLS_COLD[0]} END AS confidence, CASE WHEN warm THEN {_TLS[1]} ELSE {_TLS_COLD[1]} END AS factors FROM rows)
SELECT client || '>' || ja4 AS entity, dst_ip AS dst, flow_id, t AS event_end, CASE WHEN listed THEN 'Known-bad TLS fingerprint' ELSE 'Anomalous TLS client' END AS sub_type, confidence, prior::DOUBLE AS fingerprint_prevalence, factors
FROM judged WHERE listed OR confidence >= 0.6""")
def tls_alerts(spark, sf):
    import hashlib

    found = tls_clients(tls(spark, sf), {hashlib.md5(b"7").hexdigest()}, p=Tls())
    return found.select("entity", "dst", "flow_id", "event_end", "sub_type", "confidence", seen("fingerprint_prevalence"), names())


_BEACON = combine_sql([("interval_regularity", "interval_cv", 0.6, 0.45, False), ("size_regularity", "size_cv", 2.0, 0.25, False), ("repetitions", "n", 4, 0.2, True), ("dst_prevalence", "callers", 3, 0.1, False)])


@query("beacon_alerts", f"""WITH {FLOWS_SQL}, held AS (SELECT src_ip, dst_ip, seq, t, list_sort(list(t) OVER w) AS starts, list(bytes_fwd::DOUBLE) OVER w AS sizes FROM flows
  WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY seq ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)),
gapped AS (SELECT *, len(starts) AS n, list_transform(range(1, len(starts)), lambda i: starts[i + 1] - starts[i]) AS gaps FROM held WHERE len(starts) >= 4),
measured AS (SELECT *, list_avg(gaps) AS interval, list_stddev_pop(gaps) AS spread, list_avg(sizes) AS size, list_stddev_pop(sizes) AS size_spread FROM gapped),
firsts AS (SELECT *, row_number() OVER (PARTITION BY dst_ip, src_ip ORDER BY seq) = 1 AS new FROM flows),
prevalence AS (SELECT seq, least(4, sum(new::INTEGER) OVER (PARTITION BY dst_ip ORDER BY seq)) AS callers FROM firsts),
judged AS (SELECT *, spread / interval AS interval_cv, CASE WHEN size = 0 THEN 'inf'::DOUBLE ELSE size_spread / size END AS size_cv FROM measured JOIN prevalence USING (seq) WHERE interval >= 5)
SELECT src_ip || '>' || dst_ip || ':443' AS entity, {_BEACON[0]} AS confidence, starts[1] AS event_start, t AS event_end, 'e' || seq AS flow_id, n::DOUBLE AS connections, round(interval, 4) AS mean_interval_s,
  round(interval_cv, 4) AS interval_cv, round(size_cv, 4) AS bytes_per_session_cv, callers::DOUBLE AS internal_hosts_calling_dst, {_BEACON[1]} AS factors
FROM judged WHERE interval_cv <= 0.6 AND {_BEACON[0]} >= 0.4""")
def beacon_alerts(spark, sf):
    """Pairs of user and target with loose limits."""
    rows = flows(spark, sf).withColumn("dst_port", F.lit(443))
    found = beacons(rows, Beacon(connections=4, interval_cv=0.6, bytes_cv=2.0, min_confidence=0.4))
    return found.select("entity", "confidence", "event_start", "event_end", "flow_id", seen("connections"), seen("mean_interval_s"), seen("interval_cv"), seen("bytes_per_session_cv"), seen("internal_hosts_calling_dst"), names())


_FLOOD = combine_sql([("flow_rate_z", "greatest(z, 0)", 6, 0.35, True), ("src_ip_entropy", "entropy", 5, 0.25, True), ("syn_only_ratio", "syn_ratio", 0.1, 0.25, True)])
_WALK = combine_sql([("flow_rate_z", "greatest(x.z, 0)", 6, 0.35, True), ("src_ip_entropy", "x.entropy", 5, 0.25, True), ("syn_only_ratio", "x.syn", 0.1, 0.25, True)])[0].replace("x.z", "coalesce(CASE WHEN a.n >= 5 THEN (x.rate - a.mean) / greatest(sqrt(a.var), 0.1 * abs(a.mean), 1.0) END, 6.0::DOUBLE * x.rate / (60 / 86400.0::DOUBLE))")
_HIT = f"(x.rate >= 60 / 86400.0::DOUBLE AND {_WALK} >= 0.5)"


@query("flood_alerts", f"""WITH {FLOWS_SQL}, n AS (SELECT day, dst_ip, src_ip, count(*) AS c, count(*) FILTER (NOT ok) AS f FROM flows GROUP BY ALL),
w AS (SELECT day, dst_ip, sum(c)::BIGINT AS new_flows, sum(c) / 86400.0::DOUBLE AS rate, count(*) AS sources, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) AS entropy, sum(f) / sum(c)::DOUBLE AS syn_ratio FROM n GROUP BY day, dst_ip),
walks AS (SELECT dst_ip, list_reduce(
  list_transform(list({{'day': day, 'rate': rate, 'entropy': entropy, 'syn': syn_ratio}} ORDER BY day), lambda e: {{'n': 0, 'mean': 0.0::DOUBLE, 'var': 0.0::DOUBLE, 'hits': []::STRUCT(day DOUBLE, n INTEGER, mean DOUBLE, var DOUBLE)[], 'day': e.day::DOUBLE, 'rate': e.rate, 'entropy': e.entropy, 'syn': e.syn}}),
  lambda a, x: {{'n': CASE WHEN {_HIT} THEN a.n ELSE a.n + 1 END,
    'mean': CASE WHEN {_HIT} THEN a.mean WHEN a.n = 0 THEN x.rate ELSE a.mean + 0.1::DOUBLE * (x.rate - a.mean) END,
    'var': CASE WHEN {_HIT} THEN a.var WHEN a.n = 0 THEN 0.0::DOUBLE ELSE 0.9::DOUBLE * (a.var + (x.rate - a.mean) * (x.rate - a.mean) * 0.1::DOUBLE) END,
    'hits': CASE WHEN {_HIT} THEN list_append(a.hits, {{'day': x.day, 'n': a.n, 'mean': a.mean, 'var': a.var}}) ELSE a.hits END, 'day': x.day, 'rate': x.rate, 'entropy': x.entropy, 'syn': x.syn}},
  {{'n': 0, 'mean': 0.0::DOUBLE, 'var': 0.0::DOUBLE, 'hits': []::STRUCT(day DOUBLE, n INTEGER, mean DOUBLE, var DOUBLE)[], 'day': 0.0::DOUBLE, 'rate': 0.0::DOUBLE, 'entropy': 0.0::DOUBLE, 'syn': 0.0::DOUBLE}}).hits AS hits FROM w GROUP BY dst_ip),
hits AS (SELECT dst_ip, unnest(hits, recursive := true) FROM walks),
ends AS (SELECT dst_ip, day, arg_min(t, seq) AS first_ts, arg_min('e' || seq, seq) AS flow_id, max(t) AS last_ts FROM flows GROUP BY ALL),
rated AS (SELECT *, coalesce(CASE WHEN h.n >= 5 THEN (rate - mean) / greatest(sqrt(var), 0.1 * abs(mean), 1.0) END, 6.0::DOUBLE * rate / (60 / 86400.0::DOUBLE)) AS z FROM hits h JOIN w USING (dst_ip, day) JOIN ends USING (dst_ip, day))
SELECT dst_ip AS entity, CASE WHEN syn_ratio >= 0.1 AND entropy >= 5 THEN 'Spoofed SYN flood' WHEN syn_ratio >= 0.1 THEN 'SYN flood' ELSE 'Volumetric flood' END AS sub_type, {_FLOOD[0]} AS confidence, flow_id, first_ts AS event_start, last_ts AS event_end,
  sources::DOUBLE AS unique_sources, round(entropy, 4) AS src_ip_entropy_bits, round(syn_ratio, 4) AS syn_only_ratio, {_FLOOD[1]} AS factors FROM rated""")
def flood_alerts(spark, sf):
    """Floods with day windows, each target against its own quiet windows before."""
    found = ddos(flows(spark, sf), Ddos(window_s=DAY, flows_per_s=60 / DAY, entropy_bits=5.0, syn_only=0.1))
    return found.select("entity", "sub_type", "confidence", "flow_id", "event_start", "event_end", seen("unique_sources"), seen("src_ip_entropy_bits"), seen("syn_only_ratio"), names())


_SCAN = combine_sql([("trw_score", "score", Trw().upper, 0.4, True), ("distinct_targets", "n", 3, 0.35, True), ("failed_ratio", "failed / n::DOUBLE", 0.5, 0.25, True)])
_NONE = "[]::STRUCT(n INTEGER, score DOUBLE, failed INTEGER)[]"
_MOVED = "(CASE WHEN a.s + x.s <= -ln(99.0::DOUBLE) THEN 0.0::DOUBLE ELSE a.s + x.s END)"


@query("scan_alerts", f"""WITH {FLOWS_SQL}, f AS (SELECT src_ip, dst_ip, port, min(seq) AS seq, arg_min(ok, seq) AS ok FROM flows GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY seq) AS nth FROM f),
ends AS (SELECT seq, max(t) OVER (PARTITION BY src_ip ORDER BY seq) AS so_far FROM flows),
w AS (SELECT src_ip, list_reduce(list_transform(list(ok ORDER BY seq), lambda x: {{'s': CASE WHEN x THEN -ln(4.0::DOUBLE) ELSE ln(4.0::DOUBLE) END, 'n': 0, 'failed': (NOT x)::INTEGER, 'next': 0, 'fired': {_NONE}}}),
  lambda a, x: {{'s': {_MOVED}, 'n': a.n + 1, 'failed': a.failed + x.failed, 'next': CASE WHEN {_MOVED} >= ln(99.0::DOUBLE) AND a.n + 1 >= a.next THEN 2 * (a.n + 1) ELSE a.next END,
    'fired': CASE WHEN {_MOVED} >= ln(99.0::DOUBLE) AND a.n + 1 >= a.next THEN list_append(a.fired, {{'n': a.n + 1, 'score': {_MOVED}, 'failed': a.failed + x.failed}}) ELSE a.fired END}},
  {{'s': 0.0::DOUBLE, 'n': 0, 'failed': 0, 'next': 3, 'fired': {_NONE}}}).fired AS fired FROM c GROUP BY src_ip),
h AS (SELECT src_ip, unnest(fired, recursive := true) FROM w),
shape AS (SELECT h.src_ip, h.n, count(DISTINCT dst_ip) AS hosts, count(DISTINCT port) AS ports, arg_min('e' || seq, seq) AS flow_id, max(seq) AS seq FROM h JOIN c ON c.src_ip = h.src_ip AND c.nth <= h.n GROUP BY ALL)
SELECT src_ip AS entity, n::DOUBLE AS distinct_targets, {_SCAN[0]} AS confidence, hosts::DOUBLE AS distinct_hosts, ports::DOUBLE AS distinct_ports, round(failed / n::DOUBLE, 4) AS failed_connection_ratio, round(score, 4) AS trw_log_likelihood,
  CASE WHEN ports >= 5 * hosts THEN 'Vertical port scan' WHEN hosts >= 5 * ports THEN 'Horizontal host sweep' ELSE 'Block scan' END AS sub_type, flow_id, so_far AS event_end, {_SCAN[1]} AS factors
FROM h JOIN shape USING (src_ip, n) JOIN ends USING (seq) WHERE {_SCAN[0]} >= 0.5""")
def scan_alerts(spark, sf):
    found = scans(flows(spark, sf), Scan(gap_s=1e9, targets=3))
    return found.select("entity", seen("distinct_targets"), "confidence", seen("distinct_hosts"), seen("distinct_ports"), seen("failed_connection_ratio"), seen("trw_log_likelihood"), "sub_type", "flow_id", "event_end", names())


_UPLOAD = [("upload_volume", "sent", 5000, 0.35, True), ("pcr", "1", 0.8, 0.35, True), ("upload_zscore", "greatest(z, 0)", 4, 0.3, True)]
_KNOWN, _NEW = combine_sql(_UPLOAD), combine_sql(_UPLOAD[:2])


@query("upload_alerts", f"""WITH {FLOWS_SQL}, r AS (SELECT src_ip AS host, day, seq, t, dst_ip, bytes_fwd, sum(bytes_fwd) OVER (PARTITION BY src_ip, day ORDER BY seq)::DOUBLE AS v FROM flows),
l AS (SELECT host, day, list_reduce(list_transform(list(v ORDER BY seq), lambda x: {{'next': x, 'fired': []::DOUBLE[]}}),
  lambda a, x: CASE WHEN x.next >= a.next THEN {{'next': 2 * x.next, 'fired': list_append(a.fired, x.next)}} ELSE a END, {{'next': 5000.0::DOUBLE, 'fired': []::DOUBLE[]}}).fired AS fired FROM r GROUP BY host, day),
f AS (SELECT host, day, unnest(fired) AS sent FROM l),
hit AS (SELECT f.host, f.day, f.sent, min(r.seq) AS upto FROM f JOIN r ON r.host = f.host AND r.day = f.day AND r.v = f.sent GROUP BY ALL),
parts AS (SELECT hit.host, hit.day, hit.sent, r.dst_ip, sum(r.bytes_fwd) AS b, min(r.seq) AS s FROM hit JOIN r ON r.host = hit.host AND r.day = hit.day AND r.seq <= hit.upto AND r.bytes_fwd > 0 GROUP BY ALL),
tops AS (SELECT host, day, sent, arg_max(dst_ip, {{'b': b, 's': -s}}) AS top, max(b) AS top_bytes FROM parts GROUP BY ALL),
ends AS (SELECT hit.host, hit.day, hit.sent, max(r.t) AS event_end, min(r.t) AS event_start FROM hit JOIN r ON r.host = hit.host AND r.day = hit.day AND r.seq <= hit.upto GROUP BY ALL),
since AS (SELECT host, dst_ip AS top, min(day) AS since FROM r WHERE bytes_fwd > 0 GROUP BY ALL),
sums AS (SELECT host, day, sum(bytes_fwd)::DOUBLE AS v FROM r GROUP BY ALL),
past AS (SELECT hit.host, hit.day, hit.sent, coalesce(list(s.v ORDER BY s.day) FILTER (s.v IS NOT NULL), []::DOUBLE[]) AS past FROM hit LEFT JOIN sums s ON s.host = hit.host AND s.day < hit.day AND s.v < 5000 GROUP BY ALL),
based AS (SELECT *, list_reduce(list_transform(past, lambda x: {{'n': 0, 'm': x, 'v': 0.0::DOUBLE}}),
  lambda a, x: {{'n': a.n + 1, 'm': CASE WHEN a.n = 0 THEN x.m ELSE a.m + 0.1::DOUBLE * (x.m - a.m) END, 'v': CASE WHEN a.n = 0 THEN 0.0::DOUBLE ELSE 0.9::DOUBLE * (a.v + (x.m - a.m) * (0.1::DOUBLE * (x.m - a.m))) END}},
  {{'n': 0, 'm': 0.0::DOUBLE, 'v': 0.0::DOUBLE}}) AS s FROM past),
judged AS (SELECT *, CASE WHEN s.n >= 5 THEN (sent - s.m) / greatest(sqrt(s.v), 0.1 * abs(s.m), 1.0) END AS z FROM based JOIN tops USING (host, day, sent) JOIN ends USING (host, day, sent) JOIN since USING (host, top)),
rated AS (SELECT *, CASE WHEN z IS NULL THEN {_NEW[0]} ELSE {_KNOWN[0]} END AS confidence, CASE WHEN z IS NULL THEN {_NEW[1]} ELSE {_KNOWN[1]} END AS factors FROM judged)
SELECT host || '>' || top AS entity, CASE WHEN since >= day THEN 'Bulk upload to a new destination' ELSE 'Bulk upload' END AS sub_type, confidence, event_start, event_end, round(sent / 1048576, 4) AS bytes_out_mib,
  round(z, 4) AS upload_zscore, round(top_bytes / sent, 4) AS top_destination_share, factors FROM rated WHERE confidence >= 0.5""")
def upload_alerts(spark, sf):
    found = uploads(addressed(spark, sf), Exfil(window_s=DAY, bytes_out=5000.0))
    return found.select(F.concat(host_name(F.col("host")), F.lit(">"), "dst").alias("entity"), "sub_type", "confidence", "event_start", "event_end", seen("bytes_out_mib"), seen("upload_zscore"), seen("top_destination_share"), names())


_CLASSES = {"click": "dga", "view": "c2_beacon", "purchase": "exfiltration", "error": "recon_scan", "signup": "ddos"}
_LIVE = "STRUCT(t DOUBLE, s INTEGER, id VARCHAR)[]"
_OUT = f"STRUCT(live {_LIVE}, t DOUBLE)[]"
_OTHERS = "list_filter(a.live, lambda y: y.s <> x.live[1].s AND x.live[1].t - y.t <= 50000)"


@query("campaign_alerts", f"""WITH {FLOWS_SQL}, e AS (SELECT src_ip, t, CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 4 WHEN 'purchase' THEN 6 END AS s, 'e' || seq AS id FROM flows WHERE event_type <> 'signup'),
walks AS (SELECT src_ip, list_reduce(list_transform(list({{'t': t, 's': s::INTEGER, 'id': id}} ORDER BY t, s, id), lambda y: {{'live': [y], 'told': 0, 'out': []::{_OUT}}}),
  lambda a, x: {{'live': list_append({_OTHERS}, x.live[1]),
    'told': CASE WHEN len({_OTHERS}) + 1 >= 2 AND len({_OTHERS}) + 1 > least(a.told, len({_OTHERS}) + 1) THEN len({_OTHERS}) + 1 ELSE least(a.told, len({_OTHERS}) + 1) END::INTEGER,
    'out': CASE WHEN len({_OTHERS}) + 1 >= 2 AND len({_OTHERS}) + 1 > least(a.told, len({_OTHERS}) + 1) THEN list_append(a.out, {{'live': list_sort(list_append({_OTHERS}, x.live[1])), 't': x.live[1].t}}) ELSE a.out END}},
  {{'live': []::{_LIVE}, 'told': 0, 'out': []::{_OUT}}}).out AS hits FROM e GROUP BY src_ip),
hits AS (SELECT src_ip, h.live AS live, h.t AS t FROM (SELECT src_ip, unnest(hits) AS h FROM walks))
SELECT src_ip AS host, array_to_string(list_transform(live, lambda y: [{", ".join(f"'{w}'" for _, w in STAGES)}][y.s]), ' -> ') AS chain, len(live)::DOUBLE AS linked_stages, live[1].t AS event_start, t AS event_end,
  least(0.99, round(0.9 + 0.03 * (len(live) - 2), 4))::DOUBLE AS confidence, array_to_string(list_transform(live, lambda y: y.id), ',') AS related FROM hits""")
def campaign_alerts(spark, sf):
    kind = F.create_map(*[F.lit(x) for p in _CLASSES.items() for x in p])
    alerts = flows(spark, sf).select(F.col("src_ip").alias("host"), kind[F.col("event_type")].alias("threat_class"), F.col("first_ts").alias("detected_at"), F.col("flow_id").alias("alert_key"), "flow_id")
    found = campaigns(alerts, Fusion(correlation_s=50_000.0))
    return found.select("host", F.col("evidence")["stage_chain"]["observed"].alias("chain"), seen("linked_stages"), "event_start", "event_end", "confidence", F.array_join("related", ",").alias("related"))


@query("alert_projection", f"""WITH {FLOWS_SQL}, allow AS (SELECT '10.0.' || c_custkey // 250 || '.' || c_custkey % 250 + 1 AS ip FROM customer WHERE c_mktsegment = 'BUILDING'),
found AS (SELECT event_type AS threat_class, src_ip, src_ip || '>' || dst_ip AS entity, t, 'e' || seq AS flow_id, 0.5::DOUBLE + (bytes_fwd % 40) / 100.0::DOUBLE AS c FROM flows WHERE src_ip NOT IN (SELECT ip FROM allow)),
g AS (SELECT *, CASE WHEN t - max(t) OVER (PARTITION BY threat_class, entity ORDER BY t, c, flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 100000 THEN 0 ELSE 1 END AS fresh FROM found),
i AS (SELECT *, sum(fresh) OVER w AS island, row_number() OVER w AS nth FROM g WINDOW w AS (PARTITION BY threat_class, entity ORDER BY t, c, flow_id)),
runs AS (SELECT threat_class, entity, island, any_value(src_ip) AS ip, count(*) AS events_merged, min(t) AS event_start, max(t) AS event_end, arg_min(flow_id, nth) AS flow_id,
  list_reduce(list_transform(list({{'c': c, 'n': nth}} ORDER BY nth), lambda e: {{'held': e.c, 'n': e.n}}), lambda a, x: CASE WHEN a.n = 0 OR x.held >= a.held THEN {{'held': round(x.held, 3), 'n': x.n}} ELSE a END, {{'held': 0.0::DOUBLE, 'n': 0::BIGINT}}).held AS confidence
  FROM i GROUP BY threat_class, entity, island),
assets AS (SELECT '10.0.' || c_custkey // 250 || '.' || c_custkey % 250 + 1 AS ip, c_name, c_mktsegment, (c_nationkey % 5 + 1)::INTEGER AS criticality FROM customer),
scored AS (SELECT runs.*, c_name, c_mktsegment, coalesce(criticality, 3) AS level, round_even(least(100.0::DOUBLE, 100 * confidence * (0.6::DOUBLE + 0.1::DOUBLE * coalesce(criticality, 3))), 0)::INTEGER AS score FROM runs LEFT JOIN assets USING (ip))
SELECT threat_class, entity, flow_id, events_merged, event_start, event_end, confidence, score AS severity_score, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS severity,
  coalesce(c_name, 'unregistered') AS asset_name, coalesce(c_mktsegment, 'unknown') AS asset_zone, level AS criticality FROM scored""")
def alert_projection(spark, sf):
    """Every flow as a finding, fused: allowlist, merging with the best confidence, asset, severity."""
    customer = table(spark, sf, "customer")
    ip = F.concat(F.lit("10.0."), F.expr("c_custkey div 250"), F.lit("."), F.col("c_custkey") % 250 + 1).alias("ip")
    assets = customer.select(ip, F.col("c_name").alias("name"), F.col("c_mktsegment").alias("zone"), (F.col("c_nationkey") % 5 + 1).cast("int").alias("criticality"))
    allow = customer.filter("c_mktsegment = 'BUILDING'").select(ip)
    rows = flows(spark, sf)
    found = _findings(rows, 0.5 + (F.col("bytes_fwd") % 40) / 100.0)
    alerts = fuse(found, assets, allow, Fusion(dedup_s=100_000.0, min_stages=len(STAGES) + 1))
    return alerts.select("threat_class", "entity", "flow_id", "events_merged", "event_start", "event_end", "confidence", "severity_score", "severity", F.col("asset.name").alias("asset_name"), F.col("asset.zone").alias("asset_zone"), F.col("asset.criticality").alias("criticality"))


@query("alert_updates", f"""WITH {FLOWS_SQL}, found AS (SELECT event_type AS threat_class, src_ip || '>' || dst_ip AS entity, t, 'e' || seq AS flow_id, 0.5::DOUBLE + (bytes_fwd % 40) / 100.0::DOUBLE AS c FROM flows),
g AS (SELECT *, CASE WHEN t - max(t) OVER (PARTITION BY threat_class, entity ORDER BY t, c, flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 100000 THEN 0 ELSE 1 END AS fresh FROM found),
i AS (SELECT *, sum(fresh) OVER w AS island, row_number() OVER w AS n FROM g WINDOW w AS (PARTITION BY threat_class, entity ORDER BY t, c, flow_id)),
past AS (SELECT *, row_number() OVER v AS nth, list(c) OVER v AS cs, max(t) OVER v AS event_end, min(t) OVER v AS event_start FROM i WINDOW v AS (PARTITION BY threat_class, entity, island ORDER BY n))
SELECT CASE WHEN nth = 1 THEN 'alert' ELSE 'update' END AS kind, threat_class, entity, event_start, nth::INTEGER AS nth, event_end, nth AS events_merged, flow_id,
  list_reduce(cs, lambda a, x: CASE WHEN x >= a THEN round(x, 3) ELSE a END, 0.0::DOUBLE) AS confidence FROM past""")
def alert_updates(spark, sf):
    rows = flows(spark, sf)
    return updates(_findings(rows, 0.5 + (F.col("bytes_fwd") % 40) / 100.0), Fusion(dedup_s=100_000.0))


@query("smoothed_rate", f"""WITH {FLOWS_SQL}, h AS (SELECT floor(t / 3600)::BIGINT AS second, count(*) AS n FROM flows GROUP BY ALL),
every AS (SELECT unnest(range((SELECT min(second) FROM h), (SELECT max(second) + 1 FROM h))) AS second),
w AS (SELECT second, coalesce(n, 0) AS n, list(coalesce(n, 0)::DOUBLE) OVER (ORDER BY second) AS past FROM every LEFT JOIN h USING (second))
SELECT second, n AS events, round(list_reduce(past, lambda a, x: a + 0.2::DOUBLE * (x - a), past[1]), 6) AS rate FROM w""")
def smoothed_rate(spark, sf):
    hours = flows(spark, sf).select((F.col("first_ts") / 3600).alias("ts"))
    return smoothed_rates(hours).withColumn("rate", F.round("rate", 6))
