"""Queries of the detectors, windows, assembly and lexical functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquill.functions import net, text
from netquill.operators import assembly, features, predicates, signatures, stateless, windows
from netquill.operators.aggregates import host_inventory, protocol_mix, throughput_series, top_flows
from netquill.operators.sequential import cooldown, recon_campaigns
from netquill.plans.adapters import CONN, PACKETS, REQUESTS, SWAPPED, conn, entropy_sql, packets, requests, swapped, table

DAY = 86400
TEN = tuple(range(10))

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("e13_brute_force", f"""WITH {CONN}, n AS (SELECT *, floor(ts / 864000)::BIGINT AS bucket,
  row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port, floor(ts / 864000) ORDER BY ts, rid) AS attempt FROM conn WHERE dst_port IN (1, 3, 5, 7))
SELECT rid, src_ip, dst_ip, dst_port, bucket, ts, 'MEDIUM' AS severity, 70.0::DOUBLE AS confidence FROM n WHERE attempt = 3""")
def _(spark, d):
    hits = windows.brute_force(conn(spark, d), ports=(1, 3, 5, 7), window=10 * DAY, attempts=3)
    return hits.select("rid", "src_ip", "dst_ip", "dst_port", "bucket", "ts", "severity", "confidence")


@query("e1a_slowloris", f"""WITH {CONN} SELECT rid, duration_s, orig_bytes, resp_bytes, 85.0::DOUBLE AS confidence FROM conn
  WHERE duration_s > 500 AND orig_bytes + resp_bytes < 20000""")
def _(spark, d):
    return stateless.slowloris(conn(spark, d), 500, 20000, TEN).select("rid", "duration_s", "orig_bytes", "resp_bytes", "confidence")


_RUNNING = """f AS (SELECT *, floor(ts / 86400)::BIGINT AS bucket, (row_number() OVER (PARTITION BY {a}, floor(ts / 86400), {b} ORDER BY ts, rid) = 1)::INT AS fresh FROM {t}),
r AS (SELECT *, sum(fresh) OVER w AS n_distinct, count(*) OVER w AS n_flows FROM f WINDOW w AS (PARTITION BY {a}, bucket ORDER BY ts, rid ROWS UNBOUNDED PRECEDING)),
hits AS (SELECT *, row_number() OVER (PARTITION BY {a}, bucket ORDER BY ts, rid) AS n FROM r WHERE {c})"""


@query("e1b_flood", f"""WITH {SWAPPED}, {_RUNNING.format(a="src_ip", b="dst_ip", t="swapped", c="n_flows >= 50 AND n_flows / n_distinct >= 1.1")}
SELECT rid, src_ip, bucket, n_flows, n_distinct::BIGINT AS n_dst, least(99.0, 60 + 0.5::DOUBLE * (n_flows - 50))::DOUBLE AS confidence FROM hits WHERE n = 1""")
def _(spark, d):
    hits = windows.flood_sources(swapped(conn(spark, d)), DAY, 50, 1.1, skip=F.lit(False))
    return hits.select("rid", "src_ip", "bucket", "n_flows", "n_dst", "confidence")


@query("e1c_spoofed_flood", f"""WITH {CONN}, {_RUNNING.format(a="dst_ip", b="src_ip", t="conn", c="n_flows >= 40 AND n_distinct / n_flows >= 0.85")}
SELECT rid, dst_ip, bucket, n_flows, n_distinct::BIGINT AS n_src FROM hits WHERE n = 1""")
def _(spark, d):
    return windows.spoofed_flood(conn(spark, d), DAY, 40, 0.85, skip=F.lit(False)).select("rid", "dst_ip", "bucket", "n_flows", "n_src")


@query("e1d_flood_sketch")
def _(spark, d):
    return windows.flood_sketch(swapped(conn(spark, d)), DAY)


@query("e1d_flood_count_min", f"""WITH {CONN}, b AS (SELECT src_ip, floor(ts / 864000)::BIGINT AS bucket FROM conn),
cells AS (SELECT bucket, src_ip, i, ('0x' || substr(md5(i || '|' || src_ip), 1, 8))::BIGINT % 50 AS cell FROM b CROSS JOIN (SELECT unnest(range(5)) AS i)),
sketch AS (SELECT bucket, i, cell, count(*) AS n FROM cells GROUP BY bucket, i, cell)
SELECT bucket, src_ip, min(n) AS estimate FROM (SELECT DISTINCT * FROM cells) JOIN sketch USING (bucket, i, cell) GROUP BY bucket, src_ip HAVING min(n) >= 60""")
def _(spark, d):
    return windows.flood_count_min(conn(spark, d), 10 * DAY, 60, width=50)


@query("e2_beacons", f"""WITH {CONN},
g AS (SELECT *, ts - lag(ts) OVER w AS g0 FROM conn WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ts, rid)),
e AS (SELECT *, sum((coalesce(g0, 0) > 432000)::INT) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts, rid ROWS UNBOUNDED PRECEDING) AS era FROM g),
h AS (SELECT *, CASE WHEN lag(ts) OVER w IS NOT NULL AND g0 > 0 THEN g0 END AS gap FROM e WINDOW w AS (PARTITION BY src_ip, dst_ip, era ORDER BY ts, rid)),
s AS (SELECT *, count(gap) OVER w AS samples, avg(gap) OVER w AS mean_gap, stddev_pop(gap) OVER w AS sd, quantile_cont(gap, 0.5) OVER w AS median_gap, list(gap) OVER w AS gaps
  FROM h WINDOW w AS (PARTITION BY src_ip, dst_ip, era ORDER BY ts, rid ROWS BETWEEN 48 PRECEDING AND CURRENT ROW)),
p AS (SELECT *, sd / mean_gap AS cv, len(list_filter(gaps, lambda x: x IS NOT NULL AND abs(x - median_gap) <= 0.9 * median_gap)) / samples AS clustered FROM s
  WHERE samples >= 5 AND mean_gap BETWEEN 2 AND 432000 AND sd / mean_gap <= 0.9)
SELECT rid, src_ip, dst_ip, samples, round(mean_gap, 3) AS mean_gap, round(cv, 6) AS cv, round(clustered, 6) AS clustered FROM p WHERE clustered >= 0.6""")
def _(spark, d):
    hits = windows.beacons(conn(spark, d), min_samples=5, cv=0.9, hi=5 * DAY, cluster=0.6)
    rounded = [F.round(c, n).alias(c) for c, n in (("mean_gap", 3), ("cv", 6), ("clustered", 6))]
    return hits.select("rid", "src_ip", "dst_ip", "samples", *rounded)


#: the fold row by row: targets of the last day, cleared at 25; a campaign by its last time, its targets and the next report
RECON_SQL = f"""WITH RECURSIVE {SWAPPED}, probes AS (SELECT DISTINCT src_ip, ts, dst_ip || '|' || dst_port AS target FROM swapped),
numbered AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts, target) AS n FROM probes),
walk AS (
  SELECT DISTINCT src_ip, 0::BIGINT AS n, []::STRUCT(target VARCHAR, ts DOUBLE)[] AS seen, NULL::DOUBLE AS last, 0::BIGINT AS total, 0::BIGINT AS due,
         NULL::DOUBLE AS ts, false AS fresh, false AS escalation, 0::BIGINT AS k FROM numbered
  UNION ALL
  SELECT src_ip, n, CASE WHEN k >= 25 THEN [] ELSE held END, CASE WHEN fresh THEN t WHEN k >= 25 THEN greatest(last, t) ELSE last END,
         CASE WHEN fresh THEN k WHEN k >= 25 THEN total + k ELSE total END, CASE WHEN fresh THEN 3 * k WHEN escalation THEN 3 * (total + k) ELSE due END, t, fresh, escalation, k
  FROM (SELECT *, k >= 25 AND (last IS NULL OR t - last > 172800) AS fresh, k >= 25 AND last IS NOT NULL AND t - last <= 172800 AND total + k >= due AS escalation
    FROM (SELECT *, len(held)::BIGINT AS k FROM (
      SELECT w.src_ip, o.n, w.last, w.total, w.due, o.ts AS t,
             list_append(list_filter(w.seen, lambda x: x.target <> o.target AND x.ts >= o.ts - 86400), {{'target': o.target, 'ts': o.ts}}) AS held
      FROM walk w JOIN numbered o ON o.src_ip = w.src_ip AND o.n = w.n + 1))))
SELECT src_ip, ts, total::INT AS targets, escalation, least(95.0, 50.0 + k)::DOUBLE AS confidence FROM walk WHERE fresh OR escalation"""


@query("e5_recon_campaigns", RECON_SQL)
def _(spark, d):
    return recon_campaigns(swapped(conn(spark, d)), window=DAY, fanout=25, factor=3, silence=2 * DAY, probes=F.lit(True))


@query("e5w_recon_windows", f"""WITH {SWAPPED} SELECT src_ip, floor(ts / 86400)::BIGINT AS bucket, count(DISTINCT (dst_ip, dst_port)) AS targets, min(ts) AS ts
  FROM swapped GROUP BY ALL HAVING count(DISTINCT (dst_ip, dst_port)) >= 60""".replace("GROUP BY ALL", "GROUP BY src_ip, floor(ts / 86400)"))
def _(spark, d):
    return windows.recon_windows(swapped(conn(spark, d)), DAY, 60, probes=F.lit(True))


@query("e6a_exfil_single", f"WITH {CONN} SELECT rid, orig_bytes, resp_bytes FROM conn WHERE resp_bytes > 0 AND orig_bytes >= 100000 AND orig_bytes / resp_bytes >= 2000")
def _(spark, d):
    return stateless.exfil_single(conn(spark, d), 100_000, 2000).select("rid", "orig_bytes", "resp_bytes")


@query("e6b_exfil_accumulated", f"""WITH {CONN}, r AS (SELECT *, floor(ts / 864000)::BIGINT AS bucket, sum(orig_bytes) OVER w AS sent, sum(resp_bytes) OVER w AS received, count(*) OVER w AS n_flows
  FROM conn WHERE NOT (resp_bytes > 0 AND orig_bytes >= 4194304 AND orig_bytes / resp_bytes >= 20)
  WINDOW w AS (PARTITION BY src_ip, dst_ip, floor(ts / 864000) ORDER BY ts, rid ROWS UNBOUNDED PRECEDING))
SELECT rid, src_ip, dst_ip, bucket, sent::BIGINT AS sent, received::BIGINT AS received, n_flows FROM r WHERE sent >= 100000 AND n_flows >= 3 AND received > 0 AND sent / received >= 1000""")
def _(spark, d):
    hits = windows.exfil_accumulated(conn(spark, d), 10 * DAY, 100_000, 3, 1000)
    return hits.select("rid", "src_ip", "dst_ip", "bucket", "sent", "received", "n_flows")


@query("e6b_lineitem_exfil", """WITH f AS (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_shipdate, l_extendedprice::BIGINT AS b FROM (SELECT * REPLACE (floor(l_extendedprice) AS l_extendedprice) FROM lineitem)),
r AS (SELECT *, sum(b) OVER w AS sent, count(*) OVER w AS n_flows FROM f WINDOW w AS (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, l_linenumber, sent::BIGINT AS sent, n_flows FROM r WHERE sent >= 100000 AND n_flows >= 2""")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey", "l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "lineitem").withColumn("b", F.floor("l_extendedprice").cast("bigint"))
    rows = rows.select("l_orderkey", "l_linenumber", F.sum("b").over(w).alias("sent"), F.count("*").over(w).alias("n_flows"))
    return rows.where("sent >= 100000 and n_flows >= 2")


@query("w1_register_sweep", f"""WITH {CONN} SELECT rid, len(list_distinct(list(k) OVER (PARTITION BY src_ip ORDER BY ts, rid ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)))::INT AS register_sweep_count FROM conn""")
def _(spark, d):
    return windows.register_sweep(conn(spark, d).withColumnRenamed("k", "register_address")).select("rid", "register_sweep_count")


@query("w2_fanout_features", f"""WITH {CONN}, b AS (SELECT *, floor(ts / 86400)::BIGINT AS bucket FROM conn),
m AS (SELECT src_ip, bucket, count(DISTINCT dst_port) AS distinct_ports, count(DISTINCT dst_ip) AS distinct_hosts, count(*) AS flow_count FROM b GROUP BY src_ip, bucket)
SELECT rid, distinct_ports, distinct_hosts, flow_count FROM b JOIN m USING (src_ip, bucket)""")
def _(spark, d):
    return windows.fanout_features(conn(spark, d), DAY).select("rid", "distinct_ports", "distinct_hosts", "flow_count")


COOLDOWN_SQL = f"""WITH RECURSIVE {CONN}, kept AS (
  SELECT src_ip, dst_ip, min(ts) AS ts FROM conn GROUP BY src_ip, dst_ip
  UNION ALL SELECT c.src_ip, c.dst_ip, min(c.ts) FROM kept k JOIN conn c ON c.src_ip = k.src_ip AND c.dst_ip = k.dst_ip AND c.ts - k.ts >= 259200 GROUP BY c.src_ip, c.dst_ip)
SELECT src_ip, dst_ip, ts FROM kept"""


@query("w9_cooldown", COOLDOWN_SQL)
def _(spark, d):
    return cooldown(conn(spark, d), ["src_ip", "dst_ip"], "ts", 3 * DAY, ("rid",)).select("src_ip", "dst_ip", "ts")


# ---- lexical ---------------------------------------------------------------------------------------------------------------
_LABELS = """labels AS (SELECT rid, unnest(string_split(lower(rtrim(trim(dns_query), '.')), '.')[1:-2]) AS l FROM requests WHERE dns_query <> ''),
scored AS (SELECT rid, l, {e} AS e, length(regexp_replace(l, '[^a-z]', '', 'g')) AS letters, length(regexp_replace(l, '[^aeiou]', '', 'g')) AS vowels,
  length(regexp_replace(l, '[^0-9]', '', 'g')) / length(l) AS digits, coalesce(list_max(list_transform(regexp_extract_all(l, '[b-df-hj-np-tv-z]+'), lambda x: length(x))), 0) AS run FROM labels),
terms AS (SELECT rid, least(1.0, 0.4 * least(1, greatest(0, (e - 3) / 1.5)) + 0.3 * least(1, greatest(0, (0.3 - CASE WHEN letters > 0 THEN vowels / letters ELSE 0 END) / 0.3))
  + 0.2 * least(1, greatest(0, (run - 3) / 4.0)) + 0.1 * least(1, greatest(0, digits / 0.4)) + CASE WHEN length(l) >= 18 THEN 0.05 ELSE 0 END) AS s FROM scored)""".replace("{e}", entropy_sql("l"))


@query("x_lexical", f"""WITH {REQUESTS} SELECT rid, round({entropy_sql("dns_query")}, 6) AS entropy,
  coalesce(list_max(list_transform(regexp_extract_all(dns_query, '[A-Zb-df-hj-np-tv-z]+'), lambda x: length(x))), 0)::INT AS consonant_run,
  array_to_string(string_split(dns_query, '.')[-2:], '.') AS domain, round(length(regexp_replace(dns_query, '[^0-9]', '', 'g')) / length(dns_query), 6) AS digit_ratio FROM requests""")
def _(spark, d):
    q = F.col("dns_query")
    made = {"entropy": F.round(text.entropy(q), 6), "consonant_run": text.consonant_run(q), "domain": text.registrable_domain(q), "digit_ratio": F.round(text.char_ratio(q, "digit"), 6)}
    return requests(spark, d).select("rid", *[c.alias(n) for n, c in made.items()])


@query("x6_dga_score", f"WITH {REQUESTS}, {_LABELS} SELECT rid, round(max(s), 6) AS score FROM terms GROUP BY rid")
def _(spark, d):
    return requests(spark, d).where("dns_query <> ''").select("rid", F.round(text.dga_score(F.col("dns_query")), 6).alias("score"))


@query("e3a_dns_tunnels", f"""WITH {REQUESTS} SELECT rid, dns_query, dns_qtype FROM requests
  WHERE dns_qtype IN ('TXT', 'NULL', 'CNAME') AND dst_port <> 5353 AND dns_query LIKE '%.%' AND (length(dns_query) > 22 OR {entropy_sql("dns_query")} > 3.6)""")
def _(spark, d):
    return stateless.dns_tunnels(requests(spark, d), 22, 3.6).select("rid", "dns_query", "dns_qtype")


@query("e3b_dga_lexical", f"""WITH {REQUESTS}, {_LABELS}, best AS (SELECT rid, max(s) AS s FROM terms GROUP BY rid)
SELECT rid, round(s, 5) AS dga_score FROM requests JOIN best USING (rid) WHERE length(dns_query) > 12 AND dst_port <> 5353 AND dns_query LIKE '%.%' AND s >= 0.3
  AND NOT (dns_qtype IN ('TXT', 'NULL', 'CNAME') AND (length(dns_query) > 40 OR {entropy_sql("dns_query")} > 4.2))""")
def _(spark, d):
    return stateless.dga_lexical(requests(spark, d), 0.3).select("rid", F.round("dga_score", 5).alias("dga_score"))


@query("e3s_sni_dga", f"""WITH {REQUESTS}, {_LABELS}, best AS (SELECT rid, max(s) AS s FROM terms GROUP BY rid)
SELECT rid, 'TCP' AS proto FROM requests JOIN best USING (rid) WHERE length(dns_query) > 12 AND dst_port <> 5353 AND dns_query LIKE '%.%' AND s >= 0.55""")
def _(spark, d):
    return stateless.sni_dga(requests(spark, d), min_conf=0).select("rid", "proto")


@query("e9_http_threats", f"""WITH {REQUESTS}, j AS (SELECT *, http_method = 'POST' AND http_request_body_len > 5000000 AS large,
  http_user_agent IN ('', 'curl/8.0') AND length(http_uri) >= 12 AND {entropy_sql("http_uri")} > 3.9 AS random FROM requests)
SELECT rid, 60.0 + 15.0 * (large::INT + random::INT) AS confidence, CASE WHEN large AND random THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN large THEN 'DATA_EXFILTRATION' ELSE 'C2_BEACONING' END AS threat_class FROM j WHERE large OR random""".replace("AS confidence", "AS confidence"))
def _(spark, d):
    hits = stateless.http_threats(requests(spark, d), min_entropy=3.9)
    return hits.select("rid", F.col("confidence").cast("double").alias("confidence"), "severity", "threat_class")


@query("e8_signatures", """WITH hits AS (
  SELECT doc_id, 'secrets' AS rule, (contains(text, 'password='))::INT + (contains(text, 'token ='))::INT + (regexp_matches(text, '[0-9]{16}'))::INT AS hits, 1 AS least FROM documents
  UNION ALL SELECT doc_id, 'notice', (contains(lower(text), 'all rights reserved'))::INT + (substr(text, 1, 2) = 'Th')::INT, 2 FROM documents)
SELECT doc_id, rule, hits::BIGINT AS hits, sha256(text) AS sha256 FROM hits JOIN documents USING (doc_id) WHERE hits >= least""")
def _(spark, d):
    rules = [
        ("secrets", "a", "text", "password=", None, 1, None), ("secrets", "b", "text", "token =", None, 1, None), ("secrets", "c", "regex", "[0-9]{16}", None, 1, None),
        ("notice", "a", "nocase", "All Rights Reserved", None, 2, None), ("notice", "b", "hex", "5468", 0, 2, None),
    ]
    table_of = spark.createDataFrame(rules, "rule string, string_id string, kind string, pattern string, at_offset int, min_hits int, max_size bigint")
    return signatures.scan_signatures(table(spark, d, "documents"), table_of, "text", "doc_id").select("doc_id", "rule", "hits", "sha256")


@query("e7_ot_commands", f"""WITH {CONN}, r(c, severity, confidence) AS (SELECT unnest(range(45, 52)), 'CRITICAL', 92.0::DOUBLE UNION ALL SELECT unnest(range(58, 65)), 'CRITICAL', 92.0)
SELECT rid, k AS code, severity, confidence FROM conn JOIN r ON k = c""")
def _(spark, d):
    return stateless.ot_commands(conn(spark, d), "iec104", function="k").select("rid", F.col("k").alias("code"), "severity", "confidence")


@query("e11_kerberoasting", """SELECT c_custkey, lower(c_mktsegment) AS service FROM customer WHERE c_nationkey % 2 = 0 AND c_mktsegment <> 'MACHINERY'""")
def _(spark, d):
    rows = table(spark, d, "customer").select(
        "c_custkey", F.lower("c_mktsegment").alias("service"), F.when(F.col("c_nationkey") % 2 == 0, "TGS").otherwise("AS").alias("krb_request_type"), F.lit("rc4-hmac").alias("krb_cipher"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "HOST/a").otherwise(F.concat("c_mktsegment", F.lit("/a"))).alias("krb_service"), F.lit("u").alias("krb_client"),
    )
    return stateless.kerberoasting(rows).select("c_custkey", "service")


@query("e4_ja4_matches", """WITH intel(tier, ja4, application) AS (VALUES ('malicious', 'Brand#2', 'x'), ('dual_use', 'Brand#2', 'y'), ('dual_use', 'Brand#17', 'z'))
SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN 'malicious' ELSE 'dual_use' END AS tier, CASE WHEN p_brand = 'Brand#2' THEN 94.5 ELSE 55.0 END::DOUBLE AS confidence
FROM part WHERE p_brand IN ('Brand#2', 'Brand#17')""")
def _(spark, d):
    intel = spark.createDataFrame([("malicious", "Brand#2", "x"), ("dual_use", "Brand#2", "y"), ("dual_use", "Brand#17", "z")], "tier string, ja4 string, application string")
    flows = table(spark, d, "part").withColumnRenamed("p_brand", "ja4")
    return stateless.ja4_matches(flows, intel).select("p_partkey", "tier", "confidence")


def _turns(*kinds: str):
    return F.element_at(F.array(*map(F.lit, kinds)), F.col("k") % len(kinds) + 1)


def login_events(flows):
    return flows.withColumns({"app_function": _turns("http_basic", "http_401"), "app_detail": F.lit("/x"), "dst_port": F.lit(80)})


def mail_events(flows):
    return flows.withColumns({"app_function": _turns("smtp_vrfy", "smtp_rcpt", "smtp_reject"), "app_detail": F.col("k").cast("string"), "app_code": F.lit(0)})


def deployment_events(flows):
    code = F.when(F.col("k") % 3 == 0, F.col("k") % 2).otherwise(0)
    return flows.withColumns({"app_function": _turns("http_basic", "http_401", "http_admin_deploy"), "app_detail": F.lit("/x"), "app_code": code, "dst_port": F.lit(80)})


@query("e14_http_guessing", f"""WITH {CONN}, e AS (SELECT *, CASE k % 2 WHEN 0 THEN 'http_basic' ELSE 'http_401' END AS f FROM conn),
r AS (SELECT *, count(*) FILTER (WHERE f = 'http_basic') OVER w AS n_basic, count(*) FILTER (WHERE f = 'http_401') OVER w AS n_401 FROM e
  WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ts RANGE BETWEEN 864000 PRECEDING AND CURRENT ROW))
SELECT rid, n_basic, n_401 FROM r WHERE n_basic >= 3 AND n_401 >= 3""")
def _(spark, d):
    return windows.http_guessing(login_events(conn(spark, d)), 10 * DAY, 3).select("rid", "n_basic", "n_401")


@query("e14_smtp_enumeration", f"""WITH {CONN}, e AS (SELECT *, ['smtp_vrfy', 'smtp_rcpt', 'smtp_reject'][k % 3 + 1] AS f FROM conn),
r AS (SELECT *, len(list_distinct(list(CASE WHEN f = 'smtp_vrfy' THEN k END) OVER w)) AS n_vrfy FROM e WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ts RANGE BETWEEN 864000 PRECEDING AND CURRENT ROW))
SELECT rid, n_vrfy::INT AS n_vrfy FROM r WHERE f <> 'smtp_reject' AND n_vrfy >= 3""")
def _(spark, d):
    return windows.smtp_enumeration(mail_events(conn(spark, d)), 10 * DAY, rcpt=10_000).select("rid", "n_vrfy")


@query("e14_web_deployments", f"""WITH {CONN}, e AS (SELECT *, ['http_basic', 'http_401', 'http_admin_deploy'][k % 3 + 1] AS f FROM conn),
r AS (SELECT *, max(CASE WHEN f = 'http_basic' AND k % 2 = 1 THEN ts END) OVER w AS dts, max(CASE WHEN f <> 'http_admin_deploy' THEN ts END) OVER w AS lts, max(CASE WHEN f = 'http_401' THEN ts END) OVER w AS rts
  FROM e WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ts RANGE UNBOUNDED PRECEDING))
SELECT rid, coalesce(ts - dts < 432000, false) OR coalesce(ts - rts <= 432000 AND lts - rts <= 86400, false) AS preceded FROM r WHERE f = 'http_admin_deploy'""")
def _(spark, d):
    return windows.web_deployments(deployment_events(conn(spark, d)), 5 * DAY, DAY).select("rid", "preceded")


# ---- assembly and inventory ------------------------------------------------------------------------------------------------
_FLOWS = """fl AS (SELECT capture_id, proto, host, high, server, low, min(ts) AS ts, max(ts) - min(ts) AS duration_s, arg_min(odd, (ts, id)) AS server_first,
  sum(wire_len) FILTER (WHERE NOT odd) AS up, sum(wire_len) FILTER (WHERE odd) AS down, count(*) FILTER (WHERE NOT odd) AS up_n, count(*) FILTER (WHERE odd) AS down_n
  FROM packets GROUP BY capture_id, proto, host, high, server, low)"""


@query("a1_assemble_flows", f"""WITH {PACKETS}, {_FLOWS} SELECT capture_id, proto, host AS src_ip, high::INT AS src_port, server AS dst_ip, low::INT AS dst_port, ts, duration_s,
  coalesce(up, 0)::BIGINT AS orig_bytes, coalesce(down, 0)::BIGINT AS resp_bytes, up_n AS orig_pkts, down_n AS resp_pkts FROM fl""")
def _(spark, d):
    columns = ("capture_id", "proto", "src_ip", "src_port", "dst_ip", "dst_port", "ts", "duration_s", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")
    return assembly.assemble_flows(packets(spark, d)).select(*columns)


@query("a2_live_flows", f"""WITH {PACKETS}, g AS (SELECT *, (coalesce(ts - lag(ts) OVER w, 0) > 604800)::INT AS fresh FROM packets WINDOW w AS (PARTITION BY capture_id, proto, host, high, server, low ORDER BY ts, id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY capture_id, proto, host, high, server, low ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT capture_id, proto, host AS src_ip, server AS dst_ip, min(ts) AS ts, count(*) AS pkts FROM s GROUP BY capture_id, proto, host, high, server, low, session""")
def _(spark, d):
    flows = assembly.assemble_live(packets(spark, d), idle=7 * DAY, hard=100 * DAY)
    return flows.select("capture_id", "proto", "src_ip", "dst_ip", "ts", (F.col("orig_pkts") + F.col("resp_pkts")).alias("pkts"))


@query("a2_lifetime_cut")
def _(spark, d):
    return assembly.assemble_live(packets(spark, d).withColumns({"sport": F.lit(40000), "dport": F.lit(80)}), idle=30 * DAY, hard=3 * DAY)


@query("a3_snapshots", f"""WITH {PACKETS}, t AS (SELECT capture_id, proto, host, high, server, low, floor(ts / 604800)::BIGINT AS tick, sum(wire_len) AS b, count(*) AS p, min(ts) AS t0 FROM packets
  GROUP BY capture_id, proto, host, high, server, low, floor(ts / 604800))
SELECT capture_id, host AS ip, tick, min(t0) OVER w AS ts, (sum(b) OVER w)::BIGINT AS total_bytes, (sum(p) OVER w)::BIGINT AS total_pkts FROM t
  WINDOW w AS (PARTITION BY capture_id, proto, host, high, server, low ORDER BY tick ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    return assembly.flow_snapshots(packets(spark, d), 7 * DAY).select("capture_id", F.col("a.ip").alias("ip"), "tick", "ts", "total_bytes", "total_pkts")


@query("g10_host_inventory", f"""WITH {PACKETS}, e AS (SELECT src AS ip, true AS tx, ts, wire_len, proto, src_mac AS mac FROM packets UNION ALL SELECT dst, false, ts, wire_len, proto, NULL FROM packets)
SELECT ip, min(ts) AS first_seen, max(ts) AS last_seen, count(*) FILTER (WHERE tx) AS tx_pkts, count(*) FILTER (WHERE NOT tx) AS rx_pkts,
  coalesce(sum(wire_len) FILTER (WHERE tx), 0)::BIGINT AS tx_bytes, coalesce(sum(wire_len) FILTER (WHERE NOT tx), 0)::BIGINT AS rx_bytes,
  count(*) FILTER (WHERE proto = 'TCP') AS tcp, count(*) FILTER (WHERE proto = 'UDP') AS udp, count(*) FILTER (WHERE proto = 'ICMP') AS other, max(mac) AS mac, false AS via_arp FROM e GROUP BY ip""")
def _(spark, d):
    return host_inventory(packets(spark, d))


@query("g11_protocol_mix", f"""WITH {PACKETS} SELECT CASE WHEN proto = 'ICMP' THEN 'ICMP' WHEN low = 443 THEN CASE proto WHEN 'TCP' THEN 'HTTPS/TLS' ELSE 'QUIC' END WHEN low = 53 THEN 'DNS' WHEN low = 80 THEN 'HTTP'
  WHEN low = 22 THEN 'SSH' ELSE 'other-' || proto END AS protocol, count(*) AS pkts, sum(wire_len)::BIGINT AS bytes FROM packets GROUP BY 1""")
def _(spark, d):
    return protocol_mix(packets(spark, d))


@query("g12_top_flows", f"WITH {CONN} SELECT flow_uid, orig_bytes + resp_bytes AS total_bytes FROM conn ORDER BY total_bytes DESC, flow_uid LIMIT 50")
def _(spark, d):
    return top_flows(conn(spark, d)).select("flow_uid", "total_bytes")


@query("g14_throughput", f"""WITH {PACKETS}, s AS (SELECT floor(ts / 3600)::BIGINT AS slot, count(*) / 3600 AS pps, sum(wire_len) * 8 / 1e6 / 3600 AS mbit_s FROM packets GROUP BY 1)
SELECT slot, round(pps, 9) AS pps, round(mbit_s, 9) AS mbit_s, round(max(pps) OVER (ORDER BY slot ROWS UNBOUNDED PRECEDING), 9) AS peak_pps, pps >= 0.005 AS high FROM s""")
def _(spark, d):
    made = throughput_series(packets(spark, d), 3600, 0.005, 1e9, block=24)
    return made.select("slot", *[F.round(c, 9).alias(c) for c in ("pps", "mbit_s", "peak_pps")], "high")


# ---- expressions -----------------------------------------------------------------------------------------------------------
@query("x11_addresses", """WITH a AS (SELECT o_orderkey, (o_orderkey * 7 % 256) || '.' || (o_orderkey * 3 % 256) || '.' || (o_custkey % 256) || '.' || (o_orderkey % 256) AS ip,
  o_orderkey * 7 % 256 AS p, o_orderkey * 3 % 256 AS q, o_custkey % 256 AS r, o_orderkey % 256 AS s FROM orders)
SELECT o_orderkey, ip, (p * 16777216 + q * 65536 + r * 256 + s)::BIGINT AS number,
  p = 10 OR p = 127 OR (p = 172 AND q BETWEEN 16 AND 31) OR (p = 192 AND q = 168) OR (p = 169 AND q = 254) AS private,
  (p BETWEEN 224 AND 239) OR (s = 255 AND (p = 10 OR (p = 172 AND q BETWEEN 16 AND 31) OR (p = 192 AND q = 168) OR (p = 169 AND q = 254))) AS multicast FROM a""")
def _(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ip = F.concat_ws(".", *[(x % 256).cast("string") for x in (key * 7, key * 3, cust, key)])
    rows = table(spark, d, "orders").select("o_orderkey", ip.alias("ip"))
    return rows.select("o_orderkey", "ip", net.ip_long(F.col("ip")).alias("number"), net.is_private(F.col("ip")).alias("private"), net.is_multicast(F.col("ip")).alias("multicast"))


@query("p_hashes", f"""WITH {CONN} SELECT rid, substr(sha256(src_ip || ':' || dst_port || '-' || dst_ip || ':0-TCP'), 1, 16) AS uid, sha256(src_ip || '|' || dst_ip) AS parts,
  'tcp/' || dst_port AS service, strftime(make_timestamp((ts * 1000000)::BIGINT - ((ts * 1000000)::BIGINT % 1000000)), '%Y-%m-%dT%H:%M:%SZ') AS at FROM conn""")
def _(spark, d):
    a, b = F.concat_ws(":", "src_ip", "dst_port"), F.concat(F.col("dst_ip"), F.lit(":0"))
    made = {"uid": net.flow_uid(a, b, F.col("proto")), "parts": net.parts_hash(F.col("src_ip"), F.col("dst_ip")), "service": net.service_key(F.col("proto"), F.col("dst_port")),
            "at": net.iso_time(F.floor("ts").cast("double"))}
    return conn(spark, d).select("rid", *[c.alias(n) for n, c in made.items()])


@query("f2_local_resolution", f"WITH {REQUESTS} SELECT rid, dst_port = 5353 OR NOT dns_query LIKE '%.%' AS local FROM requests")
def _(spark, d):
    return requests(spark, d).select("rid", predicates.is_local_resolution(F.col("dst_port"), F.col("dst_ip"), F.col("dns_query")).alias("local"))


@query("f9_search_terms", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND NOT contains(lower(text), 'password')")
def _(spark, d):
    return predicates.search_terms(table(spark, d, "documents"), "text", "THE !password").select("doc_id")


@query("m1_flow_features", f"""WITH {CONN} SELECT rid, (orig_bytes + resp_bytes)::DOUBLE AS total_bytes, round(orig_bytes / greatest(resp_bytes, 1), 6) AS byte_ratio,
  round((orig_bytes + resp_bytes) / CASE WHEN duration_s = 0 THEN 1e-6 ELSE duration_s END, 3) AS bytes_per_second, 1.0::DOUBLE AS proto_tcp FROM conn""")
def _(spark, d):
    made = features.flow_features(conn(spark, d))
    return made.select("rid", "total_bytes", F.round("byte_ratio", 6).alias("byte_ratio"), F.round("bytes_per_second", 3).alias("bytes_per_second"), "proto_tcp")


@query("m2_dns_features")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    made = features.dns_features(requests(spark, d).withColumnRenamed("dns_query", "domain"))
    return made.select("rid", *[F.round(c, 6).alias(c) for c in features.DNS], vector_to_array("dns_grams").alias("dns_grams"))


@query("m3_tls_features")
def _(spark, d):
    return features.tls_features(requests(spark, d).withColumn("ja4", F.col("dns_qtype"))).select("rid", *features.TLS)


@query("s11_dedup_files", "SELECT sha256(html) AS sha256, min(page_id) AS path, count(*) AS copies FROM pages GROUP BY 1")
def _(spark, d):
    from netquill.sources.readers import dedup_files

    return dedup_files(table(spark, d, "pages"), "page_id", "html")


@query("s10_packets_page", f"WITH {PACKETS} SELECT id, proto FROM packets WHERE id >= 100 AND proto = 'UDP' ORDER BY id LIMIT 200")
def _(spark, d):
    from netquill.sources.readers import packets_page

    return packets_page(packets(spark, d), 100, 200, "udp")[0].select("id", "proto")
