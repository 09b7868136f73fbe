"""Queries of the alert filters, joins, aggregations, evaluation, models, baseline and streams."""

from __future__ import annotations

from pyspark.sql import functions as F


from netquill.operators import aggregates as agg
from netquill.operators import baseline, evaluation, joins, models, predicates, stateless
from netquill.operators.mapping import build_alert, field_dictionary, flatten_alert, nest_alert
from netquill.operators.sequential import alert_cooldown
from netquill.plans.adapters import ALERTS, CONN, PACKETS, alerts, conn, packets, scratch, table
from netquill.plans.detect_queries import COOLDOWN_SQL, DAY
from netquill.sources import sinks

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _nested(spark, d):
    return nest_alert(alerts(spark, d)).withColumns({"forensics": F.lit("{}"), "model_scores": F.lit(None).cast("map<string,double>")})


@query("f8_list_alerts", f"WITH {ALERTS} SELECT alert_id, timestamp, severity FROM alerts WHERE severity = 'HIGH' AND timestamp >= 883612800 ORDER BY timestamp DESC, alert_id LIMIT 100")
def _(spark, d):
    return predicates.list_alerts(alerts(spark, d), severity="HIGH", since=883612800).select("alert_id", "timestamp", "severity")


@query("f10_discover", f"WITH {ALERTS} SELECT alert_id FROM alerts WHERE severity = 'HIGH' AND (src_ip LIKE '%c77%' OR rule LIKE '%c77%')")
def _(spark, d):
    return predicates.discover(alerts(spark, d), "C77", {"severity": "HIGH"}).select("alert_id")


@query("f11_workspace", f"WITH {ALERTS} SELECT alert_id FROM alerts WHERE threat_class = '1-URGENT' AND (src_ip LIKE '%c1%' OR dst_ip LIKE '%c1%' OR technique_id LIKE '%c1%')")
def _(spark, d):
    return predicates.workspace_filter(alerts(spark, d), "c1", threat_class="1-URGENT").select("alert_id")


@query("f13_filter_hosts", f"""WITH {PACKETS}, e AS (SELECT src AS ip, wire_len, src_mac AS mac FROM packets UNION ALL SELECT dst, wire_len, NULL FROM packets)
SELECT ip, sum(wire_len)::BIGINT AS bytes FROM e GROUP BY ip HAVING contains(ip || ' ' || coalesce(max(mac), ''), 'h1')""")
def _(spark, d):
    return predicates.filter_hosts(agg.host_inventory(packets(spark, d)), text="H1").select("ip", (F.col("tx_bytes") + F.col("rx_bytes")).alias("bytes"))


@query("f15_live_alerts", f"WITH {ALERTS} SELECT severity, count(*) AS n FROM alerts WHERE dst_ip LIKE '%d4%' OR src_ip LIKE '%d4%' GROUP BY severity")
def _(spark, d):
    return predicates.live_alert_filter(alerts(spark, d), text="d4").groupBy("severity").agg(F.count("*").alias("n"))


@query("g1_alert_counts", f"""WITH {ALERTS} SELECT 'severity' AS field, severity AS value, count(*) AS n FROM alerts GROUP BY 2 UNION ALL SELECT 'threat_class', threat_class, count(*) FROM alerts GROUP BY 2
UNION ALL SELECT 'detection_mode', detection_mode, count(*) FROM alerts GROUP BY 2""")
def _(spark, d):
    return agg.alert_counts(alerts(spark, d))


@query("g2_engine_coverage", f"WITH {ALERTS}, {CONN} SELECT engine, (SELECT count(*) FROM conn) AS records, count(*) AS alerts FROM alerts GROUP BY engine UNION ALL SELECT 'idle', 0, 0")
def _(spark, d):
    n = conn(spark, d).agg(F.count("*").alias("records"))
    seen = n.select(F.explode(F.array(*map(F.lit, ("flood", "recon", "dga")))).alias("engine"), "records")
    idle = n.select(F.lit("idle").alias("engine"), F.lit(0).cast("bigint").alias("records"))
    return agg.engine_coverage(seen.unionByName(idle), alerts(spark, d))


@query("g3_capture_summary", "SELECT 'conn' AS log_type, count(*) AS records FROM events UNION ALL SELECT 'dns', count(*) FROM pages")
def _(spark, d):
    return agg.capture_summary({"dns": table(spark, d, "pages"), "conn": conn(spark, d)})


@query("g4_terms", f"WITH {ALERTS} SELECT src_ip AS bucket, count(*) AS value FROM alerts WHERE severity = 'HIGH' GROUP BY 1 ORDER BY value DESC, bucket LIMIT 10")
def _(spark, d):
    return agg.aggregate(alerts(spark, d), {"filters": {"severity": "HIGH"}, "bucket": {"terms": "src_ip", "size": 10}})


@query("g4_date_histogram", f"WITH {ALERTS} SELECT floor(timestamp / 86400)::BIGINT * 86400 AS bucket, severity AS split, max(confidence_score) AS value FROM alerts GROUP BY ALL")
def _(spark, d):
    cfg = {"bucket": {"time": "timestamp", "every": "day"}, "metric": ("max", "confidence_score"), "split": "severity"}
    return agg.aggregate(alerts(spark, d), cfg)


for _name, _cfg, _sql in (
    ("targets", agg.PRESETS["targets"], "SELECT dst_ip AS bucket, count(DISTINCT src_ip) AS value FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    ("classes", agg.PRESETS["classes"], "SELECT threat_class AS bucket, count(*) AS value FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    ("severity_over_time", agg.PRESETS["severity_over_time"], "SELECT floor(timestamp / 3600)::BIGINT * 3600 AS bucket, severity AS split, count(*) AS value FROM alerts GROUP BY ALL"),
):
    query(f"g5_{_name}", f"WITH {ALERTS} {_sql}")(lambda spark, d, cfg=_cfg: agg.aggregate(alerts(spark, d), cfg))


@query("g6_distinct_values", f"WITH {ALERTS} SELECT DISTINCT src_ip FROM alerts ORDER BY src_ip LIMIT 30")
def _(spark, d):
    return agg.distinct_values(alerts(spark, d), "src_ip")


@query("g7_time_histogram", f"""WITH {ALERTS}, s AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM alerts),
c AS (SELECT least(floor((timestamp - lo) / (hi - lo) * 12), 11)::INT AS bin, count(*) AS n FROM alerts, s GROUP BY 1)
SELECT r.bin::INT AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(12)) AS bin) r LEFT JOIN c ON c.bin = r.bin""")
def _(spark, d):
    return agg.time_histogram(alerts(spark, d))


@query("g8_top_values", f"""WITH {ALERTS}, c AS (SELECT 'src_ip' AS field, src_ip AS value, count(*) AS n FROM alerts GROUP BY 2 UNION ALL SELECT 'dst_ip', dst_ip, count(*) FROM alerts GROUP BY 2
  UNION ALL SELECT 'tactic', tactic, count(*) FROM alerts GROUP BY 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value)::INT AS rank FROM c)
SELECT field, value, n, rank FROM r WHERE rank <= 5""")
def _(spark, d):
    return agg.top_values(alerts(spark, d), ["src_ip", "dst_ip", "tactic"])


@query("g9_dashboard", f"""WITH {ALERTS}, {CONN} SELECT count(*) AS alerts, (SELECT count(*) FROM conn) AS flows, round(100 * count(*) / (SELECT count(*) FROM conn), 2) AS flagged_pct, 'day' AS every FROM alerts""")
def _(spark, d):
    return agg.dashboard_kpis(alerts(spark, d), conn(spark, d))


@query("g13_coverage", f"""WITH {PACKETS}, seen AS (SELECT DISTINCT src AS ip FROM packets UNION SELECT dst FROM packets), known AS (SELECT DISTINCT 'h' || (c_custkey % 400) AS ip FROM customer)
SELECT count(*) AS known, count(*) FILTER (WHERE false) AS visible, 0.0::DOUBLE AS ratio, 'own-traffic-only' AS verdict FROM known WHERE ip <> 'h1'""")
def _(spark, d):
    known = table(spark, d, "customer").select(F.concat(F.lit("h"), (F.col("c_custkey") % 400).cast("string")).alias("ip"))
    return agg.coverage_verdict(agg.host_inventory(packets(spark, d)), known, spark.createDataFrame([("h1",)], "ip string"))


@query("g15_latency", f"""WITH {CONN}, o AS (SELECT dst_ip, value, row_number() OVER (PARTITION BY dst_ip ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY dst_ip) AS n FROM conn)
SELECT dst_ip, max(n) AS n, min(value) FILTER (WHERE i = least(n - 1, floor(0.5 * n))) AS p50, min(value) FILTER (WHERE i = least(n - 1, floor(0.95::DOUBLE * n))) AS p95,
  min(value) FILTER (WHERE i = least(n - 1, floor(0.99::DOUBLE * n))) AS p99, max(value) AS max FROM o GROUP BY dst_ip""")
def _(spark, d):
    return agg.latency_summary(conn(spark, d), "value", ["dst_ip"])


@query("g17_triage", f"""WITH {ALERTS} SELECT threat_class, detection_mode, dst_port, rule AS signature, count(*) AS alerts, count(DISTINCT file) AS captures, count(DISTINCT src_ip) AS src_hosts,
  count(DISTINCT dst_ip) AS dst_hosts, min(alert_id) AS example FROM alerts GROUP BY ALL""")
def _(spark, d):
    return agg.triage_groups(_nested(spark, d), "file")


@query("g19_trend", f"WITH {CONN} SELECT round(regr_slope(value, ts) * 3600, 9) AS slope_per_hour, count(*) AS samples FROM conn WHERE ts >= (SELECT min(ts) FROM conn) + 86400")
def _(spark, d):
    return agg.trend_slope(conn(spark, d), "ts", "value", DAY).withColumn("slope_per_hour", F.round("slope_per_hour", 9))


@query("g20_by_severity", f"WITH {ALERTS} SELECT alert_id, severity FROM alerts")
def _(spark, d):
    return agg.by_severity(alerts(spark, d)).select("alert_id", "severity")


@query("p13_field_dictionary", """SELECT 'r_regionkey' AS field, 'int' AS type, true AS aggregatable, min(r_regionkey)::VARCHAR AS sample FROM region UNION ALL SELECT 'r_name', 'string', true, min(r_name) FROM region""")
def _(spark, d):
    return field_dictionary(table(spark, d, "region"))


# ---- joins -----------------------------------------------------------------------------------------------------------------
@query("j2_corroborate", f"""WITH {CONN}, {ALERTS} SELECT flow_uid, flow_uid IN (SELECT alert_id FROM alerts WHERE detection_mode = 'xgboost') AS corroborated FROM conn""")
def _(spark, d):
    rules = alerts(spark, d).where("detection_mode = 'xgboost'").select(F.col("alert_id").alias("flow_uid"))
    return joins.corroborate(conn(spark, d), rules).select("flow_uid", "corroborated")


_RULES = [
    ("r-port", "scanner", 0, ["5-LOW"], None, None, None, None, None, [1, 2, 3], None, None, None, True),
    ("r-evidence", "known", 1, None, ["HIGH"], None, None, None, None, None, {"rule": "r5"}, None, None, True),
    ("r-critical", "accepted", 2, None, None, None, None, None, None, [7], None, None, True, True),
]
_RULE_DDL = (
    "id string, reason string, rule_order int, threat_class array<string>, severity array<string>, detection_mode array<string>, src array<string>, dst array<string>,"
    " src_port array<int>, dst_port array<int>, evidence map<string,string>, expires string, critical_ok boolean, enabled boolean"
)


@query("j3_allowlist", f"""WITH {ALERTS}, m AS (SELECT alert_id, CASE WHEN threat_class = '5-LOW' AND dst_port IN (1, 2, 3) AND severity <> 'CRITICAL' THEN 'r-port'
  WHEN severity = 'HIGH' AND rule = 'r5' THEN 'r-evidence' WHEN dst_port = 7 THEN 'r-critical' END AS rule_id FROM alerts) SELECT * FROM m WHERE rule_id IS NOT NULL""")
def _(spark, d):
    return joins.apply_allowlist(_nested(spark, d), spark.createDataFrame(_RULES, _RULE_DDL))[1].select("alert_id", "rule_id")


@query("g18_suppression_audit", f"""WITH {ALERTS}, m AS (SELECT CASE WHEN threat_class = '5-LOW' AND dst_port IN (1, 2, 3) AND severity <> 'CRITICAL' THEN 'r-port'
  WHEN severity = 'HIGH' AND rule = 'r5' THEN 'r-evidence' WHEN dst_port = 7 THEN 'r-critical' END AS rule_id FROM alerts) SELECT rule_id, count(*) AS hits FROM m WHERE rule_id IS NOT NULL GROUP BY rule_id""")
def _(spark, d):
    return agg.suppression_audit(joins.apply_allowlist(_nested(spark, d), spark.createDataFrame(_RULES, _RULE_DDL))[1])[0]


@query("j5_ids_mapping", """WITH n(i, category, cls) AS (VALUES (0, 'Web Application Attack', 'NETWORK_INTRUSION_ATTEMPT'), (1, 'Attempted Denial of Service', 'VOLUMETRIC_DDOS'), (2, 'Odd', 'NETWORK_INTRUSION_ATTEMPT'))
SELECT c_custkey AS signature_id, cls AS threat_class, CASE c_custkey % 4 WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE c_custkey % 4 WHEN 1 THEN 90.0 WHEN 2 THEN 70.0 ELSE 50.0 END::DOUBLE AS confidence
FROM customer JOIN n ON c_custkey % 3 = i""")
def _(spark, d):
    category = F.element_at(F.array(F.lit("Web Application Attack"), F.lit("Attempted Denial of Service"), F.lit("Odd")), (F.col("c_custkey") % 3 + 1).cast("int"))
    alert = F.struct(F.lit("s").alias("signature"), F.col("c_custkey").alias("signature_id"), category.alias("category"), (F.col("c_custkey") % 4).cast("int").alias("severity"))
    eve = table(spark, d, "customer").select(
        F.lit("alert").alias("event_type"), F.lit("a").alias("src_ip"), F.lit("b").alias("dest_ip"), F.lit("tcp").alias("proto"), F.lit(1).alias("src_port"), F.lit(2).alias("dest_port"),
        F.lit(1.0).alias("timestamp_epoch"), alert.alias("alert"),
    )
    return stateless.map_ids_alerts(eve).select("signature_id", "threat_class", "severity", "confidence")


@query("j5_notice_mapping", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'T1078.002' WHEN 1 THEN 'T1135' ELSE 'T1021' END AS technique_id, CASE c_custkey % 3 WHEN 1 THEN 'Discovery' WHEN 0 THEN 'Discovery' ELSE 'Lateral Movement' END AS tactic FROM customer""")
def _(spark, d):
    i = F.col("c_custkey") % 3
    rows = table(spark, d, "customer").select(
        "c_custkey", F.when(i < 2, "BZAR::ATTACK::Discovery").otherwise("BZAR::Other").alias("note"), F.when(i == 0, "saw T1078.002 here").otherwise("none").alias("msg"), F.lit("a").alias("src"),
        F.lit("b").alias("dst"), F.lit(445).alias("p"), F.lit(1.0).alias("ts"),
    )
    return stateless.map_notices(rows).select("c_custkey", "technique_id", "tactic")


@query("j6_new_only", f"WITH {ALERTS} SELECT alert_id, severity FROM alerts WHERE o_orderkey % 10 <> 3")
def _(spark, d):
    stored = table(spark, d, "orders").where("o_orderkey % 10 = 3").select(F.col("o_orderkey").cast("string").alias("alert_id"))
    a = alerts(spark, d)
    return sinks.new_only(a.unionByName(a), stored).select("alert_id", "severity")


_TRUTH = """truth AS (SELECT DISTINCT o_orderpriority AS expected_alert, 'k' || (floor(epoch_us(o_orderdate) / 1e6 / 31536000)::BIGINT) AS category, floor(epoch_us(o_orderdate) / 1e6 / 31536000)::BIGINT * 31536000.0::DOUBLE AS start_ts,
  floor(epoch_us(o_orderdate) / 1e6 / 31536000)::BIGINT * 31536000.0::DOUBLE + 864000 AS end_ts FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query("j7_ground_truth", f"""WITH {ALERTS}, {_TRUTH}, p AS (SELECT alert_id, category, start_ts FROM alerts JOIN truth ON timestamp BETWEEN start_ts AND end_ts AND threat_class = expected_alert)
SELECT t.category, t.start_ts, CASE WHEN count(p.alert_id) > 0 THEN 'found' ELSE 'missed' END AS outcome, count(DISTINCT p.alert_id) AS alerts FROM truth t LEFT JOIN p ON p.category = t.category AND p.start_ts = t.start_ts GROUP BY 1, 2
UNION ALL SELECT threat_class, min(timestamp), 'unexpected', count(*) FROM alerts WHERE alert_id NOT IN (SELECT alert_id FROM p) GROUP BY 1""")
def _(spark, d):
    a = alerts(spark, d)
    year = F.floor(F.col("timestamp") / 31536000)
    truth = a.where("threat_class = '1-URGENT'").select(
        F.col("threat_class").alias("expected_alert"), F.concat(F.lit("k"), year.cast("string")).alias("category"), (year * 31536000.0).alias("start_ts"), (year * 31536000.0 + 864000).alias("end_ts")
    )
    return joins.match_ground_truth(a, truth.distinct(), slot=10 * DAY)


@query("j8_detection_latency", f"""WITH {CONN}, ev AS (SELECT rid AS event_id, ts AS event_ts, dst_ip AS threat_class FROM conn WHERE k = 1), al AS (SELECT flow_uid AS alert_id, ts, dst_ip AS threat_class FROM conn WHERE k > 90),
j AS (SELECT event_id, min(al.ts - event_ts) AS latency FROM ev JOIN al ON al.threat_class = ev.threat_class AND al.ts BETWEEN event_ts - 600 AND event_ts + 14400 GROUP BY event_id)
SELECT event_id, round(latency, 3) AS latency_s FROM ev LEFT JOIN j USING (event_id)""")
def _(spark, d):
    c = conn(spark, d)
    events = c.where("k = 1").select(F.col("rid").alias("event_id"), F.col("ts").alias("event_ts"), F.col("dst_ip").alias("threat_class"))
    found = c.where("k > 90").select(F.col("flow_uid").alias("alert_id"), F.col("ts").alias("timestamp"), F.col("dst_ip").alias("threat_class"))
    return joins.detection_latency(events, found, 600, 14400).select("event_id", F.round("latency_s", 3).alias("latency_s"))


@query("j9_silent_hosts", "SELECT c_custkey AS ip FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey % 50 <> 0")
def _(spark, d):
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("ip"))
    seen = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("ip"))
    return joins.silent_hosts(known, seen, known.where("ip % 50 = 0"))


@query("j10_gateways", """WITH h AS (SELECT CASE WHEN s_suppkey % 5 = 0 THEN '10.0.' ELSE '8.8.' END || (s_suppkey // 250) || '.' || (s_suppkey % 250) AS ip, 'm' || (s_suppkey % 20) AS mac, s_suppkey % 5 = 0 AS own FROM supplier),
r AS (SELECT mac, count(DISTINCT ip) AS n FROM h WHERE NOT own GROUP BY mac) SELECT ip, own AND coalesce(n, 0) >= 3 AS gateway FROM h LEFT JOIN r USING (mac)""")
def _(spark, d):
    k = F.col("s_suppkey")
    net_ = F.when(k % 5 == 0, "10.0.").otherwise("8.8.")
    ip = F.concat(net_, F.floor(k / 250).cast("string"), F.lit("."), (k % 250).cast("string"))
    hosts = table(spark, d, "supplier").select(ip.alias("ip"), F.concat(F.lit("m"), (k % 20).cast("string")).alias("mac"))
    return joins.mark_gateways(hosts).select("ip", "gateway")


# ---- alert structure -------------------------------------------------------------------------------------------------------
@query("k2_rejected_alerts", f"WITH {ALERTS} SELECT alert_id, severity FROM alerts WHERE confidence_score + 55 > 100")
def _(spark, d):
    ok = _nested(spark, d).withColumn("threat_class", F.lit("RECONNAISSANCE")).withColumn("confidence_score", F.col("confidence_score") + 55)
    return sinks.validate_alerts(ok)[1].select("alert_id", "severity")


@query("p11_flatten", f"WITH {ALERTS} SELECT alert_id, src_ip, dst_port, technique_id FROM alerts")
def _(spark, d):
    return flatten_alert(_nested(spark, d)).select("alert_id", "src_ip", "dst_port", "technique_id")


@query("k3_documents", f"""WITH {ALERTS} SELECT alert_id AS _id, strftime(make_timestamp((timestamp * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS "@timestamp" FROM alerts""")
def _(spark, d):
    return sinks.to_documents(_nested(spark, d)).select("_id", "@timestamp")


@query("k4_store_and_load", f"WITH {ALERTS} SELECT alert_id, timestamp FROM alerts ORDER BY timestamp DESC, alert_id LIMIT 500")
def _(spark, d):
    path = scratch(spark, "alerts")
    rows = _nested(spark, d).where("timestamp is not null")
    sinks.append_alerts(rows.where("cast(alert_id as bigint) % 2 = 0"), path)
    sinks.append_alerts(rows, path)
    return sinks.load_alerts(spark, path)[0].select("alert_id", "timestamp")


@query("p9_built_alerts", f"WITH {CONN} SELECT count(*) AS alerts, count(*) AS ids, 'SLOWLORIS' AS threat_class FROM conn WHERE duration_s > 500 AND orig_bytes + resp_bytes < 20000")
def _(spark, d):
    hits = stateless.slowloris(conn(spark, d), 500, 20000, tuple(range(10)))
    made = build_alert(hits, "slowloris", "SLOWLORIS", F.col("severity"), F.col("confidence"), ("Impact", "T1499", "Endpoint Denial of Service"), ["duration_s", "orig_bytes"])
    return sinks.validate_alerts(made)[0].groupBy("threat_class").agg(F.count("*").alias("alerts"), F.countDistinct("alert_id").alias("ids")).select("alerts", "ids", "threat_class")


@query("w9_alert_cooldown", f"""WITH RECURSIVE {ALERTS}, kept AS (
  SELECT threat_class, src_ip, dst_ip, rule, min(timestamp) AS timestamp FROM alerts GROUP BY threat_class, src_ip, dst_ip, rule
  UNION ALL SELECT a.threat_class, a.src_ip, a.dst_ip, a.rule, min(a.timestamp) FROM kept k JOIN alerts a
    ON (a.threat_class, a.src_ip, a.dst_ip, a.rule) = (k.threat_class, k.src_ip, k.dst_ip, k.rule) AND a.timestamp - k.timestamp >= 2592000
  GROUP BY a.threat_class, a.src_ip, a.dst_ip, a.rule)
SELECT min(alert_id) AS alert_id, threat_class, timestamp FROM kept JOIN alerts USING (threat_class, src_ip, dst_ip, rule, timestamp)
GROUP BY threat_class, src_ip, dst_ip, rule, timestamp""")
def _(spark, d):
    return alert_cooldown(_nested(spark, d), 30 * DAY).select("alert_id", "threat_class", "timestamp")


# ---- evaluation ------------------------------------------------------------------------------------------------------------
_SCORED = "scored AS (SELECT doc_id, toxic AS label, quality, n_chars % 1000 / 1000 AS score FROM labels JOIN documents USING (doc_id))"


def _scored(spark, d):
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.select("doc_id", F.col("toxic").alias("label"), "quality", (F.col("n_chars") % 1000 / 1000).alias("score"))


@query("m11_binary_metrics", f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn FROM scored),
a AS (SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM scored p, scored n WHERE p.label = 1 AND n.label = 0)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(auc, 9) AS roc_auc FROM c, a""")
def _(spark, d):
    m = models.binary_metrics(_scored(spark, d))
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "roc_auc")])


_WILSON = "({k} / {n} + 3.8416 / (2 * {n}) + 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8416 / (4 * {n} * {n}))) / (1 + 3.8416 / {n})"


@query("m15_operating_points", f"""WITH {_SCORED}, c AS (SELECT t AS threshold, count(*) FILTER (WHERE label = 0 AND score >= t) AS fp, count(*) FILTER (WHERE label = 0) AS benign,
  count(*) FILTER (WHERE label = 1 AND score >= t) AS tp, count(*) FILTER (WHERE label = 1) AS attacks FROM scored, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99]::DOUBLE[]) AS t) GROUP BY t)
SELECT threshold, fp, benign, tp, attacks, round(fp / benign, 9) AS fpr, round({_WILSON.format(k="fp", n="benign")}, 9) AS fpr_upper, round(tp / attacks, 9) AS recall FROM c""")
def _(spark, d):
    m = models.operating_points(_scored(spark, d))
    return m.select("threshold", "fp", "benign", "tp", "attacks", *[F.round(c, 9).alias(c) for c in ("fpr", "fpr_upper", "recall")])


@query("m16_score_floors", f"WITH {ALERTS}, f AS (SELECT unnest([10, 20, 30, 40]) AS floor) SELECT floor, count(DISTINCT src_ip) AS names FROM alerts JOIN f ON confidence_score >= floor GROUP BY floor")
def _(spark, d):
    return models.score_floors(alerts(spark, d), (10, 20, 30, 40), "src_ip", "confidence_score")


@query("m18_compare_models", f"""WITH {_SCORED} SELECT count(*) AS rows, round(max(abs(score - quality * 0.5)), 9) AS max_difference, round(avg(((score >= 0.6) = (quality * 0.5 >= 0.6))::INT), 9) AS agreement FROM scored""")
def _(spark, d):
    s = _scored(spark, d)
    other = s.select("doc_id", (F.col("quality") * 0.5).alias("threat_score"))
    m = models.compare_models(s.select("doc_id", F.col("score").alias("threat_score")), other, "doc_id")
    return m.select("rows", F.round("max_difference", 9).alias("max_difference"), F.round("agreement", 9).alias("agreement"))


@query("m14_accept_model", f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (WHERE label = 0 AND score >= 0.5) / count(*) FILTER (WHERE label = 0) AS a, count(*) FILTER (WHERE label = 0 AND score >= 0.4) / count(*) FILTER (WHERE label = 0) AS b,
  count(*) FILTER (WHERE label = 1 AND score >= 0.5) / count(*) FILTER (WHERE label = 1) AS ra, count(*) FILTER (WHERE label = 1 AND score >= 0.4) / count(*) FILTER (WHERE label = 1) AS rb FROM scored)
SELECT round(a, 9) AS base_fpr, round(b, 9) AS candidate_fpr, round(ra - rb, 9) AS recall_drop, b <= a AND ra - rb <= 0.01 AS accepted FROM c""")
def _(spark, d):
    s = _scored(spark, d)
    m = models.accept_model(models.binary_metrics(s), models.binary_metrics(s, threshold=0.4))
    return m.select(*[F.round(c, 9).alias(c) for c in ("base_fpr", "candidate_fpr", "recall_drop")], "accepted")


@query("v1_file_accuracy", f"""WITH {_SCORED}, o AS (SELECT 'c' || (doc_id % 3) AS config, label = 1 AS attack, score >= 0.5 AS alerted FROM scored),
c AS (SELECT config, count(*) FILTER (WHERE attack AND alerted) AS tp, count(*) FILTER (WHERE attack AND NOT alerted) AS fn, count(*) FILTER (WHERE NOT attack AND alerted) AS fp, count(*) FILTER (WHERE NOT attack AND NOT alerted) AS tn FROM o GROUP BY config)
SELECT config, tp, fn, fp, tn, round(tp / (tp + fn), 9) AS recall, round({_WILSON.format(k="tp", n="(tp + fn)")}, 9) AS recall_high, round(tn / (tn + fp), 9) AS specificity, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""")
def _(spark, d):
    o = _scored(spark, d).select(F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("config"), (F.col("label") == 1).alias("is_attack"), (F.col("score") >= 0.5).alias("alerted"))
    return evaluation.file_accuracy(o).select("config", "tp", "fn", "fp", "tn", *[F.round(c, 9).alias(c) for c in ("recall", "recall_high", "specificity", "f1")])


@query("v2_flow_fpr", f"""WITH {ALERTS}, {CONN}, f AS (SELECT 'f' || (rid % 12) AS file, count(*) AS flows FROM conn GROUP BY 1), a AS (SELECT file, count(DISTINCT alert_id) AS alerts FROM alerts GROUP BY 1)
SELECT file, flows, coalesce(alerts, 0) AS alerts, round(1000 * coalesce(alerts, 0) / flows, 4) AS per_1000 FROM f LEFT JOIN a USING (file)""")
def _(spark, d):
    flows = conn(spark, d).withColumn("file", F.concat(F.lit("f"), (F.col("rid") % 12).cast("string")))
    return evaluation.flow_fpr(alerts(spark, d), flows)


@query("v3_engines_per_file", f"WITH {ALERTS} SELECT engine, count(DISTINCT file) AS files, count(*) AS alerts FROM alerts GROUP BY engine")
def _(spark, d):
    return evaluation.engines_per_file(alerts(spark, d))


@query("v4_file_table", f"""WITH {ALERTS}, c AS (SELECT file, threat_class, count(*) AS n FROM alerts GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, threat_class) AS r, sum(n) OVER (PARTITION BY file) AS total FROM c)
SELECT file, max(total)::BIGINT AS alerts, string_agg(threat_class || ':' || n, ', ' ORDER BY r) AS top_classes FROM r WHERE r <= 4 GROUP BY file""")
def _(spark, d):
    return evaluation.file_table(alerts(spark, d))


@query("v5_file_flags", f"""WITH {CONN}, cut AS (SELECT quantile_cont(value, 0.9) AS cut FROM conn WHERE k < 50)
SELECT dst_ip, round(avg((value > cut)::INT), 9) AS over, count(*) AS flows, avg((value > cut)::INT) > 0.1 AS flagged FROM conn, cut GROUP BY dst_ip""")
def _(spark, d):
    c = conn(spark, d).withColumn("score", F.col("value"))
    return evaluation.file_flags(c, c.where("k < 50"), ["dst_ip"], 0.9, 0.1).withColumn("over", F.round("over", 9))


@query("v6_run_summary", f"""WITH {CONN}, o AS (SELECT dst_ip, value, row_number() OVER (PARTITION BY dst_ip ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY dst_ip) AS n FROM conn),
s AS (SELECT dst_ip, max(n) AS n, median(value) AS m, min(value) FILTER (WHERE i = least(n - 1, floor(0.95::DOUBLE * n))) AS p95, 1000 AS flows FROM o GROUP BY dst_ip)
SELECT dst_ip, n, round(m, 6) AS median_s, p95, round(flows / m, 1) AS flows_per_s FROM s""")
def _(spark, d):
    m = evaluation.run_summary(conn(spark, d).withColumn("flows", F.lit(1000)), ["dst_ip"], "value")
    return m.select("dst_ip", "n", F.round("median_s", 6).alias("median_s"), "p95", "flows_per_s")


@query("v7_latency_stats", f"""WITH {CONN} SELECT dst_ip, count(*) AS events, count(*) FILTER (WHERE k > 20) AS detected, round(count(*) FILTER (WHERE k > 20) / count(*), 9) AS rate, min(value) FILTER (WHERE k > 20) AS min_s,
  max(value) FILTER (WHERE k > 20) AS max_s, count(*) FILTER (WHERE k <= 20) AS missed FROM conn GROUP BY dst_ip""")
def _(spark, d):
    m = evaluation.latency_stats(conn(spark, d).withColumn("latency_s", F.when(F.col("k") > 20, F.col("value"))), ["dst_ip"])
    return m.select("dst_ip", "events", "detected", F.round("rate", 9).alias("rate"), "min_s", "max_s", "missed")


@query("v8_replay_summary", """WITH f AS (SELECT doc_id, sha256(text) AS h, coalesce(toxic, 0) = 1 AS attack, n_chars % 3 AS alerts, n_chars AS flows FROM documents LEFT JOIN labels USING (doc_id)),
u AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1 AS used FROM f)
SELECT count(*) FILTER (WHERE used AND attack) AS attack_files, count(*) FILTER (WHERE used AND attack AND alerts > 0) AS detected, count(*) FILTER (WHERE used AND NOT attack) AS benign_files,
  count(*) FILTER (WHERE used AND NOT attack AND alerts = 0) AS benign_clean, count(*) FILTER (WHERE NOT used) AS duplicates,
  round(count(*) FILTER (WHERE used AND attack AND alerts > 0) / count(*) FILTER (WHERE used AND attack), 9) AS recall FROM u""")
def _(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    rows = docs.select(
        F.col("doc_id").alias("file"), F.sha2("text", 256).alias("sha256"), (F.coalesce("toxic", F.lit(0)) == 1).alias("is_attack"), (F.col("n_chars") % 3).alias("alerts"), F.col("n_chars").alias("flows")
    )
    m = evaluation.replay_summary(rows)
    return m.select("attack_files", "detected", "benign_files", "benign_clean", "duplicates", F.round("recall", 9).alias("recall"))


@query("v9_soak_summary", f"""WITH {PACKETS}, s AS (SELECT floor(ts / 3600)::BIGINT AS slot, count(*) / 3600 AS pps FROM packets GROUP BY 1) SELECT count(*) AS seconds, round(sum(pps), 6) AS packets, round(max(pps), 9) AS peak_pps FROM s""")
def _(spark, d):
    totals = evaluation.soak_summary(agg.throughput_series(packets(spark, d), 3600), alerts(spark, d))[0]
    return totals.select("seconds", F.round("packets", 6).alias("packets"), F.round("peak_pps", 9).alias("peak_pps"))


@query("v10_history", f"""WITH {CONN} SELECT rid, round(value - lag(value) OVER (PARTITION BY src_ip ORDER BY ts), 6) AS change FROM conn""")
def _(spark, d):
    c = conn(spark, d)
    made = evaluation.append_history(c.where("rid % 2 = 0"), c.where("rid % 2 = 1"), ("src_ip",), "ts")
    return made.select("rid", F.round("change", 6).alias("change"))


# ---- baseline and models ---------------------------------------------------------------------------------------------------
@query("b3_profiles", f"""WITH {CONN}, l AS (SELECT *, row_number() OVER (ORDER BY ts, rid) AS rank, min(ts) OVER () AS t0 FROM conn), e AS (SELECT least(coalesce(min(rank) FILTER (WHERE rank >= 500 AND ts - t0 >= 864000), 50000), 50000, count(*)) AS last FROM l),
s AS (SELECT 'tcp/' || dst_port AS service, ln(1 + orig_bytes) AS f, rank, (SELECT last FROM e) AS n FROM l WHERE rank <= (SELECT last FROM e)),
m AS (SELECT service, count(*) AS c, median(f) AS m, max(f) - min(f) AS r FROM s WHERE rank <= floor(n * 0.7::DOUBLE) GROUP BY service),
d AS (SELECT s.service, median(abs(f - m)) AS d FROM s JOIN m USING (service) WHERE rank <= floor(n * 0.7::DOUBLE) GROUP BY 1)
SELECT service, round(m, 6) AS m_f_orig_bytes, round(greatest(1.4826 * d, 0.05 + 0.02 * r), 6) AS s_f_orig_bytes FROM m JOIN d USING (service) WHERE c >= 20""")
def _(spark, d):
    learned = baseline.learning_set(baseline.baseline_features(conn(spark, d)), 500, 10 * DAY)
    profiles, _, _ = baseline.fit_baseline(learned)
    return profiles.select("service", F.round("m_f_orig_bytes", 6).alias("m_f_orig_bytes"), F.round("s_f_orig_bytes", 6).alias("s_f_orig_bytes"))


_BASE = {
    "ob": "orig_bytes", "op": "k % 13", "du": "duration_s", "ra": "orig_bytes / greatest(duration_s, 1e-3)", "rb": "resp_bytes", "rp": "k % 7",
}


def _each(text: str) -> str:
    return ", ".join(text.format(f=f) for f in _BASE)


_PROFILE = """{m} AS (SELECT {key}, count(*) AS c, %s FROM t GROUP BY 1),
{d} AS (SELECT {key}, %s FROM t JOIN {m} ON {on} GROUP BY 1),
{p} AS (SELECT {m}.*, %s FROM {m} JOIN {d} USING (svc))""" % (
    _each("median({f}) AS m_{f}, max({f}) - min({f}) AS r_{f}"),
    _each("median(abs({f} - m_{f})) AS d_{f}"),
    _each("greatest(1.4826 * d_{f}, 0.05 + 0.02 * r_{f}) AS s_{f}"),
)


@query("b5_baseline_p_values", f"""WITH {CONN}, f AS (SELECT rid, ts, 'tcp/' || dst_port AS service, {", ".join(f"ln(1 + greatest(({x})::DOUBLE, 0)) AS {f}" for f, x in _BASE.items())} FROM conn),
l AS (SELECT *, row_number() OVER (ORDER BY ts, rid) AS rank, min(ts) OVER () AS t0 FROM f), e AS (SELECT least(coalesce(min(rank) FILTER (WHERE rank >= 500 AND ts - t0 >= 864000), 50000), 50000, count(*)) AS last FROM l),
t AS (SELECT * FROM l WHERE rank <= floor((SELECT last FROM e) * 0.7::DOUBLE)), {_PROFILE.format(m="m", d="d", p="own", key="service AS svc", on="service = svc")},
{_PROFILE.format(m="m0", d="d0", p="pool", key="1 AS svc", on="true")},
z AS (SELECT rid, rank, greatest({", ".join(f"abs({x} - coalesce(own.m_{x}, pool.m_{x})) / coalesce(own.s_{x}, pool.s_{x})" for x in _BASE)}, 0) + CASE WHEN own.svc IS NULL THEN 3 ELSE 0 END AS raw
  FROM l LEFT JOIN own ON service = own.svc AND own.c >= 20 CROSS JOIN pool),
y AS (SELECT rid, rank, round(raw, 6) AS score FROM z), c AS (SELECT score FROM y WHERE rank > floor((SELECT last FROM e) * 0.7::DOUBLE) AND rank <= (SELECT last FROM e)), n AS (SELECT count(*) AS n FROM c),
q AS (SELECT score, count(*) AS k FROM c GROUP BY score), a AS (SELECT score AS at, sum(k) OVER (ORDER BY score DESC) AS above FROM q)
SELECT rid, score, (1 + coalesce(above, 0)) / ((SELECT n FROM n) + 1)::DOUBLE AS p FROM y ASOF LEFT JOIN a ON y.score <= a.at""")
def _(spark, d):
    flows = baseline.baseline_features(conn(spark, d))
    profiles, pooled, calibration = baseline.fit_baseline(baseline.learning_set(flows, 500, 10 * DAY))
    rounded = F.round("score", 6)  # equal scores differ in their last bits from engine to engine, so ties are settled at six digits
    scored = baseline.baseline_score(flows, profiles, pooled).withColumn("score", rounded)
    return baseline.p_values(scored, calibration.withColumn("score", rounded)).select("rid", "score", "p")


@query("m5_train_flow_model")
def _(spark, d):
    rows = conn(spark, d).withColumn("label", (F.col("value") > 60).cast("int"))
    model = models.train_family(rows, "flow", trees=5, depth=3)
    return models.score_rows(rows.select("rid", "duration_s", "orig_bytes", "resp_bytes", "proto"), model).select("rid", F.round("threat_score", 6).alias("threat_score"))


@query("m6_isolation_forest")
def _(spark, d):
    rows = conn(spark, d)
    forest = models.isolation_forest(rows, ["orig_bytes", "resp_bytes", "value"], trees=30)
    return forest.score(rows).select("rid", "iforest_score", (F.col("iforest_score") > forest.threshold).alias("outlier"))


@query("m13_time_split", f"WITH {CONN} SELECT count(*) AS rows, count(DISTINCT src_ip) AS sources FROM conn")
def _(spark, d):
    split = models.group_split(models.time_split(conn(spark, d)).drop("part"), "src_ip")
    return split.groupBy("src_ip").agg(F.count("*").alias("n"), F.countDistinct("part").alias("p")).where("p = 1").agg(F.sum("n").alias("rows"), F.count("*").alias("sources"))


@query("m13_time_parts", f"""WITH {CONN}, cut AS (SELECT quantile_disc(ts, 0.5) AS middle FROM conn)
SELECT (ts > middle)::INT AS part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM conn, cut GROUP BY 1""")
def _(spark, d):
    return models.time_split(conn(spark, d), accuracy=1_000_000).groupBy("part").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
