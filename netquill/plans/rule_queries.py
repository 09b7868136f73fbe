"""Queries of code names, industrial-protocol rules, small filters, snapshots and the routing of flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from netquill.functions import codes, net
from netquill.operators import aggregates, assembly, predicates, stateless
from netquill.plans.adapters import ALERTS, CONN, PACKETS, alerts, conn, packets, table
from netquill.plans.alert_queries import _nested
from netquill.plans.detect_queries import DAY

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: events as records of the protocols: a code of each from k, some without a name
NAMED = {"iec104": "k", "bacnet": "k % 30 + 256 * (rid % 2)", "opcua": "422 + k * 3"}
_NAMES = [(p, code, name) for p in NAMED for code, name in codes.CODES[p].items()]


@query("x15_code_names", f"""WITH {CONN}, names(protocol, code, name) AS ({_values(_NAMES)}),
c AS ({" UNION ALL ".join(f"SELECT rid, '{p}' AS protocol, ({code})::INT AS code FROM conn" for p, code in NAMED.items())})
SELECT rid, protocol, coalesce(name, code::VARCHAR) AS name FROM c LEFT JOIN names USING (protocol, code)""")
def _(spark, d):
    rows = conn(spark, d)
    parts = [rows.select("rid", F.lit(p).alias("protocol"), codes.code_name(F.expr(code), p).alias("name")) for p, code in NAMED.items()]
    return reduce(lambda x, y: x.unionByName(y), parts)


#: functions of each protocol in rules, and others that none names
FUNCTIONS = {
    "modbus": ("READ_COILS", "WRITE_SINGLE_COIL", "WRITE_MULTIPLE_REGISTERS", "DIAGNOSTICS"), "cip": ("4", "14", "16", "76", "80"),
    "dnp3": ("READ", "OPERATE", "WARM_RESTART", "WRITE", "DELETE_FILE"), "s7comm": ("READ_VAR", "PLC_STOP", "DOWNLOAD_BLOCK", "WRITE_VAR", "UPLOAD"),
    "bacnet": ("WHO_IS", "REINITIALIZE_DEVICE", "WRITE_PROPERTY", "CREATE_OBJECT"), "opcua": ("READ", "WRITE", "CALL", "ADD_NODES"),
}
_RULES = """VALUES ('modbus', 'WRITE_SINGLE_COIL', 'HIGH', 95.0, 'T0855'), ('modbus', 'WRITE_MULTIPLE_REGISTERS', 'HIGH', 95.0, 'T0855'), ('modbus', 'DIAGNOSTICS', 'HIGH', 95.0, 'T0855'),
('cip', '4', 'HIGH', 85.0, 'T0855'), ('cip', '16', 'HIGH', 85.0, 'T0855'), ('cip', '80', 'HIGH', 85.0, 'T0855'), ('dnp3', 'OPERATE', 'CRITICAL', 94.0, 'T0855'),
('dnp3', 'WARM_RESTART', 'CRITICAL', 94.0, 'T0855'), ('dnp3', 'WRITE', 'HIGH', 80.0, 'T0855'), ('dnp3', 'DELETE_FILE', 'HIGH', 80.0, 'T0855'), ('s7comm', 'PLC_STOP', 'CRITICAL', 92.0, 'T0858'),
('s7comm', 'DOWNLOAD_BLOCK', 'CRITICAL', 92.0, 'T0843'), ('s7comm', 'WRITE_VAR', 'HIGH', 80.0, 'T0836'), ('s7comm', 'UPLOAD', 'HIGH', 80.0, 'T0845'),
('bacnet', 'REINITIALIZE_DEVICE', 'CRITICAL', 90.0, 'T0855'), ('bacnet', 'WRITE_PROPERTY', 'HIGH', 78.0, 'T0836'), ('bacnet', 'CREATE_OBJECT', 'HIGH', 78.0, 'T0855'),
('opcua', 'WRITE', 'CRITICAL', 88.0, 'T0836'), ('opcua', 'CALL', 'CRITICAL', 88.0, 'T0855'), ('opcua', 'ADD_NODES', 'HIGH', 76.0, 'T0855')"""


@query("e7_protocol_rules", f"""WITH {CONN}, r(protocol, function, severity, confidence, technique_id) AS ({_RULES}),
f AS ({" UNION ALL ".join(f"SELECT rid, '{p}' AS protocol, {list(names)}[k % {len(names)} + 1] AS function, k % 2 = 0 AS answer FROM conn" for p, names in FUNCTIONS.items())})
SELECT rid, protocol, function, severity, confidence::DOUBLE AS confidence, technique_id FROM f JOIN r USING (protocol, function) WHERE NOT (protocol = 'cip' AND answer)""")
def _(spark, d):
    rows, found = conn(spark, d).withColumn("cip_response", F.col("k") % 2 == 0), []
    for protocol, names in FUNCTIONS.items():
        own = rows.withColumn("said", F.element_at(F.array(*map(F.lit, names)), F.col("k") % len(names) + 1))
        found.append(stateless.ot_commands(own, protocol, function="said").select("rid", F.lit(protocol).alias("protocol"), "function", "severity", "confidence", "technique_id"))
    return reduce(lambda x, y: x.unionByName(y), found)


@query("e7_profinet", f"""WITH {CONN} SELECT rid, CASE WHEN k % 5 = 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, CASE WHEN k % 5 = 0 THEN 90.0 ELSE 80.0 END::DOUBLE AS confidence
FROM conn WHERE k % 2 = 0""")
def _(spark, d):
    blocks = F.when(F.col("k") % 5 == 0, "IP,FACTORY_RESET").otherwise("IP")
    rows = conn(spark, d).withColumns({"pn_function": F.when(F.col("k") % 2 == 0, "DCP_SET").otherwise("DCP_GET"), "pn_blocks": blocks})
    return stateless.ot_commands(rows, "profinet").select("rid", "severity", "confidence")


@query("f3_infrastructure", "SELECT page_id, 'h' || page_id || ['.apple.com', '.example.org', '.a.windows.net', '.site.net', '.com'][page_id % 5 + 1] AS host FROM pages WHERE page_id % 5 IN (1, 4)")
def _(spark, d):
    ends = F.array(*map(F.lit, (".apple.com", ".example.org", ".a.windows.net", ".site.net", ".com")))
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("h"), "page_id", F.element_at(ends, (F.col("page_id") % 5 + 1).cast("int"))).alias("host"))
    return predicates.drop_infra_domains(rows, "host", spark.createDataFrame([("site.net",)], "domain string"))


@query("f6_networks", """SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_custkey % 256 BETWEEN 16 AND 31 AS v4, o_orderkey % 3 = 0 AND o_custkey % 256 >= 128 AS v6 FROM orders""")
def _(spark, d):
    key, part = F.col("o_orderkey"), F.col("o_custkey") % 256
    ip = F.when(key % 3 == 0, F.concat(F.lit("2001:db8:0:"), F.lower(F.hex(part * 256)), F.lit("::"), F.lower(F.hex(key % 65536)))).otherwise(F.concat(F.lit("203."), part, F.lit(".7."), key % 256))
    rows = table(spark, d, "orders").select("o_orderkey", ip.alias("ip"))
    return rows.select("o_orderkey", net.in_cidr(F.col("ip"), ["203.16.0.0/12"]).alias("v4"), net.in_cidr(F.col("ip"), ["2001:db8:0:8000::/49"]).alias("v6"))


@query("f7_queries_only", f"WITH {PACKETS} SELECT id FROM packets WHERE NOT odd")
def _(spark, d):
    return predicates.queries_only(packets(spark, d).withColumn("dns_qr", F.when(F.col("id") % 2 == 1, 1))).select("id")


@query("f12_probes", f"WITH {CONN} SELECT rid FROM conn WHERE resp_bytes % 5 = 0 AND orig_bytes <= 20000 AND dst_port <> 5")
def _(spark, d):
    return conn(spark, d).withColumn("resp_bytes", F.col("resp_bytes") % 5).where(predicates.is_probe(20_000, (5,))).select("rid")


@query("f14_filter_flows", f"WITH {CONN} SELECT rid FROM conn WHERE contains(lower(rid || ' ' || src_ip || ' ' || dst_ip || ' ' || dst_port), 'u12')")
def _(spark, d):
    return predicates.filter_flows(conn(spark, d).select("rid", "src_ip", "dst_ip", "dst_port"), "U12").select("rid")


@query("f11_recount", f"""WITH {ALERTS}, f AS (SELECT * FROM alerts WHERE severity = 'HIGH' AND (contains(src_ip, 'c1') OR contains(lower(technique_id), 'c1')))
SELECT 'alerts' AS facet, NULL::VARCHAR AS value, count(*) AS n FROM f HAVING count(*) > 0 UNION ALL SELECT 'severity', severity, count(*) FROM f GROUP BY severity
UNION ALL SELECT 'threat_class', threat_class, count(*) FROM f GROUP BY threat_class UNION ALL SELECT 'detection_mode', detection_mode, count(*) FROM f GROUP BY detection_mode""")
def _(spark, d):
    return predicates.workspace_counts(predicates.workspace_filter(alerts(spark, d), "C1", severity="HIGH"))


@query("g17_suggestions", f"""WITH {ALERTS}, g AS (SELECT threat_class, detection_mode, dst_port, rule, count(*) AS n FROM alerts GROUP BY ALL)
SELECT 'suggest-' || lower(threat_class) || '-' || dst_port AS id, 'review: ' || n || ' alerts' AS reason, false AS enabled FROM g WHERE n >= 2""")
def _(spark, d):
    return aggregates.suggest_rules(aggregates.triage_groups(_nested(spark, d), "file"), 2).select("id", "reason", "enabled")


@query("g17_alert_rate", "SELECT (SELECT count(*) FROM orders) AS alerts, (SELECT count(*) FROM events) AS flows, round(1000 * (SELECT count(*) FROM orders) / (SELECT count(*) FROM events), 3) AS per_1000")
def _(spark, d):
    return aggregates.alerts_per_thousand(alerts(spark, d), conn(spark, d))


@query("a3_directed_snapshots", f"""WITH {PACKETS}, t AS (SELECT capture_id, proto, host, high, server, low, floor(ts / 604800)::BIGINT AS tick, sum(wire_len) FILTER (WHERE NOT odd) AS u, sum(wire_len) FILTER (WHERE odd) AS v,
  count(*) FILTER (WHERE NOT odd) AS m, count(*) FILTER (WHERE odd) AS n, max(ts) AS t1 FROM packets GROUP BY ALL)
SELECT capture_id, proto, host AS src_ip, high::INT AS src_port, server AS dst_ip, low::INT AS dst_port, tick, max(t1) OVER w AS last_ts, coalesce(sum(u) OVER w, 0)::BIGINT AS orig_bytes,
  coalesce(sum(v) OVER w, 0)::BIGINT AS resp_bytes, (sum(m) OVER w)::BIGINT AS orig_pkts, (sum(n) OVER w)::BIGINT AS resp_pkts FROM t
  WINDOW w AS (PARTITION BY capture_id, proto, host, high, server, low ORDER BY tick ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    made = assembly.flow_snapshots(packets(spark, d), 7 * DAY)
    return made.select("capture_id", "proto", "src_ip", "src_port", "dst_ip", "dst_port", "tick", "last_ts", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")


@query("a4_route_phases", f"""WITH {CONN}, r(detector, phase) AS (VALUES ('flood', 0), ('recon', 0), ('brute_force', 0), ('flood', 1), ('beacons', 1), ('recon', 1), ('exfiltration', 1), ('brute_force', 1))
SELECT detector, count(*) AS flows, sum(rid)::BIGINT AS rids FROM conn JOIN r ON phase = k % 3 GROUP BY detector""")
def _(spark, d):
    rows = conn(spark, d).withColumn("phase", F.element_at(F.array(*map(F.lit, ("snapshot", "ended", "none"))), F.col("k") % 3 + 1))
    routed = [flows.agg(F.lit(name).alias("detector"), F.count("*").alias("flows"), F.sum("rid").alias("rids")) for name, flows in assembly.route_phases(rows).items()]
    return reduce(lambda x, y: x.unionByName(y), routed)
