"""The given tables in the shapes that the operators read: flows, packets, alerts, queries, requests, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.functions.net import epoch
from netquill.sources.scratch import scratch  # noqa: F401  the queries' own tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_flows(table(spark, sf_dir, "events"))


def as_flows(events: DataFrame) -> DataFrame:
    """Events as flows: user to event type; the port is k modulo 10."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("rid"), F.col("event_id").cast("string").alias("flow_uid"), epoch(F.col("ts")).alias("ts"), F.concat(F.lit("u"), "user_id").alias("src_ip"),
        (F.col("event_id") % 50000).cast("int").alias("src_port"), F.col("event_type").alias("dst_ip"), (k % 10).alias("dst_port"), F.lit("TCP").alias("proto"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("orig_bytes"), k.cast("bigint").alias("resp_bytes"), (k * 10.0).alias("duration_s"),
        (k % 13).cast("bigint").alias("orig_pkts"), (k % 7).cast("bigint").alias("resp_pkts"), k.alias("k"), F.col("value"),
    )


CONN = """conn AS (SELECT event_id AS rid, event_id::VARCHAR AS flow_uid, epoch_us(ts) / 1e6 AS ts, 'u' || user_id AS src_ip, event_type AS dst_ip,
  json_extract(props, '$.k')::INT % 10 AS dst_port, floor(value * 1000)::BIGINT AS orig_bytes, json_extract(props, '$.k')::BIGINT AS resp_bytes,
  json_extract(props, '$.k')::INT * 10.0::DOUBLE AS duration_s, json_extract(props, '$.k')::INT AS k, value FROM events)"""


def swapped(flows: DataFrame) -> DataFrame:
    """The same flows seen from the other side: few sources, many destinations."""
    return flows.withColumnsRenamed({"src_ip": "_a"}).withColumnsRenamed({"dst_ip": "src_ip"}).withColumnsRenamed({"_a": "dst_ip"})


SWAPPED = CONN + ", swapped AS (SELECT * EXCLUDE (src_ip, dst_ip), dst_ip AS src_ip, src_ip AS dst_ip FROM conn)"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_packets(table(spark, sf_dir, "events"))


def as_packets(events: DataFrame) -> DataFrame:
    """Events as packets between hosts and servers, odd ones sent by the server."""
    k, odd = F.get_json_object("props", "$.k").cast("int"), F.col("event_id") % 2 == 1
    host, server = F.concat(F.lit("h"), "user_id"), F.concat(F.lit("s"), (k % 7).cast("string"))
    high, low = 40000 + k, F.element_at(F.array(*map(F.lit, (443, 53, 80, 22, 9999))), k % 5 + 1)
    flip = lambda a, b: F.when(odd, b).otherwise(a)
    kind = F.when(F.col("event_type").isin("view", "click"), "TCP").when(F.col("event_type") == "purchase", "UDP").otherwise("ICMP")
    return events.select(
        F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("capture_id"), F.col("event_id").alias("id"), epoch(F.col("ts")).alias("ts"),
        F.floor(F.col("value") * 10).cast("int").alias("wire_len"), flip(host, server).alias("src"), flip(server, host).alias("dst"), kind.alias("proto"),
        flip(high, low).cast("int").alias("sport"), flip(low, high).cast("int").alias("dport"), F.lit(None).cast("int").alias("tcp_flags"),
        F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string")).alias("src_mac"), F.lit(False).alias("is_arp"), F.lit(None).cast("int").alias("dns_qr"),
        F.lit(None).cast("binary").alias("payload"), F.lit("").alias("info"),
    )


PACKETS = """raw AS (SELECT *, json_extract(props, '$.k')::INT AS k, event_id % 2 = 1 AS odd FROM events),
ends AS (SELECT *, 'h' || user_id AS host, 's' || (k % 7) AS server, 40000 + k AS high, [443, 53, 80, 22, 9999][k % 5 + 1] AS low FROM raw),
packets AS (SELECT 'c' || (event_id % 3) AS capture_id, event_id AS id, epoch_us(ts) / 1e6 AS ts, floor(value * 10)::INT AS wire_len, odd,
  CASE WHEN odd THEN server ELSE host END AS src, CASE WHEN odd THEN host ELSE server END AS dst, host, server, high, low,
  CASE WHEN event_type IN ('view', 'click') THEN 'TCP' WHEN event_type = 'purchase' THEN 'UDP' ELSE 'ICMP' END AS proto,
  CASE WHEN odd THEN low ELSE high END AS sport, CASE WHEN odd THEN high ELSE low END AS dport, 'm' || (user_id % 20) AS src_mac FROM ends)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as flat alerts."""
    key = F.col("o_orderkey")
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    severity = F.when(F.col("o_orderstatus") == "F", "HIGH").when(F.col("o_orderstatus") == "O", "MEDIUM").otherwise("CRITICAL")
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("alert_id"), epoch(F.col("o_orderdate")).alias("timestamp"), severity.alias("severity"), (F.col("o_totalprice") / 10000).alias("confidence_score"),
        F.col("o_orderpriority").alias("threat_class"), named("c", F.col("o_custkey")).alias("src_ip"), (key % 60000).cast("int").alias("src_port"),
        named("d", F.col("o_custkey") % 50).alias("dst_ip"), (F.col("o_custkey") % 100).cast("int").alias("dst_port"), F.lit("TCP").alias("protocol"),
        named("t", key % 4).alias("tactic"), named("T10", key % 6).alias("technique_id"), F.lit("n").alias("technique_name"),
        F.to_json(F.struct(named("r", key % 11).alias("rule"))).alias("evidence"), F.when(key % 7 == 0, "xgboost").otherwise("rule").alias("detection_mode"),
        named("f", key % 9).alias("file"), F.element_at(F.array(*map(F.lit, ("flood", "recon", "dga"))), (key % 3 + 1).cast("int")).alias("engine"),
    )


ALERTS = """alerts AS (SELECT o_orderkey::VARCHAR AS alert_id, epoch_us(o_orderdate) / 1e6 AS timestamp, o_orderkey,
  CASE o_orderstatus WHEN 'F' THEN 'HIGH' WHEN 'O' THEN 'MEDIUM' ELSE 'CRITICAL' END AS severity, o_totalprice / 10000 AS confidence_score,
  o_orderpriority AS threat_class, 'c' || o_custkey AS src_ip, 'd' || (o_custkey % 50) AS dst_ip, (o_custkey % 100)::INT AS dst_port, (o_orderkey % 60000)::INT AS src_port,
  't' || (o_orderkey % 4) AS tactic, 'T10' || (o_orderkey % 6) AS technique_id, 'r' || (o_orderkey % 11) AS rule,
  CASE WHEN o_orderkey % 7 = 0 THEN 'xgboost' ELSE 'rule' END AS detection_mode, 'f' || (o_orderkey % 9) AS file, ['flood', 'recon', 'dga'][o_orderkey % 3 + 1] AS engine FROM orders)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as DNS queries and HTTP requests."""
    host, path = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://[^/?#]*([^#]*)", 1)
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("page_id") % len(xs) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("rid"), F.col("page_id").cast("string").alias("flow_uid"), F.col("page_id").cast("double").alias("ts"), F.lit("10.0.0.1").alias("src_ip"),
        F.lit("8.8.8.8").alias("dst_ip"), pick(53, 53, 53, 5353).alias("dst_port"), host.alias("dns_query"), pick("A", "TXT", "CNAME", "AAAA", "A").alias("dns_qtype"), host.alias("sni"),
        path.alias("http_uri"), pick("curl/8.0", "Mozilla/5.0", "").alias("http_user_agent"), pick("GET", "POST").alias("http_method"),
        (F.col("page_id") % 11 * 1_000_000).alias("http_request_body_len"),
    )


REQUESTS = """requests AS (SELECT page_id AS rid, regexp_extract(url, '://([^/?#]*)', 1) AS dns_query, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS http_uri,
  [53, 53, 53, 5353][page_id % 4 + 1] AS dst_port, ['A', 'TXT', 'CNAME', 'AAAA', 'A'][page_id % 5 + 1] AS dns_qtype,
  ['curl/8.0', 'Mozilla/5.0', ''][page_id % 3 + 1] AS http_user_agent, ['GET', 'POST'][page_id % 2 + 1] AS http_method, page_id % 11 * 1000000 AS http_request_body_len FROM pages)"""


def entropy_sql(s: str) -> str:
    """Entropy of a text expression in DuckDB."""
    share = f"(len(list_filter(string_split({s}, ''), lambda y: y = x)) / length({s}))"
    return f"coalesce(-list_sum(list_transform(list_distinct(string_split({s}, '')), lambda x: {share} * log2({share}))), 0.0)"
