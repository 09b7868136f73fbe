"""Aggregations behind dashboards, inventory and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquill.functions.net import bucket, classify_protocol, is_private
from netquill.functions.text import first_evidence

INTERVALS = {"minute": 60, "5min": 300, "hour": 3600, "day": 86400}
SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}


def alert_counts(alerts: DataFrame, fields=("severity", "threat_class", "detection_mode")) -> DataFrame:
    """``field, value, n`` for each of the fields in one pass."""
    flat = alerts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x"))
    return flat.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def engine_coverage(processed: DataFrame, alerts: DataFrame) -> DataFrame:
    """Records each engine processed (``engine, records``) and the alerts it fired."""
    fired = alerts.groupBy("engine").agg(F.count("*").alias("alerts"))
    seen = processed.groupBy("engine").agg(F.sum("records").alias("records"))
    return seen.join(fired, "engine", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))


def capture_summary(logs: dict[str, DataFrame]) -> DataFrame:
    """Record counts by log type."""
    parts = [df.agg(F.count("*").alias("records")).select(F.lit(kind).alias("log_type"), "records") for kind, df in sorted(logs.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_METRICS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "cardinality": F.countDistinct}


def aggregate(df: DataFrame, cfg: dict) -> DataFrame:
    """A chart's data: ``bucket``, ``split`` (if asked for) and ``value``.

    ``cfg``: ``filters`` (field: value), ``bucket`` ({"terms": field, "size": n} or {"time": field, "every": interval}),
    ``metric`` ("count" or (name, field)), ``split`` (field).
    """
    for field, value in cfg.get("filters", {}).items():
        df = df.where(F.col(field) == value)
    b, metric = cfg["bucket"], cfg.get("metric", "count")
    value = F.count("*") if metric == "count" else _METRICS[metric[0]](metric[1])
    if "time" in b:
        width = INTERVALS[b["every"]]
        df = df.withColumn("bucket", bucket(F.col(b["time"]), width) * width)
    else:
        df = df.withColumn("bucket", F.col(b["terms"]).cast("string"))
        top = df.groupBy("bucket").agg(value.alias("value")).orderBy(F.desc("value"), "bucket").limit(b.get("size", 10))
        if "split" not in cfg:
            return top
        df = df.join(F.broadcast(top.select("bucket")), "bucket", "left_semi")  # ``size`` rows
    keys = ["bucket"] + ([F.col(cfg["split"]).cast("string").alias("split")] if "split" in cfg else [])
    return df.groupBy(*keys).agg(value.alias("value"))


PRESETS = {
    "severity": {"bucket": {"terms": "severity"}},
    "classes": {"bucket": {"terms": "threat_class"}},
    "over_time": {"bucket": {"time": "timestamp", "every": "hour"}},
    "top_sources": {"bucket": {"terms": "src_ip", "size": 10}},
    "tactics": {"bucket": {"terms": "tactic"}},
    "confidence_by_mode": {"bucket": {"terms": "detection_mode"}, "metric": ("avg", "confidence_score")},
    "severity_over_time": {"bucket": {"time": "timestamp", "every": "hour"}, "split": "severity"},
    "targets": {"bucket": {"terms": "dst_ip", "size": 10}, "metric": ("cardinality", "src_ip")},
}


def distinct_values(df: DataFrame, field: str, limit: int = 30) -> DataFrame:
    return df.where(F.col(field).isNotNull()).select(field).distinct().orderBy(field).limit(limit)


def time_histogram(df: DataFrame, ts: str = "timestamp", bins: int = 12) -> DataFrame:
    """Counts in ``bins`` equal parts of the span of times: ``bin`` from 0, empty ones included."""
    span = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))  # one row
    placed = df.select(ts).crossJoin(F.broadcast(span))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(ts) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    counted = placed.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").fillna(0, "n")


def top_values(df: DataFrame, fields: list[str], k: int = 5) -> DataFrame:
    """The ``k`` commonest values of each field: ``field, value, n, rank``."""
    counts = alert_counts(df, fields).where("value is not null")
    order = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dashboard_kpis(alerts: DataFrame, flows: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One row: alerts, flows, flagged per cent, and the chart interval that fits the span."""
    a = alerts.agg(F.count("*").alias("alerts"), (F.max(ts) - F.min(ts)).alias("span"))
    f = flows.agg(F.count("*").alias("flows"))
    span = F.col("span")
    every = F.when(span <= 7200, "minute").when(span <= 21600, "5min").when(span <= 259200, "hour").otherwise("day")
    share = F.when(F.col("flows") > 0, F.round(100 * F.col("alerts") / F.col("flows"), 2)).otherwise(0.0)
    return a.crossJoin(f).select("alerts", "flows", share.alias("flagged_pct"), every.alias("every"))  # one row each


def host_inventory(packets: DataFrame) -> DataFrame:
    """Per address: first and last seen, packets and bytes sent and received, TCP, UDP and other packets, hardware address."""
    size, arp = F.coalesce("wire_len", F.lit(0)).cast("bigint"), F.coalesce("is_arp", F.lit(False))
    side = lambda ip, tx: F.struct(F.col(ip).alias("ip"), F.lit(tx).alias("tx"), (F.col("src_mac") if tx else F.lit(None).cast("string")).alias("mac"))
    rows = packets.select("ts", size.alias("size"), arp.alias("arp"), F.upper("proto").alias("proto"), F.explode(F.array(side("src", True), side("dst", False))).alias("e"))
    when = lambda c, v=1: F.sum(F.when(c, v).otherwise(0))
    tx, proto = F.col("e.tx"), F.col("proto")
    return rows.where("e.ip is not null").groupBy("e.ip").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), when(tx).alias("tx_pkts"), when(~tx).alias("rx_pkts"),
        when(tx, F.col("size")).alias("tx_bytes"), when(~tx, F.col("size")).alias("rx_bytes"), when(proto == "TCP").alias("tcp"), when(proto == "UDP").alias("udp"),
        when(~F.coalesce(proto.isin("TCP", "UDP"), F.lit(False))).alias("other"), F.max("e.mac").alias("mac"), F.max(F.col("arp") & tx).alias("via_arp"),
    )


def protocol_mix(packets: DataFrame) -> DataFrame:
    kind = classify_protocol(F.col("proto"), F.col("sport"), F.col("dport")).alias("protocol")
    made = packets.groupBy(kind).agg(F.count("*").alias("pkts"), F.sum(F.coalesce("wire_len", F.lit(0)).cast("bigint")).alias("bytes"))
    return made.orderBy(F.desc("bytes"), "protocol")


def top_flows(flows: DataFrame, n: int = 50, tie: str = "flow_uid") -> DataFrame:
    return flows.withColumn("total_bytes", F.col("orig_bytes") + F.col("resp_bytes")).orderBy(F.desc("total_bytes"), tie).limit(n)


def coverage_verdict(hosts: DataFrame, known: DataFrame, own: DataFrame) -> DataFrame:
    """One row: known devices, those visible, their ratio and what it says about the sensor's place."""
    others = known.select("ip").distinct().join(own.select("ip"), "ip", "left_anti")
    seen = hosts.where(is_private(F.col("ip"))).select("ip").distinct().withColumn("seen", F.lit(1))
    counts = others.join(seen, "ip", "left").agg(F.count("*").alias("known"), F.count("seen").alias("visible"))
    ratio = F.when(F.col("known") > 0, F.col("visible") / F.col("known")).otherwise(0.0)
    verdict = F.when(F.col("known") == 0, "unknown").when(ratio >= 0.9, "full").when(ratio >= 0.35, "partial").otherwise("own-traffic-only")
    return counts.select("known", "visible", F.round(ratio, 4).alias("ratio"), verdict.alias("verdict"))


def throughput_series(packets: DataFrame, every: float = 1, pps_high: float = 50_000, mbit_high: float = 200, block: int = 3600) -> DataFrame:
    """Packets and Mbit a second in each interval, the peak so far, and whether the rate is high.

    The running peak is taken within blocks of intervals and then over the blocks before, so that no single task orders all."""
    made = packets.groupBy(bucket(F.col("ts"), every).alias("slot")).agg(F.count("*").alias("pkts"), F.sum(F.coalesce("wire_len", F.lit(0)).cast("bigint")).alias("bytes"))
    rates = made.select("slot", (F.col("pkts") / every).alias("pps"), (F.col("bytes") * 8 / 1e6 / every).alias("mbit_s"), F.floor(F.col("slot") / block).alias("block"))
    peaks = rates.groupBy("block").agg(F.max("pps").alias("peak"))
    before = peaks.withColumn("earlier", F.max("peak").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("block", "earlier")
    own = F.max("pps").over(Window.partitionBy("block").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    out = rates.join(before, "block").withColumn("peak_pps", F.greatest(own, F.coalesce("earlier", F.lit(0.0))))
    return out.select("slot", "pps", "mbit_s", "peak_pps", ((F.col("pps") >= pps_high) | (F.col("mbit_s") >= mbit_high)).alias("high"))


def index_percentile(df: DataFrame, col: str, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Order statistics at ``min(n - 1, int(q * n))`` of each group, by counted values and running sums: no list is collected."""
    values = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_c"))
    key = by or [F.lit(0)]
    up = F.sum("_c").over(Window.partitionBy(*key).orderBy(col).rowsBetween(Window.unboundedPreceding, 0))
    placed = values.withColumn("_up", up).withColumn("_n", F.sum("_c").over(Window.partitionBy(*key)))
    at = lambda q: F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n")))
    picked = [F.min(F.when(F.col("_up") > at(q), F.col(col))).alias(name) for name, q in quantiles.items()]
    return placed.groupBy(*by).agg(F.max("_n").alias("n"), *picked, F.max(col).alias("max"))


def latency_summary(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    return index_percentile(df, col, by or [], {"p50": 0.50, "p95": 0.95, "p99": 0.99})


def triage_groups(alerts: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Alerts that look alike: by class, mode, destination port and signature, with their spread and one example."""
    signature = F.coalesce(first_evidence(F.col("evidence"), "rule", "signature", "dns_query", "ja4", "function"), F.lit("")).alias("signature")
    return alerts.groupBy("threat_class", "detection_mode", F.col("flow_identifier.dst_port").alias("dst_port"), signature).agg(
        F.count("*").alias("alerts"), F.countDistinct(capture).alias("captures"), F.countDistinct("flow_identifier.src_ip").alias("src_hosts"),
        F.countDistinct("flow_identifier.dst_ip").alias("dst_hosts"), F.min("alert_id").alias("example"),
    )


def suggest_rules(groups: DataFrame, min_alerts: int = 20) -> DataFrame:
    """Disabled allowlist rules for the largest groups, for a person to look at."""
    rows = groups.where(F.col("alerts") >= min_alerts)
    name = F.concat_ws("-", F.lit("suggest"), F.lower("threat_class"), F.col("dst_port").cast("string"))
    return rows.select(name.alias("id"), F.concat(F.lit("review: "), F.col("alerts").cast("string"), F.lit(" alerts")).alias("reason"),
                       F.array("threat_class").alias("threat_class"), F.array("dst_port").alias("dst_port"), F.lit(False).alias("enabled"))


def alerts_per_thousand(alerts: DataFrame, flows: DataFrame) -> DataFrame:
    a, f = alerts.agg(F.count("*").alias("alerts")), flows.agg(F.count("*").alias("flows"))
    return a.crossJoin(f).withColumn("per_1000", F.when(F.col("flows") > 0, F.round(1000 * F.col("alerts") / F.col("flows"), 3)))  # one row each


def suppression_audit(suppressed: DataFrame, newest: int = 100) -> tuple[DataFrame, DataFrame]:
    """Hits of each rule, and the newest suppressed alerts."""
    return suppressed.groupBy("rule_id").agg(F.count("*").alias("hits")), suppressed.orderBy(F.desc("timestamp"), "alert_id").limit(newest)


def trend_slope(df: DataFrame, t: str, v: str, warm_up: float = 0) -> DataFrame:
    """Least-squares slope of a value per hour, after ``warm_up`` seconds."""
    if warm_up:
        start = df.agg(F.min(t).alias("_t0"))  # one row
        df = df.crossJoin(start).where(F.col(t) >= F.col("_t0") + warm_up)
    return df.agg((F.regr_slope(v, t) * 3600).alias("slope_per_hour"), F.count("*").alias("samples"))


def severity_rank(col: str | Column = "severity") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(len(SEVERITY_RANK))
    for name, rank in SEVERITY_RANK.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(severity_rank(), F.desc("confidence_score"), "alert_id")
