"""Detectors over windows: tumbling buckets, running counts and trailing frames.

Order within a key is by time, then by the row id column ``rid``. Filters stand before the windows, and every window is
partitioned by its detector's own key, so that one exchange serves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquill.functions.net import bucket, by_run, is_multicast, jitter_pct
from netquill.operators.predicates import is_probe
from netquill.operators.stateless import is_exfil, is_slow

# fixed values: ports of services that authenticate
AUTH_PORTS = (21, 22, 23, 25, 110, 143, 993, 995, 3389, 5900)


def _running(*keys, order=("ts", "rid")):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_distinct(df: DataFrame, keys: list, value, into: str, order=("ts", "rid")) -> DataFrame:
    """Adds the exact number of distinct values so far: first occurrences are flagged, then summed."""
    first = F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order)) == 1
    return df.withColumn("_first", first.cast("int")).withColumn(into, F.sum("_first").over(_running(*keys, order=order))).drop("_first")


def _first_per(df: DataFrame, keys: list, order=("ts", "rid")) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def flood_sources(conn: DataFrame, window: float = 10, threshold: int = 200, min_ratio: float = 15, skip: Column | None = None) -> DataFrame:
    """The first flow of a source and bucket at which both its flows and its flows per destination reach the thresholds.

    Slow flows (``skip``) aren't counted."""
    rows = conn.where(~(is_slow() if skip is None else skip)).withColumn("bucket", bucket(F.col("ts"), window))
    keys = by_run(rows, "src_ip", "bucket")
    rows = running_distinct(rows, keys, "dst_ip", "n_dst").withColumn("n_flows", F.count("*").over(_running(*keys)))
    hits = _first_per(rows.where((F.col("n_flows") >= threshold) & (F.col("n_flows") / F.col("n_dst") >= min_ratio)), keys)
    return hits.withColumns({"severity": F.lit("HIGH"), "confidence": F.least(F.lit(99.0), 60 + 0.5 * (F.col("n_flows") - threshold))})


def spoofed_flood(conn: DataFrame, window: float = 10, min_packets: int = 150, ratio: float = 0.85, skip: Column | None = None) -> DataFrame:
    """The first flow to a unicast destination and bucket at which enough flows come from nearly as many sources."""
    rows = conn.where(~(is_slow() if skip is None else skip) & ~is_multicast(F.col("dst_ip"))).withColumn("bucket", bucket(F.col("ts"), window))
    keys = by_run(rows, "dst_ip", "bucket")
    rows = running_distinct(rows, keys, "src_ip", "n_src").withColumn("n_flows", F.count("*").over(_running(*keys)))
    hits = _first_per(rows.where((F.col("n_flows") >= min_packets) & (F.col("n_src") / F.col("n_flows") >= ratio)), keys)
    return hits.withColumns({"severity": F.lit("CRITICAL"), "confidence": F.lit(92.0)})


def flood_sketch(conn: DataFrame, window: float = 10) -> DataFrame:
    """Approximate totals of each source and bucket: flows, and destinations by a HyperLogLog sketch."""
    rows = conn.withColumn("bucket", bucket(F.col("ts"), window))
    return rows.groupBy(*by_run(rows, "src_ip", "bucket")).agg(F.count("*").alias("n_flows"), F.hll_sketch_estimate(F.hll_sketch_agg("dst_ip")).alias("n_dst"))


def count_min(rows: DataFrame, key: Column, by: list[str], width: int = 2000, depth: int = 5) -> DataFrame:
    """A count-min sketch of ``key`` for each group of ``by``: ``line, cell, n``.

    A sketch is at most ``width * depth`` rows for each group, whatever the number of keys: every task adds up its own cells, and
    those of all tasks are merged by addition. ``line`` i hashes a key by MD5 of ``i|key``."""
    cells = [F.struct(F.lit(i).alias("line"), _cell(key, i, width).alias("cell")) for i in range(depth)]
    lines = rows.select(*by, F.explode(F.array(*cells)).alias("c"))
    return lines.groupBy(*by, F.col("c.line").alias("line"), F.col("c.cell").alias("cell")).agg(F.count("*").alias("n"))


def _cell(key: Column, line: int, width: int) -> Column:
    digest = F.substr(F.md5(F.concat(F.lit(f"{line}|"), key).cast("binary")), F.lit(1), F.lit(8))
    return (F.conv(digest, 16, 10).cast("long") % width).cast("int")


def count_min_estimates(keys: DataFrame, sketch: DataFrame, key: str, by: list[str], width: int = 2000, depth: int = 5) -> DataFrame:
    """``keys`` with ``estimate``: the least of a key's cells. It is never under the true count, and over it by more than
    e / ``width`` of a group's rows with a probability of e ** -``depth`` at most."""
    cells = [F.struct(F.lit(i).alias("line"), _cell(F.col(key), i, width).alias("cell")) for i in range(depth)]
    asked = keys.select(*by, key, F.explode(F.array(*cells)).alias("c")).select(*by, key, "c.*")
    return asked.join(sketch, [*by, "line", "cell"]).groupBy(*by, key).agg(F.min("n").alias("estimate"))


def flood_count_min(conn: DataFrame, window: float = 10, threshold: int = 200, width: int = 2000, depth: int = 5) -> DataFrame:
    """Sources and buckets whose flows reach ``threshold`` by the sketch of the bucket: all that really do, and few others."""
    rows = conn.withColumn("bucket", bucket(F.col("ts"), window))
    by = by_run(rows, "bucket")
    sketch = count_min(rows, F.col("src_ip"), by, width, depth)
    made = count_min_estimates(rows.select(*by, "src_ip").distinct(), sketch, "src_ip", by, width, depth)
    return made.where(F.col("estimate") >= threshold)


def beacons(conn: DataFrame, max_ts: int = 50, min_samples: int = 8, cv: float = 0.55, lo: float = 2, hi: float = 3600, cluster: float = 0.75) -> DataFrame:
    """Flows at which the recent gaps of their pair are regular: a low coefficient of variation and most near the median.

    A gap over ``hi`` starts a new history; equal times make no gap. The share of gaps near the median is counted on a
    collected frame only for rows that pass everything else.
    """
    rows = conn.where(~is_multicast(F.col("src_ip")) & ~is_multicast(F.col("dst_ip")))
    pair = Window.partitionBy(*by_run(rows, "src_ip", "dst_ip")).orderBy("ts", "rid")
    gap = F.col("ts") - F.lag("ts").over(pair)
    rows = rows.withColumn("_gap", gap).withColumn("_era", F.sum((F.coalesce("_gap", F.lit(0.0)) > hi).cast("int")).over(pair.rowsBetween(Window.unboundedPreceding, 0)))
    era = Window.partitionBy(*by_run(rows, "src_ip", "dst_ip", "_era")).orderBy("ts", "rid")
    rows = rows.withColumn("gap", F.when((F.lag("ts").over(era)).isNotNull() & (F.col("_gap") > 0), F.col("_gap")))
    frame = era.rowsBetween(-(max_ts - 2), 0)
    rows = rows.withColumns({
        "samples": F.count("gap").over(frame), "mean_gap": F.avg("gap").over(frame), "sd_gap": F.stddev_pop("gap").over(frame),
    })
    rows = rows.withColumn("cv", F.col("sd_gap") / F.col("mean_gap"))
    passes = (F.col("samples") >= min_samples) & F.col("mean_gap").between(lo, hi) & (F.col("cv") <= cv)
    rows = rows.withColumn("_gaps", F.when(passes, F.collect_list("gap").over(frame))).where(passes)
    middle = lambda up: F.element_at(F.array_sort("_gaps"), (F.floor((F.col("samples") + up) / 2) + 1).cast("int"))
    rows = rows.withColumn("median_gap", 0.5 * middle(-1) + 0.5 * middle(0))
    near = F.size(F.filter("_gaps", lambda g: F.abs(g - F.col("median_gap")) <= cv * F.col("median_gap"))) / F.col("samples")
    hits = rows.withColumn("clustered", near).where(F.col("clustered") >= cluster)
    hits = hits.withColumns({"severity": F.lit("HIGH"), "confidence": 95.0 - 25.0 * F.col("cv") / cv, "jitter_pct": jitter_pct(F.col("cv"))})
    return hits.drop("_gap", "_era", "_gaps", "gap")


def recon_windows(conn: DataFrame, window: float = 300, fanout: int = 25, probes: Column | None = None) -> DataFrame:
    """Sources and tumbling windows with many distinct probed targets."""
    rows = conn.where(is_probe() if probes is None else probes).withColumn("bucket", bucket(F.col("ts"), window))
    return rows.groupBy(*by_run(rows, "src_ip", "bucket")).agg(F.countDistinct("dst_ip", "dst_port").alias("targets"), F.min("ts").alias("ts")).where(F.col("targets") >= fanout)


def exfil_accumulated(conn: DataFrame, window: float = 300, min_bytes: int = 1_000_000, min_flows: int = 20, ratio: float = 10) -> DataFrame:
    """Flows at which what a pair sent in its bucket so far adds up; flows that alone are exfiltration don't count."""
    rows = conn.where(~is_exfil()).withColumn("bucket", bucket(F.col("ts"), window))
    so_far = _running(*by_run(rows, "src_ip", "dst_ip", "bucket"))
    rows = rows.withColumns({
        "sent": F.sum(F.col("orig_bytes").cast("bigint")).over(so_far), "received": F.sum(F.col("resp_bytes").cast("bigint")).over(so_far), "n_flows": F.count("*").over(so_far),
    })
    return exfil_judged(rows, min_bytes, min_flows, ratio)


def exfil_judged(rows: DataFrame, min_bytes: int = 1_000_000, min_flows: int = 20, ratio: float = 10) -> DataFrame:
    hits = rows.where((F.col("sent") >= min_bytes) & (F.col("n_flows") >= min_flows) & (F.col("received") > 0) & (F.col("sent") / F.col("received") >= ratio))
    return hits.withColumns({"severity": F.lit("HIGH"), "confidence": F.lit(82.0)})


def brute_force(conn: DataFrame, ports=AUTH_PORTS, window: float = 60, attempts: int = 10) -> DataFrame:
    """The attempt that reaches the limit of its source, destination, login port and bucket."""
    rows = conn.where(F.col("dst_port").isin(*ports)).withColumn("bucket", bucket(F.col("ts"), window))
    n = F.row_number().over(Window.partitionBy(*by_run(rows, "src_ip", "dst_ip", "dst_port", "bucket")).orderBy("ts", "rid"))
    return attempts_judged(rows.withColumn("attempt", n), attempts)


def attempts_judged(rows: DataFrame, attempts: int = 10) -> DataFrame:
    return rows.where(F.col("attempt") == attempts).withColumns({"severity": F.lit("MEDIUM"), "confidence": F.lit(70.0)})


def register_sweep(modbus: DataFrame, n: int = 50) -> DataFrame:
    """Adds the distinct registers among the last ``n`` requests of a source."""
    last = Window.partitionBy(*by_run(modbus, "src_ip")).orderBy("ts", "rid").rowsBetween(-(n - 1), 0)
    return modbus.withColumn("register_sweep_count", F.size(F.collect_set("register_address").over(last)))


def fanout_features(conn: DataFrame, window: float = 60) -> DataFrame:
    """Adds to each flow its source's distinct ports, distinct hosts and flows in the bucket."""
    rows = conn.withColumn("bucket", bucket(F.col("ts"), window))
    made = rows.groupBy(*by_run(rows, "src_ip", "bucket")).agg(
        F.countDistinct("dst_port").alias("distinct_ports"), F.countDistinct("dst_ip").alias("distinct_hosts"), F.count("*").alias("flow_count")
    )
    return rows.join(made, by_run(rows, "src_ip", "bucket"))


# ---- application services -------------------------------------------------------------------------------------------------


def _trailing(seconds: float, *keys):
    return Window.partitionBy(*keys).orderBy("ts").rangeBetween(-seconds, 0)


def distcc_exec(app: DataFrame) -> DataFrame:
    """Compile servers asked to run what is no compiler (all of them; the cooldown is the caller's)."""
    hits = app.where(F.col("app_function").startswith("distcc:") & (F.col("app_code") == 1))
    return hits.withColumns({"severity": F.lit("CRITICAL"), "confidence": F.lit(95.0)})


def smtp_enumeration(app: DataFrame, window: float = 300, vrfy: int = 3, rcpt: int = 15, rejects: int = 3, ratio: float = 0.3) -> DataFrame:
    """Client commands at which a pair of addresses has probed enough accounts, or enough recipients with refusals."""
    kind = F.col("app_function")
    rows = app.where(kind.isin("smtp_vrfy", "smtp_expn", "smtp_rcpt", "smtp_reject")).withColumn("pair", F.array_sort(F.array("src_ip", "dst_ip")))
    w = _trailing(window, *by_run(rows, "pair"))
    rows = rows.withColumns({
        "n_vrfy": F.size(F.collect_set(F.when(kind.isin("smtp_vrfy", "smtp_expn"), F.col("app_detail"))).over(w)),
        "n_rcpt": F.size(F.collect_set(F.when(kind == "smtp_rcpt", F.col("app_detail"))).over(w)),
        "n_reject": F.count(F.when(kind == "smtp_reject", 1)).over(w),
    })
    return smtp_judged(rows, vrfy, rcpt, rejects, ratio).drop("pair")


def smtp_judged(rows: DataFrame, vrfy: int = 3, rcpt: int = 15, rejects: int = 3, ratio: float = 0.3) -> DataFrame:
    """Of counted mail events those that are client commands and have reached a limit."""
    many = (F.col("n_rcpt") >= rcpt) & (F.col("n_reject") >= rejects) & (F.col("n_reject") >= ratio * F.col("n_rcpt"))
    hits = rows.where((F.col("app_function") != "smtp_reject") & ((F.col("n_vrfy") >= vrfy) | many))
    return hits.withColumns({"severity": F.lit("MEDIUM"), "confidence": F.lit(85.0)})


def default_credentials(app: DataFrame) -> DataFrame:
    return app.where((F.col("app_function") == "http_basic") & (F.col("app_code") == 1)).withColumns({"severity": F.lit("HIGH"), "confidence": F.lit(80.0)})


def http_guessing(app: DataFrame, window: float = 60, least: int = 5) -> DataFrame:
    """Login events at which a client has as many attempts and refusals at a server's port."""
    kind = F.col("app_function")
    rows = app.where(kind.isin("http_basic", "http_401"))
    w = _trailing(window, *by_run(rows, "src_ip", "dst_ip", "dst_port"))
    rows = rows.withColumns({"n_basic": F.count(F.when(kind == "http_basic", 1)).over(w), "n_401": F.count(F.when(kind == "http_401", 1)).over(w)})
    return guessing_judged(rows, least)


def guessing_judged(rows: DataFrame, least: int = 5) -> DataFrame:
    return rows.where((F.col("n_basic") >= least) & (F.col("n_401") >= least)).withColumns({"severity": F.lit("HIGH"), "confidence": F.lit(85.0)})


def web_deployments(app: DataFrame, window: float = 300, refusal: float = 60) -> DataFrame:
    """Deployment requests; worse where default credentials or refusals went before.

    A refusal counts within ``window`` of the request if it lay within ``refusal`` of the last login event before it.
    """
    kind, ts = F.col("app_function"), F.col("ts")
    rows = app.where(kind.isin("http_basic", "http_401", "http_admin_deploy"))
    keys = by_run(rows, "src_ip", "dst_ip", "dst_port")
    before = Window.partitionBy(*keys).orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "_default": F.max(F.when((kind == "http_basic") & (F.col("app_code") == 1), ts)).over(before),
        "_login": F.max(F.when(kind.isin("http_basic", "http_401"), ts)).over(before),
        "_refused": F.max(F.when(kind == "http_401", ts)).over(before),
    })
    return deployments_judged(rows, window, refusal)


def deployments_judged(rows: DataFrame, window: float = 300, refusal: float = 60) -> DataFrame:
    """Deployments among events that know the last default login, login event and refusal before them."""
    ts, same = F.col("ts"), F.col("app_code").bitwiseAND(2) != 0
    refused = (ts - F.col("_refused") <= window) & (F.col("_login") - F.col("_refused") <= refusal)
    bad = same | F.coalesce(ts - F.col("_default") < window, F.lit(False)) | F.coalesce(refused, F.lit(False))
    hits = rows.where(F.col("app_function") == "http_admin_deploy").withColumn("preceded", bad).drop("_default", "_login", "_refused")
    return hits.withColumns({"severity": F.when(F.col("preceded"), "HIGH").otherwise("MEDIUM"), "confidence": F.when(F.col("preceded"), 85.0).otherwise(65.0)})
