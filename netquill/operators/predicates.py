"""Filters over flows, queries, hosts and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.functions.net import is_private
from netquill.functions.text import registrable_domain

# fixed values: registrable domains of infrastructure whose names only look generated
KNOWN_INFRASTRUCTURE = (
    "msedge.net", "avcdn.net", "mozgcp.net", "akamaiedge.net", "akamaitechnologies.com", "cloudfront.net", "googleusercontent.com", "gvt1.com", "gvt2.com",
    "azureedge.net", "windows.net", "fastly.net", "cloudflare.net", "msftconnecttest.com", "msftncsi.com", "windowsupdate.com", "microsoft.com",
    "gstatic.com", "apple.com", "icloud.com", "mozilla.org", "mozilla.com", "ubuntu.com", "debian.org", "digicert.com",
)


def is_local_resolution(dst_port: Column, dst_ip: Column, query: Column) -> Column:
    """Name resolution that stays on the local network and isn't judged."""
    q = F.rtrim(F.lower(query), F.lit("."))
    group = dst_ip.isin("224.0.0.251", "224.0.0.252", "ff02::fb", "ff02::1:3")
    name = q.rlike(r"\.(local|arpa|home\.arpa|lan|internal|localdomain)$") | q.startswith("_") | q.contains("._") | ~q.contains(".")
    return F.coalesce(dst_port.isin(5353, 5355), F.lit(False)) | F.coalesce(group, F.lit(False)) | name


def drop_infra_domains(df: DataFrame, column: str, domains: DataFrame | None = None) -> DataFrame:
    """Rows whose registrable domain isn't a known one; ``domains``: the site's own (column ``domain``)."""
    out = df.where(~registrable_domain(F.col(column)).isin(*KNOWN_INFRASTRUCTURE))
    if domains is None:
        return out
    return out.join(domains.select("domain"), registrable_domain(out[column]) == domains["domain"], "left_anti")


def queries_only(dns: DataFrame) -> DataFrame:
    return dns.where(F.coalesce("dns_qr", F.lit(0)) == 0)


def is_probe(max_orig: int = 512, excluded_ports=(7680,)) -> Column:
    """A flow without an answer and with little sent."""
    return (F.col("resp_bytes") == 0) & (F.col("orig_bytes") <= max_orig) & ~F.col("dst_port").isin(*excluded_ports)


def search_terms(df: DataFrame, line: str, terms: str) -> DataFrame:
    """Rows whose line holds all terms; ``!term`` must be absent; case doesn't matter."""
    keep = F.lit(True)
    for term in terms.lower().split():
        keep &= ~F.lower(line).contains(term[1:]) if term[0] == "!" and term[1:] else F.lower(line).contains(term)
    return df.where(keep)


def discover(alerts: DataFrame, text: str = "", pinned: dict | None = None) -> DataFrame:
    """Rows whose JSON holds the text and whose pinned fields have the given values."""
    out = alerts.where(F.lower(F.to_json(F.struct("*"))).contains(text.lower())) if text else alerts
    for field, value in (pinned or {}).items():
        out = out.where(F.col(field) == value)
    return out


def workspace_filter(alerts: DataFrame, needle: str = "", fields=("src_ip", "dst_ip", "threat_class", "technique_name", "technique_id"), **equal) -> DataFrame:
    """Rows with the given values (``severity=..``, ``threat_class=..``, ..), the needle in one of five fields."""
    for field, value in equal.items():
        if value not in (None, "", "all"):
            alerts = alerts.where(F.col(field) == value)
    if needle:
        alerts = alerts.where(F.lower(F.concat_ws("\n", *[F.col(f).cast("string") for f in fields])).contains(needle.lower()))
    return alerts


def workspace_counts(alerts: DataFrame, facets=("severity", "threat_class", "detection_mode")) -> DataFrame:
    """``facet, value, n``: how many alerts are left, as a whole (facet ``alerts``) and for each value of each facet; one pass."""
    held = [F.struct(F.lit("alerts").alias("facet"), F.lit(None).cast("string").alias("value"))]
    held += [F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]
    return alerts.select(F.explode(F.array(*held)).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def filter_hosts(hosts: DataFrame, scope: str = "all", text: str = "", sort: str = "bytes") -> DataFrame:
    """Hosts of a scope (all, local, remote) matching a text, sorted by bytes, pkts, last or ip."""
    if scope != "all":
        hosts = hosts.where(is_private(F.col("ip")) if scope == "local" else ~is_private(F.col("ip")))
    if text:
        hosts = hosts.where(F.lower(F.concat_ws(" ", "ip", "mac")).contains(text.lower()))
    order = {"bytes": F.desc(F.col("tx_bytes") + F.col("rx_bytes")), "pkts": F.desc(F.col("tx_pkts") + F.col("rx_pkts")), "last": F.desc("last_seen"), "ip": F.asc("ip")}
    return hosts.orderBy(order[sort], "ip")


def filter_flows(flows: DataFrame, text: str) -> DataFrame:
    return flows.where(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in flows.columns])).contains(text.lower()))


def live_alert_filter(alerts: DataFrame, severity: str | None = None, text: str = "") -> DataFrame:
    return workspace_filter(alerts, text, ("threat_class", "src_ip", "dst_ip", "technique_id"), severity=severity)


def time_range(alerts: DataFrame, start: float | None = None, end: float | None = None, ts: str = "timestamp") -> DataFrame:
    if start is not None:
        alerts = alerts.where(F.col(ts) >= start)
    return alerts if end is None else alerts.where(F.col(ts) <= end)


def list_alerts(alerts: DataFrame, tenant=None, threat_class=None, severity=None, since=None, limit: int = 100) -> DataFrame:
    """The newest alerts of a tenant, class and severity, ``limit`` (1000 at most) of them."""
    equal = {k: v for k, v in {"tenant": tenant, "threat_class": threat_class, "severity": severity}.items() if v is not None}
    return time_range(workspace_filter(alerts, **equal), since).orderBy(F.desc("timestamp"), "alert_id").limit(min(limit, 1000))


def get_alert(alerts: DataFrame, alert_id: str, tenant=None) -> DataFrame:
    return workspace_filter(alerts, alert_id=alert_id, tenant=tenant)
