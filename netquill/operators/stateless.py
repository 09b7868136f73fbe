"""Detectors that judge one record at a time. Each takes a DataFrame of mapped flows and returns its hits with ``severity``,
``confidence`` and what explains them; the rows' own columns stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.functions import codes
from netquill.functions.text import dga_score, entropy, is_pki_fetch, technique_id
from netquill.operators.predicates import drop_infra_domains, is_local_resolution

SLOW_PORTS = (0, 80, 3000, 5000, 8000, 8008, 8080, 8081, 8088, 8888, 9000, 9090)
WEAK_CIPHERS = ("rc4-hmac", "rc4-hmac-exp")
# fixed values: service classes of computer accounts
MACHINE_SERVICES = (
    "host", "cifs", "ldap", "dns", "gc", "rpcss", "wsman", "termsrv", "restrictedkrbhost", "exchangemdb", "exchangerfr", "exchangeab", "imap", "smtp", "pop", "ftp",
)
LIBRARY_AGENTS = ("python-requests", "python-urllib", "go-http-client", "curl/", "libwww-perl", "java/", "okhttp")


def lookup(df: DataFrame, dim: DataFrame, on: list[str] | str, default: dict | None = None) -> DataFrame:
    """Left join with a small dimension of rules; unmatched columns take their defaults."""
    joined = df.join(F.broadcast(dim), on, "left")  # dimensions are rule tables written in this library or its configuration
    for column, value in (default or {}).items():
        joined = joined.withColumn(column, F.coalesce(column, F.lit(value)))
    return joined


def is_slow(min_s: float = 120, max_bytes: int = 50, ports=SLOW_PORTS) -> Column:
    return (F.col("duration_s") > min_s) & (F.col("orig_bytes") + F.col("resp_bytes") < max_bytes) & F.col("dst_port").isin(*ports)


def slowloris(conn: DataFrame, min_s: float = 120, max_bytes: int = 50, ports=SLOW_PORTS) -> DataFrame:
    return conn.where(is_slow(min_s, max_bytes, ports)).withColumns({"severity": F.lit("HIGH"), "confidence": F.lit(85.0)})


def dns_tunnels(dns: DataFrame, min_length: int = 40, min_entropy: float = 4.2) -> DataFrame:
    """Queries of carrier record types that are long or of high entropy."""
    rows = dns.where((F.col("dns_query") != "") & F.col("dns_qtype").isin("TXT", "NULL", "CNAME"))
    rows = rows.where(~is_local_resolution(F.col("dst_port"), F.col("dst_ip"), F.col("dns_query"))).withColumn("entropy", entropy(F.col("dns_query")))
    rows = rows.where((F.length("dns_query") > min_length) | (F.col("entropy") > min_entropy))
    return rows.withColumns({"severity": F.lit("CRITICAL"), "confidence": F.lit(96.0)})


def _candidates(dns: DataFrame, min_length: int = 12, domains: DataFrame | None = None) -> DataFrame:
    """Queries that a generated-domain test looks at: no tunnels, no local names, long enough, not of known infrastructure."""
    rows = dns.where((F.length("dns_query") > min_length) & ~is_local_resolution(F.col("dst_port"), F.col("dst_ip"), F.col("dns_query")))
    tunnel = F.col("dns_qtype").isin("TXT", "NULL", "CNAME") & ((F.length("dns_query") > 40) | (entropy(F.col("dns_query")) > 4.2))
    return drop_infra_domains(rows.where(~F.coalesce(tunnel, F.lit(False))), "dns_query", domains)


def dga_lexical(dns: DataFrame, fire: float = 0.55, domains: DataFrame | None = None) -> DataFrame:
    """Names that look generated by their letters."""
    scored = _candidates(dns, domains=domains).withColumn("dga_score", dga_score(F.col("dns_query"))).where(F.col("dga_score") >= fire)
    return scored.withColumns({"severity": F.lit("HIGH"), "confidence": F.round(60.0 + F.col("dga_score") * 35.0, 2)})


def dga_model(dns: DataFrame, model, threshold: float = 0.6, domains: DataFrame | None = None) -> DataFrame:
    """Names whose registrable domain a trained model scores high; the model's no is final."""
    from netquill.functions.text import registrable_domain
    from netquill.operators.models import score_rows

    rows = _candidates(dns, domains=domains).withColumn("domain", registrable_domain(F.col("dns_query")))
    scored = score_rows(rows, model).where(F.col("threat_score") >= threshold)
    return scored.withColumns({"severity": F.lit("HIGH"), "confidence": F.round(F.col("threat_score") * 100, 2)})


def sni_dga(ssl: DataFrame, min_conf: float = 90, model=None) -> DataFrame:
    """The generated-domain test on the server names of TLS flows."""
    rows = ssl.where(F.trim("sni") != "").withColumns({"dns_query": F.lower(F.trim("sni")), "dns_qtype": F.lit("A")})
    hits = dga_model(rows, model) if model else dga_lexical(rows)
    port = F.when(F.col("dst_port") == 0, 443).otherwise(F.col("dst_port"))
    return hits.where(F.col("confidence") >= min_conf).withColumns({"dst_port": port, "proto": F.lit("TCP")})


def ja4_matches(ssl: DataFrame, intel: DataFrame) -> DataFrame:
    """TLS flows with a listed fingerprint; a malicious entry goes before a dual-use one."""
    best = intel.groupBy("ja4").agg(F.max_by(F.struct("tier", "application"), F.struct(F.col("tier") == "malicious", "application")).alias("entry"))
    hits = ssl.where("ja4 <> ''").join(F.broadcast(best), "ja4").select("*", "entry.*").drop("entry")
    bad = F.col("tier") == "malicious"
    return hits.withColumns({"severity": F.when(bad, "CRITICAL").otherwise("MEDIUM"), "confidence": F.when(bad, 94.5).otherwise(55.0)})


def is_exfil(min_bytes: int = 4_194_304, ratio: float = 20) -> Column:
    return (F.col("resp_bytes") > 0) & (F.col("orig_bytes") >= min_bytes) & (F.col("orig_bytes") / F.col("resp_bytes") >= ratio)


def exfil_single(conn: DataFrame, min_bytes: int = 4_194_304, ratio: float = 20) -> DataFrame:
    return conn.where(is_exfil(min_bytes, ratio)).withColumns({"severity": F.lit("HIGH"), "confidence": F.lit(90.0)})


def ot_rules(spark) -> DataFrame:
    flat = [(p, f, s, c, t, n) for p, fs, s, c, t, n in codes.OT_RULES for f in fs]
    return spark.createDataFrame(flat, "protocol string, function string, severity string, confidence double, technique_id string, technique_name string")


def ot_commands(df: DataFrame, protocol: str, rules: DataFrame | None = None, function: str | None = None) -> DataFrame:
    """Records of an industrial protocol whose function the rules name. CIP: requests only; PROFINET: station settings."""
    columns = {
        "modbus": "modbus_func", "cip": "cip_service", "dnp3": "dnp3_func", "s7comm": "s7_function", "iec104": "iec104_type_id", "bacnet": "bacnet_service",
        "opcua": "opcua_service",
    }
    if protocol == "profinet":
        reset = F.col("pn_blocks").contains("FACTORY_RESET")
        hits = df.where(F.col("pn_function") == "DCP_SET")
        return hits.withColumns({
            "severity": F.when(reset, "CRITICAL").otherwise("HIGH"), "confidence": F.when(reset, 90.0).otherwise(80.0),
            "technique_id": F.lit("T0836"), "technique_name": F.lit("Modify Parameter"),
        })
    if protocol == "cip" and "cip_response" in df.columns:
        df = df.where(~F.coalesce("cip_response", F.lit(False)))
    own = (rules if rules is not None else ot_rules(df.sparkSession)).where(F.col("protocol") == protocol).drop("protocol")
    column = function or columns[protocol]
    return df.withColumn("function", F.col(column).cast("string")).join(F.broadcast(own), "function")


def http_threats(http: DataFrame, max_post: int = 5_000_000, min_entropy: float = 4.2, min_length: int = 12) -> DataFrame:
    """Large uploads, and random paths fetched by a library's user agent or none."""
    agent, uri = F.lower(F.coalesce("http_user_agent", F.lit(""))), F.coalesce("http_uri", F.lit(""))
    library = (agent == "") | agent.rlike("|".join(LIBRARY_AGENTS))
    random_ = library & (F.length(uri) >= min_length) & (entropy(uri) > min_entropy) & ~is_pki_fetch(uri)
    large = (F.upper("http_method") == "POST") & (F.col("http_request_body_len") > max_post)
    reasons = F.array_compact(F.array(F.when(large, F.lit("large_post_body")), F.when(random_, F.lit("suspicious_ua_and_high_entropy_uri"))))
    hits = http.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    exfil = F.array_contains("reasons", "large_post_body")
    return hits.withColumns({
        "severity": F.when(F.size("reasons") > 1, "HIGH").otherwise("MEDIUM"), "confidence": 60.0 + 15.0 * F.size("reasons"),
        "threat_class": F.when(exfil, "DATA_EXFILTRATION").otherwise("C2_BEACONING"),
        "tactic": F.when(exfil, "Exfiltration").otherwise("Command and Control"), "technique_id": F.when(exfil, "T1041").otherwise("T1071.001"),
        "technique_name": F.when(exfil, "Exfiltration Over C2 Channel").otherwise("Application Layer Protocol: Web Protocols"),
    })


def ids_mapping(spark) -> DataFrame:
    return spark.createDataFrame(list(codes.IDS_CATEGORIES), "category string, threat_class string, tactic string, technique_id string, technique_name string")


def map_ids_alerts(eve: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """IDS alerts as hits, classified by their category."""
    rows = eve.where(F.col("event_type") == "alert").select(
        F.coalesce("timestamp_epoch", F.lit(0.0)).alias("ts"), F.coalesce("src_ip", F.lit("0.0.0.0")).alias("src_ip"), F.coalesce("src_port", F.lit(0)).alias("src_port"),
        F.coalesce("dest_ip", F.lit("0.0.0.0")).alias("dst_ip"), F.coalesce("dest_port", F.lit(0)).alias("dst_port"), F.upper(F.coalesce("proto", F.lit("TCP"))).alias("proto"),
        F.lower(F.trim(F.coalesce("alert.category", F.lit("")))).alias("category"), F.coalesce("alert.severity", F.lit(3)).alias("ids_severity"), "alert.signature", "alert.signature_id",
    )
    default = {"threat_class": "NETWORK_INTRUSION_ATTEMPT", "tactic": "Unknown", "technique_id": "T0000", "technique_name": "Unclassified IDS Signature"}
    known = lookup(rows, mapping if mapping is not None else ids_mapping(eve.sparkSession), "category", default)
    rank = F.col("ids_severity")
    return known.withColumns({
        "severity": F.when(rank == 1, "CRITICAL").when(rank == 2, "HIGH").otherwise("MEDIUM"), "confidence": F.when(rank == 1, 90.0).when(rank == 2, 70.0).otherwise(50.0),
    })


def kerberoasting(krb: DataFrame) -> DataFrame:
    """Service tickets with an RC4 cipher for what is no computer account."""
    service = F.split(F.lower(F.coalesce("krb_service", F.lit(""))), "/")[0]
    hits = krb.where((F.col("krb_request_type") == "TGS") & F.col("krb_cipher").isin(*WEAK_CIPHERS) & ~service.isin("krbtgt", "", *MACHINE_SERVICES))
    return hits.withColumns({"severity": F.lit("HIGH"), "confidence": F.lit(85.0)})


def notice_mapping(spark) -> DataFrame:
    return spark.createDataFrame(list(codes.NOTICES), "notice string, tactic string, technique_id string, technique_name string")


def map_notices(notice: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Attack notices as hits; a technique id in the message goes before the table's."""
    rows = notice.where(F.col("note").startswith("BZAR::")).withColumn("notice", F.expr("substring(note, 7)"))
    default = {"tactic": "Lateral Movement", "technique_id": "T1021", "technique_name": "Remote Services"}
    known = lookup(rows, mapping if mapping is not None else notice_mapping(notice.sparkSession), "notice", default)
    return known.withColumns({
        "technique_id": F.coalesce(technique_id(F.coalesce("msg", F.lit(""))), "technique_id"), "severity": F.lit("HIGH"), "confidence": F.lit(80.0),
        "src_ip": F.coalesce("src", F.lit("0.0.0.0")), "dst_ip": F.coalesce("dst", F.lit("0.0.0.0")), "dst_port": F.coalesce("p", F.lit(0)),
    })
