"""Logs to alerts: every detector over its log, then fusion, allowlist, cooldown and storage; in batch and on streams."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.operators import stateless as st
from netquill.operators import windows as win
from netquill.operators.baseline import baseline_alerts, baseline_features, baseline_score
from netquill.operators.features import MAKERS
from netquill.operators.joins import apply_allowlist, union_alerts
from netquill.operators.mapping import build_alert, map_records
from netquill.operators.models import FamilyModel, IsolationForest, combine_scores, ml_alerts, score_rows
from netquill.operators.sequential import alert_cooldown, cooldown, discriminator, recon_campaigns
from netquill.sources.readers import read_logs, stream_logs
from netquill.sources.scratch import delete, scratch, written
from netquill.sources.sinks import append_alerts, validate_alerts, violations
from netquill.streaming import keyed
from netquill.streaming.learning import LiveBaseline
from netquill.streaming.stateful import cooldown_batch, recon_batch

IMPACT = ("Impact", "T1498", "Network Denial of Service")
C2 = ("Command and Control", "T1071", "Application Layer Protocol")
DGA = ("Command and Control", "T1568.002", "Domain Generation Algorithms")
TUNNEL = ("Command and Control", "T1572", "Protocol Tunneling")
SCAN = ("Discovery", "T1046", "Network Service Discovery")
EXFIL = ("Exfiltration", "T1041", "Exfiltration Over C2 Channel")
GUESS = ("Credential Access", "T1110", "Brute Force")
ROAST = ("Credential Access", "T1558.003", "Steal or Forge Kerberos Tickets: Kerberoasting")


@dataclass
class Config:
    """What a deployment sets: reference tables, learned models, and whether alerts of a pair are thinned.

    ``models``: family models by family (dns takes the place of the lexical test); ``forests``: isolation forests by family with
    their F1; ``baseline``: what ``fit_baseline`` gives. On streams: ``live_baseline`` learns and then scores; ``keyed_state``
    runs the detectors that keep state for each key, a query for each; ``every`` is their trigger. ``counts`` gathers, by query,
    the alerts made, rejected, suppressed by the allowlist and stored.
    """

    ja4_intel: DataFrame | None = None
    allowlist: DataFrame | None = None
    benign_domains: DataFrame | None = None
    cooldown_s: float | None = None
    models: dict[str, FamilyModel] = field(default_factory=dict)
    forests: dict[str, tuple[IsolationForest, float]] = field(default_factory=dict)
    baseline: tuple[DataFrame, DataFrame, DataFrame] | None = None
    live_baseline: LiveBaseline | None = None
    keyed_state: bool = True
    every: str = "5 seconds"
    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    extra: dict[str, tuple[str, Callable[[DataFrame, Config], DataFrame]]] = field(default_factory=dict)


def _rid(flows: DataFrame) -> DataFrame:
    return flows.withColumn("rid", F.col("flow_uid"))


@dataclass(frozen=True)
class Service:
    """An application-service detector: its hits in batch and on a stream, and what its alerts say. A pair alerts once in 600 s."""

    engine: str
    batch: Callable[[DataFrame], DataFrame]
    stream: Callable[[DataFrame], DataFrame]
    cls: str
    mitre: tuple
    evidence: tuple[str, ...]
    pair = ("src_ip", "dst_ip")
    silence = 600

    def alerts(self, hits: DataFrame) -> DataFrame:
        return build_alert(hits, self.engine, self.cls, F.col("severity"), F.col("confidence"), self.mitre, list(self.evidence))

    def __call__(self, flows: DataFrame, cfg: Config) -> DataFrame:
        return self.alerts(cooldown(self.batch(_rid(flows)), list(self.pair), "ts", self.silence, ("rid",)))

    def micro_batch(self, hits: DataFrame, number: int, path: str) -> DataFrame:
        """Alerts of the hits that a micro-batch of ``stream`` brings."""
        return self.alerts(cooldown_batch(hits, number, path, list(self.pair), "ts", self.silence))


def _ot(flows: DataFrame, protocol: str) -> DataFrame:
    hits = st.ot_commands(flows, protocol).withColumn("tactic", F.lit("Impair Process Control"))
    evidence = ["technique_id"] if protocol == "profinet" else ["function"]
    return build_alert(hits, f"ot_{protocol}", "ICS_UNAUTHORIZED_CONTROL_COMMAND", F.col("severity"), F.col("confidence"), None, evidence)


def _columns(engine: str, cls: str, mitre: tuple, detect: Callable, evidence: list[str]) -> Callable:
    return lambda flows, cfg: build_alert(detect(_rid(flows)), engine, cls, F.col("severity"), F.col("confidence"), mitre, evidence)


def _dga(hits: DataFrame, engine: str, name: str, cfg: Config) -> DataFrame:
    score, mode = ("threat_score", "xgboost") if "dns" in cfg.models else ("dga_score", "rule")
    return build_alert(hits, engine, "DGA_DOMAIN", F.col("severity"), F.col("confidence"), DGA, [name, score], mode)


def _campaigns(flows: DataFrame) -> DataFrame:
    return recon_campaigns(flows).withColumn("severity", F.when(F.col("escalation"), "HIGH").otherwise("MEDIUM"))


SERVICES = (
    Service("distcc", win.distcc_exec, win.distcc_exec, "NETWORK_INTRUSION_ATTEMPT", ("Initial Access", "T1190", "Exploit Public-Facing Application"), ("app_detail",)),
    Service("smtp_enumeration", win.smtp_enumeration, keyed.smtp_enumeration_stream, "RECONNAISSANCE", ("Discovery", "T1087", "Account Discovery"), ("n_vrfy", "n_rcpt", "n_reject")),
    Service(
        "default_credentials", win.default_credentials, win.default_credentials, "NETWORK_INTRUSION_ATTEMPT",
        ("Initial Access", "T1078.001", "Valid Accounts: Default Accounts"), ("app_detail",),
    ),
    Service("http_guessing", win.http_guessing, keyed.http_guessing_stream, "NETWORK_INTRUSION_ATTEMPT", GUESS, ("n_basic", "n_401")),
    Service(
        "web_deployments", win.web_deployments, keyed.web_deployments_stream, "NETWORK_INTRUSION_ATTEMPT",
        ("Execution", "T1505.003", "Server Software Component: Web Shell"), ("app_detail", "preceded"),
    ),
)
#: name: (log type, function of mapped flows and configuration that gives alerts); deployments add their own by Config.extra
DETECTORS: dict[str, tuple[str, Callable[[DataFrame, Config], DataFrame]]] = {
    "slowloris": ("conn", _columns("slowloris", "SLOWLORIS", ("Impact", "T1499", "Endpoint Denial of Service"), st.slowloris, ["duration_s", "orig_bytes", "resp_bytes"])),
    "flood": ("conn", _columns("flood", "VOLUMETRIC_DDOS", IMPACT, win.flood_sources, ["n_flows", "n_dst"])),
    "spoofed_flood": ("conn", _columns("spoofed_flood", "VOLUMETRIC_DDOS", IMPACT, win.spoofed_flood, ["n_flows", "n_src"])),
    "beacons": ("conn", _columns("beacons", "C2_BEACONING", C2, win.beacons, ["mean_gap", "cv", "samples", "jitter_pct"])),
    "recon": ("conn", _columns("recon", "RECONNAISSANCE", SCAN, _campaigns, ["targets", "escalation"])),
    "exfil_single": ("conn", _columns("exfil_single", "DATA_EXFILTRATION", EXFIL, st.exfil_single, ["orig_bytes", "resp_bytes"])),
    "exfil_accumulated": ("conn", _columns("exfil_accumulated", "DATA_EXFILTRATION", EXFIL, win.exfil_accumulated, ["sent", "received", "n_flows"])),
    "brute_force": ("conn", _columns("brute_force", "NETWORK_INTRUSION_ATTEMPT", GUESS, win.brute_force, ["attempt"])),
    "dns_tunnels": ("dns", _columns("dns_tunnels", "DNS_TUNNELING", TUNNEL, st.dns_tunnels, ["dns_query", "dns_qtype", "entropy"])),
    "dga": ("dns", lambda f, c: _dga(st.dga_model(f, c.models["dns"], domains=c.benign_domains) if "dns" in c.models else st.dga_lexical(f, domains=c.benign_domains), "dga", "dns_query", c)),
    "sni_dga": ("ssl", lambda f, c: _dga(st.sni_dga(_rid(f), model=c.models.get("dns")), "sni_dga", "sni", c)),
    "http": ("http", lambda f, c: build_alert(st.http_threats(f), "http", F.col("threat_class"), F.col("severity"), F.col("confidence"), None, ["http_method", "http_uri", "reasons"])),
    "kerberoasting": ("kerberos", _columns("kerberoasting", "NETWORK_INTRUSION_ATTEMPT", ROAST, st.kerberoasting, ["krb_service", "krb_cipher", "krb_client"])),
    **{f"ot_{p}": (p, lambda f, c, p=p: _ot(f, p)) for p in ("modbus", "cip", "dnp3", "s7comm", "iec104", "bacnet", "opcua", "profinet")},
    **{s.engine: ("appsvc", s) for s in SERVICES},
}
#: the same detectors on a stream, with state for each key
STREAMED: dict[str, tuple[str, Callable[[DataFrame, Config], DataFrame]]] = {
    "flood": ("conn", _columns("flood", "VOLUMETRIC_DDOS", IMPACT, keyed.flood_stream, ["n_flows", "n_dst"])),
    "spoofed_flood": ("conn", _columns("spoofed_flood", "VOLUMETRIC_DDOS", IMPACT, keyed.spoofed_flood_stream, ["n_flows", "n_src"])),
    "beacons": ("conn", _columns("beacons", "C2_BEACONING", C2, keyed.beacons_stream, ["mean_gap", "cv", "samples", "jitter_pct"])),
    "exfil_accumulated": ("conn", _columns("exfil_accumulated", "DATA_EXFILTRATION", EXFIL, keyed.exfil_accumulated_stream, ["sent", "received", "n_flows"])),
    "brute_force": ("conn", _columns("brute_force", "NETWORK_INTRUSION_ATTEMPT", GUESS, keyed.brute_force_stream, ["attempt"])),
}
#: detectors that judge rows by themselves and so run unchanged on a stream
STATELESS = ("slowloris", "exfil_single", "dns_tunnels", "dga", "sni_dga", "http", "kerberoasting", *(d for d in DETECTORS if d.startswith("ot_")))


def opcua_weak_policies(opcua: DataFrame, realert: float = 3600) -> DataFrame:
    """Weak channel policies, once for each pair, port and policy in ``realert`` seconds."""
    from netquill.functions.codes import OPCUA_WEAK

    severity, confidence = (F.create_map(*[F.lit(x) for k, v in OPCUA_WEAK.items() for x in (k, v[i])]) for i in (0, 1))
    weak = opcua.where(F.col("opcua_policy").isin(*OPCUA_WEAK))
    once = cooldown(weak, ["src_ip", "dst_ip", "dst_port", "opcua_policy"], "ts", realert, ("flow_uid",))
    return once.withColumns({"severity": severity[F.col("opcua_policy")], "confidence": confidence[F.col("opcua_policy")]})


#: family of models that judge a log's flows besides the rules
FAMILY_LOGS = {"flow": "conn", "tls": "ssl", "modbus": "modbus"}


def _learned(flows: dict[str, DataFrame], cfg: Config, rules: DataFrame | None) -> list[DataFrame]:
    """Alerts of the family models, fused with the rules' alerts on the same flows, and of the baseline."""
    found = []
    named = rules.where("flow_uid not in ('', 'unknown')") if rules is not None else None
    for family, log in FAMILY_LOGS.items():
        if family not in cfg.models or log not in flows:
            continue
        rows = flows[log].withColumn("register_sweep_count", F.lit(None).cast("int")) if family == "modbus" else flows[log]
        scored = score_rows(rows, cfg.models[family]).withColumnRenamed("threat_score", "xgb_score")
        if family in cfg.forests:
            forest, f1 = cfg.forests[family]
            made = forest.score(MAKERS[family](scored))
            scored = combine_scores(made, {"iforest_f1": f1})
        else:
            scored = scored.withColumns({"threat_score": F.col("xgb_score"), "detection_mode": F.lit("xgboost"), "model_scores": F.create_map(F.lit("xgboost"), F.col("xgb_score"))})
        hits = ml_alerts(scored, family, named)
        found.append(build_alert(hits, f"ml_{family}", F.col("threat_class"), F.col("severity"), F.col("confidence"), None, ["threat_score", "corroborated"], F.col("detection_mode")))
    if cfg.baseline is not None and "conn" in flows:
        profiles, pooled, calibration = cfg.baseline
        hits = baseline_alerts(baseline_score(baseline_features(flows["conn"]), profiles, pooled), calibration)
        found.append(build_alert(hits, "baseline", "BEHAVIORAL_ANOMALY", F.col("severity"), F.col("confidence"), SCAN, ["service", "score", "p"], "baseline"))
    return found


def detect(flows: dict[str, DataFrame], cfg: Config | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """The alerts of all detectors whose log is among ``flows`` (mapped flows by log type)."""
    cfg = cfg or Config()
    found = [f(flows[log], cfg) for name, (log, f) in (DETECTORS | cfg.extra).items() if log in flows and (only is None or name in only)]
    if "ssl" in flows and cfg.ja4_intel is not None:
        hits = st.ja4_matches(flows["ssl"], cfg.ja4_intel)
        found.append(build_alert(hits, "ja4", "ENCRYPTED_MALWARE", F.col("severity"), F.col("confidence"), ("Command and Control", "T1573", "Encrypted Channel"), ["ja4", "application", "tier"]))
    if "opcua" in flows and only is None:
        hits = opcua_weak_policies(flows["opcua"])
        found.append(build_alert(hits, "opcua_policy", "INSECURE_CONFIGURATION", F.col("severity"), F.col("confidence"), ("Collection", "T0830", "Adversary-in-the-Middle"), ["opcua_policy"]))
    if "eve" in flows:
        hits = st.map_ids_alerts(flows["eve"])
        found.append(build_alert(hits, "ids", F.col("threat_class"), F.col("severity"), F.col("confidence"), None, ["signature", "signature_id", "category"], discriminator=F.col("signature_id").cast("string")))
    if "notice" in flows:
        hits = st.map_notices(flows["notice"])
        found.append(build_alert(hits, "notice", "NETWORK_INTRUSION_ATTEMPT", F.col("severity"), F.col("confidence"), None, ["notice", "msg"], discriminator=F.col("notice")))
    if only is None:
        found += _learned(flows, cfg, union_alerts(*found) if found else None)
    return union_alerts(*found)


def finish(alerts: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, suppressed, rejected) after validation, allowlist and cooldown."""
    valid, rejected = validate_alerts(alerts)
    kept, suppressed = apply_allowlist(valid, cfg.allowlist) if cfg.allowlist is not None else (valid, valid.limit(0).withColumn("rule_id", F.lit(None).cast("string")))
    return (alert_cooldown(kept, cfg.cooldown_s) if cfg.cooldown_s else kept), suppressed, rejected


def run_batch(spark: SparkSession, directory: str, table: str, cfg: Config | None = None, log_types: tuple[str, ...] | None = None) -> DataFrame:
    """Read the logs of a folder (by default of all types), detect, and append the alerts to a table; returns what was kept."""
    cfg = cfg or Config()
    log_types = log_types or (*dict.fromkeys(log for log, _ in (DETECTORS | cfg.extra).values()), "eve", "notice")
    flows = {k: read_logs(spark, directory, k) if k in ("eve", "notice") else map_records(read_logs(spark, directory, k), k) for k in log_types}
    kept, _, _ = finish(detect(flows, cfg), cfg)
    return append_alerts(kept, table)


#: one writer at a time: the queries of a driver append to one table
_APPENDING = threading.Lock()


def _store(alerts: DataFrame, number: int, name: str, table: str, checkpoint: str, cfg: Config) -> None:
    """Validate, allow-list, thin and append a micro-batch's alerts, which are computed once; rejected ones go to ``<table>_rejected``."""
    spark = alerts.sparkSession
    path = scratch(spark, f"alerts-{name}")
    made = written(alerts, path)
    kept, suppressed, rejected = finish(made, replace(cfg, cooldown_s=None))
    n_made, n_bad = made.agg(F.count("*"), F.count_if(F.size(violations()) > 0)).first()
    n_suppressed = suppressed.count() if cfg.allowlist is not None else 0
    if cfg.cooldown_s:
        keys = {"_src": F.col("flow_identifier.src_ip"), "_dst": F.col("flow_identifier.dst_ip"), "_disc": discriminator()}
        kept = cooldown_batch(kept.withColumns(keys), number, f"{checkpoint}/{name}-cooldown", ["threat_class", *keys], "timestamp", cfg.cooldown_s).drop(*keys)
    with _APPENDING:
        stored = append_alerts(kept, table)
        if n_bad:
            rejected.withColumn("batch", F.lit(f"{name}-{number}")).write.mode("append").parquet(f"{table}_rejected")
    held = cfg.counts.setdefault(name, {"made": 0, "rejected": 0, "suppressed": 0, "stored": 0})
    for key, n in (("made", n_made), ("rejected", n_bad), ("suppressed", n_suppressed), ("stored", stored.count())):
        held[key] += n
    for folder in {f.rsplit("/", 1)[0] for f in stored.inputFiles()} | {path}:
        delete(spark, folder)


def start_pipeline(spark: SparkSession, sources: dict[str, dict], table: str, checkpoint: str, cfg: Config | None = None) -> list:
    """A streaming query for each log type, of the stateless detectors, recon campaigns and the cooldown, which keep their state
    under ``checkpoint``, and one for each detector of ``STREAMED``, by ``transformWithState``; alerts are appended once by id."""
    cfg = cfg or Config()
    queries = []
    for log, source in sources.items():
        names = tuple(n for n, (kind, _) in (DETECTORS | cfg.extra).items() if kind == log and (n in STATELESS or n in cfg.extra))
        if not names and log not in ("eve", "notice", "appsvc"):
            raise ValueError(f"no detector of {log} runs on a stream")
        rows = stream_logs(spark, log, source)
        flows = rows if log in ("eve", "notice") else map_records(rows, log)

        def sink(batch: DataFrame, number: int, log: str = log, names: tuple[str, ...] = names) -> None:
            found = [detect({log: batch}, cfg, names)]
            if log == "conn":
                campaigns = recon_batch(batch, number, f"{checkpoint}/{log}-recon")
                severity = F.when(F.col("escalation"), "HIGH").otherwise("MEDIUM")
                found.append(build_alert(campaigns, "recon", "RECONNAISSANCE", severity, F.col("confidence"), SCAN, ["targets", "escalation"]))
                hits = cfg.live_baseline.hits(_rid(batch), number) if cfg.live_baseline else None
                if hits is not None:
                    found.append(build_alert(hits, "baseline", "BEHAVIORAL_ANOMALY", F.col("severity"), F.col("confidence"), SCAN, ["service", "score", "p"], "baseline"))
            _store(union_alerts(*found), number, log, table, checkpoint, cfg)

        if log != "appsvc" or names:
            queries.append(flows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{checkpoint}/{log}").queryName(f"detect_{log}").start())
        for service in SERVICES if log == "appsvc" else ():
            if service.stream is not service.batch and not cfg.keyed_state:
                continue
            keyed.keep_state(spark)

            def thin(batch: DataFrame, number: int, service: Service = service) -> None:
                path = scratch(spark, f"hits-{service.engine}")
                hits = written(batch, path)
                _store(service.micro_batch(hits, number, f"{checkpoint}/{service.engine}-hits"), number, service.engine, table, checkpoint, cfg)
                delete(spark, path)

            hits = service.stream(_rid(flows)).writeStream.foreachBatch(thin).option("checkpointLocation", f"{checkpoint}/{service.engine}")
            queries.append(hits.trigger(processingTime=cfg.every).queryName(f"detect_{service.engine}").start())
        for name, (kind, detector) in STREAMED.items():
            if kind != log or not cfg.keyed_state:
                continue
            keyed.keep_state(spark)

            def store(batch: DataFrame, number: int, name: str = name) -> None:
                _store(batch, number, name, table, checkpoint, cfg)

            alerts = detector(flows, cfg).writeStream.foreachBatch(store).option("checkpointLocation", f"{checkpoint}/{name}")
            queries.append(alerts.trigger(processingTime=cfg.every).queryName(f"detect_{name}").start())
    return queries
