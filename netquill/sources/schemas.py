"""Schemas of the log records, packets, files and alerts."""

from __future__ import annotations

from pyspark.sql import types as T

_COMMON = "uid string, ts double, `id.orig_h` string, `id.orig_p` int, `id.resp_h` string, `id.resp_p` int, proto string, segment_hash string"
_OT = "function string, detail string, code int"
_EXTRA = {
    "conn": "duration double, orig_bytes bigint, resp_bytes bigint, orig_pkts bigint, resp_pkts bigint",
    "dns": "query string, qtype_name string",
    "ssl": "ja4 string, server_name string, sni string",
    "modbus": "func string, func_name string, register int",
    "dnp3": "fc_request string, func string",
    "http": "method string, uri string, user_agent string, request_body_len bigint, response_body_len bigint",
    "kerberos": "request_type string, cipher string, service string, client string",
    "cip": "service int, response boolean, class_id int, instance_id int",
    **{k: _OT for k in ("s7comm", "profinet", "opcua", "bacnet", "appsvc", "iec104")},
}
LOG_TYPES = tuple(_EXTRA)
NOTICE = "note string, msg string, src string, dst string, p int, ts double"
EVE = (
    "event_type string, src_ip string, dest_ip string, proto string, src_port int, dest_port int, timestamp_epoch double,"
    " alert struct<signature: string, signature_id: bigint, category: string, severity: int>"
)
PACKETS = (
    "capture_id string, id bigint, ts double, wire_len int, src string, dst string, proto string, sport int, dport int, tcp_flags int,"
    " src_mac string, is_arp boolean, dns_qr int, payload binary"
)
ALERT = (
    "alert_id string, timestamp double, severity string, confidence_score double, threat_class string,"
    " flow_identifier struct<src_ip: string, src_port: int, dst_ip: string, dst_port: int, protocol: string>,"
    " mitre_attack struct<tactic: string, technique_id: string, technique_name: string>, evidence string, forensics string, detection_mode string,"
    " model_scores map<string, double>, top_contributing_features array<struct<feature: string, importance: double>>, flow_uid string, engine string"
)


def log_schema(log_type: str) -> T.StructType:
    if log_type in ("notice", "eve"):
        return T.StructType.fromDDL(NOTICE if log_type == "notice" else EVE)
    return T.StructType.fromDDL(f"{_COMMON}, {_EXTRA[log_type]}")
