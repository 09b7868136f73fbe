import json

import pytest
from pyspark.sql import functions as F

from netquill.operators import baseline, models
from netquill.operators.joins import apply_allowlist
from netquill.operators.mapping import map_records
from netquill.plans.pipeline import Config, detect, run_batch, start_pipeline
from netquill.sources import readers, sinks
from netquill.streaming import keyed


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


CONN = {"uid": "C1", "ts": 100.0, "id.orig_h": "10.0.0.1", "id.orig_p": 4444, "id.resp_h": "10.0.0.2", "id.resp_p": 80, "proto": "tcp", "duration": 2.0, "orig_bytes": 500000, "resp_bytes": 10}


def test_bad_lines_are_skipped_and_absent_is_empty(spark, tmp_path):
    write(tmp_path / "conn.log", [CONN, "", "{broken", CONN | {"uid": "C2"}])
    assert [r["uid"] for r in readers.read_logs(spark, str(tmp_path), "conn").orderBy("uid").collect()] == ["C1", "C2"]
    assert readers.read_logs(spark, str(tmp_path), "dns").count() == 0


def test_mapping_names_and_defaults(spark, tmp_path):
    write(tmp_path / "conn.log", [CONN, {"ts": 1.0}])
    rows = {r["flow_uid"]: r for r in map_records(readers.read_logs(spark, str(tmp_path), "conn"), "conn").collect()}
    assert rows["C1"]["proto"] == "TCP" and rows["C1"]["duration_s"] == 2.0 and rows["C1"]["segment_hash"].startswith("sha256:")
    assert rows["unknown"]["src_ip"] == "" and rows["unknown"]["orig_bytes"] == 0 and rows["unknown"]["orig_pkts"] is None
    write(tmp_path / "ssl.log", [{"uid": "S", "ts": 1.0, "ja4": "x", "server_name": "", "sni": "a.b"}])
    assert map_records(readers.read_logs(spark, str(tmp_path), "ssl"), "ssl").first()["sni"] == "a.b"


def test_allowlist(spark, tmp_path):
    rules = [
        {"id": "ok", "reason": "scanner", "src": "10.0.0.0/24", "dst_port": [80, 443]}, {"id": "blanket", "reason": "x", "threat_class": "RECONNAISSANCE"},
        {"id": "old", "reason": "x", "src": "10.0.0.1", "expires": "2020-01-01"}, {"id": "off", "reason": "x", "src": "10.0.0.1", "enabled": False},
        {"id": "bad", "reason": "x", "src": "nonsense"}, {"id": "none", "src": "10.0.0.1"}, {"id": "v6", "reason": "x", "dst": ["2001:db8::/33"]},
    ]
    (tmp_path / "allow.json").write_text(json.dumps({"rules": rules}))
    good, problems = readers.load_allowlist(spark, str(tmp_path / "allow.json"), "2024-06-01")
    assert sorted(r["id"] for r in good.collect()) == ["ok", "v6"] and sorted(r["id"] for r in problems.collect()) == ["bad", "blanket", "none", "old"]
    ddl = "alert_id string, severity string, threat_class string, detection_mode string, evidence string, flow_identifier struct<src_ip: string, src_port: int, dst_ip: string, dst_port: int>"
    alerts = spark.createDataFrame([
        ("a", "HIGH", "X", "rule", "{}", ("10.0.0.7", 1, "1.1.1.1", 80)), ("b", "CRITICAL", "X", "rule", "{}", ("10.0.0.7", 1, "1.1.1.1", 80)),
        ("c", "HIGH", "X", "rule", "{}", ("10.0.1.7", 1, "1.1.1.1", 80)), ("d", "HIGH", "X", "rule", "{}", ("9.9.9.9", 1, "2001:db8:7fff::1", 1)),
        ("e", "HIGH", "X", "rule", "{}", ("9.9.9.9", 1, "2001:db8:8000::1", 1)),
    ], ddl)
    kept, suppressed = apply_allowlist(alerts, good)
    assert {r["alert_id"]: r["rule_id"] for r in suppressed.collect()} == {"a": "ok", "d": "v6"} and kept.count() == 3


def test_signature_files_and_intel(spark, tmp_path):
    from netquill.operators.signatures import scan_signatures

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"MZ\x90harmless-marker")
    (tmp_path / "f" / "b.bin").write_bytes(b"plain")
    files = readers.read_files(spark, str(tmp_path / "f"), max_bytes=100)
    rules = spark.createDataFrame([("r", "a", "hex", "4D5A", 0, 2, None), ("r", "b", "text", "marker", None, 2, None)],
                                  "rule string, string_id string, kind string, pattern string, at_offset int, min_hits int, max_size bigint")
    hit = scan_signatures(files, rules).collect()
    assert [(h["hits"], h["file_type"]) for h in hit] == [(2, "pe_executable")]
    (tmp_path / "i.json").write_text(json.dumps({"malicious": {"t1": {"application": "m"}}, "dual_use": {"t2": {"application": "d"}}}))
    assert sorted(tuple(r)[:3] for r in readers.read_ja4_intel(spark, str(tmp_path / "i.json")).collect()) == [("dual_use", "t2", "d"), ("malicious", "t1", "m")]


def test_training_needs_two_classes(spark, tmp_path):
    (tmp_path / "t.csv").write_text("domain,label\na.com,benign\nb.com,benign\n")
    with pytest.raises(ValueError):
        readers.read_training(spark, str(tmp_path / "t.csv"), "dns")


def test_batch_pipeline_stores_each_alert_once(spark, tmp_path):
    rows = [CONN | {"uid": f"B{i}", "ts": float(i), "id.resp_p": 22, "orig_bytes": 1} for i in range(12)] + [CONN | {"uid": "X", "orig_bytes": 5_000_000}]
    write(tmp_path / "conn.log", rows)
    for _ in range(2):
        run_batch(spark, str(tmp_path), str(tmp_path / "alerts"))
    nested, counters = sinks.load_alerts(spark, str(tmp_path / "alerts"))
    assert sorted(r["threat_class"] for r in nested.collect()) == ["DATA_EXFILTRATION", "NETWORK_INTRUSION_ATTEMPT"]
    assert counters.where("field = 'threat_class'").count() == 2


def test_batch_pipeline_runs_all_logs_models_and_the_baseline(spark, tmp_path):
    flow = lambda i, sent: CONN | {"uid": f"F{i}", "ts": float(i), "id.resp_p": 443, "orig_bytes": sent, "resp_bytes": 9, "orig_pkts": 3, "resp_pkts": 3}
    write(tmp_path / "conn.log", [flow(i, 400 + i % 7) for i in range(60)] + [flow(99, 5_000_000)])
    common = {k: v for k, v in CONN.items() if k not in ("duration", "orig_bytes", "resp_bytes")}
    write(tmp_path / "modbus.log", [common | {"uid": "M", "func": "WRITE_SINGLE_COIL", "register": 7}])
    write(tmp_path / "appsvc.log", [common | {"uid": "A", "function": "distcc:exec", "detail": "sh", "code": 1}])
    write(tmp_path / "notice.log", [{"note": "BZAR::Scan", "msg": "m", "src": "10.0.0.1", "dst": "10.0.0.2", "p": 1, "ts": 5.0}])
    eve = {"event_type": "alert", "src_ip": "10.0.0.1", "dest_ip": "10.0.0.2", "proto": "TCP", "src_port": 1, "dest_port": 2, "timestamp_epoch": 9.0}
    write(tmp_path / "eve.log", [eve | {"alert": {"signature": "ET SCAN", "signature_id": 1, "category": "Attempted Recon", "severity": 2}}])
    flows = map_records(readers.read_logs(spark, str(tmp_path), "conn"), "conn")
    labelled = flows.withColumn("label", (F.col("flow_uid") == "F99").cast("int")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20))))
    model = models.train_family(labelled, "flow", trees=2, depth=2)
    learned = baseline.learning_set(baseline.baseline_features(flows.where("ts < 99")).withColumn("rid", F.col("flow_uid")), 60, 1)
    profiles, pooled, _ = baseline.fit_baseline(learned)
    calibration = spark.range(2000).select(F.lit(0.0).alias("score"))
    cfg = Config(models={"flow": model}, baseline=(profiles, pooled, calibration))
    engines = {(r["engine"], r["detection_mode"]) for r in run_batch(spark, str(tmp_path), str(tmp_path / "alerts"), cfg).collect()}
    assert engines >= {("ot_modbus", "rule"), ("distcc", "rule"), ("notice", "rule"), ("ids", "rule"), ("exfil_single", "rule"), ("ml_flow", "xgboost"), ("baseline", "baseline")}


def test_rejects(spark, tmp_path):
    write(tmp_path / "conn.log", [CONN | {"orig_bytes": 5_000_000}])
    alerts = detect({"conn": map_records(readers.read_logs(spark, str(tmp_path), "conn"), "conn")}, Config(), ("exfil_single",))
    bad = alerts.withColumn("confidence_score", F.lit(101.0)).withColumn("threat_class", F.lit("NOPE"))
    valid, rejected = sinks.validate_alerts(alerts.unionByName(bad))
    assert valid.count() == 1 and rejected.first()["violations"] == ["confidence_score", "threat_class"]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [CONN | {"uid": f"X{i}", "orig_bytes": 5_000_000 if i % 2 else 10} for i in range(10)]
    write(tmp_path / "in" / "1.json", rows[:5])
    write(tmp_path / "in" / "2.json", rows[5:])
    queries = start_pipeline(spark, {"conn": {"path": str(tmp_path / "in"), "maxFilesPerTrigger": 1}}, str(tmp_path / "out"), str(tmp_path / "ck"), Config(keyed_state=False))
    for q in queries:
        q.processAllAvailable()
        q.stop()
    write(tmp_path / "conn.log", rows)
    batch = detect({"conn": map_records(readers.read_logs(spark, str(tmp_path), "conn"), "conn")}, Config(), ("exfil_single", "slowloris"))
    ids = lambda df: sorted(r["flow_uid"] for r in df.select("flow_uid").collect())
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == ids(batch) == ["X1", "X3", "X5", "X7", "X9"]


def test_stream_keeps_campaigns_and_the_cooldown_across_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    probes = [CONN | {"uid": f"P{i}", "ts": 100.0 + i, "id.resp_p": 1000 + i, "orig_bytes": 0, "resp_bytes": 0} for i in range(30)]
    sent = [CONN | {"uid": f"X{i}", "ts": 100.0 + i, "id.orig_h": "10.0.0.9", "orig_bytes": 5_000_000} for i in (3, 20)]
    write(tmp_path / "in" / "1.json", [*probes[:15], sent[0]])
    write(tmp_path / "in" / "2.json", [*probes[15:], sent[1]])
    source = {"path": str(tmp_path / "in"), "maxFilesPerTrigger": 1}
    for q in start_pipeline(spark, {"conn": source}, str(tmp_path / "out"), str(tmp_path / "ck"), Config(cooldown_s=60, keyed_state=False)):
        q.processAllAvailable()
        q.stop()
    assert sorted(r["engine"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["exfil_single", "recon"]
    with pytest.raises(ValueError):
        start_pipeline(spark, {"kerberoast": source}, str(tmp_path / "out"), str(tmp_path / "ck2"))


def test_stream_of_service_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    app = CONN | {"id.resp_p": 80, "function": "http_basic", "detail": "/x", "code": 0}
    tries = [app | {"uid": f"B{i}", "ts": 100.0 + i} for i in range(6)] + [app | {"uid": f"R{i}", "ts": 100.5 + i, "function": "http_401"} for i in range(6)]
    tries.sort(key=lambda r: r["ts"])
    run = [app | {"uid": f"D{t}", "ts": t, "id.resp_p": 3632, "function": "distcc:exec", "code": 1} for t in (101.0, 400.0, 800.0)]
    write(tmp_path / "in" / "1.json", [*tries[:5], run[0]])
    write(tmp_path / "in" / "2.json", [*tries[5:], *run[1:]])
    (tmp_path / "logs").mkdir()
    write(tmp_path / "logs" / "appsvc.log", [*tries, *run])
    found = lambda path: sorted((r["engine"], r["flow_uid"]) for r in spark.read.parquet(path).collect())
    cfg = Config(every="100 milliseconds")
    source = {"path": str(tmp_path / "in"), "maxFilesPerTrigger": 1}
    for q in start_pipeline(spark, {"appsvc": source}, str(tmp_path / "out"), str(tmp_path / "ck"), cfg):
        keyed.drain(q, 2)
    run_batch(spark, str(tmp_path / "logs"), str(tmp_path / "whole"), log_types=("appsvc",))
    assert found(str(tmp_path / "out")) == found(str(tmp_path / "whole")) == [("distcc", "D101.0"), ("distcc", "D800.0"), ("http_guessing", "R4")]
