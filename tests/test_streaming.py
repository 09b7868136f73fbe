import json
import random

import pytest
from pyspark.sql import functions as F

from netquill.operators.sequential import cooldown, recon_campaigns
from netquill.operators import assembly, baseline, windows
from netquill.plans.pipeline import Config, detect, start_pipeline
from netquill.operators.mapping import map_records
from netquill.sources import readers
from netquill.sources.scratch import listed
from netquill.streaming import keyed
from netquill.streaming.learning import LiveBaseline
from netquill.streaming.stateful import cooldown_batch, recon_batch, recon_stream, stream_metrics

CONN = "ts double, src_ip string, dst_ip string, dst_port int, orig_bytes long, resp_bytes long"


def run(spark, tmp_path, ddl, batches, build, mode="append"):
    """Feed batches of rows one after the other; rows written by the stream, and the query."""
    source = tmp_path / "in"
    source.mkdir()
    names = [c.split()[0] for c in ddl.split(", ")]
    frame = build(spark.readStream.schema(ddl).json(str(source)))
    query = frame.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).start()
    for i, rows in enumerate(batches):
        (tmp_path / "part").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
        (tmp_path / "part").rename(source / f"{i}.json")
        query.processAllAvailable()
    metrics = stream_metrics(query)
    query.stop()
    return spark.table("out").collect(), metrics


def test_recon_stream_equals_batch(spark, tmp_path):
    rows = [(i * 0.5, "10.0.0.6", "10.0.0.7", i, 40, 0) for i in range(400)] + [(900 + i * 0.5, "10.0.0.6", "10.0.0.8", i, 40, 0) for i in range(60)]
    rows += [(i * 1.0, "quiet", "b", i, 40, 0) for i in range(10)]
    rows = [(1000 + t, *rest) for t, *rest in rows]  # the watermark starts at 0, which would make a first row at 0 late
    batch = recon_campaigns(spark.createDataFrame(rows, CONN)).collect()
    got, metrics = run(spark, tmp_path, CONN, [rows[:150], rows[150:390], rows[390:]], recon_stream)
    key = lambda r: (r["src_ip"], r["ts"], r["targets"], r["escalation"])
    assert sorted(map(key, got)) == sorted(map(key, batch)) and len(batch) >= 2
    assert metrics["received"] >= 0 and metrics["late"] == 0


def feed(spark, tmp_path, ddl, batches, build, endless=True):
    """The rows of a stream with keyed state, fed in batches."""
    keyed.keep_state(spark)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    names = [c.split()[0] for c in ddl.split(", ")]
    for i, rows in enumerate(batches):
        (tmp_path / "part").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
        (tmp_path / "part").rename(source / f"{i}.json")
    frame = build(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(source)))
    to = frame.writeStream.foreachBatch(lambda batch, n: batch.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "ck"))
    if endless:
        keyed.drain(to.trigger(processingTime="50 milliseconds").start(), len(batches))
    else:
        to.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).collect()


FLOWS = "rid long, ts double, src_ip string, dst_ip string, dst_port int, orig_bytes long, resp_bytes long, duration_s double, run_id string"


def traffic():
    draw = random.Random(2)
    rows = [(1000 + 20.0 * i + draw.random() / 4, "10.0.0.5", "9.9.9.9", 443, 10, 10) for i in range(70)]  # a beacon, longer than its ring
    rows += [(9000 + 20.0 * i, "10.0.0.5", "9.9.9.9", 443, 10, 10) for i in range(12)]  # after a silence
    rows += [(1500 + i * 0.02, "10.0.0.6", f"8.8.8.{i % 4}", 80, 10, 10) for i in range(450)]  # a flood, and one by spoofed sources
    rows += [(1700 + i * 0.03, f"11.0.{i // 200}.{i % 200}", "8.8.4.4", 80, 10, 10) for i in range(300)]
    rows += [(2100.0 + i, "10.0.0.7", "7.7.7.7", 443, 90_000, 500) for i in range(40)]
    rows += [(2400.0 + i, "10.0.0.8", "7.7.7.8", 22, 10, 10) for i in range(25)]
    rows += [(1000 + draw.random() * 2000, f"10.1.0.{draw.randrange(9)}", f"6.6.6.{draw.randrange(9)}", 53, None, 20) for _ in range(200)]
    return [(i, *r, 1.0, "a") for i, r in enumerate(sorted(rows))]


DETECT = [
    (windows.beacons, keyed.beacons_stream, {}),
    (windows.flood_sources, keyed.flood_stream, {"skip": F.lit}),
    (windows.spoofed_flood, keyed.spoofed_flood_stream, {"skip": F.lit}),
    (windows.exfil_accumulated, keyed.exfil_accumulated_stream, {}),
    (windows.brute_force, keyed.brute_force_stream, {}),
]


@pytest.mark.parametrize("cuts", [(300,), (5, 130, 131, 700)])
@pytest.mark.parametrize("batch,stream,named", DETECT, ids=[b.__name__ for b, _, _ in DETECT])
def test_keyed_detectors_equal_batch(spark, tmp_path, batch, stream, named, cuts):
    rows, named = traffic(), {k: v(False) for k, v in named.items()}
    ends = [0, *cuts, len(rows)]
    parts = [rows[a:b] for a, b in zip(ends, ends[1:])]
    for part in parts:
        random.Random(1).shuffle(part)  # order inside a micro-batch doesn't matter
    whole = batch(spark.createDataFrame(rows, FLOWS), **named).collect()
    got = feed(spark, tmp_path, FLOWS, parts, lambda s: stream(s, **named))
    key = lambda r: (r["rid"], round(r["confidence"], 6), r["severity"])
    assert sorted(map(key, got)) == sorted(map(key, whole)) and whole


APP = "rid long, ts double, src_ip string, dst_ip string, dst_port int, app_function string, app_detail string, app_code int, run_id string"


def service_events():
    draw = random.Random(8)
    kinds = ["smtp_vrfy", "smtp_expn", "smtp_rcpt", "smtp_reject", "http_basic", "http_401", "http_admin_deploy"]
    rows = [(1000 + draw.random() * 4000, f"10.0.0.{draw.randrange(3)}", f"9.9.9.{draw.randrange(2)}", 80, draw.choice(kinds), draw.choice(["a", "b", "c", None]), draw.choice([0, 0, 1, 2, None])) for _ in range(500)]
    rows += [(2000 + 4.0 * i, "10.0.0.9", "9.9.9.9", 25, "smtp_rcpt", f"user{i % 20}", 0) for i in range(60)]
    rows += [(2002 + 8.0 * i, "9.9.9.9", "10.0.0.9", 25, "smtp_reject", "x", 0) for i in range(30)]  # the server answers
    rows += [(3000 + 3.0 * (i // 2), "10.0.0.8", "9.9.9.8", 80, ("http_basic", "http_401")[i % 2], "x", 0) for i in range(40)]  # both at one time
    return [(i, *r, "a") for i, r in enumerate(sorted(rows, key=lambda r: r[0]))]


SERVICE = [
    (windows.smtp_enumeration, keyed.smtp_enumeration_stream, ("n_vrfy", "n_rcpt", "n_reject")),
    (windows.http_guessing, keyed.http_guessing_stream, ("n_basic", "n_401")),
    (windows.web_deployments, keyed.web_deployments_stream, ("preceded",)),
]


@pytest.mark.parametrize("batch,stream,counts", SERVICE, ids=[b.__name__ for b, _, _ in SERVICE])
def test_service_detectors_equal_batch(spark, tmp_path, batch, stream, counts):
    rows = service_events()
    ends = [0, *(i for i in (7, 150, 151, 400) if rows[i][1] != rows[i - 1][1]), len(rows)]
    parts = [rows[a:b] for a, b in zip(ends, ends[1:])]
    for part in parts:
        random.Random(1).shuffle(part)
    key = lambda r: (r["rid"], r["severity"], r["confidence"], *(r[c] for c in counts))
    whole = batch(spark.createDataFrame(rows, APP)).collect()
    got = feed(spark, tmp_path, APP, parts, stream)
    assert sorted(map(str, map(key, got))) == sorted(map(str, map(key, whole))) and whole


def test_a_late_row_is_judged_by_the_state_there_is(spark, tmp_path):
    rows = traffic()
    early = [r for r in rows if r[3] == "7.7.7.7"]
    others = [r for r in rows if r[3] != "7.7.7.7"]
    got = feed(spark, tmp_path, FLOWS, [others, early], keyed.exfil_accumulated_stream)  # a hundred minutes late
    assert {r["rid"] for r in got} == {r["rid"] for r in windows.exfil_accumulated(spark.createDataFrame(rows, FLOWS)).collect()}


PACKETS = "capture_id string, id long, ts double, src string, sport int, dst string, dport int, proto string, wire_len int, tcp_flags int, dns_qr int"


@pytest.mark.parametrize("cuts", [(40,), (3, 60, 61, 150)])
def test_flow_sessions_equal_batch(spark, tmp_path, cuts):
    draw = random.Random(4)
    times = sorted([1000.0 + 5 * i for i in range(140)] + [2500.0 + 70 * i for i in range(5)] + [4000.0 + draw.random() * 900 for _ in range(80)])
    rows = []
    for i, t in enumerate(times):  # one long talk that reaches its limit, pauses, and random ones
        a, b = ("a", 50000), ("b", draw.choice([80, 443]))
        (s, sp), (d, dp) = (a, b) if draw.random() < 0.6 else (b, a)
        rows.append((draw.choice(["c1", "c2"]) if t > 4000 else "c1", i, t, s, sp, d, dp, "tcp", 100 + i, None, 0))
    ends = [0, *cuts, len(rows)]
    parts = [rows[x:y] for x, y in zip(ends, ends[1:])] + [[("c9", 10**6, 10.0**6, "x", 1, "y", 2, "tcp", 1, None, 0)]]
    key = lambda r: (r["capture_id"], r["src_ip"], r["src_port"], r["dst_port"], r["ts"], r["last_ts"], r["orig_bytes"], r["resp_bytes"], r["orig_pkts"], r["resp_pkts"], r["flow_uid"])
    whole = assembly.assemble_live(spark.createDataFrame(rows, PACKETS)).collect()
    got = feed(spark, tmp_path, PACKETS, parts, lambda s: keyed.flow_sessions(s, delay="10 seconds"), endless=False)
    assert sorted(map(key, got)) == sorted(map(key, whole)) and len(whole) > 12


def test_two_runs_in_one_table_are_worlds_of_their_own(spark):
    rows = traffic()
    half = [r for r in rows if r[0] % 2 == 0]
    both = spark.createDataFrame([(*r[:-1], "a") for r in rows] + [(*r[:-1], "b") for r in half], FLOWS).repartition(3)
    for batch, _, named in DETECT:
        named = {k: v(False) for k, v in named.items()}
        alone = {run: {r["rid"] for r in batch(spark.createDataFrame(part, FLOWS), **named).collect()} for run, part in (("a", rows), ("b", half))}
        got = batch(both, **named).collect()
        assert {run: {r["rid"] for r in got if r["run_id"] == run} for run in "ab"} == alone


def test_alerts_of_two_runs_dont_meet(spark):
    conn = [(1.0, f"u{i}", "10.0.0.9", 1, "8.8.8.8", 443, "tcp", 5_000_000, 10, 1.0, 5, 5, "S1", run) for i in range(3) for run in ("a", "b")]
    ddl = "ts double, uid string, `id.orig_h` string, `id.orig_p` int, `id.resp_h` string, `id.resp_p` int, proto string, orig_bytes long, resp_bytes long, duration double, orig_pkts long, resp_pkts long, conn_state string, run_id string"
    records = spark.createDataFrame(conn, ddl).withColumn("segment_hash", F.lit(""))
    found = detect({"conn": map_records(records, "conn")}, Config(), ("exfil_single",)).collect()
    assert len(found) == 6 == len({r["alert_id"] for r in found}) and {r["run_id"] for r in found} == {"a", "b"}


def test_the_baseline_learns_and_is_armed(spark, tmp_path):
    draw = random.Random(6)
    ddl = "rid long, ts double, src_ip string, dst_ip string, dst_port int, proto string, orig_bytes long, resp_bytes long, orig_pkts long, resp_pkts long, duration_s double"
    rows = [(i, 1000.0 + i, "10.0.0.1", "10.0.0.2", draw.choice([80, 443]), "TCP", draw.randrange(100, 200), draw.randrange(100, 200), 5, 5, 1.0) for i in range(900)]
    rows += [(2000 + i, 1950.0 + i, "10.0.0.1", "10.0.0.2", 80, "TCP", 10**9, 10, 10**6, 1, 0.1) for i in range(3)]
    frame = lambda part: spark.createDataFrame(part, ddl)
    live = LiveBaseline(spark, str(tmp_path / "live"), min_flows=500, min_s=300, alpha=0.01)
    got, phases = set(), []
    for n, (a, b) in enumerate([(0, 200), (200, 450), (450, 800), (800, 903)]):
        for _ in range(2):  # a batch that runs again gives the same
            hits = live.hits(frame(rows[a:b]), n)
            found = set() if hits is None else {r["rid"] for r in hits.collect()}
        got |= found
        phases.append(live.phase())
    assert phases == ["learning", "learning", "armed", "armed"]
    flows = baseline.baseline_features(frame(rows))
    learned = baseline.learning_set(flows, 500, 300)
    profiles, pooled, calibration = baseline.fit_baseline(learned)
    whole = baseline.baseline_alerts(baseline.baseline_score(flows.join(learned.select("rid"), "rid", "left_anti"), profiles, pooled), calibration, 0.01)
    assert got == {r["rid"] for r in whole.collect()} and {2000, 2001, 2002} <= got
    assert live.relearn(frame(rows)) == 2 and live.version() == 2
    (tmp_path / "live" / "versions" / "3").mkdir()  # one that was never completed
    assert live.version() == 2


def test_the_pipeline_streams_keyed_detectors_and_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one = {"id.orig_p": 1, "id.resp_p": 22, "proto": "tcp", "orig_bytes": 100, "resp_bytes": 100, "duration": 1.0, "orig_pkts": 5, "resp_pkts": 5, "conn_state": "SF"}
    rows = [one | {"uid": f"X{i}", "ts": 1200.0 + i, "id.orig_h": "10.0.0.1", "id.resp_h": "10.0.0.2"} for i in range(20)]
    rows += [one | {"uid": "bad", "ts": 1200.0, "id.orig_h": "10.0.0.3", "id.resp_h": "8.8.8.8", "id.orig_p": 70_000, "orig_bytes": 9_000_000}]
    for i, part in enumerate((rows[:6], rows[6:])):
        (tmp_path / "part").write_text("\n".join(map(json.dumps, part)))
        (tmp_path / "part").rename(tmp_path / "in" / f"{i}.json")
    cfg = Config(cooldown_s=30, every="100 milliseconds")
    queries = start_pipeline(spark, {"conn": {"path": str(tmp_path / "in"), "maxFilesPerTrigger": 1}}, str(tmp_path / "out"), str(tmp_path / "ck"), cfg)
    for q in queries[1:]:
        keyed.drain(q, 2)
    queries[0].processAllAvailable()
    queries[0].stop()
    stored = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r["flow_uid"] for r in stored if r["engine"] == "brute_force"] == ["X9"]
    assert cfg.counts["brute_force"] == {"made": 1, "rejected": 0, "suppressed": 0, "stored": 1}
    assert cfg.counts["conn"]["rejected"] == 1 and spark.read.parquet(str(tmp_path / "out_rejected")).first()["violations"] == ["ports"]


def test_late_rows_missing_state_and_old_state(spark, tmp_path):
    ddl, at = "src_ip string, ts double", str(tmp_path / "state")
    give = lambda n, *rows: sorted((r["src_ip"], r["ts"]) for r in cooldown_batch(spark.createDataFrame(rows, ddl), n, at, ["src_ip"], "ts", 60).collect())
    assert give(3, ("a", 1000.0)) == [("a", 1000.0)]  # nothing was kept under number 2
    assert give(4, ("b", 900.0), ("a", 990.0), ("a", 700.0)) == [("a", 700.0), ("b", 900.0)]  # late, and no reason to lose them
    assert give(5, ("a", 1059.0), ("b", 960.0)) == [("b", 960.0)]
    assert give(6, ("a", 1061.0)) == [("a", 1061.0)]
    assert set(listed(spark, at)) == {"5", "6", "6-all"}


def test_batches_go_on_from_the_last_state(spark, tmp_path):
    rows = [(1000 + i * 0.02, "10.0.0.6", "10.0.0.7", i % 25, 40, 0) for i in range(600)] + [(1012.0, "quiet", "b", 1, 40, 0)]
    frame = lambda part: spark.createDataFrame(part, CONN)
    key = lambda r: (r["src_ip"], r["ts"], r["targets"], r["escalation"])
    got, thinned = [], []
    for n, part in enumerate((rows[:110], rows[110:390], rows[390:])):
        for _ in range(2 if n == 1 else 1):  # a batch that runs again gives the same
            again = [key(r) for r in recon_batch(frame(part), n, str(tmp_path / "recon")).collect()]
            kept = [r["ts"] for r in cooldown_batch(frame(part), n, str(tmp_path / "cool"), ["src_ip"], "ts", 3).collect()]
        got += again
        thinned += kept
    whole = [key(r) for r in recon_campaigns(frame(rows)).collect()]
    assert sorted(got) == sorted(whole) and any(r[3] for r in whole)
    assert sorted(thinned) == sorted(r["ts"] for r in cooldown(frame(rows), ["src_ip"], "ts", 3).collect())
