"""Boundary vectors: what must fire and what must stay silent, and windows against naive sequential versions."""

import random

import pytest
from pyspark.sql import functions as F

from netquill.functions import net, text
from netquill.operators import assembly, predicates, stateless, windows
from netquill.operators.sequential import cooldown, recon_campaigns

CONN = "rid long, ts double, src_ip string, dst_ip string, dst_port int, duration_s double, orig_bytes long, resp_bytes long, proto string"


def conn(spark, rows):
    return spark.createDataFrame([(i, float(ts), s, d, p, float(dur), o, r, "TCP") for i, (ts, s, d, p, dur, o, r) in enumerate(rows)], CONN)


def flood(n_dst, n=200):
    return [(i * 0.05, "10.0.0.9", f"10.0.1.{i % n_dst}", 443, 1, 500, 500) for i in range(n)]


@pytest.mark.parametrize("n_dst,fires", [(8, 1), (16, 0), (21, 0)])
def test_flood_needs_flows_per_destination(spark, n_dst, fires):
    assert windows.flood_sources(conn(spark, flood(n_dst))).count() == fires


@pytest.mark.parametrize("port,fires", [(80, 1), (8080, 1), (0, 1), (22, 0), (443, 0), (1883, 0)])
def test_slowloris_ports(spark, port, fires):
    assert stateless.slowloris(conn(spark, [(0, "a", "b", port, 600, 30, 10)])).count() == fires


@pytest.mark.parametrize("dst,fires", [("10.0.0.80", 1), ("224.0.0.251", 0)])
def test_spoofed_flood_ignores_multicast(spark, dst, fires):
    rows = [(i * 0.01, f"1.2.{i // 250}.{i % 250}", dst, 80, 1, 60, 0) for i in range(200)]
    assert windows.spoofed_flood(conn(spark, rows)).count() == fires


@pytest.mark.parametrize("dst,fires", [("203.0.113.7", True), ("239.255.255.250", False), ("192.168.1.255", False)])
def test_beacons(spark, dst, fires):
    rows = [(i * 30.0, "192.168.1.5", dst, 443, 1, 100, 100) for i in range(30)]
    assert (windows.beacons(conn(spark, rows)).count() > 0) == fires


def test_beacon_history_restarts_after_silence(spark):
    rows = [(i * 30.0 + (0 if i < 8 else 10_000), "a.b", "c.d", 443, 1, 1, 1) for i in range(16)]
    assert windows.beacons(conn(spark, rows)).count() == 0  # 7 gaps on either side


def test_recon_fires_once_then_escalates(spark):
    rows = [(i * 0.01, "10.0.0.6", "10.0.0.7", i, 0, 40, 0) for i in range(3000)]
    hits = recon_campaigns(conn(spark, rows)).orderBy("ts").collect()
    assert 1 <= len(hits) <= 4 and hits[-1]["targets"] >= 2500 and [h["escalation"] for h in hits] == [False] + [True] * (len(hits) - 1)


def test_recon_counts_targets_repeated_within_a_second(spark):
    rows = [(round_ * 0.05 + i * 0.001, "10.0.0.6", "10.0.0.7", i, 0, 40, 0) for round_ in range(10) for i in range(25)]
    hits = recon_campaigns(conn(spark, rows)).orderBy("ts").collect()
    assert [(h["targets"], h["escalation"]) for h in hits] == [(25, False), (250, True)]


def test_recon_ignores_answered_and_multicast(spark):
    answered = [(i * 0.01, "a", "10.0.0.7", i, 0, 40, 100) for i in range(100)]
    ssdp = [(i * 0.01, "a", "239.255.255.250", i, 0, 40, 0) for i in range(100)]
    assert recon_campaigns(conn(spark, answered + ssdp)).count() == 0


def test_recon_new_campaign_after_silence(spark):
    rows = [(t + i * 0.01, "a", "b", i, 0, 40, 0) for t in (0, 1000) for i in range(30)]
    assert [h["escalation"] for h in recon_campaigns(conn(spark, rows)).collect()] == [False, False]


@pytest.mark.parametrize("sent,back,fires", [(5_000_000, 100, 1), (601_527, 22_742, 0), (5_000_000, 0, 0)])
def test_exfil_single(spark, sent, back, fires):
    assert stateless.exfil_single(conn(spark, [(0, "a", "b", 443, 1, sent, back)])).count() == fires


@pytest.mark.parametrize("n,sent,back,fires", [(40, 30_000, 1_000, True), (60, 20_000, 100, True), (10, 54_000, 3_857, False)])
def test_exfil_accumulated(spark, n, sent, back, fires):
    rows = [(i * 4.0, "a", "b", 443, 1, sent, back) for i in range(n)]
    assert (windows.exfil_accumulated(conn(spark, rows)).count() > 0) == fires


def test_brute_force_fires_exactly_at_ten(spark):
    rows = [(i * 1.0, "a", "b", 22, 1, 1, 1) for i in range(15)] + [(i * 1.0, "a", "b", 4444, 1, 1, 1) for i in range(15)]
    assert [r["rid"] for r in windows.brute_force(conn(spark, rows)).collect()] == [9]


APP = "rid long, ts double, src_ip string, dst_ip string, dst_port int, app_function string, app_detail string, app_code int"


def app(spark, rows):
    return spark.createDataFrame([(i, float(t), "c", "s", 80, f, d, k) for i, (t, f, d, k) in enumerate(rows)], APP)


def test_smtp_enumeration(spark):
    assert windows.smtp_enumeration(app(spark, [(i, "smtp_vrfy", f"u{i}", 0) for i in range(3)])).count() == 1
    harvest = [(i, "smtp_rcpt", f"u{i}", 0) for i in range(20)]
    refused = [(i + 0.5, "smtp_reject", "", 0) for i in range(20)]
    assert windows.smtp_enumeration(app(spark, harvest + refused)).count() > 0
    assert windows.smtp_enumeration(app(spark, harvest)).count() == 0
    assert windows.smtp_enumeration(app(spark, [(i, "smtp_rcpt", f"u{i}", 0) for i in range(40)] + refused[:4])).count() == 0


def test_http_guessing(spark):
    rows = [(i, f, "", 0) for i in range(6) for f in ("http_basic", "http_401")]
    assert windows.http_guessing(app(spark, rows)).count() > 0
    assert windows.http_guessing(app(spark, rows[:2])).count() == 0


@pytest.mark.parametrize("rows,severity", [
    ([(0, "http_admin_deploy", "/x", 0)], "MEDIUM"), ([(0, "http_basic", "u", 1), (100, "http_admin_deploy", "/x", 0)], "HIGH"), ([(0, "http_admin_deploy", "/x", 2)], "HIGH"),
    ([(0, "http_401", "", 0), (250, "http_admin_deploy", "/x", 0)], "HIGH"), ([(0, "http_401", "", 0), (100, "http_basic", "u", 0), (250, "http_admin_deploy", "/x", 0)], "MEDIUM"),
    ([(0, "http_401", "", 0), (301, "http_admin_deploy", "/x", 0)], "MEDIUM"),
])
def test_web_deployment(spark, rows, severity):
    assert [r["severity"] for r in windows.web_deployments(app(spark, rows)).collect()] == [severity]


def test_http_threats_and_pki(spark):
    import base64

    ocsp = "/" + base64.b64encode(bytes([0x30, 0x30, 0x30, 0x2E]) + bytes(range(46))).decode().replace("/", "%2F")
    rows = [("/x9f3k2j1z8q7w4b6v5n0", "python-requests/2.31", 0), (ocsp, "", 0), ("/d/pinrulesstl.cab", "", 0), ("/up", "Mozilla/5.0", 6_000_000), ("/api", "curl/8", 0)]
    df = spark.createDataFrame([(u, a, "POST", n) for u, a, n in rows], "http_uri string, http_user_agent string, http_method string, http_request_body_len long")
    assert sorted(r["http_uri"] for r in stateless.http_threats(df).collect()) == ["/up", "/x9f3k2j1z8q7w4b6v5n0"]


def test_dns(spark):
    rows = [("kqx3vwzptlmnbrx9.com", "A"), ("www.google.com", "A"), ("d2hhdGV2ZXItdGhpcy1pcy1lbmNvZGVkLWRhdGEtY2h1bms.evil.com", "TXT"), ("_googlecast._tcp.local", "A")]
    df = spark.createDataFrame([(q, t, 53, "8.8.8.8") for q, t in rows], "dns_query string, dns_qtype string, dst_port int, dst_ip string")
    assert [r["dns_query"] for r in stateless.dga_lexical(df).collect()] == ["kqx3vwzptlmnbrx9.com"]
    assert [r["dns_qtype"] for r in stateless.dns_tunnels(df).collect()] == ["TXT"]


def test_registrable_domain(spark):
    names = {"a-ring-fallback.msedge.net": "msedge.net", "x.bbc.co.uk": "bbc.co.uk", "a.b": "a.b", "www.example.com.": "example.com", "": ""}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.registrable_domain(F.col("n")).alias("d"))
    assert {r["n"]: r["d"] for r in df.collect()} == names


def test_ot_and_kerberos(spark):
    df = spark.createDataFrame([("OPERATE",), ("READ",), ("WRITE",)], "dnp3_func string")
    assert {r["function"]: r["severity"] for r in stateless.ot_commands(df, "dnp3").collect()} == {"OPERATE": "CRITICAL", "WRITE": "HIGH"}
    krb = spark.createDataFrame([("TGS", "rc4-hmac", s) for s in ("MSSQLSvc/db01", "krbtgt/R", "HOST/x", "")], "krb_request_type string, krb_cipher string, krb_service string")
    assert [r["krb_service"] for r in stateless.kerberoasting(krb).collect()] == ["MSSQLSvc/db01"]


@pytest.mark.parametrize("ip,private,multicast", [
    ("10.1.2.3", True, False), ("172.32.0.1", False, False), ("192.168.0.255", True, True), ("8.8.8.255", False, False), ("239.1.1.1", False, True), ("ff02::fb", False, True),
    ("fe80::1", True, False), ("2001:db8::1", False, False), ("::1", True, False), ("not an ip", False, False), (None, False, False),
])
def test_addresses(spark, ip, private, multicast):
    row = spark.createDataFrame([(ip,)], "ip string").select(net.is_private(F.col("ip")), net.is_multicast(F.col("ip"))).first()
    assert tuple(row) == (private, multicast)


def test_cooldown_equals_sequential(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), round(rng.random() * 500, 1)) for i in range(300)]
    kept = {}
    for _, k, t in sorted(rows, key=lambda r: r[2]):
        if not kept.get(k) or t - kept[k][-1] >= 30:
            kept.setdefault(k, []).append(t)
    got = cooldown(spark.createDataFrame(rows, "rid long, k string, ts double"), ["k"], "ts", 30, ("rid",)).collect()
    assert sorted((r["k"], r["ts"]) for r in got) == sorted((k, t) for k, ts in kept.items() for t in ts)


def test_running_distinct_equals_sequential(spark):
    rng = random.Random(4)
    rows = [(float(i), "s", rng.choice("abcdef")) for i in range(100)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rid long, ts double, k string, v string")
    got = [r["n"] for r in windows.running_distinct(df, ["k"], "v", "n").orderBy("ts").collect()]
    assert got == [len({v for _, _, v in rows[: i + 1]}) for i in range(100)]


PACKETS = "capture_id string, id long, ts double, wire_len int, src string, dst string, proto string, sport int, dport int, tcp_flags int, dns_qr int, payload binary"


def packets(spark, rows):
    return spark.createDataFrame([("c", i, float(t), 60, s, d, "tcp", sp, dp, fl, None, p) for i, (t, s, sp, d, dp, fl, p) in enumerate(rows)], PACKETS)


def test_assembly_orientation(spark):
    rows = [(0, "srv", 80, "cli", 50000, 0x10, None), (1, "cli", 50000, "srv", 80, 0x10, None), (2, "srv", 80, "cli", 50000, 0x10, None)]
    f = assembly.assemble_flows(packets(spark, rows)).first()
    assert (f["src_ip"], f["dst_ip"], f["orig_pkts"], f["resp_pkts"], f["duration_s"]) == ("cli", "srv", 1, 2, 2.0)


def test_live_assembly_cuts(spark):
    rows = [(t, "a", 50000, "b", 80, 0x10, None) for t in (*range(0, 400, 20), 600)]
    flows = assembly.assemble_live(packets(spark, rows)).orderBy("ts").collect()
    assert [(f["ts"], f["orig_pkts"]) for f in flows] == [(0.0, 16), (320.0, 4), (600.0, 1)]


def test_compile_jobs_are_cut_by_their_lengths(spark):
    jobs = {
        b"DIST00000001ARGC00000001ARGV00000002sh": ("distcc:sh", "", 1),
        b"DIST00000001ARGC00000003ARGV0000000C/usr/bin/GCCARGV00000002-cARGV00000003a.c": ("distcc:gcc", "-c a.c", 0),
        b"DIST00000001ARGC00000001ARGV00000007arm-gcc": ("distcc:arm-gcc", "", 0),
        b"DIST00000001ARGC00000002ARGV00000008clang-17ARGV00000004a AR": ("distcc:clang-17", "a AR", 0),
        b"DIST00000001ARGC00000001ARGV00000009sh": None,  # cut off
        b"DIST00000001ARGC00000002ARGV00000002shARGV0000000x-c": None,
        b"DIST00000001ARGC00000000": None,
        b"DIST0000000": None,
    }
    rows = [(i, "c", 1, "d", 3632, None, p) for i, p in enumerate(jobs)]
    got = {r["ts"]: (r["app_function"], r["app_detail"], r["app_code"]) for r in assembly.app_events(packets(spark, rows)).collect()}
    assert got == {float(i): v for i, v in enumerate(jobs.values()) if v}


def test_app_events_hide_passwords(spark):
    basic = b"PUT /manager/text/deploy?path=/x HTTP/1.1\r\nAuthorization: Basic YWRtaW46YWRtaW4=\r\nUser-Agent: x\r\n\r\n"
    rows = [(0, "c", 50000, "s", 80, None, basic), (1, "s", 80, "c", 50000, None, b"HTTP/1.1 401 No\r\n"), (2, "c", 50001, "m", 25, None, b"VRFY root@h\r\n")]
    rows += [(3, "c", 50000, "s", 80, None, basic.replace(b"PUT /manager/text/deploy", b"GET /docs")), (4, "c", 1, "d", 3632, None, b"DIST00000001ARGC00000002ARGV00000007/bin/shARGV00000002-c")]
    got = assembly.app_events(packets(spark, rows)).collect()
    assert sorted((r["app_function"], r["app_detail"], r["app_code"]) for r in got) == [
        ("distcc:sh", "-c", 1), ("http_401", "", 401), ("http_admin_deploy", "/manager/text/deploy?path=/x", 3), ("http_basic", "admin", 1), ("smtp_vrfy", "root", 0),
    ]
    assert all("admin:admin" not in str(r) for r in got)
    http = assembly.http_requests(packets(spark, rows)).first()
    assert (http["method"], http["uri"], http["user_agent"]) == ("PUT", "/manager/text/deploy?path=/x", "x")


def test_fixed_decode_and_ja4(spark):
    modbus = bytes([0, 1, 0, 0, 0, 6, 1, 6, 0x9C, 0x41, 0, 1])
    got = assembly.ot_fixed_decode(packets(spark, [(0, "a", 50000, "b", 502, None, modbus)])).first()
    assert (got["function"], got["register"]) == ("WRITE_SINGLE_REGISTER", 40001)
    hello = spark.createDataFrame(
        [("t", [0x0304, 0x0A0A], [0x1301, 0x1302], [0, 16, 43, 0x2A2A], [0x0403], "h2", True)],
        "transport string, versions array<int>, ciphers array<int>, extensions array<int>, sig_algs array<int>, alpn string, has_sni boolean",
    )
    import hashlib

    cut = lambda s: hashlib.sha256(s.encode()).hexdigest()[:12]
    assert assembly.ja4(hello).first()["ja4"] == f"t13d0203h2_{cut('1301,1302')}_{cut('002b_0403')}"


def test_search_terms(spark):
    df = spark.createDataFrame([("1 tcp A b",), ("2 udp a c",)], "line string")
    assert predicates.search_terms(df, "line", "a !UDP").count() == 1
