import random

import pytest
from pyspark.sql import functions as F

from netquill.operators import assembly, windows
from netquill.plans import stream_queries
from netquill.sources.scratch import listed
from netquill.streaming import batches
from tests.test_streaming import APP, FLOWS, PACKETS, SERVICE, service_events, traffic

DETECT = [
    (windows.beacons, batches.beacons_batch), (windows.exfil_accumulated, batches.exfil_accumulated_batch), (windows.brute_force, batches.brute_force_batch),
]
APPS = [
    (windows.smtp_enumeration, batches.smtp_enumeration_batch), (windows.http_guessing, batches.http_guessing_batch), (windows.web_deployments, batches.web_deployments_batch),
]


def fed(spark, tmp_path, ddl, rows, cuts, form):
    """What the batches give, the second of them twice."""
    ends, at, got = [0, *cuts, len(rows)], str(tmp_path / "state"), []
    for n, (a, b) in enumerate(zip(ends, ends[1:])):
        part = random.Random(1).sample(rows[a:b], b - a)
        for _ in range(2 if n == 1 else 1):
            found = form(spark.createDataFrame(part, ddl), n, at).collect()
        got += found
    assert len([x for x in listed(spark, at) if x.isdigit()]) <= 2
    return got


@pytest.mark.parametrize("cuts", [(300,), (130, 131, 700)])
@pytest.mark.parametrize("whole,form", DETECT, ids=[w.__name__ for w, _ in DETECT])
def test_batches_of_flows_equal_the_whole(spark, tmp_path, whole, form, cuts):
    rows = traffic()
    key = lambda r: (r["rid"], round(r["confidence"], 6), r["severity"])
    want = whole(spark.createDataFrame(rows, FLOWS)).collect()
    assert sorted(map(key, fed(spark, tmp_path, FLOWS, rows, cuts, form))) == sorted(map(key, want)) and want


@pytest.mark.parametrize("whole,form", APPS, ids=[w.__name__ for w, _ in APPS])
def test_batches_of_service_events_equal_the_whole(spark, tmp_path, whole, form):
    rows = service_events()
    counts = next(c for w, _, c in SERVICE if w is whole)
    key = lambda r: str((r["rid"], r["severity"], r["confidence"], *(r[c] for c in counts)))
    cuts = [i for i in (150, 400) if rows[i][1] != rows[i - 1][1]]
    want = whole(spark.createDataFrame(rows, APP)).collect()
    assert sorted(map(key, fed(spark, tmp_path, APP, rows, cuts, form))) == sorted(map(key, want)) and want


def test_batches_of_packets_equal_the_whole(spark, tmp_path):
    draw = random.Random(4)
    times = sorted([1000.0 + 5 * i for i in range(140)] + [2500.0 + 70 * i for i in range(5)] + [4000.0 + draw.random() * 900 for _ in range(80)])
    rows = []
    for i, t in enumerate(times):
        (s, sp), (d, dp) = draw.sample([("a", 50000), ("b", draw.choice([80, 443]))], 2)
        rows.append((draw.choice(["c1", "c2"]) if t > 4000 else "c1", i, t, s, sp, d, dp, "tcp", 100 + i, None, 0))
    key = lambda r: (r["capture_id"], r["src_ip"], r["src_port"], r["dst_port"], r["ts"], r["last_ts"], r["orig_bytes"], r["resp_bytes"], r["orig_pkts"], r["resp_pkts"])
    want = assembly.assemble_live(spark.createDataFrame(rows, PACKETS)).collect()
    rows.append(("c9", 10**6, 10.0**6, "x", 1, "y", 2, "tcp", 1, None, 0))
    got = fed(spark, tmp_path, PACKETS, rows, (60, 61, 150, len(rows) - 1), lambda b, n, at: batches.flow_sessions_batch(b, n, at, delay=10))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 12


def test_a_late_row_counts_on_and_old_state_goes(spark, tmp_path):
    flow = lambda rid, ts: (rid, ts, "a", "b", 22, 1, 1, 1.0, "x")
    give = lambda n, *rows: [r["rid"] for r in batches.brute_force_batch(spark.createDataFrame(rows, FLOWS), n, str(tmp_path / "s"), attempts=3).collect()]
    assert give(0, flow(1, 610.0), flow(2, 611.0)) == []
    assert give(1, flow(3, 601.0)) == [3]  # before both, and the third that has come
    assert give(2, flow(4, 9000.0)) == []
    assert spark.read.parquet(str(tmp_path / "s" / "2")).count() == 1


def test_slices_are_read_by_all_cores(spark):
    parts = list(stream_queries._slices(spark, "/root/testdata/sf0.001"))
    events = stream_queries.table(spark, "/root/testdata/sf0.001", "events")
    assert all(p.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism for p in parts[:-1])
    fed = parts[0]
    for part in parts[1:]:
        fed = fed.unionByName(part)
    assert fed.where(F.col("event_id") >= 0).exceptAll(events).isEmpty() and fed.count() == events.count() + 1
