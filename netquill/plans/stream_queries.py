"""Queries of the stream operators: the events are fed in several micro-batches, and what the batch form gives is the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquill.functions.net import epoch
from netquill.plans.adapters import CONN, as_flows, as_packets, scratch, swapped, table
from netquill.plans.detect_queries import COOLDOWN_SQL, DAY, RECON_SQL, deployment_events, login_events, mail_events
from netquill.plans.detect_queries import SQL as DETECT
from netquill.streaming import batches, keyed, stateful

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


SLICES = 4


def _slices(spark, d, n=SLICES):
    """The events cut into ``n`` parts by time, and one event long after them, by which all timers are due."""
    events, tasks = table(spark, d, "events"), spark.sparkContext.defaultParallelism
    at = epoch(F.col("ts"))
    cuts = events.select(at.alias("at")).approxQuantile("at", [i / n for i in range(1, n)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = events.where((F.lit(True) if low is None else at >= low) & (F.lit(True) if high is None else at < high))
        yield part.repartition(tasks)  # files for all cores to read
    last = events.orderBy(F.desc("ts"), "event_id").limit(1)
    late = {"ts": F.col("ts") + F.expr("INTERVAL 20 YEARS"), "user_id": F.lit(-1).cast(events.schema["user_id"].dataType), "event_id": F.lit(-1).cast(events.schema["event_id"].dataType)}
    yield last.withColumns(late)


def _stream(spark, d, build, mode="append", fold=None, endless=False):
    """Run a stream over the events and give back what it wrote; ``fold(batch, number, path)`` keeps state.

    A slice of the events comes in and the stream goes on from its checkpoint, in one micro-batch over all the slice's files. State
    with a time to live makes batches without rows for ever (``endless``), so such a query isn't started again: it takes a file for
    each slice and is stopped when all has come in."""
    keyed.keep_state(spark)
    source, out, checkpoint, state = (scratch(spark, tag) for tag in ("stream-source", "stream", "stream-checkpoint", "stream-state"))
    schema = table(spark, d, "events").schema

    def sink(batch, number):
        batch = fold(batch, number, state) if fold else batch
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    def start(limits):
        made = build(spark.readStream.schema(schema).options(**limits).parquet(source))
        return made.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)

    for part in _slices(spark, d):
        (part.coalesce(1) if endless else part).write.mode("append").parquet(source)
        if not endless:
            start({}).trigger(availableNow=True).start().awaitTermination()
    if endless:
        keyed.drain(start({"maxFilesPerTrigger": 1}).trigger(processingTime="100 milliseconds").start(), SLICES + 1)
    return spark.read.parquet(out)


def _flows(events):
    return as_flows(events.where("event_id >= 0"))


@query("t8_cooldown_stream", COOLDOWN_SQL)
def _(spark, d):
    return _stream(spark, d, _flows, fold=lambda b, n, path: stateful.cooldown_batch(b, n, path, ["src_ip", "dst_ip"], "ts", 3 * DAY)).select("src_ip", "dst_ip", "ts")


@query("t2_brute_force_stream", f"""WITH {CONN} SELECT src_ip, dst_ip, dst_port, count(*) AS attempts, min(ts) AS first_ts FROM conn WHERE dst_port IN (1, 3, 5, 7) GROUP BY src_ip, dst_ip, dst_port, floor(ts / 864000) HAVING count(*) >= 3""")
def _(spark, d):
    made = _stream(spark, d, lambda e: stateful.attempt_windows(_flows(e), (1, 3, 5, 7), "10 days", 3), "update")
    last = made.groupBy("src_ip", "dst_ip", "dst_port", "window").agg(F.max_by(F.struct("attempts", "first_ts"), "batch").alias("x"))
    return last.select("src_ip", "dst_ip", "dst_port", "x.attempts", "x.first_ts")


@query("t3_recon_stream", RECON_SQL)
def _(spark, d):
    return _stream(spark, d, lambda e: swapped(_flows(e)), fold=lambda b, n, path: stateful.recon_batch(b, n, path, DAY, 25, 3, 2 * DAY, probes=F.lit(True))).drop("batch")


@query("t_beacons_stream", DETECT["e2_beacons"])
def _(spark, d):
    hits = _stream(spark, d, _flows, fold=lambda b, n, path: batches.beacons_batch(b, n, path, min_samples=5, cv=0.9, hi=5 * DAY, cluster=0.6))
    return hits.select("rid", "src_ip", "dst_ip", "samples", *[F.round(c, n).alias(c) for c, n in (("mean_gap", 3), ("cv", 6), ("clustered", 6))])


@query("t_flood_stream", DETECT["e1b_flood"])
def _(spark, d):
    hits = _stream(spark, d, lambda e: keyed.flood_stream(swapped(_flows(e)), DAY, 50, 1.1, skip=F.lit(False)), endless=True)
    return hits.select("rid", "src_ip", "bucket", "n_flows", "n_dst", "confidence")


@query("t_spoofed_flood_stream", DETECT["e1c_spoofed_flood"])
def _(spark, d):
    return _stream(spark, d, lambda e: keyed.spoofed_flood_stream(_flows(e), DAY, 40, 0.85, skip=F.lit(False)), endless=True).select("rid", "dst_ip", "bucket", "n_flows", "n_src")


@query("t_exfil_stream", DETECT["e6b_exfil_accumulated"])
def _(spark, d):
    hits = _stream(spark, d, _flows, fold=lambda b, n, path: batches.exfil_accumulated_batch(b, n, path, 10 * DAY, 100_000, 3, 1000))
    return hits.select("rid", "src_ip", "dst_ip", "bucket", "sent", "received", "n_flows")


@query("t_login_attempts_stream", DETECT["e13_brute_force"])
def _(spark, d):
    hits = _stream(spark, d, _flows, fold=lambda b, n, path: batches.brute_force_batch(b, n, path, (1, 3, 5, 7), 10 * DAY, 3))
    return hits.select("rid", "src_ip", "dst_ip", "dst_port", "bucket", "ts", "severity", "confidence")


@query("t_smtp_enumeration_stream", DETECT["e14_smtp_enumeration"])
def _(spark, d):
    return _stream(spark, d, lambda e: mail_events(_flows(e)), fold=lambda b, n, path: batches.smtp_enumeration_batch(b, n, path, 10 * DAY, rcpt=10_000)).select("rid", F.col("n_vrfy").cast("int"))


@query("t_http_guessing_stream", DETECT["e14_http_guessing"])
def _(spark, d):
    return _stream(spark, d, lambda e: login_events(_flows(e)), fold=lambda b, n, path: batches.http_guessing_batch(b, n, path, 10 * DAY, 3)).select("rid", "n_basic", "n_401")


@query("t_web_deployments_stream", DETECT["e14_web_deployments"])
def _(spark, d):
    return _stream(spark, d, lambda e: deployment_events(_flows(e)), fold=lambda b, n, path: batches.web_deployments_batch(b, n, path, 5 * DAY, DAY)).select("rid", "preceded")


@query("t7_flow_sessions_stream", DETECT["a2_live_flows"])
def _(spark, d):
    flows = _stream(spark, d, as_packets, fold=lambda b, n, path: batches.flow_sessions_batch(b, n, path, 7 * DAY, 100 * DAY, DAY))
    return flows.select("capture_id", "proto", "src_ip", "dst_ip", "ts", (F.col("orig_pkts") + F.col("resp_pkts")).alias("pkts"))
