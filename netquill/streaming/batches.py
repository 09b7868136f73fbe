"""Micro-batch forms of the keyed detectors and of flow sessions, for streams with very many keys: the state is a table.

A micro-batch is joined to what the last one left under ``path``, judged by windows, and leaves its own state, so that a key costs
a row and no call from Python. Each is called by ``foreachBatch`` with the batch's number. A batch that runs again reads the same
state and writes its own anew. No row is dropped for being late: it is judged by the state there is, or a new one. States whose
last row is older than a time to live, by the records' own time, go; the states before the last are deleted.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquill.functions.net import bucket, by_run, is_multicast
from netquill.operators import windows as win
from netquill.operators.assembly import oriented
from netquill.operators.sequential import split_lifetimes
from netquill.operators.stateless import is_exfil
from netquill.sources.scratch import delete, exists, written
from netquill.streaming.keyed import ENDS, FLOW, packet_ends


def held(like: DataFrame, number: int, path: str) -> DataFrame:
    """The state that the batch before left, with the columns of ``like``; empty if there is none."""
    spark = like.sparkSession
    if number and exists(spark, f"{path}/{number - 1}"):
        return spark.read.schema(like.schema).parquet(f"{path}/{number - 1}")
    if number:
        logging.getLogger(__name__).warning("no state of batch %d under %s: an empty one is taken", number - 1, path)
    return spark.createDataFrame([], like.schema)


def keep(state: DataFrame, number: int, path: str, age: float) -> None:
    """Write a state whose rows have the last time of their key as ``_last``; keys more than ``age`` behind the latest one go."""
    latest = state.agg(F.max("_last").alias("_latest"))  # one row
    kept = state.crossJoin(F.broadcast(latest)).where(F.col("_last") >= F.col("_latest") - age).drop("_latest", "_last")
    kept.write.mode("overwrite").parquet(f"{path}/{number}")
    delete(state.sparkSession, f"{path}/{number - 2}")


def _with_tail(rows: DataFrame, number: int, path: str, needs: list[str], detect: Callable, tail: Callable, age: float) -> DataFrame:
    """What ``detect`` finds among new rows, the rows that ``tail`` left of earlier batches standing before them."""
    new = rows.withColumn("_own", F.lit(True))
    old = held(rows.select(*needs), number, path)
    keep(tail(new.select(*needs).unionByName(old)), number, path, age)
    return detect(new.unionByName(old.withColumn("_own", F.lit(False)), allowMissingColumns=True)).where("_own").drop("_own")


def _newest(keys: list[str], count: int, order=("ts", "rid")) -> Callable:
    """The last ``count`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*map(F.desc, order))
    return lambda rows: rows.withColumns({"_n": F.row_number().over(w), "_last": F.max("ts").over(w)}).where(F.col("_n") <= count).drop("_n")


def _trailing(keys: list[str], seconds: float) -> Callable:
    """The rows of each key within ``seconds`` of its last one."""
    last = F.max("ts").over(Window.partitionBy(*keys))
    return lambda rows: rows.withColumn("_last", last).where(F.col("ts") >= F.col("_last") - seconds)


def beacons_batch(batch: DataFrame, number: int, path: str, max_ts: int = 50, min_samples: int = 8, cv: float = 0.55, lo: float = 2, hi: float = 3600, cluster: float = 0.75, ttl_s: float | None = None) -> DataFrame:
    """``windows.beacons`` of a micro-batch; the last ``max_ts`` times of a pair are kept, for ``ttl_s`` (by default twice ``hi``)."""
    rows = batch.where(~is_multicast(F.col("src_ip")) & ~is_multicast(F.col("dst_ip")))
    keys = by_run(rows, "src_ip", "dst_ip")
    detect = lambda both: win.beacons(both, max_ts, min_samples, cv, lo, hi, cluster)
    return _with_tail(rows, number, path, [*keys, "ts", "rid"], detect, _newest(keys, max_ts), ttl_s or 2 * hi)


def smtp_enumeration_batch(app: DataFrame, number: int, path: str, window: float = 300, vrfy: int = 3, rcpt: int = 15, rejects: int = 3, ratio: float = 0.3, ttl_s: float | None = None) -> DataFrame:
    """``windows.smtp_enumeration`` of a micro-batch; what a pair did in its last ``window`` seconds is kept for ``ttl_s`` (twice that)."""
    rows = app.where(F.col("app_function").isin("smtp_vrfy", "smtp_expn", "smtp_rcpt", "smtp_reject"))
    keys = by_run(rows, "src_ip", "dst_ip")
    pair = [*by_run(rows), F.array_sort(F.array("src_ip", "dst_ip"))]
    detect = lambda both: win.smtp_enumeration(both, window, vrfy, rcpt, rejects, ratio)
    return _with_tail(rows, number, path, [*keys, "ts", "app_function", "app_detail"], detect, _trailing(pair, window), ttl_s or 2 * window)


def http_guessing_batch(app: DataFrame, number: int, path: str, window: float = 60, least: int = 5, ttl_s: float | None = None) -> DataFrame:
    """``windows.http_guessing`` of a micro-batch."""
    rows = app.where(F.col("app_function").isin("http_basic", "http_401"))
    keys = by_run(rows, "src_ip", "dst_ip", "dst_port")
    detect = lambda both: win.http_guessing(both, window, least)
    return _with_tail(rows, number, path, [*keys, "ts", "app_function"], detect, _trailing(keys, window), ttl_s or 2 * window)


def web_deployments_batch(app: DataFrame, number: int, path: str, window: float = 300, refusal: float = 60, ttl_s: float | None = None) -> DataFrame:
    """``windows.web_deployments`` of a micro-batch; a client's login events at a server's port in the last ``window`` seconds are kept
    for ``ttl_s`` (twice that)."""
    rows = app.where(F.col("app_function").isin("http_basic", "http_401", "http_admin_deploy"))
    keys = by_run(rows, "src_ip", "dst_ip", "dst_port")
    recent = _trailing(keys, window)
    logins = lambda both: recent(both.where("app_function != 'http_admin_deploy'"))
    detect = lambda both: win.web_deployments(both, window, refusal)
    return _with_tail(rows, number, path, [*keys, "ts", "app_function", "app_code"], detect, logins, ttl_s or 2 * window)


def _so_far(rows: DataFrame, number: int, path: str, keys: list[str], sums: dict[str, str], count: str, age: float) -> DataFrame:
    """Adds running sums and the number of rows of a key so far; rows of earlier batches come first, as one row of totals."""
    long = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
    new = rows.withColumns({"_own": F.lit(True), count: F.lit(1).cast("bigint"), **{name: long(c) for name, c in sums.items()}})
    totals = [count, *sums]
    old = held(new.select(*keys, *totals, "ts"), number, path).withColumn("_own", F.lit(False))
    both = new.unionByName(old, allowMissingColumns=True)
    state = new.select(*keys, *totals, "ts").unionByName(old.drop("_own")).groupBy(*keys).agg(*[F.sum(t).alias(t) for t in totals], F.max("ts").alias("ts"))
    keep(state.withColumn("_last", F.col("ts")), number, path, age)
    w = Window.partitionBy(*keys).orderBy("_own", "ts", "rid").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({t: F.sum(t).over(w) for t in totals}).where("_own").drop("_own")


def exfil_accumulated_batch(batch: DataFrame, number: int, path: str, window: float = 300, min_bytes: int = 1_000_000, min_flows: int = 20, ratio: float = 10, ttl_s: float | None = None) -> DataFrame:
    """``windows.exfil_accumulated`` of a micro-batch; a bucket's sums are kept for ``ttl_s`` (by default two windows) after its last row."""
    rows = batch.where(~is_exfil()).withColumn("bucket", bucket(F.col("ts"), window))
    keys = by_run(rows, "src_ip", "dst_ip", "bucket")
    counted = _so_far(rows, number, path, keys, {"sent": "orig_bytes", "received": "resp_bytes"}, "n_flows", ttl_s or 2 * window)
    return win.exfil_judged(counted, min_bytes, min_flows, ratio)


def brute_force_batch(batch: DataFrame, number: int, path: str, ports=win.AUTH_PORTS, window: float = 60, attempts: int = 10, ttl_s: float | None = None) -> DataFrame:
    """``windows.brute_force`` of a micro-batch: the attempt that reaches the limit."""
    rows = batch.where(F.col("dst_port").isin(*ports)).withColumn("bucket", bucket(F.col("ts"), window))
    keys = by_run(rows, "src_ip", "dst_ip", "dst_port", "bucket")
    return win.attempts_judged(_so_far(rows, number, path, keys, {}, "attempt", ttl_s or 2 * window), attempts)


def flow_sessions_batch(packets: DataFrame, number: int, path: str, idle: float = 60, hard: float = 300, delay: float = 120) -> DataFrame:
    """``assembly.assemble_live`` of a micro-batch: the flows that have ended, by a packet too late for them or because the latest
    packet is ``delay`` past one of their limits. The state is a row for each running flow."""
    new = packet_ends(packets).withColumn("_own", F.lit(True))
    sides = {f"{d}_{what}": F.when(there, x).otherwise(0).cast("bigint") for d, there in (("ab", F.col("forward")), ("ba", ~F.col("forward"))) for what, x in (("bytes", F.col("size")), ("pkts", F.lit(1)))}
    new = new.withColumns({"last_ts": F.col("ts"), **sides})
    names = [c.split()[0] for c in FLOW.split(", ")]
    old = held(new.select(*ENDS, *names), number, path).withColumns({"_own": F.lit(False), "id": F.lit(None).cast(new.schema["id"].dataType)})
    pieces = new.select(*old.columns).unionByName(old)
    w = Window.partitionBy(*ENDS).orderBy("ts", "_own", "id")
    pause = F.col("ts") - F.max("last_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("_new", F.coalesce((pause > idle).cast("int"), F.lit(0)))
    pieces = pieces.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    whole = Window.partitionBy(*ENDS, "session")
    pieces = pieces.withColumn("long", F.max("ts").over(whole) - F.min("ts").over(whole) > hard)
    pieces = written(pieces, f"{path}/{number}-pieces")
    parts, long_ = pieces.where("not long").withColumn("part", F.lit(0)), pieces.where("long")
    if not long_.isEmpty():
        parts = parts.unionByName(split_lifetimes(long_, [*ENDS, "session"], "ts", hard))
    flows = parts.groupBy(*ENDS, "session", "part").agg(
        F.min("ts").alias("ts"), F.max("last_ts").alias("last_ts"), F.min_by("a_starts", F.struct("ts", "_own", "id")).alias("a_starts"),
        *[F.sum(c).alias(c) for c in names[3:]],
    )
    last = pieces.agg((F.max("last_ts") - delay).alias("_mark"))  # one row
    newest = F.row_number().over(Window.partitionBy(*ENDS).orderBy(F.desc("session"), F.desc("part"))) == 1
    over = F.least(F.col("last_ts") + idle, F.col("ts") + hard) < F.col("_mark")
    made = flows.withColumn("_newest", newest).crossJoin(F.broadcast(last)).withColumn("ended", ~F.col("_newest") | over)
    made = written(made.select(*ENDS, *names, "ended"), f"{path}/{number}-all")
    made.where("not ended").drop("ended").write.mode("overwrite").parquet(f"{path}/{number}")
    for before in (f"{path}/{number - 2}", f"{path}/{number - 1}-all", f"{path}/{number}-pieces"):
        delete(packets.sparkSession, before)
    ends = [F.struct(F.col(f"{s}_ip").alias("ip"), F.col(f"{s}_port").alias("port")).alias(s) for s in "ab"]
    return oriented(made.where("ended").select("*", *ends), ["capture_id", "proto"])
