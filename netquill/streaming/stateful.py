"""Stream forms of the stateful operators: built-in windows where they do, keyed state with event-time timeouts elsewhere.

Time is that of the records. Late rows beyond the watermark are dropped by Spark and counted in the query's progress.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netquill.functions.net import by_run, is_multicast
from netquill.operators.predicates import is_probe
from netquill.operators.sequential import campaign_fold, fold_sorted
from netquill.operators.windows import AUTH_PORTS
from netquill.sources.scratch import delete, exists, written


def with_event_time(df: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros((F.col(ts) * 1_000_000).cast("bigint"))).withWatermark("event_time", delay)


def attempt_windows(conn: DataFrame, ports=AUTH_PORTS, window: str = "60 seconds", attempts: int = 10, delay: str = "120 seconds") -> DataFrame:
    """Sources, destinations, ports and windows that have reached the limit of attempts; in update mode at the crossing."""
    rows = with_event_time(conn.where(F.col("dst_port").isin(*ports)), delay)
    made = rows.groupBy("src_ip", "dst_ip", "dst_port", F.window("event_time", window)).agg(F.count("*").alias("attempts"), F.min("ts").alias("first_ts"), F.max("ts").alias("ts"))
    return made.where(F.col("attempts") >= attempts)


def fold_batch(batch: DataFrame, number: int, path: str, keys: list[str], order: list[str], start, step, out: str, expiry: float, delay: float = 60) -> DataFrame:
    """What ``fold_sorted`` gives for a micro-batch whose keys go on from the state that the last one left under ``path``.

    ``order`` begins with the time; ``step`` gives rows of ``out``, its columns beside the keys. A key's state is a first row and
    leaves by a last one, so that a task needs the state of one key at a time. States older than ``expiry`` and ``delay`` go. No
    row goes for being late: it is judged against the state its key has, or a new one. A batch that runs again reads the same
    state and writes its own anew; a state that isn't there, as in a checkpoint made before the operator was turned on, is an
    empty one. The states before the last are deleted.
    """
    spark = batch.sparkSession
    kinds = dict(batch.dtypes)
    rows = batch.select(*keys, *order)
    before = None
    if number and exists(spark, f"{path}/{number - 1}"):
        before = spark.read.parquet(f"{path}/{number - 1}").where("_state is not null")
    elif number:
        logging.getLogger(__name__).warning("no state of batch %d under %s: an empty one is taken", number - 1, path)
    blank = [F.lit(None).cast(kinds[c]).alias(c) for c in order]
    text = F.lit(None).cast("string")
    all_keys = rows.select(*keys)
    parts = rows.select(*keys, F.lit(1).alias("_flag"), *order, text.alias("_old"))
    if before is not None:
        all_keys = all_keys.union(before.select(*keys))
        parts = parts.union(before.select(*keys, F.lit(0), *blank, F.to_json(F.struct("_state", "_newest"))))
    parts = parts.union(all_keys.distinct().select(*keys, F.lit(2), *blank, text))
    nothing = (None,) * len(out.split(", "))

    def begin() -> list:
        return [start(), None]

    def walk(held: list, row: tuple) -> tuple | None:
        flag, *own, old = row
        if flag == 0:
            old = json.loads(old)
            held[:] = [json.loads(old["_state"]), old["_newest"]]
        elif flag == 1:
            held[1] = own[0] if held[1] is None else max(held[1], own[0])
            found = step(held[0], tuple(own))
            return None if found is None else (*found, None, None)
        else:
            return (*nothing, json.dumps(held[0]), held[1])
        return None

    made = fold_sorted(parts, keys, ["_flag", *order, "_old"], begin, walk, f"{out}, _state string, _newest double")
    made = written(made, f"{path}/{number}-all")
    ends = made.where("_state is not null")
    last = ends.agg(F.max("_newest").alias("_last"))  # one row
    ends.crossJoin(F.broadcast(last)).where(F.col("_newest") >= F.col("_last") - expiry - delay).drop("_last").write.mode("overwrite").parquet(f"{path}/{number}")
    for old in (f"{path}/{number - 2}", f"{path}/{number - 1}-all"):
        delete(spark, old)
    return made.where("_state is null").drop("_state", "_newest")


def cooldown_batch(batch: DataFrame, number: int, path: str, keys: list[str], ts: str, seconds: float, delay: float = 60) -> DataFrame:
    """Rows of a micro-batch that lie ``seconds`` or more from the last row kept of their key, after it or, if they are late, before."""

    def step(state: list, row: tuple) -> tuple | None:
        if state and abs(row[0] - state[0]) < seconds:
            return None
        state[:] = [max(row[0], *state)] if state else [row[0]]
        return (row[0],)

    keys = by_run(batch, *keys)
    times = batch.select(*keys, F.col(ts).cast("double").alias("_ts")).distinct()
    kept = fold_batch(times, number, path, keys, ["_ts"], list, step, "_kept double", seconds, delay)
    joined = batch.join(kept, [batch[k].eqNullSafe(kept[k]) for k in keys] + [batch[ts].cast("double") == kept["_kept"]], "left_semi")
    first = F.row_number().over(Window.partitionBy(*keys, ts).orderBy(F.to_json(F.struct(*batch.columns))))
    return joined.withColumn("_n", first).where("_n = 1").drop("_n")


def recon_batch(batch: DataFrame, number: int, path: str, window: float = 300, fanout: int = 25, factor: int = 10, silence: float = 300, delay: float = 60, probes=None) -> DataFrame:
    """The fan-out campaigns of ``recon_campaigns`` that a micro-batch brings."""
    wanted = (is_probe() if probes is None else probes) & ~is_multicast(F.col("dst_ip"))
    keys = by_run(batch, "src_ip")
    rows = batch.where(wanted).select(*keys, F.col("ts").alias("_ts"), F.concat_ws("|", "dst_ip", "dst_port").alias("target"))
    start, step = campaign_fold(window, fanout, factor, silence)
    return fold_batch(rows, number, path, keys, ["_ts", "target"], start, step, "ts double, targets int, escalation boolean, confidence double", max(window, silence), delay)


def recon_stream(conn: DataFrame, window: float = 300, fanout: int = 25, factor: int = 10, silence: float = 300, delay: str = "60 seconds", probes=None) -> DataFrame:
    """The fan-out campaigns of ``recon_campaigns`` on a stream; state holds at most the targets below the limit and the campaign.
    A key's rows of a micro-batch are sorted in one worker's memory; ``recon_batch`` has no such limit."""
    wanted = (is_probe() if probes is None else probes) & ~is_multicast(F.col("dst_ip"))
    rows = with_event_time(conn.where(wanted), delay).select("src_ip", "ts", "event_time", F.concat_ws("|", "dst_ip", "dst_port").alias("target"))
    out = "src_ip string, ts double, targets int, escalation boolean, confidence double"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "target"])
        seen: dict[str, float] = {}
        campaign = None
        if state.exists:
            times, targets, last, total, due = state.get
            seen = dict(zip(targets, times))
            campaign = [last, total, due] if total else None
        found = []
        for ts, target in zip(rows["ts"].tolist(), rows["target"].tolist()):
            seen[target] = ts
            seen = {k: t for k, t in seen.items() if t >= ts - window} if len(seen) >= fanout else seen
            if len(seen) < fanout:
                continue
            n, seen = len(seen), {}
            if campaign is None or ts - campaign[0] > silence:
                campaign = [ts, n, n * factor]
                found.append((key[0], ts, n, False, min(95.0, 50.0 + n)))
            else:
                campaign[0], campaign[1] = max(campaign[0], ts), campaign[1] + n
                if campaign[1] >= campaign[2]:
                    campaign[2] = campaign[1] * factor
                    found.append((key[0], ts, campaign[1], True, min(95.0, 50.0 + n)))
        newest = float(rows["ts"].max())
        state.update((list(seen.values()), list(seen), *(campaign or (0.0, 0, 0))))
        state.setTimeoutTimestamp(max(int((newest + max(window, silence)) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=["src_ip", "ts", "targets", "escalation", "confidence"])

    kept = "times array<double>, targets array<string>, last double, total int, due int"
    return rows.groupBy("src_ip").applyInPandasWithState(fold, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def stream_metrics(query) -> dict:
    """Rows received, dropped as late and held in state, from a query's last progress."""
    p = query.lastProgress
    if p is None:
        return {"received": 0, "late": 0, "state_rows": 0}
    p = p if isinstance(p, dict) else json.loads(p.json)
    states = p.get("stateOperators", [])
    return {"received": p.get("numInputRows", 0), "late": sum(s.get("numRowsDroppedByWatermark", 0) for s in states), "state_rows": sum(s.get("numRowsTotal", 0) for s in states)}
