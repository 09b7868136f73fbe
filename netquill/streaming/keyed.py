"""Stateful detectors and flow sessions on streams by ``transformWithState``: what they give doesn't depend on how rows are cut
into micro-batches, as long as the rows of a key come in order (for the service detectors: those of one time in one batch).

Rows of a key are sorted inside a micro-batch by time and row id. The detectors go by the records' own time and keep their state
for a time to live, so no row is dropped for being late: it is judged by the state there is. Flow sessions end by timers of event
time; rows beyond the watermark are dropped there and counted in the query's progress. State lives in RocksDB, see ``keep_state``.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from netquill.functions.net import bucket, by_run, is_multicast, jitter_pct, sender_is_originator
from netquill.operators.stateless import is_exfil, is_slow
from netquill.operators.windows import AUTH_PORTS, deployments_judged, guessing_judged, smtp_judged

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def keep_state(spark: SparkSession) -> None:
    """Keyed state needs this provider; set it before the queries start."""
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(query: StreamingQuery, batches: int, timeout: float = 600) -> None:
    """Stop a query after so many micro-batches. With a time to live queries go on making batches, so they never are idle."""
    done = lambda: query.lastProgress["batchId"] + 1 if query.lastProgress else 0
    end = time.monotonic() + timeout
    while query.isActive and time.monotonic() < end and done() < batches:
        time.sleep(0.05)
    failed, made = query.exception(), done()
    query.stop()
    if failed or made < batches:
        raise failed or TimeoutError(f"{made} of {batches} micro-batches were made")


def _in_order(rows: Iterator[pd.DataFrame], order: tuple[str, ...] = ("ts", "rid")) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


def _apply(df: DataFrame, keys: list[str], processor: StatefulProcessor, extra: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows that the processor lets through, with ``extra`` columns."""
    out = StructType(df.drop(*drop).schema.fields + StructType.fromDDL(extra).fields)
    return df.groupBy(*by_run(df, *keys)).transformWithStateInPandas(processor, out, "Append", "ProcessingTime")


class Beacons(StatefulProcessor):
    """Holds the last ``max_ts`` times of a pair, of its current history alone."""

    def __init__(self, max_ts: int, min_samples: int, cv: float, lo: float, hi: float, cluster: float, ttl_s: float):
        self.max_ts, self.min_samples, self.cv, self.lo, self.hi, self.cluster, self.ttl_s = max_ts, min_samples, cv, lo, hi, cluster, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "times array<double>", int(self.ttl_s * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _in_order(rows)
        held = np.array(self.recent.get()[0] if self.recent.exists() else [], float)
        times = np.concatenate((held, new["ts"].to_numpy(float)))
        own = np.concatenate((np.full(len(held), -1), np.arange(len(new))))
        order = np.argsort(times, kind="stable")
        times, own = times[order], own[order]
        gaps = np.diff(times, prepend=np.nan)
        fresh = np.concatenate(([True], gaps[1:] > self.hi))
        gaps[fresh | (gaps <= 0)] = np.nan
        starts = np.flatnonzero(fresh)
        self.recent.update((times[max(starts[-1], len(times) - self.max_ts) :].tolist(),))
        found = []
        for start, end in zip(starts, np.append(starts[1:], len(times))):
            frames = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(self.max_ts - 2, np.nan), gaps[start:end])), self.max_ts - 1)
            samples = np.count_nonzero(~np.isnan(frames), axis=1)
            at = np.flatnonzero((samples >= self.min_samples) & (own[start:end] >= 0))
            frames, samples = frames[at], samples[at]
            mean, sd = np.nanmean(frames, axis=1), np.nanstd(frames, axis=1)
            median = np.nanmedian(frames, axis=1)
            near = np.count_nonzero(np.abs(frames - median[:, None]) <= self.cv * median[:, None], axis=1) / samples
            ok = (mean >= self.lo) & (mean <= self.hi) & (sd / mean <= self.cv) & (near >= self.cluster)
            hits = new.iloc[own[start:end][at[ok]]].assign(samples=samples[ok], mean_gap=mean[ok], sd_gap=sd[ok], median_gap=median[ok], cv=sd[ok] / mean[ok], clustered=near[ok])
            found.append(hits)
        yield pd.concat(found, ignore_index=True)


def beacons_stream(conn: DataFrame, max_ts: int = 50, min_samples: int = 8, cv: float = 0.55, lo: float = 2, hi: float = 3600, cluster: float = 0.75, ttl_s: float | None = None) -> DataFrame:
    """``windows.beacons`` on a stream; a pair's times are kept for ``ttl_s`` (by default twice ``hi``) after its last row."""
    rows = conn.where(~is_multicast(F.col("src_ip")) & ~is_multicast(F.col("dst_ip")))
    held = Beacons(max_ts, min_samples, cv, lo, hi, cluster, ttl_s or 2 * hi)
    hits = _apply(rows, ["src_ip", "dst_ip"], held, "samples long, mean_gap double, sd_gap double, median_gap double, cv double, clustered double")
    return hits.withColumns({"severity": F.lit("HIGH"), "confidence": 95.0 - 25.0 * F.col("cv") / cv, "jitter_pct": jitter_pct(F.col("cv"))})


class Crossing(StatefulProcessor):
    """The first row of a key at which its rows and distinct peers pass a test; peers are forgotten then."""

    def __init__(self, peer: str, into: tuple[str, str], least: int, test, ttl_s: float):
        self.peer, self.into, self.least, self.test, self.ttl_s = peer, into, least, test, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = int(self.ttl_s * 1000)
        self.totals = handle.getValueState("totals", "n long, distinct long, crossed boolean", ttl)
        self.peers = handle.getMapState("peers", "peer string", "seen boolean", ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, distinct, crossed = self.totals.get() if self.totals.exists() else (0, 0, False)
        if crossed:
            return
        new = _in_order(rows)
        named = new[self.peer].fillna("")
        unseen = {p for p in named.unique() if not self.peers.containsKey((p,))}
        first = named.isin(unseen) & ~named.duplicated()
        n_rows = n + np.arange(1, len(new) + 1)
        n_peers = distinct + first.cumsum().to_numpy()
        at = np.flatnonzero((n_rows >= self.least) & self.test(n_rows, n_peers))[:1]
        self.totals.update((int(n_rows[-1]), int(n_peers[-1]), bool(len(at))))
        if len(at):
            self.peers.clear()
            yield new.iloc[at].assign(**{self.into[0]: n_rows[at], self.into[1]: n_peers[at]})
        else:
            for p in unseen:
                self.peers.updateValue((p,), (True,))


def flood_stream(conn: DataFrame, window: float = 10, threshold: int = 200, min_ratio: float = 15, skip: Column | None = None, ttl_s: float | None = None) -> DataFrame:
    """``windows.flood_sources`` on a stream; a bucket's counts are kept for ``ttl_s`` (by default three windows) after its last row."""
    rows = conn.where(~(is_slow() if skip is None else skip)).withColumn("bucket", bucket(F.col("ts"), window))
    held = Crossing("dst_ip", ("n_flows", "n_dst"), threshold, lambda n, peers: n / peers >= min_ratio, ttl_s or 3 * window)
    hits = _apply(rows, ["src_ip", "bucket"], held, "n_flows long, n_dst long")
    return hits.withColumns({"severity": F.lit("HIGH"), "confidence": F.least(F.lit(99.0), 60 + 0.5 * (F.col("n_flows") - threshold))})


def spoofed_flood_stream(conn: DataFrame, window: float = 10, min_packets: int = 150, ratio: float = 0.85, skip: Column | None = None, ttl_s: float | None = None) -> DataFrame:
    """``windows.spoofed_flood`` on a stream."""
    rows = conn.where(~(is_slow() if skip is None else skip) & ~is_multicast(F.col("dst_ip"))).withColumn("bucket", bucket(F.col("ts"), window))
    held = Crossing("src_ip", ("n_flows", "n_src"), min_packets, lambda n, peers: peers / n >= ratio, ttl_s or 3 * window)
    hits = _apply(rows, ["dst_ip", "bucket"], held, "n_flows long, n_src long")
    return hits.withColumns({"severity": F.lit("CRITICAL"), "confidence": F.lit(92.0)})


class Sums(StatefulProcessor):
    """Running sums of some columns and the number of rows of a key, on the rows that pass a test."""

    def __init__(self, sums: dict[str, str], count: str, test, ttl_s: float):
        self.sums, self.count, self.test, self.ttl_s = sums, count, test, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "n long, sums array<long>", int(self.ttl_s * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _in_order(rows)
        n, before = self.totals.get() if self.totals.exists() else (0, [0] * len(self.sums))
        made = {name: old + new[column].fillna(0).astype("int64").cumsum() for (name, column), old in zip(self.sums.items(), before)}
        made[self.count] = n + np.arange(1, len(new) + 1)
        new = new.assign(**made)
        self.totals.update((int(new[self.count].iloc[-1]), [int(new[name].iloc[-1]) for name in self.sums]))
        yield new[self.test(new)]


def exfil_accumulated_stream(conn: DataFrame, window: float = 300, min_bytes: int = 1_000_000, min_flows: int = 20, ratio: float = 10, ttl_s: float | None = None) -> DataFrame:
    """``windows.exfil_accumulated`` on a stream; a bucket's sums are kept for ``ttl_s`` (by default two windows) after its last row."""
    rows = conn.where(~is_exfil()).withColumn("bucket", bucket(F.col("ts"), window))

    def adds_up(r: pd.DataFrame) -> pd.Series:
        return (r["sent"] >= min_bytes) & (r["n_flows"] >= min_flows) & (r["received"] > 0) & (r["sent"] >= ratio * r["received"])

    held = Sums({"sent": "orig_bytes", "received": "resp_bytes"}, "n_flows", adds_up, ttl_s or 2 * window)
    hits = _apply(rows, ["src_ip", "dst_ip", "bucket"], held, "sent long, received long, n_flows long")
    return hits.withColumns({"severity": F.lit("HIGH"), "confidence": F.lit(82.0)})


def brute_force_stream(conn: DataFrame, ports=AUTH_PORTS, window: float = 60, attempts: int = 10, ttl_s: float | None = None) -> DataFrame:
    """``windows.brute_force`` on a stream: the attempt that reaches the limit."""
    rows = conn.where(F.col("dst_port").isin(*ports)).withColumn("bucket", bucket(F.col("ts"), window))
    held = Sums({}, "attempt", lambda r: r["attempt"] == attempts, ttl_s or 2 * window)
    hits = _apply(rows, ["src_ip", "dst_ip", "dst_port", "bucket"], held, "attempt long")
    return hits.withColumns({"severity": F.lit("MEDIUM"), "confidence": F.lit(70.0)})


class Trailing(StatefulProcessor):
    """For each row of a key how many events, or distinct details, of some kinds lie in the ``window`` seconds up to it.

    ``counts`` names, by column, the kinds and whether details are counted. The state is the key's events of the last ``window``.
    """

    def __init__(self, counts: dict[str, tuple[tuple[str, ...], bool]], window: float, ttl_s: float):
        self.counts, self.window, self.ttl_s = counts, window, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "times array<double>, kinds array<string>, details array<string>", int(self.ttl_s * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _in_order(rows)
        own = new[["ts", "app_function", "app_detail"]].set_axis(["ts", "kind", "detail"], axis=1).assign(own=True)
        held = pd.DataFrame(dict(zip(("ts", "kind", "detail"), self.recent.get())) if self.recent.exists() else {"ts": [], "kind": [], "detail": []})
        both = pd.concat((held.assign(own=False), own), ignore_index=True) if len(held) else own
        both = both.sort_values("ts", kind="stable", ignore_index=True)
        ts = both["ts"].to_numpy(float)
        low, high = np.searchsorted(ts, ts - self.window, "left"), np.searchsorted(ts, ts, "right")
        mine = both["own"].to_numpy(bool)
        made = {}
        for name, (kinds, distinct) in self.counts.items():
            counted = both["kind"].isin(kinds).to_numpy() & (both["detail"].notna().to_numpy() if distinct else True)
            made[name] = (_distinct_between(both["detail"], counted, low, high) if distinct else np.subtract(*(np.append(0, counted.cumsum())[at] for at in (high, low))))[mine]
        stay = both[ts >= ts[-1] - self.window]
        details = [None if pd.isna(x) else x for x in stay["detail"]]
        self.recent.update((stay["ts"].tolist(), stay["kind"].tolist(), details))
        yield new.assign(**made)


def _distinct_between(values: pd.Series, counted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distinct counted values at positions [low, high) of each row; both bounds never fall."""
    codes, inside, left, right = pd.factorize(values)[0].tolist(), {}, 0, 0
    found = np.zeros(len(low), np.int64)
    for i, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
        for at in range(right, b):
            if counted[at]:
                inside[codes[at]] = inside.get(codes[at], 0) + 1
        for at in range(left, a):
            if counted[at]:
                inside[codes[at]] -= 1
                if not inside[codes[at]]:
                    del inside[codes[at]]
        left, right = a, b
        found[i] = len(inside)
    return found


def smtp_enumeration_stream(app: DataFrame, window: float = 300, vrfy: int = 3, rcpt: int = 15, rejects: int = 3, ratio: float = 0.3, ttl_s: float | None = None) -> DataFrame:
    """``windows.smtp_enumeration`` on a stream; what a pair did in the last ``window`` seconds is kept for ``ttl_s`` (twice that)."""
    kinds = {"n_vrfy": (("smtp_vrfy", "smtp_expn"), True), "n_rcpt": (("smtp_rcpt",), True), "n_reject": (("smtp_reject",), False)}
    rows = app.where(F.col("app_function").isin("smtp_vrfy", "smtp_expn", "smtp_rcpt", "smtp_reject"))
    pair = F.array_sort(F.array("src_ip", "dst_ip"))
    rows = rows.withColumns({"pair_low": pair[0], "pair_high": pair[1]})
    counted = _apply(rows, ["pair_low", "pair_high"], Trailing(kinds, window, ttl_s or 2 * window), "n_vrfy long, n_rcpt long, n_reject long")
    return smtp_judged(counted, vrfy, rcpt, rejects, ratio).drop("pair_low", "pair_high")


def http_guessing_stream(app: DataFrame, window: float = 60, least: int = 5, ttl_s: float | None = None) -> DataFrame:
    """``windows.http_guessing`` on a stream."""
    kinds = {"n_basic": (("http_basic",), False), "n_401": (("http_401",), False)}
    rows = app.where(F.col("app_function").isin("http_basic", "http_401"))
    return guessing_judged(_apply(rows, ["src_ip", "dst_ip", "dst_port"], Trailing(kinds, window, ttl_s or 2 * window), "n_basic long, n_401 long"), least)


class LastLogins(StatefulProcessor):
    """Adds to each row of a key when a default login, any login event and a refusal came last, that row's own time included."""

    NAMES = ("_default", "_login", "_refused")

    def __init__(self, ttl_s: float):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "times array<double>", int(self.ttl_s * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _in_order(rows)
        ts, kind = new["ts"].to_numpy(float), new["app_function"]
        which = (kind == "http_basic") & (new["app_code"] == 1), kind.isin(["http_basic", "http_401"]), kind == "http_401"
        before = self.last.get()[0] if self.last.exists() else [None] * len(which)
        peers = np.searchsorted(ts, ts, "right") - 1
        made, kept = {}, []
        for name, marked, old in zip(self.NAMES, which, before):
            old, at = -np.inf if old is None else old, np.where(marked, ts, -np.inf)
            seen = np.maximum(np.maximum.accumulate(at)[peers], np.where(old <= ts, old, -np.inf))  # a late row knows nothing after it
            made[name] = np.where(np.isinf(seen), None, seen)
            newest = max(float(at.max()), old)
            kept.append(None if np.isinf(newest) else newest)
        self.last.update((kept,))
        yield new.assign(**made)


def web_deployments_stream(app: DataFrame, window: float = 300, refusal: float = 60, ttl_s: float | None = None) -> DataFrame:
    """``windows.web_deployments`` on a stream; three times for each client, server and port are kept for ``ttl_s`` (twice ``window``)."""
    rows = app.where(F.col("app_function").isin("http_basic", "http_401", "http_admin_deploy"))
    known = _apply(rows, ["src_ip", "dst_ip", "dst_port"], LastLogins(ttl_s or 2 * window), "_default double, _login double, _refused double")
    return deployments_judged(known, window, refusal)


ENDS = ["capture_id", "proto", "a_ip", "a_port", "b_ip", "b_port"]
FLOW = "ts double, last_ts double, a_starts boolean, ab_bytes long, ba_bytes long, ab_pkts long, ba_pkts long"


class Sessions(StatefulProcessor):
    """The running flow of a pair of endpoints. It ends by a packet too late for it, or by the timers of its two limits."""

    def __init__(self, idle: float, hard: float):
        self.idle, self.hard = idle, hard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.flow = handle, handle.getValueState("flow", FLOW)

    def _frame(self, key, flows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in FLOW.split(", ")]
        return pd.DataFrame([(*key, *f) for f in flows], columns=[*ENDS, *names])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _in_order(rows, ("ts", "id"))
        ts = new["ts"].to_numpy(float)
        flow = list(self.flow.get()) if self.flow.exists() else None
        ended, at = [], 0
        forward, starts, size = (new[c].to_numpy() for c in ("forward", "a_starts", "size"))
        pauses = np.flatnonzero(np.diff(ts) > self.idle) + 1
        while at < len(ts):
            if flow is not None and (ts[at] - flow[1] > self.idle or ts[at] - flow[0] > self.hard):
                ended.append(tuple(flow))
                flow = None
            begin = ts[at] if flow is None else flow[0]
            # all rows up to the next pause or the limit of life belong to the running flow
            pause = pauses[np.searchsorted(pauses, at, side="right") :][:1]
            stop = min(int(np.searchsorted(ts, begin + self.hard, side="right")), int(pause[0]) if len(pause) else len(ts))
            stop = max(stop, at + 1)
            part, there = slice(at, stop), forward[at:stop]
            if flow is None:
                flow = [float(ts[at]), float(ts[at]), bool(starts[at]), 0, 0, 0, 0]
            flow[0], flow[1] = min(flow[0], float(ts[at])), max(flow[1], float(ts[stop - 1]))
            flow[3] += int(size[part][there].sum())
            flow[4] += int(size[part][~there].sum())
            flow[5] += int(there.sum())
            flow[6] += int((~there).sum())
            at = stop
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.flow.update(tuple(flow))
        self._wait(flow, timerValues)
        yield self._frame(key, ended)

    def _wait(self, flow: list, timerValues) -> None:
        due = int(min(flow[1] + self.idle, flow[0] + self.hard) * 1000) + 1
        self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.flow.exists():
            flow = list(self.flow.get())
            if expiredTimerInfo.getExpiryTimeInMs() > int(min(flow[1] + self.idle, flow[0] + self.hard) * 1000):
                self.flow.clear()
                yield self._frame(key, [tuple(flow)])


def packet_ends(packets: DataFrame, *more: str) -> DataFrame:
    """Packets by the ends of their flow, with what a running flow needs of them; DNS replies aren't folded in."""
    from netquill.operators.assembly import direction_free

    rows = direction_free(packets)
    starts = F.col("forward") == sender_is_originator(F.col("proto"), F.col("sport"), F.col("dport"), F.col("tcp_flags"))
    return rows.select(
        "capture_id", "proto", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("ip", "port")), "ts", "id", *more, "forward",
        F.coalesce(starts, F.lit(False)).alias("a_starts"), F.coalesce("wire_len", F.lit(0)).cast("long").alias("size"),
    )


def flow_sessions(packets: DataFrame, idle: float = 60, hard: float = 300, delay: str = "120 seconds") -> DataFrame:
    """``assembly.assemble_live`` on a stream: a flow comes out once ``idle`` seconds passed without a packet, or ``hard`` of its life."""
    from netquill.operators.assembly import oriented

    timed = packets.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint"))).withWatermark("event_time", delay)
    slim = packet_ends(timed, "event_time")
    out = StructType([slim.schema[c] for c in ENDS] + StructType.fromDDL(FLOW).fields)
    flows = slim.groupBy(*ENDS).transformWithStateInPandas(Sessions(idle, hard), out, "Append", "EventTime")
    ends = [F.struct(F.col(f"{s}_ip").alias("ip"), F.col(f"{s}_port").alias("port")).alias(s) for s in "ab"]
    return oriented(flows.select("*", *ends), ["capture_id", "proto"])
