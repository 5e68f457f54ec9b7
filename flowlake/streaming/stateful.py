"""Keyed-state streaming forms of the per-source operators.

Each takes packets as a stream and yields the same rows as its batch operator.
A micro-batch of one key is sorted in its task; the source's rate limits
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) bound its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowlake.operators.behaviour import FLOW_COUNT_CAP, HISTORY
from flowlake.operators.health import CLEAR, COOLDOWN_SECONDS, LIMITS, alert_message
from flowlake.operators.police import STATE as BUCKET_STATE
from flowlake.operators.police import Bucket
from flowlake.streaming import run

COUNTERS = ("packets_captured", "packets_processed", "packets_dropped")
GAUGES = ("flows_in_queue", "interface_available", "memory_usage_mb", "cpu_usage_percent", "disk_usage_percent")
RATES = ("capture_rate_pps", "processing_rate_pps", "drop_rate_percent")

POLICE_ROWS = 10_000  # policed and handed on at once

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(
    stream: DataFrame,
    keys: list[str],
    order: list[str],
    update: Callable[[tuple, pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]],
    output: T.StructType,
    state: T.StructType,
    idle_seconds: int | None = None,
) -> DataFrame:
    """Run ``update(key, sorted rows, old state) -> (output rows, new state)`` per key and micro-batch.

    With ``idle_seconds`` a key is forgotten once the watermark is that far past
    its last row; the stream must then have a watermark and an ``_us`` column.
    """
    names = output.names

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        out, new = update(key, rows, held.get if held.exists else None)
        held.update(new)
        if idle_seconds is not None:
            ends = int(rows["_us"].max()) // 1000 + idle_seconds * 1000
            held.setTimeoutTimestamp(max(ends, held.getCurrentWatermarkMs() + 1))
        if len(out):
            yield out[names]

    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.EventTimeTimeout
    return stream.groupBy(*keys).applyInPandasWithState(step, output, state, "append", timeout)


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


class _PerSource(StatefulProcessor):
    """Shared part of the processors: one batch's rows of a key in order, and forgetting idle keys.

    ``clock`` holds the newest time of the key. A row that is older than it is late: it is taken after the
    rows of earlier batches, as if it came at the clock's time. With ``idle_us`` a key is forgotten once the
    watermark is that far past its clock.
    """

    order: tuple[str, ...] = ("_us", "packet_id")
    idle_us: int | None = None
    columns: list[str] = []

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Get the state variables."""

    def update(self, key: tuple, rows: pd.DataFrame, now: np.ndarray, clock: int | None) -> pd.DataFrame:
        """Output of a batch's rows; ``now`` are their times, late ones put forward."""

    def forgotten(self, key: tuple) -> pd.DataFrame | None:
        """Rows to put out before a key's state is dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", T.StructType(_long("us")))
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues):
        # computed columns arrive without their names
        pdf = pd.concat([f.set_axis(self.columns, axis=1) for f in rows], ignore_index=True).sort_values(list(self.order), kind="stable")
        clock = int(self.clock.get()[0]) if self.clock.exists() else None
        now = pdf["_us"].to_numpy(np.int64)
        out = self.update(key, pdf, now if clock is None else np.maximum(now, clock), clock)
        newest = int(now[-1]) if clock is None else max(clock, int(now[-1]))
        if newest != clock:
            self.clock.update((newest,))
            if self.idle_us is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                ends = (newest + self.idle_us) // 1000 + 1
                self.handle.registerTimer(max(ends, timerValues.getCurrentWatermarkInMs() + 1))
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = self.forgotten(key)
        for variable in (self.clock, *self.variables):
            variable.clear()
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, keys: list[str], processor: _PerSource, output: T.StructType, idle_seconds: float | None) -> DataFrame:
    """Rows of ``processor`` per key; state variables need the RocksDB store."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    processor.columns = stream.columns
    processor.idle_us = None if idle_seconds is None else int(idle_seconds * 1_000_000)
    mode = "None" if idle_seconds is None else "EventTime"
    return stream.groupBy(*keys).transformWithStateInPandas(processor, output, "Append", mode)


def _kept(state, least: int) -> np.ndarray:
    """The elements of a list state as rows of numbers."""
    rows = [tuple(r) for r in state.get()]
    return np.array(rows, dtype=np.float64).reshape(len(rows), least)


def _keep(state, held: int, new: np.ndarray, most: int) -> None:
    """Append the last ``most`` of ``new``; a list of over twice that length is cut, so an element is rewritten about once."""
    rows = [tuple(float(x) for x in r) for r in new[-most:]]
    if held + len(rows) > 2 * most:
        rest = [tuple(r) for r in state.get()] if len(rows) < most else []
        state.put([*rest, *rows][-most:])
    elif rows:
        state.appendList(rows)


class _History(_PerSource):
    def __init__(self, history, burst, slow, periodic_cv, names):
        self.history, self.burst, self.slow, self.cv, self.names = history, burst, slow, periodic_cv, names

    def open(self, handle):
        self.recent = handle.getListState("recent", T.StructType([T.StructField("score", T.DoubleType()), T.StructField("gap", T.DoubleType())]))
        self.count = handle.getValueState("flows", T.StructType(_long("n")))
        self.variables = (self.recent, self.count)

    def update(self, key, rows, now, clock):
        gap = np.diff(now, prepend=now[0] if clock is None else clock)
        first = 0  # rows before it belong to what was remembered of the source earlier
        held, flows = _kept(self.recent, 2), int(self.count.get()[0]) if self.count.exists() else 0
        fresh = gap > self.idle_us if self.idle_us is not None else np.zeros(len(gap), bool)
        parts, borders = [], [*np.flatnonzero(fresh).tolist(), len(rows)]
        for border in borders:
            if first < border or border == len(rows):
                parts.append(self.stretch(key, rows.iloc[first:border], gap[first:border], held, flows))
                kept = np.column_stack([rows["_score"].to_numpy(np.float64)[first:border], gap[first:border]])
            if border < len(rows):  # the source was idle: it starts anew
                gap[border], held, flows = 0, np.zeros((0, 2)), 0
                self.recent.clear()
                first = border
        _keep(self.recent, len(held), kept, self.history)
        self.count.update((flows + len(kept),))
        return pd.concat(parts)

    def stretch(self, key, rows, gap, held, flows) -> pd.DataFrame:
        """Rolling values by prefix sums and sliding windows over what is held and the new rows."""
        n, value = len(rows), rows["_score"].to_numpy(np.float64)
        before = held[-(self.history - 1) :] if self.history > 1 else held[:0]
        k = len(before)
        scores, gaps = np.concatenate([before[:, 0], value]), np.concatenate([before[:, 1], gap])
        pad = np.full(self.history - 1, np.nan)
        windows = lambda x: np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, x]), self.history)[k:]
        size = np.minimum(np.arange(k + 1, k + n + 1), self.history)
        total = np.append(0, np.cumsum(gaps.astype(np.int64)))
        total = total[k + 1 :] - total[np.arange(k + 1, k + n + 1) - size]
        mean, deviation = np.empty(n), np.empty(n)
        for i in range(0, n, 4096):  # a bounded number of windows at a time
            part = slice(i, i + 4096)
            mean[part] = np.nanmean(windows(scores)[part], axis=1)
            with np.errstate(invalid="ignore"):
                w, m = windows(gaps)[part], (total[part] / size[part])[:, None]
                deviation[part] = np.sqrt(np.nansum((w - m) ** 2, axis=1) / np.maximum(size[part] - 1, 1))
        mean_gap = np.where(size >= 2, total / (size * 1e6), np.nan)
        raw = gap / 1e6
        steady = (size >= 5) & (total > 0) & (deviation < self.cv * (total / size))
        return pd.DataFrame(
            {
                "packet_id": rows["packet_id"].to_numpy(),
                "src_ip": key[0],
                "mean_score": mean,
                "mean_interval": pd.Series(mean_gap, dtype="Float64").mask(size < 2),
                "ip_score_delta": value - mean,
                "interval_raw": raw,
                "interval_delta": np.where(np.nan_to_num(mean_gap) > 0, raw - mean_gap, 0.0),
                "ip_flow_count": np.minimum(flows + np.arange(1, n + 1), FLOW_COUNT_CAP),
                "is_burst": (raw < self.burst).astype(np.int64),
                "is_slow": (raw > self.slow).astype(np.int64),
                "is_periodic": steady.astype(np.int64),
            }
        )[self.names]


def source_history(
    stream: DataFrame,
    score: str = "if_score",
    history: int = HISTORY,
    burst: float = 0.1,
    slow: float = 30.0,
    periodic_cv: float = 0.25,
    idle_seconds: int | None = None,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Rolling per-source history, optionally forgetting sources idle for ``idle_seconds``.

    The last ``history`` scores and gaps are elements of a list state, appended batch by batch.
    Forgetting goes by event time between a source's own rows, so it does not
    depend on how rows fall into micro-batches; the timer only frees state.
    """
    doubles = ["mean_score", "mean_interval", "ip_score_delta", "interval_raw", "interval_delta"]
    output = T.StructType(
        [
            *_long("packet_id"),
            T.StructField("src_ip", T.StringType()),
            *[T.StructField(n, T.DoubleType()) for n in doubles],
            *_long("ip_flow_count", "is_burst", "is_slow", "is_periodic"),
        ]
    )
    timed = stream if idle_seconds is None else stream.withWatermark("ts", lateness)
    columns = ["packet_id", "src_ip", F.unix_micros("ts").alias("_us"), F.col(score).alias("_score"), *["ts"] * (idle_seconds is not None)]
    return _stateful(timed.select(*columns), ["src_ip"], _History(history, burst, slow, periodic_cv, output.names), output, idle_seconds)


class _Beacons(_PerSource):
    def __init__(self, keys, history, minimum, limit, names):
        self.keys, self.history, self.minimum, self.limit, self.names = keys, history, minimum, limit, names

    def open(self, handle):
        self.times = handle.getListState("times", T.StructType([T.StructField("us", T.DoubleType())]))
        self.variables = (self.times,)

    def update(self, key, rows, now, clock):
        held = _kept(self.times, 1)[:, 0].astype(np.int64)
        times = np.concatenate([held[-(self.history - 1) :], now])
        k, n = len(times) - len(now), len(now)
        size = np.minimum(np.arange(k + 1, k + n + 1), self.history)
        gaps = np.concatenate([np.full(self.history - 1, np.nan), np.diff(times) * 1000.0])
        windows = np.lib.stride_tricks.sliding_window_view(gaps, self.history - 1)[k : k + n]
        spread = np.full(n, np.nan)
        for i in range(0, n, 16384):
            part = slice(i, i + 16384)
            enough = size[part] >= max(self.minimum, 3)
            spread[part][enough] = np.nanvar(windows[part][enough], axis=1, ddof=1)
        _keep(self.times, len(held), now.reshape(-1, 1), self.history)
        out = pd.DataFrame({"packet_id": rows["packet_id"].to_numpy(), "n_timestamps": size, "gap_variance": spread, "is_beacon": spread < self.limit})
        for name, value in zip(self.keys, key, strict=True):
            out[name] = value
        return out[size >= self.minimum][self.names]


def beacons(
    stream: DataFrame,
    keys: tuple[str, ...] = ("src_ip", "src_port", "dst_ip", "dst_port"),
    history: int = 20,
    minimum: int = 10,
    variance_limit: float = 5e13,
    idle_seconds: int | None = None,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Beacon test over the last ``history`` timestamps of each flow; flows idle for ``idle_seconds`` start anew."""
    kinds = dict(stream.select(*keys).dtypes)
    output = T.StructType(
        [
            *[T.StructField(k, T._parse_datatype_string(kinds[k])) for k in keys],
            *_long("packet_id", "n_timestamps"),
            T.StructField("gap_variance", T.DoubleType()),
            T.StructField("is_beacon", T.BooleanType()),
        ]
    )
    timed = stream if idle_seconds is None else stream.withWatermark("ts", lateness)
    columns = [*keys, "packet_id", F.unix_micros("ts").alias("_us"), *["ts"] * (idle_seconds is not None)]
    return _stateful(timed.select(*columns), list(keys), _Beacons(keys, history, minimum, variance_limit, output.names), output, idle_seconds)


class _PortScan(_PerSource):
    def __init__(self, limit):
        self.limit = limit

    def open(self, handle):
        self.ports = handle.getMapState("ports", T.StructType(_long("port")), T.StructType(_long("first_us")))
        self.count = handle.getValueState("n_ports", T.StructType(_long("n")))
        self.variables = (self.ports, self.count)

    def update(self, key, rows, now, clock):
        port = rows["_port"].to_numpy(np.int64)
        held = int(self.count.get()[0]) if self.count.exists() else 0
        different, first = np.unique(port, return_index=True)
        new = [(int(p), int(i)) for p, i in zip(different, first, strict=True) if not self.ports.containsKey((int(p),))]
        for p, i in new:  # only ports not seen before are written
            self.ports.updateValue((p,), (int(now[i]),))
        if new:
            self.count.update((held + len(new),))
        opened = np.zeros(len(port), np.int64)
        opened[[i for _, i in new]] = 1
        seen = held + np.cumsum(opened)
        return pd.DataFrame({"packet_id": rows["packet_id"].to_numpy(), "src_ip": key[0], "ports_seen": seen, "is_scan": seen > self.limit})


def port_scan(stream: DataFrame, limit: int = 5, idle_seconds: int | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Distinct destination ports per source so far, one entry of a map state for each (65,536 and NULL at most).

    Sources idle for ``idle_seconds`` are forgotten.
    """
    output = T.StructType(
        [*_long("packet_id"), T.StructField("src_ip", T.StringType()), *_long("ports_seen"), T.StructField("is_scan", T.BooleanType())]
    )
    timed = stream if idle_seconds is None else stream.withWatermark("ts", lateness)
    columns = ["packet_id", "src_ip", F.unix_micros("ts").alias("_us"), F.coalesce(F.col("dst_port").cast("long"), F.lit(-1)).alias("_port"), *["ts"] * (idle_seconds is not None)]
    rows_in = timed.filter("src_ip IS NOT NULL AND src_ip <> ''").select(*columns)
    return _stateful(rows_in, ["src_ip"], _PortScan(limit), output, idle_seconds)


class _Health(_PerSource):
    """One machine per sensor: previous snapshot, time of the last kept alert per rule, alerts not cleared yet."""

    order = ("_us",)

    def __init__(self, limits: dict, cooldown: float, names: list[str]):
        drop, queue = limits["drop"], limits["queue"]
        self.cooldown, self.names = int(cooldown * 1e6), names
        # type: (measured column, fires above, severe above, clears at or below)
        self.rules = {
            "high_drop_rate": ("drop_rate_percent", drop, drop * 2, drop * CLEAR["drop"]),
            "queue_overflow": ("flows_in_queue", queue, np.inf, queue * CLEAR["queue"]),
            "interface_unavailable": ("_down", 0.5, 0.5, 0.5),
            "high_cpu": ("cpu_usage_percent", limits["cpu"], np.inf, CLEAR["cpu"]),
            "high_memory": ("memory_usage_mb", limits["memory"], np.inf, CLEAR["memory"]),
            "high_disk_usage": ("disk_usage_percent", limits["disk"], limits["disk"], CLEAR["disk"]),
        }

    def open(self, handle):
        counters = T.StructType([T.StructField(n, T.DoubleType()) for n in COUNTERS])
        alert = T.StructType([T.StructField("alert_type", T.StringType()), *_long("us")])
        self.previous = handle.getValueState("previous", counters)
        self.last = handle.getMapState("last", T.StructType([T.StructField("alert_type", T.StringType())]), T.StructType(_long("us")))
        self.unresolved = handle.getMapState("open", alert, T.StructType([T.StructField("severity", T.StringType()), T.StructField("value", T.DoubleType())]))
        self.variables = (self.previous, self.last, self.unresolved)

    def update(self, key, rows, now, clock):
        new = np.diff(now, prepend=now[0] - 1 if clock is None else clock) > 0  # a snapshot not newer than the last one is dropped
        rows, now = rows[new].reset_index(drop=True), now[new]
        if not len(rows):
            return pd.DataFrame(columns=self.names)
        rows = rows.assign(**self.rates(rows, now, clock), _down=1.0 - rows["interface_available"].astype("Float64").astype(np.float64))
        parts = [pd.DataFrame({"kind": "rate", "_us": now, **{c: rows[c] for c in RATES}})]
        held = [(k[0], int(k[1]), v[0], v[1]) for k, v in self.unresolved.iterator()]
        for rule, (column, limit, severe, clear) in self.rules.items():
            value = rows[column].to_numpy(np.float64, na_value=np.nan)
            fires = value > limit
            fired = pd.DataFrame({"_us": now[fires], "value": value[fires], "severity": np.where(value[fires] > severe, "critical", "warning")})
            if rule == "interface_unavailable":
                fired["value"] = np.nan
            kept = self.kept(rule, now[fires])
            parts.append(fired[kept].assign(kind="alert", alert_type=rule))
            parts.append(self.resolved(rule, fired, [h for h in held if h[0] == rule], now[value <= clear]))
        out = pd.concat([p for p in parts if len(p)], ignore_index=True).reindex(columns=self.names)
        for n, c in zip(self.columns, key, strict=False):
            out[n] = c
        return out.assign(value=out["value"].astype("Float64"), **{c: out[c].astype("Float64") for c in RATES}, resolved_us=out["resolved_us"].astype("Int64"))

    def rates(self, rows, now, clock) -> dict[str, np.ndarray]:
        old = np.array([self.previous.get()]) if self.previous.exists() else np.full((1, 3), np.nan)
        line = np.concatenate([old.astype(np.float64), rows[list(COUNTERS)].to_numpy(np.float64, na_value=np.nan)])
        self.previous.update(tuple(line[-1].tolist()))
        passed = np.diff(now, prepend=now[0] if clock is None else clock) / 1e6
        captured, processed, dropped = np.diff(line, axis=0).T
        with np.errstate(divide="ignore", invalid="ignore"):
            capture, processing = (np.where(passed > 0, x / passed, 0.0) for x in (captured, processed))
            drop = np.where((passed > 0) & (captured > 0), dropped * 100.0 / captured, 0.0)
        return dict(zip(RATES, (capture, processing, np.nan_to_num(drop)), strict=True))

    def kept(self, rule: str, times: np.ndarray) -> np.ndarray:
        """Alerts at least one cooldown after the last kept one; each step goes to the next kept one."""
        kept = np.zeros(len(times), bool)
        if not len(times):
            return kept
        last = int(self.last.getValue((rule,))[0]) if self.last.containsKey((rule,)) else None
        at = 0 if last is None else int(np.searchsorted(times, last + self.cooldown))
        while at < len(times):
            kept[at], last = True, int(times[at])
            at = max(at + 1, int(np.searchsorted(times, last + self.cooldown)))
        if kept.any():
            self.last.updateValue((rule,), (last,))
        return kept

    def resolved(self, rule: str, fired: pd.DataFrame, held: list[tuple], clears: np.ndarray) -> pd.DataFrame:
        """Alerts, old and new, that a snapshot of this batch clears; the others stay open."""
        old = pd.DataFrame([(us, value, severity) for _, us, severity, value in held], columns=["_us", "value", "severity"])
        line = pd.concat([x for x in (old, fired) if len(x)], ignore_index=True) if len(old) + len(fired) else old
        at = np.searchsorted(clears, line["_us"].to_numpy(np.int64))
        done = at < len(clears)
        for i in np.flatnonzero(done[: len(old)]).tolist():
            self.unresolved.removeKey((rule, int(old["_us"][i])))
        for i in np.flatnonzero(~done[len(old) :]).tolist():
            us, value, severity = fired.iloc[i][["_us", "value", "severity"]]
            self.unresolved.updateValue((rule, int(us)), (severity, float(value)))
        return line[done].assign(kind="resolved", alert_type=rule, resolved_us=clears[at[done]])

    def forgotten(self, key):
        held = [(*key, "unresolved", int(k[1]), k[0], v[0], v[1]) for k, v in self.unresolved.iterator()]
        columns = [*self.columns[: len(key)], "kind", "_us", "alert_type", "severity", "value"]
        return pd.DataFrame(held, columns=columns).reindex(columns=self.names) if held else None


def alert_stream(
    snapshots: DataFrame,
    limits: dict = LIMITS,
    cooldown: float = COOLDOWN_SECONDS,
    keys: tuple[str, ...] = ("sensor",),
    idle_seconds: float | None = None,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Health rates, alerts and their resolution from the raw snapshot stream, as rows of several kinds.

    ``rate``: rates of every snapshot; ``alert``: alerts kept by the cooldown; ``resolved``: any alert, kept or
    not, with the time at which a snapshot cleared it; ``unresolved``: an alert of a sensor forgotten after
    ``idle_seconds``. Alerts that are still open at a stop are in the state, see ``open_alerts``. A snapshot
    that is not newer than its sensor's last one is dropped.
    """
    output = T.StructType(
        [
            *[T.StructField(k, T.StringType()) for k in keys], T.StructField("kind", T.StringType()), *_long("_us"),
            *[T.StructField(c, T.DoubleType()) for c in RATES], T.StructField("alert_type", T.StringType()), T.StructField("severity", T.StringType()),
            T.StructField("value", T.DoubleType()), *_long("resolved_us"),
        ]
    )
    timed = snapshots if idle_seconds is None else snapshots.withWatermark("ts", lateness)
    rows_in = timed.select(*keys, F.unix_micros("ts").alias("_us"), *COUNTERS, *GAUGES, *["ts"] * (idle_seconds is not None))
    rows = _stateful(rows_in, list(keys), _Health(limits, cooldown, output.names), output, idle_seconds)
    value = F.nanvl("value", F.lit(None))
    return rows.select(
        *keys, "kind", F.timestamp_micros("_us").alias("ts"), *RATES, "alert_type", "severity",
        alert_message(F.col("alert_type"), value, limits).alias("message"), F.timestamp_micros("resolved_us").alias("resolved_at"),
    )


def open_alerts(spark: SparkSession, folder: str, limits: dict = LIMITS) -> DataFrame:
    """Alerts that no snapshot has cleared when the drained stream in ``folder`` stopped."""
    held = run.state_of(spark, folder, 0, "open")
    kind, value = F.col("user_map_key.alert_type"), F.nanvl(F.col("user_map_value.value"), F.lit(None))
    return held.select(
        "key.*", kind.alias("alert_type"), F.timestamp_micros("user_map_key.us").alias("ts"), F.col("user_map_value.severity").alias("severity"),
        alert_message(kind, value, limits).alias("message"),
    )


def rate_police(stream: DataFrame, rate: int = 100_000, capacity: int = 100_000) -> DataFrame:
    """Token bucket per source carried across micro-batches."""
    output = T.StructType([*_long("packet_id"), T.StructField("src_ip", T.StringType()), T.StructField("passed", T.BooleanType())])
    rows_in = stream.select("packet_id", "src_ip", "packet_size", (F.unix_micros("ts") * 1000).alias("_ns"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        # A busy source's rows of a micro-batch: three numbers each, no objects.
        kept = [(p["packet_id"].to_numpy(), p["packet_size"].astype("int64").to_numpy(), p["_ns"].astype("int64").to_numpy()) for p in batches]
        ids, sizes, times = (np.concatenate(c) for c in zip(*kept))  # a missing size or time is refused above
        bucket = Bucket(rate, capacity, *held.get) if held.exists else Bucket(rate, capacity, capacity)
        order = np.lexsort((ids, times))
        for first in range(0, len(order), POLICE_ROWS):
            at = order[first : first + POLICE_ROWS]
            passed = [bucket.admit(now, size) for now, size in zip(times[at].tolist(), sizes[at].tolist())]
            yield pd.DataFrame({"packet_id": ids[at], "src_ip": key[0], "passed": passed})
        held.update((bucket.tokens, bucket.remainder, bucket.last))

    return rows_in.groupBy("src_ip").applyInPandasWithState(step, output, BUCKET_STATE, "append", GroupStateTimeout.NoTimeout)


def alert_cooldown(alerts: DataFrame, keys: tuple[str, ...] = ("sensor", "alert_type"), cooldown: float = COOLDOWN_SECONDS) -> DataFrame:
    """Keep alerts at least one cooldown after the last kept one of their key."""
    output = T.StructType(
        [*[T.StructField(k, T.StringType()) for k in keys], *_long("_us"), *[T.StructField(c, T.StringType()) for c in ("severity", "message")]]
    )
    state = T.StructType(_long("last_us"))
    micros = int(cooldown * 1e6)
    rows_in = alerts.select(*keys, F.unix_micros("ts").alias("_us"), "severity", "message")

    def update(key, pdf, old):
        last = None if old is None else old[0]
        rows = []
        for now, severity, message in zip(pdf["_us"], pdf["severity"], pdf["message"]):
            if last is None or now - last >= micros:
                last = int(now)
                rows.append((*key, last, severity, message))
        return pd.DataFrame(rows, columns=output.names), (last,)

    kept = _keyed(rows_in, list(keys), ["_us", "severity", "message"], update, output, state)
    return kept.select(*keys, F.timestamp_micros("_us").alias("ts"), "severity", "message")
