"""Capture health: rates, threshold alerts, cooldown and resolution."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.encode import fixed, rounded
from flowlake.operators.fold import fold_ordered
from flowlake.operators.sequence import MAX_GROUP_ROWS, POSITION, Running, Stage, ordered

# Default limits of the alert rules and of their clearing.
LIMITS = {"drop": 1.0, "queue": 1000, "cpu": 90.0, "memory": 1024.0, "disk": 90.0}
CLEAR = {"drop": 0.5, "queue": 0.8, "cpu": 70.0, "memory": 512.0, "disk": 80.0}
COOLDOWN_SECONDS = 300.0


def health_rates(
    snapshots: DataFrame, keys: Sequence[str] = ("sensor",), max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Capture and processing rates and drop share between neighbouring snapshots."""

    def columns(w):
        return {
            "_dt": (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / F.lit(1e6),
            "_captured": F.col("packets_captured") - F.lag("packets_captured").over(w),
            "_processed": F.col("packets_processed") - F.lag("packets_processed").over(w),
            "_dropped": F.col("packets_dropped") - F.lag("packets_dropped").over(w),
        }

    out = ordered(snapshots, list(keys), ["ts"], [Stage(columns, 1)], max_group_rows)

    def rate(delta: str) -> Column:
        return F.when(F.col("_dt") > 0, F.col(delta) / F.col("_dt")).otherwise(0.0)

    drop_share = F.when((F.col("_dt") > 0) & (F.col("_captured") > 0), F.col("_dropped") * 100.0 / F.col("_captured"))
    return out.withColumns(
        {
            "capture_rate_pps": rate("_captured"),
            "processing_rate_pps": rate("_processed"),
            "drop_rate_percent": F.coalesce(drop_share, F.lit(0.0)),
        }
    ).drop("_dt", "_captured", "_processed", "_dropped", POSITION)


def _messages(limits: dict) -> dict[str, Callable[[Column], Column]]:
    """Text of an alert of each type about the measured value. The wording."""
    return {
        "high_drop_rate": lambda v: F.concat(F.lit("Drop rate "), fixed(v, 1), F.lit(f"% exceeds threshold {limits['drop']}%")),
        "queue_overflow": lambda v: F.concat(F.lit("Flow queue size "), v.cast("long").cast("string"), F.lit(f" exceeds threshold {limits['queue']}")),
        "interface_unavailable": lambda v: F.lit("Capture interface is not available"),
        "high_cpu": lambda v: F.concat(F.lit("CPU usage "), fixed(v, 1), F.lit("% is very high")),
        "high_memory": lambda v: F.concat(F.lit("Memory usage "), fixed(v, 0), F.lit("MB is high")),
        "high_disk_usage": lambda v: F.concat(F.lit("Disk usage "), fixed(v, 1), F.lit("% is critically high")),
    }


def alert_message(kind: Column, value: Column, limits: dict = LIMITS) -> Column:
    return F.coalesce(*[F.when(kind == name, text(value)) for name, text in _messages(limits).items()])


def _rules(limits: dict) -> list[tuple[str, Column, Column, Column]]:
    """Alert type, firing condition, severity and message of the six rules."""
    drop, queue = F.col("drop_rate_percent"), F.col("flows_in_queue")
    cpu, memory, disk = F.col("cpu_usage_percent"), F.col("memory_usage_mb"), F.col("disk_usage_percent")
    warning, critical, text = F.lit("warning"), F.lit("critical"), _messages(limits)
    return [
        ("high_drop_rate", drop > limits["drop"], F.when(drop > limits["drop"] * 2, critical).otherwise(warning), text["high_drop_rate"](drop)),
        ("queue_overflow", queue > limits["queue"], warning, text["queue_overflow"](queue)),
        ("interface_unavailable", ~F.col("interface_available"), critical, text["interface_unavailable"](drop)),
        ("high_cpu", cpu > limits["cpu"], warning, text["high_cpu"](cpu)),
        ("high_memory", memory > limits["memory"], warning, text["high_memory"](memory)),
        ("high_disk_usage", disk > limits["disk"], critical, text["high_disk_usage"](disk)),
    ]


def threshold_alerts(rated: DataFrame, limits: dict = LIMITS, keys: Sequence[str] = ("sensor",)) -> DataFrame:
    """One row per snapshot and rule that fires."""
    fired = [
        F.when(cond, F.struct(F.lit(kind).alias("alert_type"), level.alias("severity"), message.alias("message")))
        for kind, cond, level, message in _rules(limits)
    ]
    return rated.select(*keys, "ts", F.explode(F.array_compact(F.array(*fired))).alias("a")).select(
        *keys, "ts", "a.alert_type", "a.severity", "a.message"
    )


def alert_cooldown(
    alerts: DataFrame,
    keys: Sequence[str] = ("sensor", "alert_type"),
    cooldown: float = COOLDOWN_SECONDS,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Keep an alert only if the last kept one of its key is at least ``cooldown`` old.

    Whether an alert is kept depends on earlier decisions, so this is a fold.
    But a pause of one cooldown restarts it: the alert after the pause is kept
    for certain. Keys are cut at those pauses into independent stretches, equal
    times are folded first, and a stretch streams through its task in Arrow
    batches holding one number of state.
    """
    names = list(keys)
    distinct = alerts.dropDuplicates([*names, "ts"]).select(*names, "ts")
    micros = int(cooldown * 1e6)

    def pause(w):
        before = F.lag("ts").over(w)
        return {"_fresh": before.isNull() | (F.unix_micros("ts") - F.unix_micros(before) >= micros)}

    stages = [Stage(pause, 1), Running({"_stretch": F.when(F.col("_fresh"), F.col(POSITION))})]
    cut = ordered(distinct, names, ["ts"], stages, max_group_rows)
    cut = cut.withColumn("_us", F.unix_micros("ts")).select(*names, "_stretch", "_us")

    def keep(kept: list[int], now: int) -> bool:
        if kept and now - kept[0] < micros:
            return False
        kept[:] = [now]
        return True

    kept = fold_ordered(cut, [*names, "_stretch"], ["_us"], ["_us"], list, keep, "_kept").filter("_kept")
    times = kept.select(*[F.col(n).alias(f"_k_{n}") for n in names], F.timestamp_micros("_us").alias("_kept_ts"))
    match = F.col("ts") == F.col("_kept_ts")
    for n in names:
        match = match & F.col(n).eqNullSafe(F.col(f"_k_{n}"))
    # Alerts of one key at one time would all pass; the first in text order stands for them.
    single = alerts.groupBy(*names, "ts").agg(F.min(F.struct("severity", "message")).alias("_a"))
    return single.join(times, match, "left_semi").select(*names, "ts", "_a.severity", "_a.message")


def alert_resolution(
    alerts: DataFrame,
    rated: DataFrame,
    limits: dict = LIMITS,
    keys: Sequence[str] = ("sensor",),
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """When each alert cleared: the first later snapshot of its sensor inside the clearing bound.

    Alerts and clearing snapshots are put on one time line per sensor and rule;
    the next clear time is a running minimum from the end, so no alert is
    paired with more than one snapshot.
    """
    clear = {
        "high_drop_rate": F.col("drop_rate_percent") <= limits["drop"] * CLEAR["drop"],
        "queue_overflow": F.col("flows_in_queue") <= limits["queue"] * CLEAR["queue"],
        "interface_unavailable": F.col("interface_available"),
        "high_cpu": F.col("cpu_usage_percent") <= CLEAR["cpu"],
        "high_memory": F.col("memory_usage_mb") <= CLEAR["memory"],
        "high_disk_usage": F.col("disk_usage_percent") <= CLEAR["disk"],
    }
    kinds = F.array_compact(F.array(*[F.when(cond, F.lit(kind)) for kind, cond in clear.items()]))
    names = [*keys, "alert_type"]
    cleared = rated.select(*keys, "ts", F.explode(kinds).alias("alert_type")).withColumn("_clear", F.col("ts"))
    line = alerts.select(*names, "ts", "severity", "message", F.lit(None).cast("timestamp").alias("_clear")).unionByName(
        cleared, allowMissingColumns=True
    )
    # Time runs backwards through ``ordered``; a snapshot at the alert's own time comes after it.
    line = line.withColumn("_back", -F.unix_micros("ts")).withColumn("_kind", F.col("_clear").isNull().cast("int"))
    merged = ordered(
        line, names, ["_back", "_kind"], [Running({"_next": -F.unix_micros("_clear")})], max_group_rows
    )
    resolved = F.timestamp_micros(-F.col("_next"))
    return (
        merged.filter(F.col("severity").isNotNull())
        .withColumn("resolved_at", resolved)
        .withColumn("resolved", F.col("resolved_at").isNotNull())
        .select(*names, "ts", "severity", "message", "resolved", "resolved_at")
    )


def newest(
    df: DataFrame, count: int, order: str = "ts", keys: Sequence[str] = (), ties: Sequence[str] = ()
) -> DataFrame:
    """The last ``count`` rows by ``order``, overall or per key: a bounded history view.

    Spark keeps only ``count`` rows per key before the shuffle (top-k or group limit).
    """
    ranking = [F.col(order).desc(), *ties]
    if not keys:
        return df.orderBy(*ranking).limit(count)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*ranking))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= count).drop("_rank")


def health_summary(
    rated: DataFrame,
    limits: dict = LIMITS,
    last: int = 10,
    ties: Sequence[str] = ("sensor",),
    alerts: DataFrame | None = None,
    alert_memory: int = 100,
) -> DataFrame:
    """Averages and overall status of the newest snapshots, and the newest machine gauges.

    With resolved ``alerts`` also how many of the last ``alert_memory`` are open and listed.
    """
    gauges = ["interface_available", "memory_usage_mb", "cpu_usage_percent", "disk_usage_percent"]
    moment = F.struct(F.col("ts"), *[F.col(t) for t in ties])
    recent = newest(rated, last, ties=ties).agg(
        F.avg("drop_rate_percent").alias("drop"),
        F.avg("flows_in_queue").alias("queue"),
        F.avg("capture_rate_pps").alias("capture"),
        *[F.max_by(g, moment).alias(g) for g in gauges],
        F.count(F.lit(1)).alias("snapshots"),
    )
    status = (
        F.when(F.col("snapshots") == 0, "no_data")
        .when(F.col("drop") > limits["drop"], "critical")
        .when(F.col("drop") > limits["drop"] * 0.5, "warning")
        .otherwise("healthy")
    )
    out = recent.select(
        status.alias("status"),
        rounded(F.col("drop"), 2).alias("avg_drop_rate_percent"),
        rounded(F.col("queue"), 1).alias("avg_queue_size"),
        rounded(F.col("capture"), 2).alias("avg_capture_rate_pps"),
        *gauges,
    )
    if alerts is None:
        return out
    kept = newest(alerts, alert_memory, ties=[*ties, "alert_type"])
    open_alerts, listed = kept.agg(F.count_if(~F.col("resolved")), F.count(F.lit(1))).first()
    return out.withColumns({"active_alerts": F.lit(open_alerts), "total_alerts": F.lit(listed)})
