"""Per-source behaviour: rhythm, rolling scores, beacons and port scans."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from flowlake.functions import encode
from flowlake.operators.blocklist import maybe_broadcast
from flowlake.operators.sequence import MAX_GROUP_ROWS, POSITION, Running, Stage, largest_group, ordered
from flowlake.session import cut_lineage, released

HISTORY = 100
FLOW_COUNT_CAP = 1000
# Rows of a batch that are on their way to their sources at once.
ROWS_AT_ONCE = 50_000_000


def _interval_stage(ts: str) -> Stage:
    def columns(w: WindowSpec) -> dict[str, Column]:
        now = F.unix_micros(ts)
        return {"_gap_us": F.coalesce(now - F.lag(now).over(w), F.lit(0))}

    return Stage(columns, 1)


def _history_stage(score: str, history: int) -> Stage:
    def columns(w: WindowSpec) -> dict[str, Column]:
        last = w.rowsBetween(-(history - 1), 0)
        return {
            "mean_score": F.avg(score).over(last),
            "_gaps": F.count("_gap_us").over(last),
            "_gap_sum": F.sum("_gap_us").over(last),
            "_gap_dev": F.stddev_samp("_gap_us").over(last),
        }

    return Stage(columns, history - 1)


def source_history(
    flows: DataFrame,
    key: str = "src_ip",
    ts: str = "ts",
    tie: str = "packet_id",
    score: str = "if_score",
    history: int = HISTORY,
    burst: float = 0.1,
    slow: float = 30.0,
    periodic_cv: float = 0.25,
    max_group_rows: int = MAX_GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Rolling view of each source over its last ``history`` flows, current one included.

    Adds interval_raw, mean_score, mean_interval, ip_score_delta, interval_delta,
    ip_flow_count, is_burst, is_slow and is_periodic. All share one sort per
    source. A source's first interval is zero and counts as an interval.
    """
    stages = [_interval_stage(ts), _history_stage(score, history)]
    out = ordered(flows, [key], [ts, tie], stages, max_group_rows, largest)
    raw = F.col("_gap_us") / F.lit(1e6)
    mean = F.col("_gap_sum") / (F.col("_gaps") * F.lit(1e6))
    mean_interval = F.when(F.col("_gaps") >= 2, mean)
    steady = F.try_divide(F.col("_gap_dev"), F.col("_gap_sum") / F.col("_gaps")) < periodic_cv
    return out.withColumns(
        {
            "interval_raw": raw,
            "mean_interval": mean_interval,
            "ip_score_delta": F.coalesce(F.col(score) - F.col("mean_score"), F.lit(0.0)),
            "interval_delta": F.when(mean_interval > 0, raw - mean_interval).otherwise(0.0),
            "ip_flow_count": F.least(F.col(POSITION), F.lit(FLOW_COUNT_CAP)),
            "is_burst": (raw < burst).cast("int"),
            "is_slow": (raw > slow).cast("int"),
            "is_periodic": F.coalesce(
                ((F.col("_gaps") >= 5) & (F.col("_gap_sum") > 0) & steady).cast("int"), F.lit(0)
            ),
        }
    ).drop("_gap_us", "_gaps", "_gap_sum", "_gap_dev")


def history_after(
    flows: DataFrame,
    past: DataFrame | None,
    key: str = "src_ip",
    ts: str = "ts",
    tie: str = "packet_id",
    score: str = "if_score",
    history: int = HISTORY,
    max_group_rows: int = MAX_GROUP_ROWS,
    then: Callable[[DataFrame], DataFrame] | None = None,
    needed: Column | None = None,
    columns: Collection[str] | None = None,
    rows_at_once: int = ROWS_AT_ONCE,
) -> tuple[DataFrame, DataFrame]:
    """``source_history`` of a batch that follows earlier ones, and what the next batch needs.

    ``past`` holds the last ``history`` rows of each source and, in ``_earlier``, how many rows
    came before them. Batches must follow each other in time; then the rows are those of one
    batch over everything.

    ``then`` adds columns, row by row, before the rows are stored. Of the batch only rows that are
    ``needed`` come back, and only ``columns`` of them, if these are given. Sources of more than
    ``rows_at_once`` rows together are shuffled in several rounds, each of which reads the batch.
    """
    spark, both = flows.sparkSession, flows.withColumn("_earlier", F.lit(None).cast("long"))
    if past is not None:
        both = both.unionByName(past, allowMissingColumns=True)
    # Counted before the rows are ordered: joined to them, a source's totals need no shuffle besides that of the window.
    totals = both.groupBy(key).agg(F.count(F.lit(1)).alias("_in_all"), F.coalesce(F.max("_earlier"), F.lit(0)).alias("_ahead"))
    seen = cut_lineage(totals, "seen")
    rows, largest = seen.agg(F.coalesce(F.sum("_in_all"), F.lit(0)), F.coalesce(F.max("_in_all"), F.lit(0))).first()
    counted = both.join(maybe_broadcast(seen), key)
    is_last, is_fresh = F.col(POSITION) > F.col("_in_all") - history, F.col("_earlier").isNull()
    count = F.least(F.col("ip_flow_count") + F.col("_ahead"), F.lit(FLOW_COUNT_CAP))
    rounds = max(1, -(-rows // rows_at_once))

    def placed(part: int) -> DataFrame:
        some = counted if rounds == 1 else counted.filter(F.pmod(F.xxhash64(key), F.lit(rounds)) == part)
        out = source_history(some, key, ts, tie, score, history, max_group_rows=max_group_rows, largest=largest)
        out = out.withColumn("ip_flow_count", count)
        out = out if then is None else then(out)
        if needed is not None:
            out = out.filter(is_last | (is_fresh & needed))
        if columns is not None:
            used = {key, ts, tie, score, POSITION, "_earlier", "_in_all", "_ahead", *columns}
            out = out.select(*[c for c in out.columns if c in used])
        return out

    if rounds == 1:
        stored = cut_lineage(placed(0), "history")
    else:
        stored = None
        for part in range(rounds):
            with released(spark, tables=False):
                one = cut_lineage(placed(part), "history")
            stored = one if stored is None else stored.unionByName(one)
    keep = stored.filter(is_last).select(
        key, ts, tie, score, (F.col("_ahead") + F.greatest(F.col("_in_all") - history, F.lit(0))).cast("long").alias("_earlier")
    )
    fresh = stored.filter(is_fresh if needed is None else is_fresh & needed).drop("_earlier", "_in_all", "_ahead")
    return fresh if columns is None else fresh.select(*[c for c in fresh.columns if c in columns]), keep


def router_features(
    flows: DataFrame,
    startup: Column | None = None,
    ts: str = "ts",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """The 17 model inputs of the router next to the flow's own columns.

    ``startup`` defaults to the first event of the table.
    """
    out = source_history(flows, ts=ts, max_group_rows=max_group_rows)
    if startup is None:
        startup = F.lit(flows.agg(F.min(ts)).first()[0]).cast("timestamp")
    clock = encode.clock_features(F.col(ts), startup)
    return out.withColumns(
        {
            **clock,
            "ip_seen_before": F.lit(1),
            "protocol_name": F.col("protocol"),
            "protocol": encode.encode_protocol_router(F.col("protocol")),
            "payload_available": F.col("payload_available").cast("int"),
        }
    )


def beacons(
    packets: DataFrame,
    keys: Sequence[str] = ("src_ip", "src_port", "dst_ip", "dst_port"),
    ts_ns: Column | None = None,
    tie: str = "packet_id",
    history: int = 20,
    minimum: int = 10,
    variance_limit: float = 5e13,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Packets whose flow keeps a machine-like rhythm over its last ``history`` timestamps.

    Emits every packet with at least ``minimum`` timestamps in memory, the gap
    variance in ns squared, and whether it is below the limit.
    """
    base = packets.withColumn("_ns", F.unix_micros("ts") * 1000 if ts_ns is None else ts_ns)
    gap = Stage(lambda w: {"_gap": F.col("_ns") - F.lag("_ns").over(w)}, 1)
    # A memory of n timestamps holds n - 1 gaps.
    spread = Stage(
        lambda w: {
            "n_timestamps": F.count("_ns").over(w.rowsBetween(-(history - 1), 0)),
            "gap_variance": F.var_samp("_gap").over(w.rowsBetween(-(history - 2), 0)),
        },
        history - 1,
    )
    out = ordered(base, list(keys), ["_ns", tie], [gap, spread], max_group_rows)
    return (
        out.filter(F.col("n_timestamps") >= minimum)
        .withColumn("is_beacon", F.coalesce(F.col("gap_variance") < variance_limit, F.lit(False)))
        .drop("_ns", "_gap", POSITION)
    )


def port_scan(
    packets: DataFrame,
    ts: str = "ts",
    tie: str = "packet_id",
    limit: int = 5,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Distinct destination ports each source has probed so far, per packet.

    While a source fits a task, both windows below share one shuffle on the
    source. Beyond that, first uses are found by aggregation (combined before
    the shuffle) and their numbers are carried along each source in chunks.
    """
    known = packets.filter("src_ip IS NOT NULL AND src_ip <> ''")
    if largest_group(known, ["src_ip"]) <= max_group_rows:
        use = Window.partitionBy("src_ip", "dst_port").orderBy(ts, tie)
        upto = Window.partitionBy("src_ip").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
        counted = (
            known.repartition("src_ip")
            .withColumn("_first", (F.row_number().over(use) == 1).cast("long"))
            .withColumn("ports_seen", F.sum("_first").over(upto))
            .drop("_first")
        )
    else:
        counted = _port_scan_hot(known, ts, tie, max_group_rows)
    return counted.withColumn("is_scan", F.col("ports_seen") > limit)


def _port_scan_hot(packets: DataFrame, ts: str, tie: str, max_group_rows: int) -> DataFrame:
    """A source's first uses are at most 65,536 ports and NULL, so numbering them is small."""
    moment = F.struct(F.col(ts).alias("at"), F.col(tie).alias("id"))
    first_use = packets.groupBy("src_ip", "dst_port").agg(F.min(moment).alias("m"))
    rank = Window.partitionBy("src_ip").orderBy("m")
    numbered = first_use.select(
        F.col("src_ip").alias("_src"), F.col("dst_port").alias("_port"), "m", F.row_number().over(rank).cast("long").alias("_number")
    )
    # the id alone may repeat: a first use is its source, port, time and id
    same = (
        (F.col("src_ip") == F.col("_src"))
        & F.col("dst_port").eqNullSafe(F.col("_port"))
        & F.col(ts).eqNullSafe(F.col("m.at"))
        & F.col(tie).eqNullSafe(F.col("m.id"))
    )
    flagged = packets.join(numbered, same, "left").drop("_src", "_port", "m")
    out = ordered(flagged, ["src_ip"], [ts, tie], [Running({"ports_seen": F.col("_number")})], max_group_rows)
    return out.drop("_number", POSITION)


def _scan_alerts(packets: DataFrame) -> DataFrame:
    text = F.concat(F.lit("IP probed "), F.col("ports_seen").cast("string"), F.lit(" unique ports"))
    return port_scan(packets).filter("is_scan").select(
        "packet_id", "src_ip", F.lit("PORT_SCAN_DETECTION").alias("alert"), text.alias("details")
    )


def _beacon_alerts(packets: DataFrame) -> DataFrame:
    text = F.concat(F.lit("gap variance "), encode.fixed(F.col("gap_variance"), 2))
    return beacons(packets).filter("is_beacon").select(
        "packet_id", "src_ip", F.lit("BEACON").alias("alert"), text.alias("details")
    )


PacketInspector = Callable[[DataFrame], DataFrame]

PACKET_INSPECTORS: dict[str, PacketInspector] = {"port_scan": _scan_alerts, "beacons": _beacon_alerts}


def packet_findings(packets: DataFrame, inspectors: dict[str, PacketInspector] | None = None) -> DataFrame:
    """Alerts of all packet inspectors: packet_id, src_ip, alert and details, by inspector.

    An inspector is a function from the packet table to its alert rows, so user
    inspectors are distributed like the built-in ones.
    """
    parts = [
        run(packets).select(F.lit(name).alias("inspector"), "packet_id", "src_ip", "alert", "details")
        for name, run in (PACKET_INSPECTORS if inspectors is None else inspectors).items()
    ]
    if not parts:
        raise ValueError("no inspectors")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
