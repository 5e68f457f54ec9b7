"""The blocklist table: matching, upkeep, listing and export.

Entries are keyed by (ip_address, source). Every rule that compares with "now"
takes an explicit ``as_of`` so that a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions import ip
from flowlake.schemas import BLOCKLIST_COLUMNS
from flowlake.session import cut_lineage

# Allowed risk levels.
RISK_LEVELS = ["low", "medium", "high", "critical"]

# A side is broadcast only when its measured row count is below this.
BROADCAST_ROWS = 200_000


def maybe_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a size check; above it the join shuffles (AQE splits skew)."""
    within = small.select(F.lit(1)).limit(limit + 1).count() <= limit
    return F.broadcast(small) if within else small


def in_force(entries: DataFrame, as_of: Column) -> DataFrame:
    """Active, unexpired entries, one row per address."""
    live = entries.filter(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") >= as_of)))
    rank = F.struct(F.col("created_at").alias("a"), F.col("source").alias("b"), F.col("risk_level").alias("c"))
    return live.groupBy("ip_address").agg(
        F.max_by("risk_level", rank).alias("block_risk"), F.max_by("source", rank).alias("block_source")
    )


def blocklist_match(flows: DataFrame, entries: DataFrame, as_of: Column, src: str = "src_ip", dst: str = "dst_ip") -> DataFrame:
    """Mark flows whose source, else destination, is on the blocklist.

    Adds blocked_ip, blocked_side, block_risk and block_source (NULL when clear).
    """
    # Counted once and joined twice: aggregated once and kept as a table.
    live = maybe_broadcast(cut_lineage(in_force(entries, as_of), "in-force"))

    def side(name: str) -> DataFrame:
        return live.select(
            F.col("ip_address").alias(f"_{name}_ip"),
            F.col("block_risk").alias(f"_{name}_risk"),
            F.col("block_source").alias(f"_{name}_from"),
        )

    hit = (
        flows.join(side("src"), F.col(src) == F.col("_src_ip"), "left")
        .join(side("dst"), F.col(dst) == F.col("_dst_ip"), "left")
    )
    return hit.withColumns(
        {
            "blocked_ip": F.coalesce("_src_ip", "_dst_ip"),
            "blocked_side": F.when(F.col("_src_ip").isNotNull(), "src").when(F.col("_dst_ip").isNotNull(), "dst"),
            "block_risk": F.coalesce("_src_risk", "_dst_risk"),
            "block_source": F.coalesce("_src_from", "_dst_from"),
        }
    ).drop("_src_ip", "_src_risk", "_src_from", "_dst_ip", "_dst_risk", "_dst_from")


def trusted_suppression(flows: DataFrame, trusted: DataFrame) -> DataFrame:
    """Drop flows with a trusted address on either side."""
    good = maybe_broadcast(trusted.select(F.col("ip").alias("_trusted")).distinct())
    return flows.join(good, F.col("src_ip") == F.col("_trusted"), "left_anti").join(
        good, F.col("dst_ip") == F.col("_trusted"), "left_anti"
    )


def packet_drop(packets: DataFrame, blocked: DataFrame) -> DataFrame:
    """Packets of blocked sources leave before any other work."""
    bad = maybe_broadcast(blocked.select(F.col("ip_address").alias("_blocked")).distinct())
    return packets.join(bad, F.col("src_ip") == F.col("_blocked"), "left_anti")


def hit_counts(matched: DataFrame, ts: str = "ts") -> DataFrame:
    """Hits per blocked address and the time of the last one."""
    return (
        matched.filter(F.col("blocked_ip").isNotNull())
        .groupBy(F.col("blocked_ip").alias("ip_address"))
        .agg(F.count(F.lit(1)).alias("hits"), F.max(ts).alias("last_hit"))
    )


def hit_count_merge(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """Add hit counts to every entry of an address and move its last_seen forward."""
    return (
        entries.join(hits, "ip_address", "left")
        .withColumns(
            {
                "hit_count": F.col("hit_count") + F.coalesce("hits", F.lit(0)),
                "last_seen": F.greatest("last_hit", "last_seen"),
            }
        )
        .drop("hits", "last_hit")
        .select(*entries.columns)
    )


def upsert(entries: DataFrame, incoming: DataFrame, as_of: Column, salt: str | bytes | None = None) -> DataFrame:
    """Insert or replace by (address, source); the last incoming row of a key wins.

    ``incoming`` has ip_address, reason, source, risk_level, ttl_hours, metadata
    and ``seq`` (arrival order). Rows with an invalid address or risk level are
    rejected. A replaced entry starts over: hit count zero and a new creation time.
    """
    valid = incoming.filter(ip.valid_ip(F.col("ip_address")) & F.col("risk_level").isin(RISK_LEVELS))
    address = F.col("ip_address") if salt is None else ip.hash_ip_lenient(F.col("ip_address"), salt)
    ttl = F.when(F.col("ttl_hours") > 0, F.timestamp_micros(F.unix_micros(as_of) + F.col("ttl_hours") * 3_600_000_000))
    fresh = valid.select(
        address.alias("ip_address"),
        "reason",
        "source",
        "risk_level",
        as_of.alias("created_at"),
        ttl.alias("expires_at"),
        F.lit(True).alias("is_active"),
        F.lit("none").alias("enforcement_action"),
        F.lit(0).cast("long").alias("hit_count"),
        as_of.alias("last_seen"),
        "metadata",
        F.col("seq").cast("long").alias("_seq"),
    )
    body = [c for c in BLOCKLIST_COLUMNS if c not in ("ip_address", "source")]
    both = fresh.unionByName(entries.select(*BLOCKLIST_COLUMNS, F.lit(-1).cast("long").alias("_seq")))
    # Latest-wins as an aggregate: combined before the shuffle, however often one address repeats.
    return (
        both.groupBy("ip_address", "source")
        .agg(F.max_by(F.struct(*body), "_seq").alias("_row"))
        .select("ip_address", "source", "_row.*")
        .select(*BLOCKLIST_COLUMNS)
    )


def deactivate(entries: DataFrame, removals: DataFrame) -> DataFrame:
    """Soft-delete entries named by (ip_address, source)."""
    gone = removals.select(F.col("ip_address").alias("_ip"), F.col("source").alias("_src")).distinct()
    hit = entries.join(
        maybe_broadcast(gone), (F.col("ip_address") == F.col("_ip")) & (F.col("source") == F.col("_src")), "left"
    )
    return hit.withColumn("is_active", F.col("is_active") & F.col("_ip").isNull()).select(*entries.columns)


def expire(entries: DataFrame, as_of: Column) -> DataFrame:
    """Deactivate entries past their expiry; NULL expiry never ends."""
    over = F.coalesce(F.col("expires_at") < as_of, F.lit(False))
    return entries.withColumn("is_active", F.col("is_active") & ~over)


def expired_count(entries: DataFrame, as_of: Column) -> DataFrame:
    return entries.agg(
        F.count_if(F.col("is_active") & (F.col("expires_at") < as_of)).alias("cleaned")
    )


def stats(entries: DataFrame, as_of: Column) -> DataFrame:
    ended = ~F.col("is_active") & (F.col("expires_at") < as_of)
    return entries.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if("is_active").alias("active_entries"),
        F.count_if(ended).alias("expired_entries"),
    )


def listing(
    entries: DataFrame,
    active_only: bool = True,
    risk_level: str | None = None,
    source: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Entries newest first, optionally filtered; address and source break ties."""
    out = entries.select(*BLOCKLIST_COLUMNS)
    if active_only:
        out = out.filter("is_active")
    if risk_level:
        out = out.filter(F.col("risk_level") == risk_level)
    if source:
        out = out.filter(F.col("source") == source)
    out = out.orderBy(F.col("created_at").desc(), "ip_address", "source")
    return out.limit(limit) if limit else out


def recent_blocks(entries: DataFrame, count: int = 15) -> DataFrame:
    return listing(entries, limit=count).select(
        "ip_address", "reason", "risk_level", "source", "created_at", "hit_count"
    )


def export_json(entries: DataFrame, as_of: Column, limit: int = 10_000) -> DataFrame:
    """One JSON document of the newest entries with totals; ``limit`` bounds the document.

    Entries stand newest first, then by address and source, as they are cut; fields without a value are null.
    """
    top = listing(entries, active_only=False, limit=limit)
    age = F.coalesce(-F.unix_micros("created_at"), F.lit(2**63 - 1))
    rows = F.collect_list(F.struct(F.struct(age, F.col("ip_address"), F.col("source")).alias("k"), F.struct(*BLOCKLIST_COLUMNS).alias("e")))
    newest_first = F.transform(F.array_sort(rows), lambda r: r["e"])
    doc = F.struct(
        as_of.alias("export_timestamp"),
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if("is_active").alias("active_entries"),
        newest_first.alias("entries"),
    )
    return top.agg(doc.alias("d")).select(
        F.col("d.total_entries").alias("total_entries"),
        F.col("d.active_entries").alias("active_entries"),
        F.to_json("d", {"ignoreNullFields": "false"}).alias("document"),
    )


def trust_add(trusted: DataFrame, reported: DataFrame, as_of: Column) -> DataFrame:
    """Append reported addresses that are not trusted yet; reporting twice changes nothing."""
    fresh = (
        reported.groupBy("ip")
        .agg(F.min("reason").alias("reason"))
        .join(trusted.select("ip"), "ip", "left_anti")
        .select("ip", "reason", as_of.alias("timestamp"), F.lit("active").alias("status"))
    )
    return trusted.select("ip", "reason", "timestamp", "status").unionByName(fresh)
