"""From scores to decisions: routing, verdicts, enforcement and policy events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions import encode, ip
from flowlake.operators import blocklist

CLEAR_THRESHOLD = -0.2
CRITICAL_THRESHOLD = -0.7


def route_rules(
    score: Column,
    mean_score: Column,
    flow_count: Column,
    has_payload: Column,
    clear: float = CLEAR_THRESHOLD,
    critical: float = CRITICAL_THRESHOLD,
) -> Column:
    """Rule-based path and confidence, before the payload downgrade."""

    def to(path: str, confidence: float) -> Column:
        return F.struct(F.lit(path).alias("path"), F.lit(confidence).alias("confidence"))

    known_good = (flow_count > 20) & (F.coalesce(mean_score, F.lit(float("-inf"))) > clear)
    return (
        F.when(known_good & (score > clear), to("pass", 0.75))
        .when(score > clear, to("if_only", 0.80))
        .when(score <= critical, to("escalate", 0.90))
        .when(has_payload, to("escalate", 0.65))
        .otherwise(to("if_only", 0.60))
    )


def route_downgrade(route: Column, has_payload: Column) -> Column:
    """Deep inspection without payload is pointless: fall back with less confidence."""
    pointless = (route["path"] == "escalate") & ~has_payload
    return F.struct(
        F.when(pointless, "if_only").otherwise(route["path"]).alias("path"),
        F.when(pointless, route["confidence"] * 0.8).otherwise(route["confidence"]).alias("confidence"),
    )


def route_flows(
    features: DataFrame,
    score: str = "if_score",
    payload_available: str = "payload_available",
    flow_count: str = "ip_flow_count",
) -> DataFrame:
    """Add path, confidence, used_fallback, needs_if and needs_cnn by the rules."""
    has_payload = F.coalesce(F.col(payload_available).cast("boolean"), F.lit(False))
    route = route_rules(F.col(score), F.col("mean_score"), F.col(flow_count), has_payload)
    return _decision_columns(features.withColumn("_route", route_downgrade(route, has_payload)), F.lit(True))


def _decision_columns(routed: DataFrame, fallback: Column) -> DataFrame:
    path = F.col("_route.path")
    return routed.withColumns(
        {
            "path": path,
            "confidence": F.col("_route.confidence"),
            "used_fallback": fallback,
            "needs_cnn": path == "escalate",
            "needs_if": path.isin("if_only", "escalate"),
        }
    ).drop("_route")


def verdict_merge(
    flows: DataFrame,
    prediction: str = "prediction",
    payload_score: str = "payload_score",
    suppress: float = 0.30,
    confirm: float = 0.65,
) -> DataFrame:
    """Combine routing and payload score into the final prediction and the skip flag."""
    escalated, score = F.col("path") == "escalate", F.coalesce(F.col(payload_score), F.lit(0.0))
    quiet = (F.col("path") == "pass") | (escalated & (score < suppress))
    merged = F.when(quiet, 1).when(escalated & (score >= confirm), -1).otherwise(F.col(prediction))
    return flows.withColumns({prediction: merged, "skip_enforcement": F.coalesce(quiet, F.lit(False))})


def top_deviations(values: dict[str, Column], stats: dict[str, tuple[float, float]], top: int = 3) -> Column:
    """Text of the features deviating most from their training mean, largest first.

    Equal deviations keep feature order.
    """
    entries = []
    for index, (name, (mean, scale)) in enumerate(stats.items()):
        value = encode.finite_or_zero(values[name])
        z = F.lit(0.0) if scale == 0 else (value - mean) / scale
        entries.append(F.struct((-F.abs(z)).alias("rank"), F.lit(index).alias("index"), F.lit(name).alias("name"), z.alias("z")))
    best = F.slice(F.array_sort(F.array(*entries)), 1, top)
    texts = F.transform(
        best,
        lambda e: F.concat(e["name"], F.lit(" ("), F.when(e["z"] >= 0, "+").otherwise(""), encode.fixed(e["z"], 1), F.lit("σ)")),
    )
    return F.array_join(texts, ", ")


def enforcement(
    flows: DataFrame,
    entries: DataFrame,
    trusted: DataFrame,
    as_of: Column,
    score: str = "anomaly_score",
    explanation: str = "explanation",
    salt: str | bytes | None = None,
) -> DataFrame:
    """Flows that call for action, with the reason; a blocklist hit outranks the anomaly.

    With a ``salt`` the blocklist holds hashed addresses, and flows are looked up by their hash.
    """
    open_flows = blocklist.trusted_suppression(flows.filter(~F.col("skip_enforcement")), trusted)
    if salt is None:
        matched = blocklist.blocklist_match(open_flows, entries, as_of)
    else:
        plain = {"_plain_src": F.col("src_ip"), "_plain_dst": F.col("dst_ip")}
        hashed = {c: ip.hash_ip_lenient(F.col(c), salt) for c in ("src_ip", "dst_ip")}
        matched = blocklist.blocklist_match(open_flows.withColumns(plain).withColumns(hashed), entries, as_of)
        matched = matched.withColumns({"src_ip": F.col("_plain_src"), "dst_ip": F.col("_plain_dst")}).drop(*plain)
    anomaly = F.col("prediction") == -1
    high = F.col("risk_level").isin("high", "critical")
    number = encode.fixed(F.col(score), 3)
    why = F.coalesce(F.col(explanation), F.lit("unknown_anomaly"))
    reason = (
        F.when(F.col("blocked_side") == "src", F.concat(F.lit("Source IP "), F.col("src_ip"), F.lit(" is blacklisted")))
        .when(F.col("blocked_side") == "dst", F.concat(F.lit("Destination IP "), F.col("dst_ip"), F.lit(" is blacklisted")))
        .when(
            anomaly & high,
            F.concat(F.lit("High-risk anomaly: "), why, F.lit(" (score: "), number, F.lit(", risk: "), F.col("risk_level"), F.lit(")")),
        )
        .when(anomaly, F.concat(F.lit("Anomaly detected: "), why, F.lit(" (score: "), number, F.lit(")")))
    )
    return matched.filter(anomaly | F.col("blocked_ip").isNotNull()).withColumn("action_reason", reason)


def to_blocklist(
    actions: DataFrame, order: Sequence[str], score: str = "anomaly_score", source_file: Column | None = None
) -> DataFrame:
    """One blocklist insertion per offending source: its last action wins.

    ``order`` decides "last" and must be unique. An aggregate, so a source with
    very many actions is combined before the shuffle.
    """
    details = F.struct("dst_ip", "src_port", "dst_port", "protocol", "bytes_in", "bytes_out")
    metadata = F.to_json(
        F.struct(
            (F.lit(None).cast("string") if source_file is None else source_file).alias("csv_file"),
            F.col(score).alias("prediction_score"),
            details.alias("flow_details"),
        )
    )
    row = F.struct(
        F.concat(F.lit("prediction: "), F.col("action_reason")).alias("reason"),
        F.col("risk_level").alias("risk_level"),
        metadata.alias("metadata"),
    )
    return (
        actions.groupBy(F.col("src_ip").alias("ip_address"))
        .agg(F.max_by(row, F.struct(*order)).alias("r"), F.count(F.lit(1)).alias("seq"))
        .select(
            "ip_address",
            "r.reason",
            F.lit("prediction").alias("source"),
            "r.risk_level",
            F.lit(None).cast("int").alias("ttl_hours"),
            "r.metadata",
            "seq",
        )
    )


def policy_decisions(packets: DataFrame, payload: str = "payload") -> DataFrame:
    """Application, risk score, tier and action text for each packet."""
    app = encode.identify_app(F.col("src_port"), F.col("dst_port"), F.col(payload).cast("binary"))
    return packets.withColumn("app_id", app).withColumn("confidence_score", encode.app_risk_score(F.col("app_id"))).withColumns(
        {
            "policy_tier": encode.policy_tier(F.col("confidence_score")),
            "action": encode.policy_action(F.col("confidence_score"), F.col("src_ip"), F.col("app_id")),
            "reason": F.concat(F.lit("Detected protocol "), F.col("app_id")),
        }
    )


def security_events(decisions: DataFrame) -> DataFrame:
    """The decision as one JSON message in a ``value`` column, keyed by source."""
    body = F.struct(
        "src_ip", "app_id", "confidence_score", F.col("policy_tier").alias("risk_level"), "action", "reason"
    )
    return decisions.select(F.col("src_ip").alias("key"), F.to_json(body).alias("value"))


def router_label(if_verdict: Column, payload_verdict: Column, threshold: float = 0.65) -> Column:
    """Training label of a past decision: 0 pass, 1 first model suffices, 2 escalation was worth it."""
    payload_attack, flow_attack = payload_verdict >= threshold, if_verdict == -1
    return (
        F.when(payload_verdict.isNull(), 1)
        .when(~flow_attack & ~payload_attack, 0)
        .when(flow_attack == payload_attack, 1)
        .otherwise(2)
    )


def rule_label(df: DataFrame) -> Column:
    """Label the routing rules would give a feature row."""
    score = F.col("if_score")
    good = (
        (F.col("ip_seen_before") == 1) & (F.col("ip_flow_count") > 20) & (F.col("ip_score_delta") > -0.2) & (score > -0.2)
    )
    return (
        F.when(good, 0)
        .when(score > -0.2, 1)
        .when(score <= -0.7, 2)
        .when(F.col("payload_available") == 1, 2)
        .otherwise(1)
    )
