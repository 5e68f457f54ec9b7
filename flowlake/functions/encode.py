"""Small scalar rules: codes, tiers, rounding and clock features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numeric protocol codes of the two encodings.
TRAINING_PROTOCOLS = {"TCP": 1, "UDP": 2, "ICMP": 3, "IGMP": 4, "OTHER": 5}
SERVING_PROTOCOLS = {"TCP": 1, "UDP": 2, "ICMP": 3}

# Application risk and service ports.
APP_RISK = {"BitTorrent": 96, "SSH": 85, "Unknown": 70, "HTTP": 50, "TLS": 10}

# Attack names per category.
ATTACK_CATEGORIES = {
    "DoS": ["back", "land", "neptune", "pod", "smurf", "teardrop"],
    "Probe": ["ipsweep", "nmap", "portsweep", "satan"],
    "R2L": ["ftp_write", "guess_passwd", "imap", "multihop", "phf", "spy", "warezclient", "warezmaster"],
    "U2R": ["buffer_overflow", "loadmodule", "perl", "rootkit"],
}


def lookup(key: Column, table: dict, default) -> Column:
    """Literal map lookup with a default for unknown and NULL keys."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, exact ties to even, without separators."""
    return F.regexp_replace(F.format_number(value, digits), ",", "")


def rounded(value: Column, digits: int) -> Column:
    """Number rounded by its exact binary value, exact ties to even; infinities and NaN stay."""
    number = value.cast("double")
    finite = F.abs(number) < float("inf")
    return F.when(finite, fixed(F.when(finite, value), digits).cast("double")).otherwise(number)


def protocol_name(number: Column) -> Column:
    return lookup(number.cast("int"), {6: "TCP", 17: "UDP", 1: "ICMP"}, "OTHER")


def encode_protocol_training(name: Column) -> Column:
    return lookup(name, TRAINING_PROTOCOLS, 5)


def encode_protocol_serving(name: Column) -> Column:
    return lookup(name, SERVING_PROTOCOLS, 0)


def encode_protocol_router(name: Column) -> Column:
    return lookup(F.upper(name), SERVING_PROTOCOLS, 0)


def risk_level(score: Column, high: float = 0.7, critical: float = 0.9) -> Column:
    """Tier of the magnitude of a score; strongly normal scores rank high as well."""
    size = F.abs(score)
    return (
        F.when(size >= critical, "critical")
        .when(size >= high, "high")
        .when(size >= high * 0.5, "medium")
        .otherwise("low")
    )


def identify_app(src_port: Column, dst_port: Column, payload: Column) -> Column:
    """Application by service port on either side, then by the first payload bytes."""

    def either(test) -> Column:
        return F.coalesce(test(src_port), F.lit(False)) | F.coalesce(test(dst_port), F.lit(False))

    long_enough = F.octet_length(payload) >= 3
    head = F.hex(F.substring(payload, 1, 3))
    return (
        F.when(either(lambda p: p == 22), "SSH")
        .when(either(lambda p: p == 443), "TLS")
        .when(either(lambda p: p == 80), "HTTP")
        .when(either(lambda p: p.between(6881, 6889)), "BitTorrent")
        .when(long_enough & head.startswith("1603"), "TLS")
        .when(long_enough & (head == "474554"), "HTTP")
        .otherwise("Unknown")
    )


def app_risk_score(app: Column) -> Column:
    return lookup(app, APP_RISK, APP_RISK["Unknown"])


def policy_tier(score: Column) -> Column:
    return F.when(score > 95, "Isolate").when(score >= 80, "Throttle").otherwise("Monitor")


def policy_action(score: Column, ip: Column, app: Column) -> Column:
    # The wording of the actions.
    return (
        F.when(score > 95, F.concat(F.lit("Blocking IP "), ip, F.lit(" due to high risk app "), app))
        .when(score >= 80, F.concat(F.lit("Throttling IP "), ip, F.lit(" due to suspicious app "), app))
        .otherwise(F.concat(F.lit("Monitoring IP "), ip, F.lit(" - App "), app))
    )


def attack_category(label: Column) -> Column:
    table = {"normal": "Normal"}
    table.update({name: group for group, names in ATTACK_CATEGORIES.items() for name in names})
    return lookup(label, table, "Other")


def round_epoch(seconds: Column, resolution: int, mode: str = "floor") -> Column:
    """Epoch seconds on a fixed grid; "nearest" rounds halves to even."""
    if resolution <= 0:
        raise ValueError("resolution must be positive")
    steps = seconds.cast("double") / F.lit(float(resolution))
    if mode == "floor":
        whole = F.floor(steps)
    elif mode == "nearest":
        whole = F.rint(steps)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return whole.cast("long") * resolution


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def round_timestamp(ts: Column, resolution: int, mode: str = "floor") -> Column:
    return F.timestamp_seconds(round_epoch(epoch_seconds(ts), resolution, mode))


def estimate_packets(size: Column, mtu: int = 1500) -> Column:
    """Packets needed for ``size`` bytes, at least one."""
    return F.greatest(F.ceil(size / F.lit(float(mtu))), F.lit(1)).cast("long")


def clock_features(ts: Column, startup: Column, boot_seconds: int = 120) -> dict[str, Column]:
    hour, day = F.hour(ts), F.weekday(ts)
    return {
        "hour_of_day": hour,
        "day_of_week": day,
        "is_night": (hour < 6).cast("int"),
        "is_business_hours": (hour.between(8, 17) & (day < 5)).cast("int"),
        "in_boot_window": (epoch_seconds(ts) - epoch_seconds(startup) < boot_seconds).cast("int"),
    }


def finite_or_zero(value: Column) -> Column:
    number = value.cast("double")
    bad = F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(number.isNull() | bad, 0.0).otherwise(number)
