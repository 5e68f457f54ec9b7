"""Schema harmonisation, cleaning and feature columns of flow tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions import encode, ip
from flowlake.schemas import DOUBLE_COLUMNS, LONG_COLUMNS, NUMERIC_COLUMNS

# Texts that stand for a missing value in flow files.
NULL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

ESSENTIAL = ["src_ip", "dst_ip", "bytes_in", "bytes_out"]

# Target column, the columns it may be taken from in order, and a default (None: leave it out).
HARMONISE_RULES = [
    ("src_ip", ["src_ip_anon"], None),
    ("dst_ip", ["dst_ip_anon"], None),
    ("duration", ["duration_seconds"], None),
    ("bytes_in", ["src_flow_bytes", "byte_count"], 0),
    ("bytes_out", ["dst_flow_bytes"], 0),
    ("packets_in", ["src_flow_packets", "packet_count"], 0),
    ("packets_out", ["dst_flow_packets"], 0),
]


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def null_texts(df: DataFrame) -> DataFrame:
    """Strings that mean "missing" become NULL."""
    return df.select(
        *[
            F.when(~F.col(c).isin(NULL_TEXTS), F.col(c)).alias(c) if t == "string" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def type_flow_columns(df: DataFrame) -> DataFrame:
    """Cast the known columns of both flow schemas; text that is no number becomes NULL."""
    casts = {c: F.expr(f"try_cast(`{c}` AS bigint)") for c in LONG_COLUMNS if c in df.columns}
    casts.update({c: F.expr(f"try_cast(`{c}` AS double)") for c in DOUBLE_COLUMNS if c in df.columns})
    return df.withColumns(casts)


def harmonise_schema(df: DataFrame) -> DataFrame:
    """Give a window-schema table the flow-schema columns, chosen by column presence."""
    added = {}
    for target, sources, default in HARMONISE_RULES:
        if target in df.columns:
            continue
        found = next((s for s in sources if s in df.columns), None)
        if found:
            added[target] = F.col(found)
        elif default is not None:
            added[target] = F.lit(default)
    return df.withColumns(added)


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop("any", subset=[c for c in ESSENTIAL if c in df.columns])


def coerce_numeric(df: DataFrame, columns: Iterable[str] = NUMERIC_COLUMNS) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns(
        {c: F.coalesce(F.nanvl(F.expr(f"try_cast(`{c}` AS double)"), F.lit(0.0)), F.lit(0.0)) for c in present}
    )


def coerce_timestamp(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Parse ``timestamp``, else ``window_start``, else the load time; drop what does not parse."""
    source = next((c for c in ("timestamp", "window_start") if c in df.columns), None)
    if source is None:
        return df.withColumn("timestamp", F.current_timestamp() if now is None else now)
    parsed = F.expr(f"try_cast(`{source}` AS timestamp)")
    return df.withColumn("timestamp", parsed).filter(F.col("timestamp").isNotNull())


def clean_flows(df: DataFrame, salt: str | bytes | None = None) -> DataFrame:
    """The full cleaning chain of the scoring path: one projection and one filter."""
    out = coerce_timestamp(coerce_numeric(drop_incomplete(harmonise_schema(df))))
    if salt is not None:
        out = out.withColumns(
            {f"{side}_hash": ip.hash_ip_lenient(F.col(side), salt) for side in ("src_ip", "dst_ip") if side in out.columns}
        )
    return out


def training_row_filter(df: DataFrame) -> DataFrame:
    return df.na.drop("any").filter((F.col("bytes_in") >= 0) & (F.col("bytes_out") >= 0))


def combine_flows(frames: list[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("no valid flow data")
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def dedup_flows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_report(df: DataFrame) -> DataFrame:
    """Rows before and after exact de-duplication, from one grouped pass."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("initial_rows"),
        F.count(F.lit(1)).alias("final_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates_removed"),
    )


def select_features(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Model input: the named columns as doubles, missing and non-finite values zero."""
    names = list(columns)
    require_columns(df, names)
    return df.select(
        *[encode.finite_or_zero(F.expr(f"try_cast(`{c}` AS double)")).alias(c) for c in names]
    )


def prepare_features(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Training matrix: protocol encoded, ports made positive."""
    names = list(columns)
    require_columns(df, names)
    kinds = dict(df.dtypes)
    out = []
    for c in names:
        col = F.col(c)
        if c == "protocol" and kinds[c] == "string":
            col = encode.encode_protocol_training(col)
        elif c in ("src_port", "dst_port"):
            col = F.abs(col)
        out.append(col.alias(c))
    return df.select(*keep, *out)


def log_transform(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Replace each listed column by ``<name>_log`` = log(1 + x), appended at the end."""
    present = [c for c in columns if c in df.columns]
    rest = [c for c in df.columns if c not in present]
    return df.select(*rest, *[F.log1p(F.col(c).cast("double")).alias(f"{c}_log") for c in present])


def intrusion_features_min(df: DataFrame) -> DataFrame:
    def number(name: str) -> Column:
        return F.coalesce(F.expr(f"try_cast(`{name}` AS double)"), F.lit(0.0))

    total = number("src_bytes") + number("dst_bytes")
    return df.withColumns(
        {
            "packet_count": number("count"),
            "byte_count": total,
            "duration_seconds": number("duration"),
            "rate_bps": total / F.greatest(number("duration"), F.lit(1e-3)),
            "is_attack": (F.lower(F.coalesce(F.col("label"), F.lit("nan"))) != "normal").cast("int"),
        }
    )


def intrusion_features_full(df: DataFrame) -> DataFrame:
    def number(name: str) -> Column:
        return F.coalesce(F.expr(f"try_cast(`{name}` AS double)"), F.lit(0.0))

    total = number("src_bytes") + number("dst_bytes")
    duration = F.greatest(number("duration"), F.lit(0.1))
    proto = F.coalesce(F.col("protocol_type"), F.lit(""))
    return df.withColumns(
        {
            "byte_count": total,
            "packet_count": F.greatest(total / 536.0, F.lit(1.0)).cast("long"),
            "duration": duration,
            "rate": encode.finite_or_zero(total / duration),
            "protocol_type_TCP": (proto == "tcp").cast("int"),
            "protocol_type_UDP": (proto == "udp").cast("int"),
            "protocol_type_ICMP": (proto == "icmp").cast("int"),
        }
    )


def label_attacks(df: DataFrame) -> DataFrame:
    label = F.coalesce(F.col("label"), F.lit(""))
    return df.withColumns(
        {"is_attack": (label != "normal").cast("int"), "attack_category": encode.attack_category(F.col("label"))}
    )


def binary_payload_label(df: DataFrame) -> DataFrame:
    """benign is 0 and everything else 1; rows without payload cannot be trained on."""
    label = F.coalesce(F.col("label"), F.lit("benign"))
    return df.filter(F.col("payload").isNotNull()).withColumn("y", F.when(label == "benign", 0).otherwise(1))


def feature_envelope(df: DataFrame, observed_at: str, source: str, features: Iterable[str], version: int = 1) -> DataFrame:
    """Versioned record: schema version, UTC ISO time, source and open features."""
    pairs = [x for c in features for x in (F.lit(c), F.col(c).cast("string"))]
    iso = F.date_format(F.col(observed_at), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return df.select(
        F.lit(version).alias("schema_version"),
        iso.alias("observed_at"),
        F.lit(source).alias("source"),
        F.create_map(*pairs).alias("features"),
    )
