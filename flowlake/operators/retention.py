"""Retention: counting, purging and proving the deletion of old rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIT_MINIMUM_HOURS = 90 * 24


def _cutoff(as_of: Column, hours: int) -> Column:
    return F.timestamp_micros(F.unix_micros(as_of) - F.lit(hours * 3_600_000_000))


def audit_hours(hours: int) -> int:
    """Audit rows are kept at least 90 days."""
    return max(hours // 24 * 24, AUDIT_MINIMUM_HOURS)


def purge(df: DataFrame, ts: str, as_of: Column, hours: int) -> DataFrame:
    """Rows that stay. The caller writes them back, by partition where the table has dates."""
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= _cutoff(as_of, hours)))


def purge_proof(tables: dict[str, tuple[DataFrame, str]], as_of: Column, hours: int) -> DataFrame:
    """One proof row per table with something to delete: counts and a digest of the act."""
    proofs = None
    for name, (df, ts) in tables.items():
        age = audit_hours(hours) if name.startswith("audit") else hours
        text = F.concat(F.lit(f"{name}{ts}{age}"), F.date_format(as_of, "yyyy-MM-dd HH:mm:ss"))
        row = df.agg(
            F.lit(name).alias("table_name"),
            F.lit(ts).alias("timestamp_column"),
            F.lit(age).alias("age_threshold_hours"),
            F.count(F.lit(1)).alias("rows_before"),
            F.count_if(F.col(ts) < _cutoff(as_of, age)).alias("records_deleted"),
            F.sha2(F.min(text), 256).alias("deletion_hash"),
        )
        proofs = row if proofs is None else proofs.unionByName(row)
    if proofs is None:
        raise ValueError("no tables")
    return proofs.filter("records_deleted > 0")


def retention_check(df: DataFrame, ts: str, as_of: Column, hours: int = 24) -> DataFrame:
    late = F.count_if(F.col(ts) < _cutoff(as_of, hours))
    return df.agg(late.alias("old_rows"), (late == 0).alias("passed"))
