"""Repeatable samples and splits that never rank the whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.operators.blocklist import maybe_broadcast
from flowlake.session import cut_lineage

# Hash slices: 16 ** HEX_DIGITS per stratum.
HEX_DIGITS = 4


def hash_key(columns: Sequence[str], seed: int = 42) -> Column:
    """Stable pseudo-random text key of a row's identity."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def lowest(df: DataFrame, wanted: Column, hash_col: str, strata: Sequence[str] = (), digits: int = HEX_DIGITS) -> DataFrame:
    """Flag ``picked`` on the rows with the ``wanted`` lowest hashes of each stratum, exactly.

    Rows are counted per slice of the hash range. Whole slices below the limit
    are taken and above it left without sorting; only the one slice in which the
    limit falls is ranked. ``wanted`` may use ``stratum_rows``, the stratum size.
    """
    slice_of = F.conv(F.substring(hash_col, 1, digits), 16, 10).cast("int")
    sliced = df.withColumn("_slice", slice_of)
    keys = [F.col(s) for s in strata]
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("n"))
    scope = Window.partitionBy(*keys) if strata else Window.partitionBy(F.lit(0))
    # At most 16 ** digits rows per stratum.
    plan = (
        counts.withColumn("stratum_rows", F.sum("n").over(scope))
        .withColumn("_upto", F.sum("n").over(scope.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_need", wanted)
        .filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("n") < F.col("_need")))
        .select(
            *[F.col(s).alias(f"_of_{s}") for s in strata],
            F.col("_slice").alias("_edge"),
            (F.col("_need") - (F.col("_upto") - F.col("n"))).alias("_rest"),
        )
    )
    # One row per stratum that is cut; strata without a row are taken whole.
    if strata:
        plan = cut_lineage(plan, "strata")
        on = F.lit(True)
        for s in strata:
            on = on & F.col(s).eqNullSafe(F.col(f"_of_{s}"))
        marked = sliced.join(maybe_broadcast(plan), on, "left")
    else:
        edge_row = plan.first()
        edge, rest = (edge_row["_edge"], edge_row["_rest"]) if edge_row else (None, None)
        marked = sliced.withColumns({"_edge": F.lit(edge).cast("int"), "_rest": F.lit(rest).cast("long")})
    at_edge = F.col("_slice") == F.col("_edge")
    rank = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(hash_col))
    settled = marked.filter(~F.coalesce(at_edge, F.lit(False))).withColumn(
        "picked", F.coalesce(F.col("_slice") < F.col("_edge"), F.lit(True))
    )
    edge = marked.filter(at_edge).withColumn("picked", rank <= F.col("_rest"))
    return settled.unionByName(edge).drop("_slice", "_edge", "_rest", *[f"_of_{s}" for s in strata])


def sample_cap(df: DataFrame, rows: int, identity: Sequence[str], seed: int = 42) -> DataFrame:
    """At most ``rows`` rows, the same ones on every run."""
    if rows <= 0:
        raise ValueError("rows must be positive")
    keyed = df.withColumn("_hash", hash_key(identity, seed))
    return lowest(keyed, F.lit(rows), "_hash").filter("picked").drop("picked", "_hash")


def train_test_split(
    df: DataFrame,
    identity: Sequence[str],
    test_share: float = 0.2,
    strata: Sequence[str] = (),
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: test for exactly ceil(share * rows), per stratum when given, else train.

    Below 100 rows the test share is at most 20 rows' worth.
    """
    size = F.col("stratum_rows")
    share = F.lit(test_share)
    if not strata:
        share = F.when(size < 100, F.least(F.lit(0.2), F.lit(20.0) / size)).otherwise(share)
    wanted = F.ceil(F.round(size * share, 9))
    keyed = df.withColumn("_hash", hash_key(identity, seed))
    flagged = lowest(keyed, wanted, "_hash", strata)
    return flagged.withColumn("split", F.when(F.col("picked"), "test").otherwise("train")).drop("picked", "_hash")
