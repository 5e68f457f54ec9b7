"""Ordered per-key computations that stay parallel when one key is hot.

A plain window partitioned by a source puts all rows of that source into one
task. ``ordered`` measures the largest group first. While it fits a task, the
plain window is used: one shuffle, one sort. Beyond that, the table is range
partitioned on (keys, order) so a hot key spreads over many partitions, each
row gets its exact position within its key, and positions are cut into equal
chunks. A chunk carries copies of the rows just before it, enough for the
bounded frame, so every frame sees exactly the rows it would have seen in one
big group. The copies are dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from flowlake.session import cut_lineage

# Rows of one key a single task sorts without strain; also the chunk length beyond it.
MAX_GROUP_ROWS = 2_000_000

POSITION = "_position"


@dataclass(frozen=True)
class Stage:
    """Columns computed over bounded frames that reach back at most ``lookback`` rows."""

    columns: Callable[[WindowSpec], dict[str, Column]]
    lookback: int


@dataclass(frozen=True)
class Running:
    """Running aggregates from the start of the key, over earlier columns of the row.

    ``how`` is max, min or sum; ``exclusive`` leaves the current row out. Bounded
    stages come before running ones: a copied row has no running value.
    """

    columns: dict[str, Column] = field(default_factory=dict)
    how: str = "max"
    exclusive: bool = False

    def aggregate(self, value: Column) -> Column:
        return {"max": F.max, "min": F.min, "sum": F.sum}[self.how](value)

    def merge(self, left: Column, right: Column) -> Column:
        """Combine two partial results, either of which may be NULL."""
        if self.how == "sum":
            return F.coalesce(left + right, left, right)
        return (F.greatest if self.how == "max" else F.least)(left, right)

    def frame(self, spec: WindowSpec) -> WindowSpec:
        return spec.rowsBetween(Window.unboundedPreceding, -1 if self.exclusive else 0)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest key: one partial-aggregated scan of the key columns."""
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return int(top or 0)


def _same_key(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)])


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add the exact 1-based position of each row within its key, whatever the key's size.

    ``order`` must be unique within a key. Partition numbers come from sampled
    range bounds, so they are written out before anything is derived from them.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *keys, *order).withColumn("_part", F.spark_partition_id())
    stored = cut_lineage(ranged, "ranged")
    counts = stored.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first key of a partition can have rows in earlier partitions, so
    # this table has at most one row per partition and is safe to broadcast.
    carried = (
        counts.withColumn("_before", F.sum("_rows").over(earlier))
        .filter("_before IS NOT NULL")
        .select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_in_part"), "_before")
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    joined = stored.withColumn("_local", local).join(
        F.broadcast(carried),
        (F.col("_part") == F.col("_in_part"))
        & _same_key([F.col(k) for k in keys], [F.col(f"_key_{k}") for k in keys]),
        "left",
    )
    position = (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long")
    return joined.select(*df.columns, position.alias(POSITION))


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    stages: Sequence[Stage | Running],
    max_group_rows: int = MAX_GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Apply the stages in order; adds ``_position`` and every stage column.

    ``largest`` is the row count of the biggest key, if it is known.
    """
    if (largest_group(df, keys) if largest is None else largest) <= max_group_rows:
        spec = Window.partitionBy(*keys).orderBy(*order)
        out = df.withColumn(POSITION, F.row_number().over(spec).cast("long"))
        for stage in stages:
            if isinstance(stage, Stage):
                out = out.withColumns(stage.columns(spec))
            else:
                frame = stage.frame(spec)
                out = out.withColumns({n: stage.aggregate(c).over(frame) for n, c in stage.columns.items()})
        return out

    reach = sum(s.lookback for s in stages if isinstance(s, Stage))
    if reach >= max_group_rows:
        raise ValueError("chunks must be longer than the frames reach back")
    offset = (F.col(POSITION) - 1) % max_group_rows
    home = F.floor((F.col(POSITION) - 1) / max_group_rows)
    copies = F.when(offset >= max_group_rows - reach, F.array(home, home + 1)).otherwise(F.array(home))
    out = positions(df, keys, order).withColumn("_chunk", F.explode(copies))
    out = out.withColumn("_copy", F.col("_chunk") != home)
    chunked = [*keys, "_chunk"]
    spec = Window.partitionBy(*chunked).orderBy(POSITION)
    for stage in stages:
        if isinstance(stage, Stage):
            out = out.withColumns(stage.columns(spec))
            continue
        for name, expr in stage.columns.items():
            value = F.when(~F.col("_copy"), expr)
            out = out.withColumn(f"_own_{name}", value)
            out = out.withColumn(f"_seen_{name}", stage.aggregate(F.col(f"_own_{name}")).over(stage.frame(spec)))
            # One row per chunk: what each chunk adds, and what the chunks before it add up to.
            earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
            ends = (
                out.groupBy(*chunked)
                .agg(stage.aggregate(F.col(f"_own_{name}")).alias("_end"))
                .withColumn("_carry", stage.aggregate(F.col("_end")).over(earlier))
                .select(*[F.col(k).alias(f"_key_{k}") for k in chunked], "_carry")
            )
            matched = out.join(
                ends, _same_key([F.col(k) for k in chunked], [F.col(f"_key_{k}") for k in chunked]), "left"
            )
            out = matched.withColumn(name, stage.merge(F.col(f"_seen_{name}"), F.col("_carry"))).drop(
                f"_own_{name}", f"_seen_{name}", "_carry", *[f"_key_{k}" for k in chunked]
            )
    return out.filter(~F.col("_copy")).drop("_chunk", "_copy")
