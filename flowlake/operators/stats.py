"""Exact order statistics and scaling over tables of any size.

NULL and NaN have no place in an order: quantiles leave them out, on every path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.session import cut_lineage

# Up to this many rows the built-in exact percentile keeps its value table in memory.
IN_MEMORY_ROWS = 5_000_000
# Slices of the value range that running sums are computed in, in parallel.
SLICES = 256
# Rank error, as a share of the rows, of the sketch that brackets a wanted rank.
SKETCH_ERROR = 0.001


def running_totals(df: DataFrame, order: str, totals: Sequence[str], slices: int = SLICES) -> DataFrame:
    """Running sums of ``totals`` over rows sorted by the unique numeric column ``order``.

    No single-task window: values are cut into slices at approximate quantiles,
    summed per slice, and each slice adds the sum of those before it. Any cut
    points give the exact result; good ones give slices of equal size.
    """
    probabilities = [i / slices for i in range(1, slices)]
    inner = sorted(set(df.select(F.col(order).cast("double").alias("v")).approxQuantile("v", probabilities, 0.5 / slices)))
    splits = [float("-inf"), *inner, float("inf")]
    value = F.col(order).cast("double").alias("_value")
    if len(splits) > 2:
        cut = Bucketizer(splits=splits, inputCol="_value", outputCol="_slice").transform(df.select("*", value))
    else:
        cut = df.select("*", value, F.lit(0.0).alias("_slice"))
    whole = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most ``slices`` rows, so one task and a broadcast are fine.
    before = cut.groupBy("_slice").agg(*[F.sum(t).alias(f"_sum_{t}") for t in totals])
    before = before.select("_slice", *[F.coalesce(F.sum(f"_sum_{t}").over(whole), F.lit(0)).alias(f"_base_{t}") for t in totals])
    local = Window.partitionBy("_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(F.broadcast(before), "_slice")
        .withColumns({f"running_{t}": F.sum(t).over(local) + F.col(f"_base_{t}") for t in totals})
        .drop("_slice", "_value", *[f"_base_{t}" for t in totals])
    )


def _values_at(values: DataFrame, wanted: Sequence[int], rows: int) -> dict[int, float]:
    """The value ``v`` at each 0-based rank, without a shuffle or sort of the table.

    A sketch gives a bracket of values around every rank. One pass counts the rows between the brackets
    and the copies of each value inside them; only those values, a small share of the rows, are sorted.
    A bracket that misses its rank is seen in the counts; then every value is ranked.
    """
    shares = [(w / rows - 2 * SKETCH_ERROR, w / rows + 2 * SKETCH_ERROR) for w in wanted]
    asked = values.approxQuantile("v", [min(max(s, 0.0), 1.0) for pair in shares for s in pair], SKETCH_ERROR)
    brackets: list[list[float]] = []
    for k, (low, high) in enumerate(shares):
        low, high = asked[2 * k] if low > 0 else float("-inf"), asked[2 * k + 1] if high < 1 else float("inf")
        if brackets and low <= brackets[-1][1]:
            brackets[-1][1] = max(high, brackets[-1][1])
        else:
            brackets.append([low, high])
    part = sum(((F.col("v") >= low).cast("int") + (F.col("v") > high).cast("int") for low, high in brackets), F.lit(0))
    placed = values.select(part.alias("part"), F.when(part % 2 == 1, F.col("v")).alias("v"))  # odd: in a bracket
    counted = cut_lineage(placed.groupBy("part", "v").agg(F.count(F.lit(1)).alias("n")), "ranks")
    sizes = dict(counted.groupBy("part").agg(F.sum("n")).collect())  # two rows per bracket
    starts = [sum(n for p, n in sizes.items() if p < i) for i in range(2 * len(brackets) + 1)]
    held = [any(starts[p] <= w < starts[p] + sizes.get(p, 0) for p in range(1, len(starts), 2)) for w in wanted]
    if all(held):
        upto = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        before = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in starts]), F.col("part") + 1)
        ranked = counted.filter("part % 2 = 1").select("v", "n", (F.sum("n").over(upto) + before).alias("running_n"))
    else:
        ranked = running_totals(values.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "v", ["n"])
    ranks = F.filter(
        F.array(*[F.lit(w).cast("long") for w in wanted]),
        lambda w: (w >= F.col("running_n") - F.col("n")) & (w < F.col("running_n")),
    )
    return {r["w"]: r["v"] for r in ranked.select("v", F.explode(ranks).alias("w")).collect()}


def exact_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], in_memory_rows: int = IN_MEMORY_ROWS
) -> list[float]:
    """Exact percentiles with linear interpolation; only the answers reach the driver."""
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = values.count()
    if rows == 0:
        return [float("nan") for _ in probabilities]
    if rows <= in_memory_rows:
        return list(values.agg(F.percentile("v", list(probabilities)).alias("q")).first()["q"])
    places = [p * (rows - 1) for p in probabilities]
    wanted = sorted({int(x) for x in places} | {min(int(x) + 1, rows - 1) for x in places})
    found = _values_at(values, wanted, rows)
    out = []
    for x in places:
        low, share = int(x), x - int(x)
        below, above = found[low], found[min(low + 1, rows - 1)]
        out.append(below if share == 0 or below == above else (1 - share) * below + share * above)
    return out


def _ordered_value(column: str) -> Column:
    """A number with a place in the order: NaN counts as missing, like NULL."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def quantile_table(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], in_memory_rows: int = IN_MEMORY_ROWS
) -> dict[str, list[float]]:
    """Exact percentiles of several columns: one pass for all of them while the table is small."""
    if df.count() > in_memory_rows:
        return {c: exact_quantiles(df, c, probabilities, in_memory_rows) for c in columns}
    row = df.agg(*[F.percentile(_ordered_value(c), list(probabilities)).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return {c: list(row[f"q{i}"] or [float("nan")] * len(probabilities)) for i, c in enumerate(columns)}


def scale_stats(
    df: DataFrame, columns: Sequence[str], method: str = "standard", in_memory_rows: int = IN_MEMORY_ROWS
) -> dict[str, tuple[float, float]]:
    """Centre and scale per column: mean and population deviation, or median and IQR."""
    if method == "standard":
        row = df.agg(
            *[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        ).first()
        raw = {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(columns)}
    elif method == "robust":
        quartiles = quantile_table(df, columns, [0.25, 0.5, 0.75], in_memory_rows)
        raw = {c: (q[1], q[2] - q[0]) for c, q in quartiles.items()}
    else:
        raise ValueError(f"unknown scaling method {method!r}")
    return {c: (float(m or 0.0), float(s) if s else 1.0) for c, (m, s) in raw.items()}


def apply_scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def stats_table(spark, stats: dict[str, tuple[float, float]]) -> DataFrame:
    rows = [(c, float(m), float(s)) for c, (m, s) in stats.items()]
    return spark.createDataFrame(rows, "feature string, center double, scale double")


def iqr_outliers(
    df: DataFrame, columns: Sequence[str], threshold: float = 3.0, in_memory_rows: int = IN_MEMORY_ROWS
) -> tuple[DataFrame, list[dict]]:
    """Remove rows outside the quartile fences, column after column.

    Each column's quartiles are taken on the rows the earlier columns left, so
    this is one job per column by nature. Only the fences come to the driver;
    the cleaned table stays a plain chain of filters on the input.
    """
    left, report = df, []
    size = F.count(F.lit(1)).alias("n")

    def quartiles(name: str, rows: int) -> tuple[float, float, int]:
        """Quartiles of the next column and the rows left by the last one, in one job if small."""
        if rows > in_memory_rows:
            q1, q3 = exact_quantiles(left, name, [0.25, 0.75], in_memory_rows)
            return q1, q3, left.count()
        row = left.agg(F.percentile(_ordered_value(name), [0.25, 0.75]).alias("q"), size).first()
        q1, q3 = row["q"] or (float("nan"), float("nan"))
        return q1, q3, row["n"]

    bound = df.count()
    for c in columns:
        q1, q3, rows = quartiles(c, bound)
        low, high = q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1)
        outside = F.coalesce((F.col(c) < low) | (F.col(c) > high), F.lit(False))
        report.append({"column_name": c, "lower_bound": low, "upper_bound": high, "rows_before": rows})
        bound = rows
        if threshold >= 3.0:
            left = left.filter(~outside)
        else:
            report[-1]["outliers"] = left.filter(outside).count()
    after = [r["rows_before"] for r in report[1:]] + ([left.count()] if report else [])
    for entry, rows in zip(report, after):
        entry.setdefault("outliers", entry["rows_before"] - rows)
        entry["outlier_percent"] = entry["outliers"] / entry["rows_before"] * 100 if entry["rows_before"] else 0.0
    return left, report


def outlier_report(spark, report: list[dict]) -> DataFrame:
    schema = (
        "column_name string, lower_bound double, upper_bound double, rows_before bigint, "
        "outliers bigint, outlier_percent double"
    )
    return spark.createDataFrame([tuple(r.values()) for r in report], schema)


def data_sufficiency(df: DataFrame, columns: Sequence[str], minimum: int = 1000) -> DataFrame:
    """Row count, smallest variance and NULL count with the first failing reason."""
    checks = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.least(*[F.var_samp(c) for c in columns]).alias("min_variance")
        if len(columns) > 1
        else F.var_samp(columns[0]).alias("min_variance"),
        sum((F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in columns), F.lit(0)).alias("null_values"),
    )
    reason = (
        F.when(F.col("n_rows") < minimum, F.format_string(f"Insufficient samples: %d < {minimum}", "n_rows"))
        .when(F.col("n_rows") == 0, "DataFrame is empty")
        .when(F.col("min_variance") == 0, "One or more features have zero variance")
        .when(F.col("null_values") > 0, "Data contains NaN values")
        .otherwise("Data validation passed")
    )
    return checks.withColumn("reason", reason).withColumn("sufficient", F.col("reason") == "Data validation passed")
