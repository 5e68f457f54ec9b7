"""Evaluation and profiling aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.operators.stats import IN_MEMORY_ROWS, exact_quantiles, running_totals


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion_counts(y: Column, pred: Column) -> list[Column]:
    return [
        F.count_if((y == 1) & (pred == 1)).alias("tp"),
        F.count_if((y == 0) & (pred == 1)).alias("fp"),
        F.count_if((y == 0) & (pred == 0)).alias("tn"),
        F.count_if((y == 1) & (pred == 0)).alias("fn"),
    ]


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.withColumns(
        {
            "precision": precision,
            "recall": recall,
            "f1": _ratio(2 * precision * recall, precision + recall),
            "true_positive_rate": recall,
            "false_positive_rate": _ratio(fp, fp + tn),
        }
    )


def confusion_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return with_rates(df.agg(*confusion_counts(F.col(y), F.col(pred))))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve by average ranks, ties shared.

    Rows are first combined per distinct score; ranks come from running totals
    in slices, so no task sees the whole ranking. Rows without a score (NULL or
    NaN) have no rank and are left out, counts included.
    """
    ranked_rows = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    by_score = ranked_rows.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("pos")
    )
    ranked = running_totals(by_score, "s", ["n"])
    average_rank = F.col("running_n") - (F.col("n") - 1) / 2.0
    sums = ranked.agg(
        F.sum(F.col("pos") * average_rank).alias("rank_sum"), F.sum("pos").alias("p"), F.sum("n").alias("all")
    )
    p, n = F.col("p"), F.col("all") - F.col("p")
    auc = F.try_divide(F.col("rank_sum") - p * (p + 1) / 2.0, (p * n).cast("double"))
    return sums.select(p.alias("positives"), n.alias("negatives"), auc.alias("auc"))


def class_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Precision, recall, f1 and support per class with macro and weighted averages.

    Built on the class-pair counts, a table as small as the number of classes squared.
    """
    pairs = df.groupBy(F.col(y).cast("string").alias("y"), F.col(pred).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    per = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    per = per.withColumns({"precision": _ratio(F.col("hit"), F.col("predicted")), "recall": _ratio(F.col("hit"), F.col("support"))})
    per = per.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    measures = ["precision", "recall", "f1"]
    both = per.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures],
        F.sum("support").alias("support"),
    )
    averages = both.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f"{kind} avg").alias("label"), *[F.col(f"{kind}_{m}").alias(m) for m in measures], F.col("support").alias("support"))
                    for kind in ("macro", "weighted")
                ]
            )
        ).alias("a")
    ).select("a.*")
    return per.select("label", *measures, "support").unionByName(averages)


def prediction_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("flows"),
        F.count_if(F.col("prediction") == -1).alias("anomalies"),
        F.avg("anomaly_score").alias("mean_score"),
    )


def anomaly_eval(scored: DataFrame) -> DataFrame:
    anomalies, n = F.count_if(F.col("prediction") == -1), F.count(F.lit(1))
    return scored.agg(
        n.alias("total_samples"),
        anomalies.alias("anomalies_detected"),
        _ratio(anomalies, n).alias("anomaly_rate"),
        F.avg("anomaly_score").alias("mean_anomaly_score"),
        F.stddev_pop("anomaly_score").alias("std_anomaly_score"),
        F.min("anomaly_score").alias("min_anomaly_score"),
        F.max("anomaly_score").alias("max_anomaly_score"),
    )


def dataset_profile(df: DataFrame, ts: str = "timestamp", file: Column | None = None) -> DataFrame:
    named = df.select(F.col(ts).alias("t"), (F.lit(None).cast("string") if file is None else file).alias("f"))
    # Distinct files are counted in two steps, so the wide first one combines before the shuffle.
    per_file = named.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    return per_file.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.min("lo").alias("min_timestamp"),
        F.max("hi").alias("max_timestamp"),
        F.count("f").alias("files"),
    )


def score_percentiles(
    scored: DataFrame, score: str = "anomaly_score", target: float = 0.1, in_memory_rows: int = IN_MEMORY_ROWS
) -> DataFrame:
    """P5/P50/P95, mean, deviation and the observed anomaly share against its target."""
    p5, p50, p95 = exact_quantiles(scored, score, [0.05, 0.5, 0.95], in_memory_rows)
    observed = _ratio(F.count_if(F.col("prediction") == -1), F.count(F.lit(1)))
    return scored.agg(
        F.lit(p5).alias("p5"),
        F.lit(p50).alias("p50"),
        F.lit(p95).alias("p95"),
        F.avg(score).alias("mean_score"),
        F.stddev_pop(score).alias("std_score"),
        observed.alias("observed_contamination"),
        (F.abs(observed - target) <= 0.05).alias("within_target"),
    )


def label_distribution(df: DataFrame, label: str, normal: str | None = None) -> DataFrame:
    """Count and percent per label; the total is a sum over the few label rows."""
    counts = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    out = counts.withColumn("percent", F.col("n") * 100.0 / total)
    if normal is None:
        return out
    attacks = F.sum(F.when(F.col("label") != normal, F.col("n")).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    return out.withColumn("attack_rate", attacks / total)


def threshold_search(
    df: DataFrame,
    y: str = "y",
    score: str = "score",
    target_precision: float = 0.85,
    in_memory_rows: int = IN_MEMORY_ROWS,
) -> DataFrame:
    """Metrics at the 99 score percentiles and the chosen one: best precision at or
    above the target, else best f1; the lowest percentile wins ties.

    A row is flagged when its score is below the threshold. All 99 thresholds
    are evaluated in one pass: rows are counted per gap between neighbouring
    thresholds, and the counts below each threshold are sums over those gaps.
    """
    spark = df.sparkSession
    cuts = exact_quantiles(df, score, [p / 100 for p in range(1, 100)], in_memory_rows)
    thresholds = F.array(*[F.lit(c) for c in cuts])
    gap = F.size(F.filter(thresholds, lambda t: t <= F.col("s")))
    per_gap = (
        df.select(F.col(score).cast("double").alias("s"), F.col(y).alias("y"))
        .groupBy("s")
        .agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
        .groupBy(gap.alias("gap"))
        .agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    )
    grid = spark.createDataFrame(
        [(i + 1, float(c)) for i, c in enumerate(cuts)] + [(len(cuts) + 1, None)], "percentile int, threshold double"
    )
    # 100 rows from here on: rows in the gap below threshold i are counted from i upwards.
    line = grid.join(F.broadcast(per_gap), F.col("gap") == F.col("percentile") - 1, "left")
    upto = Window.partitionBy(F.lit(0)).orderBy("percentile").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    p, q = F.coalesce("p", F.lit(0)), F.coalesce("q", F.lit(0))
    counts = line.select(
        "percentile",
        "threshold",
        F.sum(p).over(upto).alias("tp"),
        F.sum(q).over(upto).alias("fp"),
        (F.sum(q).over(everything) - F.sum(q).over(upto)).alias("tn"),
        (F.sum(p).over(everything) - F.sum(p).over(upto)).alias("fn"),
    ).filter(F.col("threshold").isNotNull())
    rated = with_rates(counts)
    reaches = F.col("precision") >= target_precision
    any_reaches = F.max(reaches.cast("int")).over(Window.partitionBy(F.lit(0)))
    merit = F.when(any_reaches == 1, F.when(reaches, F.col("precision")).otherwise(-1.0)).otherwise(F.col("f1"))
    best = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_merit"), "percentile"))
    return rated.withColumn("_merit", merit).withColumn("chosen", best == 1).drop("_merit")
