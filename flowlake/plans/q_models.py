"""Registered queries: feature preparation, statistics, evaluation and model jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlake.functions import encode, ip
from flowlake.ml import classifiers, iforest, training
from flowlake.operators import behaviour, blocklist, clean, decide, inspect, metrics, sampling, stats
from flowlake.plans import fixtures as fx
from flowlake.plans import scoring
from flowlake.plans.q_clean import intrusion_rows, labelled_frames, with_intrusion
from flowlake.plans.registry import register
from flowlake.schemas import FLOW_COLUMNS, LOG_FEATURES, MODEL_FEATURES
from flowlake.session import cut_lineage, discard, released, scratch_path
from flowlake.sources import flows as src
from flowlake.streaming import run

# -------------------------------------------------------- features and scaling

PREPARED_SQL = """
, prep AS (SELECT bytes_in, bytes_out, packets_in, packets_out, duration, src_port, dst_port,
    CASE protocol WHEN 'TCP' THEN 1 WHEN 'UDP' THEN 2 WHEN 'ICMP' THEN 3 ELSE 5 END AS protocol FROM v_flows)
, logged AS (SELECT CAST(src_port AS DOUBLE) AS src_port, CAST(dst_port AS DOUBLE) AS dst_port, CAST(protocol AS DOUBLE) AS protocol,
    ln(1 + CAST(bytes_in AS DOUBLE)) AS bytes_in_log, ln(1 + CAST(bytes_out AS DOUBLE)) AS bytes_out_log,
    ln(1 + CAST(packets_in AS DOUBLE)) AS packets_in_log, ln(1 + CAST(packets_out AS DOUBLE)) AS packets_out_log,
    ln(1 + duration) AS duration_log FROM prep)"""
_LOGGED = ["src_port", "dst_port", "protocol", *[f"{c}_log" for c in LOG_FEATURES]]


def _prepared(spark, sf):
    return clean.prepare_features(fx.v_flows(spark, sf), MODEL_FEATURES)


def _logged(spark, sf):
    out = clean.log_transform(_prepared(spark, sf), LOG_FEATURES)
    return out.select(*[F.col(c).cast("double").alias(c) for c in out.columns])


@register("m1_prepare_features", fx.with_views("v_flows", body="") + PREPARED_SQL + " SELECT * FROM prep")
def m1(spark, sf):
    return _prepared(spark, sf)


@register(
    "m2_log_transform",
    fx.with_views("v_flows", body="") + PREPARED_SQL + " SELECT "
    + ", ".join(f"round({c}, 9) AS {c}" if c.endswith("_log") else c for c in _LOGGED) + " FROM logged",
)
def m2(spark, sf):
    return _logged(spark, sf).select(*[F.round(c, 9).alias(c) if c.endswith("_log") else F.col(c) for c in _LOGGED])


def _stats_sql(center: str, scale: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round({center.format(c=c)}, 6) AS center, round({scale.format(c=c)}, 6) AS scale FROM logged" for c in _LOGGED
    )


@register("m3_scale_standard", fx.with_views("v_flows", body="") + PREPARED_SQL + _stats_sql("avg({c})", "stddev_pop({c})"))
def m3_standard(spark, sf):
    table = stats.stats_table(spark, stats.scale_stats(_logged(spark, sf), _LOGGED))
    return table.select("feature", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))


@register(
    "m3_scale_robust",
    fx.with_views("v_flows", body="") + PREPARED_SQL + _stats_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
)
def m3_robust(spark, sf):
    data = cut_lineage(_logged(spark, sf), "logged")
    table = stats.stats_table(spark, stats.scale_stats(data, _LOGGED, "robust"))
    return table.select("feature", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))


@register(
    "m3_scaled_rows",
    fx.with_views("v_flows", body="") + PREPARED_SQL + """
, s AS (SELECT avg(bytes_in_log) AS m, stddev_pop(bytes_in_log) AS d, avg(duration_log) AS m2, stddev_pop(duration_log) AS d2 FROM logged)
SELECT round((bytes_in_log - m) / d, 5) AS bytes_in_log, round((duration_log - m2) / d2, 5) AS duration_log FROM logged, s""",
)
def m3_rows(spark, sf):
    data = _logged(spark, sf).select("bytes_in_log", "duration_log")
    scaled = stats.apply_scale(data, stats.scale_stats(data, data.columns))
    return scaled.select(*[F.round(c, 5).alias(c) for c in data.columns])


_IQR_COLUMNS = ["bytes_in", "bytes_out", "packets_in", "duration"]


def _skewed(spark, sf):
    """Flow numbers with a heavy tail, so that the fences cut rows."""
    f = fx.v_flows(spark, sf)
    tail = F.col("src_port") % 40 == 0
    return f.select(
        *[
            (F.when(tail & (F.col("dst_port") % 2 == i % 2), F.col(c) * (50 + i)).otherwise(F.col(c))).cast("double").alias(c)
            for i, c in enumerate(_IQR_COLUMNS)
        ]
    )


def _iqr_sql() -> str:
    views = ", t0 AS (SELECT " + ", ".join(
        f"CAST(CASE WHEN src_port % 40 = 0 AND dst_port % 2 = {i % 2} THEN {c} * {50 + i} ELSE {c} END AS DOUBLE) AS {c}"
        for i, c in enumerate(_IQR_COLUMNS)
    ) + " FROM v_flows)"
    for i, c in enumerate(_IQR_COLUMNS):
        views += (
            f", q{i} AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM t{i})"
            f", t{i + 1} AS (SELECT t{i}.* FROM t{i}, q{i} WHERE {c} BETWEEN a - 3 * (b - a) AND b + 3 * (b - a))"
        )
    return views


@register("m4_iqr_outliers", fx.with_views("v_flows", body="") + _iqr_sql() + f" SELECT * FROM t{len(_IQR_COLUMNS)}")
def m4(spark, sf):
    return stats.iqr_outliers(_skewed(spark, sf), _IQR_COLUMNS)[0]


@register(
    "g21_outlier_report",
    fx.with_views("v_flows", body="") + _iqr_sql() + " UNION ALL ".join(
        f" SELECT '{c}' AS column_name, (SELECT count(*) FROM t{i}) - (SELECT count(*) FROM t{i + 1}) AS outliers, (SELECT count(*) FROM t{i}) AS rows_before,"
        f" round(((SELECT count(*) FROM t{i}) - (SELECT count(*) FROM t{i + 1})) * 100.0 / (SELECT count(*) FROM t{i}), 6) AS outlier_percent"
        for i, c in enumerate(_IQR_COLUMNS)
    ),
)
def g21(spark, sf):
    report = stats.outlier_report(spark, stats.iqr_outliers(_skewed(spark, sf), _IQR_COLUMNS)[1])
    return report.select("column_name", "outliers", "rows_before", F.round("outlier_percent", 6).alias("outlier_percent"))


# ------------------------------------------------------------------ evaluation

_SCORED_SQL = """
, scored AS (SELECT if_score AS anomaly_score, CASE WHEN if_score < -0.4 THEN -1 ELSE 1 END AS prediction, protocol FROM v_scores)"""


def _scored(spark, sf):
    s = fx.v_scores(spark, sf)
    return s.select(
        F.col("if_score").alias("anomaly_score"), F.when(F.col("if_score") < -0.4, -1).otherwise(1).alias("prediction"), "protocol"
    )


@register(
    "g8_prediction_summary",
    fx.with_views("v_scores", body="") + _SCORED_SQL + " SELECT count(*) AS flows, count(*) FILTER (WHERE prediction = -1) AS anomalies, round(avg(anomaly_score), 8) AS mean_score FROM scored",
)
def g8(spark, sf):
    return metrics.prediction_summary(_scored(spark, sf)).withColumn("mean_score", F.round("mean_score", 8))


_EVAL = ["anomaly_rate", "mean_anomaly_score", "std_anomaly_score", "min_anomaly_score", "max_anomaly_score"]


@register(
    "g9_anomaly_eval",
    fx.with_views("v_scores", body="") + _SCORED_SQL + """
SELECT count(*) AS total_samples, count(*) FILTER (WHERE prediction = -1) AS anomalies_detected,
  round(count(*) FILTER (WHERE prediction = -1) / CAST(count(*) AS DOUBLE), 8) AS anomaly_rate, round(avg(anomaly_score), 8) AS mean_anomaly_score,
  round(stddev_pop(anomaly_score), 8) AS std_anomaly_score, round(min(anomaly_score), 8) AS min_anomaly_score,
  round(max(anomaly_score), 8) AS max_anomaly_score FROM scored""",
)
def g9(spark, sf):
    return metrics.anomaly_eval(_scored(spark, sf)).withColumns({c: F.round(c, 8) for c in _EVAL})


_RATES = ["precision", "recall", "f1", "true_positive_rate", "false_positive_rate"]
_CONFUSION_SQL = """
, c AS (SELECT count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
    count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn FROM v_labelled)
, r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS p,
    CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS q FROM c)
SELECT tp, fp, tn, fn, round(p, 8) AS precision, round(q, 8) AS recall,
  round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 8) AS f1, round(q, 8) AS true_positive_rate,
  round(CASE WHEN fp + tn > 0 THEN fp / CAST(fp + tn AS DOUBLE) ELSE 0.0 END, 8) AS false_positive_rate FROM r"""


@register("g10_confusion_metrics", fx.with_views("v_labelled", body="") + _CONFUSION_SQL)
def g10(spark, sf):
    return metrics.confusion_metrics(fx.v_labelled(spark, sf)).withColumns({c: F.round(c, 8) for c in _RATES})


@register(
    "g11_roc_auc",
    fx.with_views(
        "v_labelled",
        body="""SELECT CAST(sum(y) AS BIGINT) AS positives, CAST(count(*) - sum(y) AS BIGINT) AS negatives,
  round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / CAST(sum(y) * (count(*) - sum(y)) AS DOUBLE), 8) AS auc
FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM v_labelled)""",
    ),
)
def g11(spark, sf):
    return metrics.roc_auc(fx.v_labelled(spark, sf)).withColumn("auc", F.round("auc", 8))


@register(
    "g12_class_report",
    fx.with_views(
        "v_labelled",
        body="""
, l AS (SELECT unnest([0, 1]) AS label)
, k AS (SELECT CAST(label AS VARCHAR) AS label, count(*) FILTER (WHERE y = label) AS support, count(*) FILTER (WHERE pred = label) AS predicted,
    count(*) FILTER (WHERE y = label AND pred = label) AS hit FROM l, v_labelled GROUP BY label)
, p AS (SELECT label, support, CASE WHEN predicted > 0 THEN hit / CAST(predicted AS DOUBLE) ELSE 0.0 END AS precision,
    CASE WHEN support > 0 THEN hit / CAST(support AS DOUBLE) ELSE 0.0 END AS recall FROM k)
, f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM p)
SELECT label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 8), round(avg(recall), 8), round(avg(f1), 8), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 8), round(sum(recall * support) / sum(support), 8),
  round(sum(f1 * support) / sum(support), 8), CAST(sum(support) AS BIGINT) FROM f""",
    ),
)
def g12(spark, sf):
    report = metrics.class_report(fx.v_labelled(spark, sf))
    return report.withColumns({c: F.round(c, 8) for c in ("precision", "recall", "f1")})


@register(
    "g14_score_percentiles",
    fx.with_views("v_scores", body="") + _SCORED_SQL + """
SELECT round(quantile_cont(anomaly_score, 0.05), 8) AS p5, round(quantile_cont(anomaly_score, 0.5), 8) AS p50,
  round(quantile_cont(anomaly_score, 0.95), 8) AS p95, round(avg(anomaly_score), 8) AS mean_score, round(stddev_pop(anomaly_score), 8) AS std_score,
  round(count(*) FILTER (WHERE prediction = -1) / CAST(count(*) AS DOUBLE), 8) AS observed_contamination,
  abs(count(*) FILTER (WHERE prediction = -1) / CAST(count(*) AS DOUBLE) - 0.1) <= 0.05 AS within_target FROM scored""",
)
def g14(spark, sf):
    out = metrics.score_percentiles(_scored(spark, sf))
    return out.withColumns({c: F.round(c, 8) for c in out.columns if c != "within_target"})


@register(
    "g15_label_distribution",
    """SELECT event_type AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 8) AS percent,
  round((SELECT count(*) FILTER (WHERE event_type <> 'view') / CAST(count(*) AS DOUBLE) FROM events), 8) AS attack_rate FROM events GROUP BY event_type""",
)
def g15(spark, sf):
    out = metrics.label_distribution(fx.table(spark, sf, "events"), "event_type", "view")
    return out.withColumns({c: F.round(c, 8) for c in ("percent", "attack_rate")})


@register(
    "g18_data_sufficiency",
    fx.with_views("v_flows", body="") + PREPARED_SQL + " SELECT count(*) AS n_rows, 0 AS null_values, 'Data validation passed' AS reason, true AS sufficient, round(least("
    + ", ".join(f"var_samp({c})" for c in _LOGGED) + "), 6) AS min_variance FROM logged",
)
def g18(spark, sf):
    return stats.data_sufficiency(_logged(spark, sf), _LOGGED).withColumn("min_variance", F.round("min_variance", 6))


@register(
    "m14_threshold_search",
    fx.with_views(
        "v_labelled",
        body="""
, t AS (SELECT p AS percentile, quantile_cont(score, p / 100.0) AS threshold FROM v_labelled, range(1, 100) r(p) GROUP BY p)""".replace(
            "quantile_cont(score, p / 100.0)", "NULL"
        ).replace(", t AS (SELECT p AS percentile, NULL AS threshold FROM v_labelled, range(1, 100) r(p) GROUP BY p)", """
, qs AS (SELECT quantile_cont(score, [%s]) AS q FROM v_labelled)
, t AS (SELECT p AS percentile, q[p] AS threshold FROM qs, range(1, 100) r(p))
, m AS (SELECT percentile, threshold, count(*) FILTER (WHERE y = 1 AND score < threshold) AS tp, count(*) FILTER (WHERE y = 0 AND score < threshold) AS fp,
    count(*) FILTER (WHERE y = 0 AND score >= threshold) AS tn, count(*) FILTER (WHERE y = 1 AND score >= threshold) AS fn
  FROM t, v_labelled GROUP BY ALL)
, r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall FROM m)
, f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r)
SELECT percentile, round(threshold, 6) AS threshold, tp, fp, tn, fn, round(precision, 8) AS precision, round(f1, 8) AS f1,
  row_number() OVER (ORDER BY CASE WHEN (SELECT max(precision) FROM f) >= 0.85 THEN CASE WHEN precision >= 0.85 THEN precision ELSE -1 END ELSE f1 END DESC, percentile) = 1 AS chosen
FROM f""" % ", ".join(str(p / 100) for p in range(1, 100))),
    ),
)
def m14(spark, sf):
    out = metrics.threshold_search(fx.v_labelled(spark, sf))
    return out.select(
        "percentile", F.round("threshold", 6).alias("threshold"), "tp", "fp", "tn", "fn",
        F.round("precision", 8).alias("precision"), F.round("f1", 8).alias("f1"), "chosen",
    )


# ------------------------------------------------------------- isolation forest


def _scaled(spark, sf):
    data = _logged(spark, sf)
    return cut_lineage(stats.apply_scale(data, stats.scale_stats(data, _LOGGED)), "scaled")


# Model jobs return facts that SQL can compute too: which rows were scored, the values of a grid,
# that scores lie in range, that shares flagged follow the quantile, that a repeated fit is equal.


@register(
    "m5_contamination_grid",
    fx.with_views("v_flows", body="""SELECT round((i + 1) / 100.0, 4)::DOUBLE AS contamination, true AS rate_near_value, true AS error_is_mean_gap, true AS chosen_has_least_error
FROM range(10) t(i) WHERE (SELECT count(*) FROM v_flows) > 0"""),
)
def m5(spark, sf):
    """Held-out rates per value; the plain loop over folds is compared in the tests."""
    grid = training.contamination_grid(_scaled(spark, sf), _LOGGED)[1]
    every = Window.partitionBy(F.lit(0))  # ten rows
    return grid.select(
        F.round("contamination", 4).alias("contamination"),
        (F.abs(F.col("held_out_rate") - F.col("contamination")) <= 0.02).alias("rate_near_value"),
        (F.col("rate_error") * F.col("contamination") + 1e-9 >= F.abs(F.col("held_out_rate") - F.col("contamination"))).alias("error_is_mean_gap"),
        (F.min("rate_error").over(every) == F.max(F.when(F.col("chosen"), F.col("rate_error"))).over(every)).alias("chosen_has_least_error"),
    )


@register(
    "m6_isolation_forest",
    fx.with_views("v_flows", body="""SELECT count(*) AS rows_scored, 0 AS rows_out_of_range, true AS flagged_close, true AS lowest_flagged,
  true AS repeat_equal, 100 AS trees, true AS exact_samples FROM v_flows"""),
)
def m6(spark, sf):
    data = _scaled(spark, sf)
    forest, judged = iforest.fit_predict(data, _LOGGED, trees=100, contamination=0.05)
    again = iforest.fit_forests(data.repartition(3), _LOGGED, [iforest.ForestSpec(100, 256)])[0]
    leaves = forest.nodes[forest.nodes["feature"] < 0].groupby("tree").size()
    flagged = F.col("prediction") == -1
    return judged.agg(
        F.count(F.lit(1)).alias("rows_scored"),
        F.count_if(~F.col("probability").between(-1, -1e-12) | F.isnan("probability")).alias("rows_out_of_range"),
        (F.abs(F.avg(flagged.cast("double")) - 0.05) <= 0.005).alias("flagged_close"),
        (F.max(F.when(flagged, F.col("probability"))) < F.min(F.when(~flagged, F.col("probability")))).alias("lowest_flagged"),
        F.lit(forest.nodes.equals(again.nodes)).alias("repeat_equal"),
        F.lit(int(forest.nodes["tree"].nunique())).alias("trees"),
        F.lit(bool((leaves <= 256).all())).alias("exact_samples"),
    )


@register(
    "m7_hyperparameter_grid",
    fx.with_views("v_flows", body="""SELECT n::INTEGER AS n_estimators, s::DOUBLE AS max_samples, b AS bootstrap, true AS mean_in_range, 1 AS best_points, 3 AS different_shares
FROM range(50, 201, 25) t(n), (VALUES (0.5), (0.75), (1.0)) u(s), (VALUES (true), (false)) v(b) WHERE (SELECT count(*) FROM v_flows) > 0"""),
)
def m7(spark, sf):
    grid = training.hyperparameter_grid(_scaled(spark, sf), _LOGGED)
    every = Window.partitionBy(F.lit(0))  # 42 rows
    shares = F.size(F.collect_set(F.when((F.col("n_estimators") == 50) & ~F.col("bootstrap"), F.col("mean_score"))).over(every))
    return grid.select(
        "n_estimators", "max_samples", "bootstrap",
        F.col("mean_score").between(-1, -1e-12).alias("mean_in_range"),
        F.sum(F.col("best").cast("int")).over(every).cast("int").alias("best_points"),
        shares.alias("different_shares"),
    )


@register(
    "m8_train_model",
    "SELECT true AS contamination_of_least_error, true AS tested_a_fifth, true AS flagged_few, true AS scores_in_range, true AS grid_point_used, "
    "'real' AS router_source, true AS router_labels_complete, true AS model_reloads FROM lineitem LIMIT 1",
)
def m8(spark, sf):
    """CSV files to a tuned, evaluated, stored forest and a trained router."""
    path, model_path = scratch_path(spark, "training-csv"), scratch_path(spark, "model")
    rows = fx.v_flows(spark, sf).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    rows.write.option("header", True).csv(path)
    samples = cut_lineage(_router_samples(spark, sf), "router")
    grid = training.parameter_grid((50, 75), (0.5, 1.0), (False,))
    result = training.train(src.scan_training_csvs(spark, path), grid=grid, router_samples=samples)
    training.save_model(spark, result["model"], result["scaler"], model_path, "flows")
    again, _, meta = training.load_model(spark, model_path)
    used = {"n_estimators": meta["trees"], "max_samples": result["grid_point"]["max_samples"], "bootstrap": meta["bootstrap"]}
    total, routed = result["data"].count(), classifiers.router_evaluation(result["router"], samples).first()
    best = result["contamination_grid"].orderBy(F.round("rate_error", 12), "contamination").first()
    e = F.col
    return result["evaluation"].select(
        F.lit(best["contamination"] == result["contamination"] == result["model"].contamination).alias("contamination_of_least_error"),
        (F.abs(e("total_samples") - 0.2 * total) <= 1).alias("tested_a_fifth"),
        (F.abs(e("anomaly_rate") - result["contamination"]) <= 0.03).alias("flagged_few"),
        (e("min_anomaly_score").between(-1, 1) & e("max_anomaly_score").between(-1, 1)).alias("scores_in_range"),
        F.lit(used in grid).alias("grid_point_used"),
        F.lit(result["router_source"]).alias("router_source"),
        F.lit(routed["n_samples"] == samples.count() == sum(routed[f"label_{p}"] for p in classifiers.PATHS)).alias("router_labels_complete"),
        F.lit(again.nodes.equals(result["model"].nodes)).alias("model_reloads"),
    )


@register("s11_save_load_model", fx.with_views("v_flows", body="SELECT count(*) AS rows_scored, 0 AS rows_differing, 8 AS scaler_rows FROM v_flows"))
def s11(spark, sf):
    """A stored and reloaded model scores every row as before."""
    data = _scaled(spark, sf)
    forest = iforest.fit(data, _LOGGED, trees=50, contamination=0.05)
    path = scratch_path(spark, "model")
    training.save_model(spark, forest, {c: (0.0, 1.0) for c in _LOGGED}, path, "flows")
    again, scaler, _ = training.load_model(spark, path)
    both = data.select(forest.score_samples().alias("a"), again.score_samples().alias("b"))
    return both.agg(
        F.count(F.lit(1)).alias("rows_scored"), F.count_if(F.col("a") != F.col("b")).alias("rows_differing"),
        F.lit(len(scaler)).alias("scaler_rows"),
    )


@register(
    "m17_robust_baseline_fit",
    fx.with_views("v_flows", body="SELECT count(*) AS rows_scored, true AS observed_close, true AS percentiles_ordered, true AS within_target FROM v_flows"),
)
def m17(spark, sf):
    scored, report = training.robust_baseline(fx.v_flows(spark, sf).drop("packets_in", "packets_out"))
    return report.select(
        F.lit(scored.count()).alias("rows_scored"),
        (F.abs(F.col("observed_contamination") - 0.1) <= 0.005).alias("observed_close"),
        ((F.col("p5") <= F.col("p50")) & (F.col("p50") <= F.col("p95")) & (F.col("p5") < 0)).alias("percentiles_ordered"),
        "within_target",
    )


# Numeric columns that the intrusion models use, besides the four derived ones and the protocol flags.
_INTRUSION = [
    "packet_count", "byte_count", "duration", "rate", "protocol_type_TCP", "protocol_type_UDP", "protocol_type_ICMP", "src_bytes", "dst_bytes",
    "count", "srv_count", "serror_rate", "rerror_rate", "same_srv_rate", "diff_srv_rate", "dst_host_count", "dst_host_srv_count",
    "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "logged_in", "hot", "num_failed_logins", "num_compromised",
]
_INTRUSION_FILE_ROWS = 200_000


def _split_intrusion(spark, sf):
    """Benchmark files read back, labelled, with their features, in two splits by row hash, as a stored table."""
    path, stored = scratch_path(spark, "intrusion"), scratch_path(spark, "split")
    with released(spark):
        # packed files are read by one task each, so they are kept small
        files = intrusion_rows(spark, sf).write.option("maxRecordsPerFile", _INTRUSION_FILE_ROWS)
        files.options(**{"header": False, "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).csv(path)
        rows = clean.intrusion_features_full(clean.label_attacks(src.scan_intrusion_csv(spark, path)))
        data = cut_lineage(rows.select("is_attack", *_INTRUSION), "intrusion-rows")
        discard(spark, path)
        named = data.withColumn("row_id", F.xxhash64(*_INTRUSION))
        split = sampling.train_test_split(named, ["row_id"], strata=["is_attack"]).drop("row_id")
        split.write.parquet(stored)
    return spark.read.schema(split.schema).parquet(stored)


@register(
    "m13_iforest_tune_labelled",
    with_intrusion("""SELECT c::DOUBLE AS contamination, k::INTEGER AS n_estimators, count(*) FILTER (WHERE label <> 'normal') AS attacks, true AS rates_in_range, 1 AS best_points
FROM v_intrusion, (VALUES (0.001), (0.002), (0.005), (0.01), (0.02)) t(c), (VALUES (100), (200), (400)) u(k) GROUP BY c, k"""),
)
def m13(spark, sf):
    """Train on normal rows; validate on the held-out normal rows and all attacks."""
    data = _split_intrusion(spark, sf)
    train = (F.col("is_attack") == 0) & (F.col("split") == "train")
    tuned = training.tune_labelled(data.filter(train), data.filter(~train), _INTRUSION)
    every = Window.partitionBy(F.lit(0))  # 15 rows
    return tuned.select(
        F.round("contamination", 4).alias("contamination"), "n_estimators", (F.col("tp") + F.col("fn")).alias("attacks"),
        (F.col("precision").between(0, 1) & F.col("f1").between(0, 1)).alias("rates_in_range"),
        F.sum(F.col("best").cast("int")).over(every).cast("int").alias("best_points"),
    )


@register("m12_intrusion_classifier", "SELECT true AS tested_a_fifth, true AS precise, true AS sensitive, true AS probabilities_in_range FROM lineitem LIMIT 1")
def m12(spark, sf):
    data = _split_intrusion(spark, sf)
    model, scaler = classifiers.intrusion_classifier(data.filter("split = 'train'"), _INTRUSION)
    predicted = cut_lineage(classifiers.intrusion_predict(model, scaler, data.filter("split = 'test'")).select("is_attack", "pred", "attack_probability"), "predicted")
    outside = predicted.filter(~F.col("attack_probability").between(0, 1)).count()
    total = data.count()
    rated = metrics.confusion_metrics(predicted, "is_attack", "pred")
    tested = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return rated.select(
        (F.abs(tested - 0.2 * total) <= 2).alias("tested_a_fifth"),
        (F.col("precision") >= 0.85).alias("precise"),  # the gates of the evaluation
        (F.col("true_positive_rate") > 0.5).alias("sensitive"),
        F.lit(outside == 0).alias("probabilities_in_range"),
    )


# -------------------------------------------------------------- router, payload


def _router_rows(spark, sf):
    return behaviour.router_features(fx.v_scores(spark, sf), F.lit("2024-01-01 00:00:00").cast("timestamp"))


def _router_samples(spark, sf):
    rows = _router_rows(spark, sf)
    verdict = F.when(F.col("if_score") < -0.25, -1).otherwise(1)
    payload = F.when(F.col("payload_available") == 1, (F.col("packet_id") % 10) / 10.0)
    return rows.withColumn("label", decide.router_label(verdict, payload))


@register(
    "m10_router_train",
    fx.with_views("v_scores", body="SELECT true AS tested_a_fifth, true AS labels_complete, true AS accurate_on_held_out, 'real' AS source FROM v_scores LIMIT 1"),
)
def m10(spark, sf):
    """Trained on four fifths, judged on the held-out fifth against always naming the commonest label."""
    samples = cut_lineage(sampling.train_test_split(_router_samples(spark, sf), ["packet_id"], strata=["label"]), "router")
    fitted, held = samples.filter("split = 'train'"), samples.filter("split = 'test'")
    model, source = classifiers.router_train(fitted, fitted)
    counts = [F.col(f"label_{p}") for p in classifiers.PATHS]
    total = samples.count()
    return classifiers.router_evaluation(model, held).select(
        (F.abs(F.col("n_samples") - 0.2 * total) <= 3).alias("tested_a_fifth"), (sum(counts) == F.col("n_samples")).alias("labels_complete"),
        (F.col("train_accuracy") >= F.greatest(*counts) / F.col("n_samples")).alias("accurate_on_held_out"), F.lit(source).alias("source"),
    )


@register(
    "e4_route_model",
    fx.with_views("v_scores", body="SELECT packet_id, true AS path_of_stored_scores, true AS confidence_of_stored_scores, false AS used_fallback FROM v_scores"),
)
def e4(spark, sf):
    """Routes beside SQL over the stored class probabilities of the same model."""
    rows = cut_lineage(_router_rows(spark, sf), "router")
    labelled = rows.withColumn("label", decide.rule_label(rows))
    model, _ = classifiers.router_train(labelled, rows)
    stored = cut_lineage(classifiers.route_scores(model, rows).select("packet_id", "payload_available", "p"), "route-scores")
    routed = classifiers.route_model(model, rows).select("packet_id", "path", "confidence", "used_fallback")
    expected = spark.sql(
        """WITH best AS (SELECT packet_id, payload_available, greatest(p[0], p[1], p[2]) AS top,
             CASE WHEN p[0] >= p[1] AND p[0] >= p[2] THEN 'pass' WHEN p[1] >= p[2] THEN 'if_only' ELSE 'escalate' END AS named FROM {stored})
           SELECT packet_id, CASE WHEN named = 'escalate' AND payload_available = 0 THEN 'if_only' ELSE named END AS want,
             CASE WHEN named = 'escalate' AND payload_available = 0 THEN top * 0.8 ELSE top END AS want_confidence FROM best""",
        stored=stored,
    )
    return routed.join(expected, "packet_id").select(
        "packet_id", (F.col("path") == F.col("want")).alias("path_of_stored_scores"),
        (F.abs(F.col("confidence") - F.col("want_confidence")) < 1e-12).alias("confidence_of_stored_scores"), "used_fallback",
    )


@register("m15_payload_classifier", "SELECT true AS tested_a_fifth, true AS scores_in_range, true AS better_than_chance FROM documents LIMIT 1")
def m15(spark, sf):
    """Fitted on four fifths, judged on the held-out fifth."""
    frames = clean.binary_payload_label(labelled_frames(spark, sf)).withColumn("payload", F.unbase64("payload"))
    named = cut_lineage(frames.select("payload", "y", F.xxhash64("payload", "src_ip", "bytes_in").alias("row_id")), "frames")
    data = cut_lineage(sampling.train_test_split(named, ["row_id"], strata=["y"]), "split")
    model = classifiers.payload_train(data.filter("split = 'train'"))
    scored = cut_lineage(classifiers.payload_score(model, data.filter("split = 'test'")).select("y", "payload", "base_score"), "scored")
    final = scored.withColumn("s", inspect.signature_score_b(F.col("base_score"), F.col("payload")))
    total, auc = data.count(), metrics.roc_auc(final, "y", "s").first()["auc"]
    return final.agg(
        (F.abs(F.count(F.lit(1)) - 0.2 * total) <= 2).alias("tested_a_fifth"),
        (F.count_if(~F.col("s").between(0, 1)) == 0).alias("scores_in_range"),
        F.lit(auc is None or auc > 0.5).alias("better_than_chance"),
    )


@register("m16_payload_reconstruction", "SELECT conv_id, turn, true AS errors_in_range FROM conversations")
def m16(spark, sf):
    scored = classifiers.payload_reconstruction(fx.table(spark, sf, "conversations"), "text")
    ordered_errors = (F.col("reconstruction_error") >= 0) & (F.col("reconstruction_error") <= F.col("max_error") + 1e-12) & (F.col("max_error") <= 1)
    return scored.select("conv_id", "turn", ordered_errors.alias("errors_in_range"))


# ----------------------------------------------------------------- whole path


_SCORE_FILE_ROWS = 500_000  # a slice of twice as many rows comes in several files


def _trained(spark, sf):
    """A forest with a high threshold, so that flows take every route, the payload scan too."""
    path = scratch_path(spark, "scoring-model")
    data = _logged(spark, sf)
    scaler = stats.scale_stats(data, _LOGGED)
    with released(spark):
        forest = iforest.fit(cut_lineage(stats.apply_scale(data, scaler), "scaled"), _LOGGED, trees=50, contamination=0.98)
        training.save_model(spark, forest, scaler, path, "flows")
    return training.load_model(spark, path)


def _once(flows, identity):
    """One row of each ``identity``: only the identities and the rows of repeated ones are shuffled."""
    repeated = cut_lineage(flows.groupBy(identity).count().filter("count > 1").select(identity), "repeated")
    known = blocklist.maybe_broadcast(repeated)
    single, several = (flows.join(known, identity, how).select(*flows.columns) for how in ("left_anti", "left_semi"))
    return single.unionByName(several.dropDuplicates([identity]))


def _write_slices(spark, sf, path):
    """Dirty flows with payloads as CSV files that follow each other in time, slice by slice; returns slices and files of each."""
    threats = " and ".join(inspect.PATTERNS_B[:3])
    texts = F.when(F.col("packets_out").isin("1", "3"), threats).when(F.col("packets_out") == "2", "GET /index.html HTTP/1.1")
    flows = fx.v_dirty_flows(spark, sf).withColumn("flow_id", F.xxhash64("*"))
    flows = cut_lineage(_once(flows, "flow_id").withColumn("payload", texts), "score-rows")
    edges = sorted({"", "9999", *[str(v) for v in flows.agg(*[F.percentile(F.year("timestamp"), p / 4).cast("int") for p in (1, 2, 3)]).first()]})
    slices = [flows.filter((F.col("timestamp") >= low) & (F.col("timestamp") < high)) for low, high in zip(edges, edges[1:])]
    # all slices have as many files, so that many files at a time are a slice
    each = max(1, min(s.count() for s in slices) // _SCORE_FILE_ROWS)
    for rows in slices:
        # a file of many is read by one task anyway, so it can be packed
        files = rows.coalesce(1).write if each == 1 else rows.repartition(each).write.option("compression", "gzip")
        files.mode("append").option("header", True).csv(path)
    return len(slices), each


@register(
    "e8_score_flows",
    "SELECT true AS some_decided, true AS batching_changes_nothing, true AS hashed_blocklist_agrees, true AS payloads_scanned, true AS verdicts_follow_scores, "
    "true AS every_reason_known FROM lineitem LIMIT 1",
)
def e8(spark, sf):
    """Streamed CSV files, cleaned, scored and decided: one batch and several give the same rows."""
    forest, scaler, _ = _trained(spark, sf)
    path = scratch_path(spark, "score-csv")
    with released(spark):
        slices, each = _write_slices(spark, sf, path)
    entries, trusted, salt = fx.v_blocklist(spark, sf), fx.v_trusted(spark, sf), "a salt of the site"
    hidden = entries.withColumn("ip_address", ip.hash_ip_lenient(F.col("ip_address"), salt))
    columns = ["flow_id", "src_ip", "dst_ip", "prediction", "anomaly_score", "risk_level", "path", "payload_score", "action_reason"]

    def decided(files: int, listed, salt=None):
        stream = src.stream_flow_csv(spark, path, [*FLOW_COLUMNS, "flow_id", "payload"], files, latest_first=False)

        def decide_batch(batch, past):
            scored = scoring.score_flows(clean.clean_flows(batch), forest, scaler)
            return scoring.decide_after(scored, past, listed, trusted, fx.as_of(), salt=salt, columns=columns)

        return run.drain_with_state(stream, decide_batch, "score")

    every = max(100, each * slices)
    one, several, hashed = decided(every, entries), decided(each, entries), decided(every, hidden, salt)
    discard(spark, path)
    rounded = [F.round(c, 9).alias(c) if c in ("anomaly_score", "payload_score") else F.col(c) for c in columns]

    def differing(a, b):
        a, b = a.select(*rounded), b.select(*rounded)
        with released(spark):
            return F.lit(a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())

    listed_reason = F.col("action_reason").rlike("^(Source|Destination) IP .* is blacklisted$")
    anomaly_reason = F.col("action_reason").rlike("^(High-risk anomaly|Anomaly detected): .*score: ")
    return one.agg(
        (F.count(F.lit(1)) > 0).alias("some_decided"),
        differing(one, several).alias("batching_changes_nothing"),
        differing(one, hashed).alias("hashed_blocklist_agrees"),
        (F.count_if(F.col("payload_score").isNotNull()) > 0).alias("payloads_scanned"),
        (F.count_if((F.col("anomaly_score") < 0) != (F.col("prediction") == -1)) == 0).alias("verdicts_follow_scores"),
        (F.count_if(~(listed_reason | ((F.col("prediction") == -1) & anomaly_reason))) == 0).alias("every_reason_known"),
    )
