"""Supervised jobs on MLlib: the router, the intrusion classifier and payload models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions.payload import payload_vector
from flowlake.ml import forest
from flowlake.operators import decide, stats
from flowlake.schemas import ROUTER_FEATURES

MIN_REAL_SAMPLES = 200
MAX_LABELS = 1000
# Rows whose histograms a task holds at once, and payload bytes counted at once.
HISTOGRAM_ROWS = 256
HISTOGRAM_BYTES = 1 << 20
# Numbers of a block of training rows: a forest keeps each row's bins and its count in every tree's bag.
BLOCK_NUMBERS = 36_000_000
PATHS = ["pass", "if_only", "escalate"]


def _filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature columns as doubles; a missing column or value counts as zero."""
    have = set(df.columns)
    return df.withColumns(
        {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0) for f in features}
    )


def _in_blocks(ready: DataFrame, rows: int, features: int, trees: int) -> DataFrame:
    """Deal the rows of a large training table out evenly, so that a task's cached share does not grow with the table.

    Files are packed into about one partition per core, however many rows they hold. A table of one block is left as it is;
    more blocks come in whole rounds of the cores.
    """
    each = max(1, BLOCK_NUMBERS // (features + trees))
    if rows <= each:
        return ready
    cores = ready.sparkSession.sparkContext.defaultParallelism
    return ready.repartition(-(-rows // (each * cores)) * cores)


def _is_even(ready: DataFrame, rows: int) -> bool:
    """Whether no partition holds more than two cores' share of the rows."""
    most = ready.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    return (most or 0) * ready.sparkSession.sparkContext.defaultParallelism <= 2 * rows


def router_train(
    samples: DataFrame,
    rows: DataFrame,
    trees: int = 100,
    depth: int = 4,
    kind: str = "forest",
    seed: int = 42,
    least_samples: int = MIN_REAL_SAMPLES,
) -> tuple[PipelineModel, str]:
    """Three-class routing model from labelled samples.

    With fewer than ``least_samples`` samples, ``rows`` labelled by the routing rules are used
    instead. ``kind="boosted"`` fits one boosted model per class.
    """
    enough = samples.limit(least_samples).count() >= least_samples
    source = "real" if enough else "bootstrap"
    data = samples if enough else rows.withColumn("label", decide.rule_label(rows))
    if kind == "boosted":
        model = OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed), labelCol="label")
    else:
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label")
    assembler = VectorAssembler(inputCols=ROUTER_FEATURES, outputCol="features")
    ready = _filled(data, ROUTER_FEATURES).select(*ROUTER_FEATURES, F.col("label").cast("double").alias("label"))
    blocks = _in_blocks(ready, data.count(), len(ROUTER_FEATURES), trees)
    return Pipeline(stages=[assembler, model]).fit(blocks), source


def router_evaluation(model: PipelineModel, samples: DataFrame) -> DataFrame:
    """Training accuracy and rows per label."""
    predicted = model.transform(_filled(samples, ROUTER_FEATURES))
    hit = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    return predicted.agg(
        F.round(hit, 4).alias("train_accuracy"),
        F.count(F.lit(1)).alias("n_samples"),
        *[F.count_if(F.col("label") == i).alias(f"label_{name}") for i, name in enumerate(PATHS)],
    )


def route_scores(model: PipelineModel, features: DataFrame) -> DataFrame:
    """``features`` with the probability of every path in ``p``."""
    return model.transform(_filled(features, ROUTER_FEATURES)).withColumn("p", vector_to_array("probability"))


def route_model(model: PipelineModel | None, features: DataFrame) -> DataFrame:
    """Path and confidence by the trained model, with the rules as fallback without one."""
    if model is None:
        return decide.route_flows(features)
    kept = [c for c in features.columns if c not in ROUTER_FEATURES]
    scored = model.transform(_filled(features, ROUTER_FEATURES))
    label = F.col("prediction").cast("int")
    best = F.array_max(vector_to_array("probability"))
    route = F.struct(
        F.coalesce(F.get(F.array(*[F.lit(p) for p in PATHS]), label), F.lit("if_only")).alias("path"), best.alias("confidence")
    )
    has_payload = F.col("payload_available") == 1
    routed = scored.withColumn("_route", decide.route_downgrade(route, has_payload)).select(
        *kept, *ROUTER_FEATURES, "_route"
    )
    return decide._decision_columns(routed, F.lit(False))


def intrusion_classifier(
    train: DataFrame, features: Sequence[str], label: str = "is_attack", trees: int = 100, depth: int = 15, seed: int = 42
) -> tuple[PipelineModel, dict]:
    """Class-balanced random forest over standardised features."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().limit(MAX_LABELS + 1).collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} classes in {label}")
    total = sum(counts.values())
    known = {int(float(value)): total / (len(counts) * n) for value, n in counts.items() if value is not None}
    weights = [known.get(i, 0.0) for i in range(max(known, default=-1) + 1)]
    filled = _filled(train, features)
    scaler = stats.scale_stats(filled, features)
    scaled = stats.apply_scale(filled, scaler).select(*features, F.col(label).cast("double").alias("label"))
    model = forest.HistogramForest(trees, depth, weights, least_rows=2, seed=seed)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    # This forest keeps no partition in memory: rows are dealt out for even tasks only, as that shuffles them all.
    even = scaled if _is_even(scaled, total) else _in_blocks(scaled, total, len(features), trees)
    return Pipeline(stages=[assembler, model]).fit(even), scaler


def intrusion_predict(model: PipelineModel, scaler: dict, df: DataFrame) -> DataFrame:
    scaled = stats.apply_scale(_filled(df, list(scaler)), scaler)
    return model.transform(scaled).withColumns(
        {"pred": F.col("prediction").cast("int"), "attack_probability": vector_to_array("probability")[1]}
    )


def _byte_counts(data: bytes, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the bytes and of the hashed byte pairs, piece by piece: indices take 8 bytes a byte."""
    raw = np.frombuffer(data, dtype=np.uint8)
    single, double = np.zeros(256, dtype=np.int64), np.zeros(pairs, dtype=np.int64)
    for first in range(0, len(raw), HISTOGRAM_BYTES):
        piece = raw[first : first + HISTOGRAM_BYTES + 1].astype(np.int64)  # and the byte that ends its last pair
        single += np.bincount(piece[:HISTOGRAM_BYTES], minlength=256)
        double += np.bincount((piece[:-1] * 31 + piece[1:] * 17) % pairs, minlength=pairs)
    return single, double


def payload_features(payload: Column, pairs: int = 1024) -> Column:
    """Byte histogram and hashed byte-pair histogram of the whole payload, as shares."""

    @F.pandas_udf("array<float>")
    def histogram(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            for first in range(0, len(values), HISTOGRAM_ROWS):
                part = values.iloc[first : first + HISTOGRAM_ROWS]
                out = np.zeros((len(part), 256 + pairs), dtype=np.float32)
                for row, data in enumerate(part):
                    if data:
                        single, double = _byte_counts(data, pairs)
                        out[row, :256] = single / len(data)
                        if len(data) > 1:
                            out[row, 256:] = double / (len(data) - 1)
                yield pd.Series(list(out))

    return histogram(payload.cast("binary"))


def payload_train(labelled: DataFrame, payload: str = "payload", label: str = "y", regularisation: float = 0.01) -> PipelineModel:
    """Logistic model of malicious payloads over whole-payload byte statistics."""
    ready = labelled.select(
        array_to_vector(payload_features(F.col(payload)).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("label"),
    )
    return Pipeline(stages=[LogisticRegression(regParam=regularisation, maxIter=50)]).fit(ready)


def payload_score(model: PipelineModel, df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add base_score: the model's probability of the malicious class."""
    vector = array_to_vector(payload_features(F.col(payload)).cast("array<double>"))
    scored = model.transform(df.withColumn("features", vector))
    return scored.withColumn("base_score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def payload_reconstruction(df: DataFrame, payload: str = "payload", size: int = 128, components: int = 16) -> DataFrame:
    """Add reconstruction_error and max_error of a principal-component round trip.

    Payloads are read whole, in blocks of ``size`` bytes (the last one padded
    with zeros; an empty or NULL payload is one block of zeros). The axes are
    fitted on the blocks of all payloads; a payload has the mean and the largest
    of its blocks' mean squared errors.
    """
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(data), F.lit(1)), F.lit(size))
    blocks = df.select(data.alias("_data"), F.explode(starts).alias("_at")).select(F.substring("_data", F.col("_at"), F.lit(size)).alias("_b"))
    fitted = blocks.select(array_to_vector(payload_vector(F.col("_b"), size).cast("array<double>")).alias("_v"))
    model = PCA(k=components, inputCol="_v", outputCol="_p").fit(fitted)
    mean = fitted.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
    axes = model.pc.toArray()

    @F.pandas_udf("mean double, max double")
    def errors(values: pd.Series) -> pd.DataFrame:
        out = []
        for raw in values:
            bytes_ = np.zeros(max(1, -(-len(raw) // size)) * size)
            bytes_[: len(raw)] = np.frombuffer(raw, dtype=np.uint8) / 255.0
            x = bytes_.reshape(-1, size) - mean
            each = ((x - x @ axes @ axes.T) ** 2).mean(axis=1)
            out.append((each.mean(), each.max()))
        return pd.DataFrame(out, columns=["mean", "max"])

    scored = df.withColumn("_e", errors(data))
    return scored.withColumns({"reconstruction_error": F.col("_e.mean"), "max_error": F.col("_e.max")}).drop("_e")
