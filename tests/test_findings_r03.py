"""Cases of the third round: whole jobs in bounded memory, and each line parsed once."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowlake.ml import classifiers, forest, iforest
from flowlake.operators import police, stats
from flowlake.plans import q_clean, q_models, registry
from flowlake.schemas import FLOW_COLUMNS, ROUTER_FEATURES
from flowlake.sources import flows
from flowlake.streaming import run, stateful


@pytest.mark.parametrize("missed", [False, True])
def test_quantiles_rank_only_values_near_the_wanted_ranks(spark, monkeypatch, missed):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=4000), np.full(1500, 0.25), [np.inf, -np.inf]])
    df = spark.createDataFrame([(float(v),) for v in rng.permutation(values)], "v double")
    full, ranked = stats.running_totals, []
    monkeypatch.setattr(stats, "running_totals", lambda *a: ranked.append(1) or full(*a))
    if missed:  # a sketch that brackets the wrong values
        monkeypatch.setattr(type(df), "approxQuantile", lambda self, c, p, e: [0.25] * len(p), raising=False)
    wanted = [0.01, 0.2, 0.5, 0.77, 0.99]
    assert stats.exact_quantiles(df, "v", wanted, 0) == pytest.approx(list(np.quantile(values, wanted)))
    assert bool(ranked) == missed


def test_training_lines_are_parsed_once(spark, tmp_path):
    names = list(FLOW_COLUMNS)
    row = {"timestamp": "2024-01-02 03:04:05", "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "protocol": "TCP"}
    for at, order in enumerate((names, names[::-1])):
        (tmp_path / f"{at}.csv").write_text("\n".join([",".join(order), ",".join(row.get(n, str(at + 1)) for n in order), ""]))
    (tmp_path / "short.csv").write_text("src_ip\n10.0.0.9\n")
    out = flows.scan_training_csvs(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") == 2  # one per header
    assert sorted((r["src_ip"], r["bytes_in"], r["duration"]) for r in out.collect()) == [("10.0.0.1", 1, 1.0), ("10.0.0.1", 2, 2.0)]


def test_forest_repeats_over_other_partitions_is_part_of_the_query():
    assert "repeat_equal" in registry.ORACLES["m6_isolation_forest"]


def test_scores_are_plain_columns_and_equal_a_walk(spark):
    df = spark.range(500).select(F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"))
    hole = df.unionByName(spark.sql("SELECT CAST(NULL AS double) AS a, double('inf') AS b"))
    forest = iforest.fit_forests(df, ["a", "b"], [iforest.ForestSpec(7, 64)])[0]
    rows = hole.select("a", "b", forest.score_samples().alias("s")).collect()
    for r in rows[::50] + rows[-1:]:
        total = 0.0
        for _, t in forest.nodes.groupby("tree"):
            nodes, at = t.set_index("node"), 0
            while nodes.loc[at, "feature"] >= 0:
                x = r["ab"[int(nodes.loc[at, "feature"])]]
                at = int(nodes.loc[at, "right_node" if x is not None and x > nodes.loc[at, "threshold"] else "left_node"])
            total += nodes.loc[at, "depth"]
        assert r["s"] == pytest.approx(-(2 ** (-total / (7 * float(iforest.average_path(64))))), abs=1e-12)


@pytest.mark.parametrize("bad_rows", [0, 1, 400])
def test_every_broken_file_is_left_out_whatever_the_number_of_files(spark, tmp_path, bad_rows):
    text = F.when(F.col("id") < bad_rows, "many").otherwise("7").alias("bytes_out")
    rows = spark.range(1000).select(*[text if c == "bytes_out" else F.col("id").cast("string").alias(c) for c in FLOW_COLUMNS])
    path = str(tmp_path / "csv")
    q_clean._write_broken(rows, F.col("bytes_out") == "many", path, file_rows=50)
    assert flows.scan_flow_csv(spark, path, FLOW_COLUMNS, malformed="skip_file").count() == (0 if bad_rows else 1000)
    files = spark.read.text(path).groupBy("_metadata.file_path").count().filter("count > 1").count()  # with a row below the header
    assert files == 1 if bad_rows == 1 else files > 5


def test_payload_histograms_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(classifiers, "HISTOGRAM_BYTES", 7)
    data = bytes(np.random.default_rng(3).integers(0, 256, 50).astype(np.uint8))
    single, double = classifiers._byte_counts(data, 64)
    raw = np.frombuffer(data, dtype=np.uint8).astype(int)
    assert (single == np.bincount(raw, minlength=256)).all()
    assert (double == np.bincount((raw[:-1] * 31 + raw[1:] * 17) % 64, minlength=64)).all()
    df = spark.range(700).select(F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("p"))
    got = df.coalesce(1).select("p", classifiers.payload_features(F.col("p"), 16).alias("h")).collect()  # several pieces of a batch
    assert len(got) == 700 and all(sum(r["h"][:256]) == pytest.approx(1 if r["p"] else 0) for r in got)


def test_stream_policing_of_a_busy_source_hands_on_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "POLICE_ROWS", 100)
    stamps = F.timestamp_micros(F.col("id") * 7_919 % 1_000_003)
    rows = spark.range(950).select(F.col("id").alias("packet_id"), stamps.alias("ts"), F.lit("10.0.0.1").alias("src_ip"), (F.col("id") % 90).alias("packet_size"))
    rows.write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "p"))
    got = {r["packet_id"]: r["passed"] for r in run.drain(stateful.rate_police(stream, 1500, 2000), "t").collect()}
    want = {r["packet_id"]: r["passed"] for r in police.rate_police(rows, rate=1500, capacity=2000).collect()}
    assert got == want and len(set(want.values())) == 2


def test_score_flows_in_several_files_a_slice(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(q_models, "_SCORE_FILE_ROWS", 300)
    assert all(registry.QUERIES["e8_score_flows"](spark, sf_dir).first())


def test_a_large_training_table_comes_in_even_blocks(spark, monkeypatch):
    monkeypatch.setattr(classifiers, "BLOCK_NUMBERS", 100 * (len(ROUTER_FEATURES) + 5))
    seen = []

    class Watched(classifiers.Pipeline):
        def fit(self, dataset, params=None):
            seen.append([r["count"] for r in dataset.groupBy(F.spark_partition_id()).count().collect()])
            return super().fit(dataset, params)

    monkeypatch.setattr(classifiers, "Pipeline", Watched)
    rows = spark.range(1001).coalesce(1).select((F.col("id") % 3).alias("label"), *[(F.col("id") * (i + 2) % 7).alias(f) for i, f in enumerate(ROUTER_FEATURES)])
    classifiers.router_train(rows, rows, trees=5, depth=2)
    classifiers.intrusion_classifier(rows.withColumn("is_attack", F.col("label") % 2), ROUTER_FEATURES, trees=5, depth=2)
    assert [sum(s) for s in seen] == [1001, 1001] and all(max(s) <= 100 for s in seen)
    few = rows.limit(90)
    classifiers.router_train(few, rows.limit(90), trees=5, depth=2, least_samples=10)
    assert seen[2] == [90]


def test_class_forest_is_the_same_in_any_number_of_passes(spark, monkeypatch):
    columns = [F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"), (F.col("id") % 5).cast("double").alias("c")]
    df = spark.range(3000).select(*columns).withColumn("label", ((F.col("a") > 0.2) != (F.col("c") > 2)).cast("double"))
    df = df.withColumn("features", array_to_vector(F.array("a", "b", "c")))
    one = forest.HistogramForest(6, 5, [1.0, 2.0], 2, 7).fit(df)
    monkeypatch.setattr(forest, "PASS_CELLS", 3 * 2 * forest.BINS * 2)  # three nodes a pass
    monkeypatch.setattr(forest, "CHUNK_CELLS", 2 * 2 * forest.BINS * 2)
    two = forest.HistogramForest(6, 5, [1.0, 2.0], 2, 7).fit(df)
    for p, q in zip(one.trees, two.trees):
        assert all((x == y).all() for x, y in zip((p.feature, p.bin, p.left, p.counts), (q.feature, q.bin, q.left, q.counts)))
        inner = np.flatnonzero(p.feature >= 0)
        assert len(inner) and (p.counts[p.left[inner]] + p.counts[p.left[inner] + 1] == p.counts[inner]).all()
        assert p.counts.sum(axis=1).min() >= 2 and abs(p.counts[0].sum() - 3000) < 300  # every row once on average
    rows = one.transform(df).select("a", "b", "c", "label", "prediction", vector_to_array("probability").alias("p")).collect()
    for r in rows[::100]:
        share = np.zeros(2)
        for t in one.trees:
            at = 0
            while t.feature[at] >= 0:
                at = t.left[at] + int(r["abc"[t.feature[at]]] > one.splits[t.feature[at]][t.bin[at]])
            share += t.counts[at] * [1, 2] / (t.counts[at] * [1, 2]).sum()
        assert r["p"] == pytest.approx(list(share / 6)) and r["prediction"] == share.argmax()
    assert np.mean([r["label"] == r["prediction"] for r in rows]) > 0.95


def test_class_forest_takes_the_best_split_of_all(spark):
    rng = np.random.default_rng(4)
    counts = np.stack([rng.integers(0, 6, (5, forest.BINS, 3)).astype(float)] * 2, axis=1)
    counts[:, 1] = rng.permuted(counts[:, 1], axis=1)  # the same rows in the bins of another feature
    counts[4] = 0
    counts[4, :, 3, 1] = 9  # pure
    weights = np.array([1.0, 0.5, 3.0])
    gini = lambda c: 1 - ((c * weights / (c * weights).sum()) ** 2).sum()
    place, last, left, total = forest.best_splits(counts, weights, 40)
    for node in range(4):
        gains = {}
        for s in range(2):
            for b in range(forest.BINS - 1):
                low, high = counts[node, s, : b + 1].sum(axis=0), counts[node, s, b + 1 :].sum(axis=0)
                if min(low.sum(), high.sum()) >= 40:
                    size = [(c * weights).sum() for c in (low, high)]
                    gains[s, b] = gini(low + high) - (size[0] * gini(low) + size[1] * gini(high)) / sum(size)
        assert gains[place[node], last[node]] == pytest.approx(max(gains.values()))
        assert (left[node] == counts[node, place[node], : last[node] + 1].sum(axis=0)).all() and (total[node] == counts[node, 0].sum(axis=0)).all()
    assert place[4] == -1


def test_thresholds_split_rare_values_and_even_ranks(spark):
    rare = spark.range(5000).select(F.array((F.col("id") == 9).cast("double"), F.col("id").cast("double")).alias("x"))
    cuts = forest._splits(rare)
    assert list(cuts[0]) == [0.5] and len(cuts[1]) == forest.BINS - 1
    assert np.abs(cuts[1] - 5000 * np.arange(1, forest.BINS) / forest.BINS).max() < 5000 * 3 / forest.RANKS
