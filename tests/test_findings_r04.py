"""Cases of the fourth round: whole jobs on bounded disk."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake import session
from flowlake.ml import classifiers, forest
from flowlake.operators import behaviour
from flowlake.plans import q_models, registry
from flowlake.streaming import run


@pytest.fixture
def scratch(spark):
    """New stage tables below the folder of stage tables, by their labels."""
    root = os.path.dirname(session.scratch_path(spark, "any")).removeprefix("file:")
    os.makedirs(root, exist_ok=True)
    before = set(os.listdir(root))

    def new(label=""):
        return sorted(f"{root}/{name}" for name in set(os.listdir(root)) - before if name.startswith(label))

    new.kinds = lambda: sorted({os.path.basename(path).rsplit("-", 1)[0] for path in new()})
    return new


def test_score_flows_leaves_only_models_and_decisions(spark, sf_dir, scratch):
    out = registry.QUERIES["e8_score_flows"](spark, sf_dir)
    assert scratch.kinds() == ["score", "score-checkpoint", "scoring-model"] and all(out.first())


def test_stage_tables_go_with_their_step(spark, scratch):
    kept = session.cut_lineage(spark.range(5), "kept")
    before = spark.conf.get(session.SHUFFLE_CLEANUP)
    with pytest.raises(ValueError), session.released(spark):
        session.cut_lineage(spark.range(5), "outer")
        with session.released(spark):
            assert session.cut_lineage(spark.range(5).repartition(2), "inner").count() == 5
        assert scratch.kinds() == ["kept", "outer"]
        with session.released(spark, tables=False):
            session.cut_lineage(spark.range(5), "left")
        assert scratch.kinds() == ["kept", "left", "outer"]
        raise ValueError
    assert scratch.kinds() == ["kept"] and kept.count() == 5 and spark.conf.get(session.SHUFFLE_CLEANUP) == before


def test_batches_take_their_state_and_leave_none(spark, scratch, tmp_path):
    for i in range(4):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    def add(batch, past):
        stored = session.cut_lineage(batch if past is None else batch.unionByName(past), "stage")
        return stored.agg(F.sum("id").alias("upto")), stored

    out = run.drain_with_state(stream, add, "t")
    assert sorted(r["upto"] for r in out.collect())[-1] == sum(range(40))
    assert scratch.kinds() == ["t", "t-checkpoint"]


@pytest.mark.parametrize("limit", [10**9, 30])
def test_history_in_rounds_of_needed_rows(spark, scratch, limit):
    rows = [(i, f"10.0.0.{i % 7 if i % 4 else 0}", 1_700_000_000 + 7 * i, math.sin(i)) for i in range(400)]
    flows = spark.createDataFrame(rows, "packet_id int, src_ip string, at long, if_score double").withColumn("ts", F.timestamp_seconds("at"))
    flows = flows.unionByName(spark.sql("SELECT 1000 AS packet_id, CAST(NULL AS string) AS src_ip, 1L AS at, 0.5D AS if_score, current_timestamp() AS ts"))
    wanted = ["packet_id", "mean_score", "ip_flow_count", "twice"]
    whole = behaviour.source_history(flows.filter("src_ip IS NOT NULL"), history=20).withColumn("twice", F.col("mean_score") * 2)
    past, parts = None, []
    for low, high in ((0, 150), (150, 155), (155, 2000)):
        out, past = behaviour.history_after(
            flows.filter(F.col("packet_id").between(low, high - 1)), past, history=20, max_group_rows=limit, rows_at_once=60,
            then=lambda d: d.withColumn("twice", F.col("mean_score") * 2), needed=F.col("twice") > 0, columns=wanted,
        )
        assert sorted(out.columns) == sorted(wanted)
        parts += out.select(*wanted).collect()
    want = {r["packet_id"]: r for r in whole.filter("twice > 0").select(*wanted).collect()}
    assert 0 < len(parts) == len(want) < 400
    for r in parts:
        assert tuple(r) == pytest.approx(tuple(want[r["packet_id"]]))
    stored = [spark.read.parquet(path) for path in scratch("history")]
    assert len(stored) > 3 and all("interval_raw" not in s.columns for s in stored)
    assert sum(s.count() for s in stored) < 500  # of 673 rows of batches and their pasts


def test_repeated_rows_are_taken_once(spark):
    rows = [(i % 50 if i < 80 else i, "x" * (i % 50 if i < 80 else i)) for i in range(200)]
    flows = spark.createDataFrame(rows, "n int, t string").withColumn("flow_id", F.xxhash64("*"))
    out = q_models._once(flows, "flow_id")
    assert out.columns == flows.columns and sorted(map(tuple, out.collect())) == sorted(set(map(tuple, flows.collect())))


def test_intrusion_classifier_leaves_only_its_split_and_predictions(spark, sf_dir, scratch):
    out = registry.QUERIES["m12_intrusion_classifier"](spark, sf_dir)
    assert scratch.kinds() == ["predicted", "split"] and all(out.first())
    assert "row_id" not in spark.read.parquet(scratch("split")[0]).columns


def test_split_of_packed_intrusion_files(spark, sf_dir, scratch, monkeypatch):
    monkeypatch.setattr(q_models, "_INTRUSION_FILE_ROWS", 700)
    split = q_models._split_intrusion(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((F.col("l_orderkey") % 60000 % 10 < 5).cast("int").alias("is_attack")).count()
    want = {(r["is_attack"], s): n for r in rows.collect() for s, n in (("test", math.ceil(r["count"] * 0.2)), ("train", r["count"] - math.ceil(r["count"] * 0.2)))}
    assert {(r["is_attack"], r["split"]): r["count"] for r in split.groupBy("is_attack", "split").count().collect()} == want


def test_an_even_training_table_is_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(classifiers, "BLOCK_NUMBERS", 100 * 7)
    seen = []

    class Watched(classifiers.Pipeline):
        def fit(self, dataset, params=None):
            seen.append([r["count"] for r in dataset.groupBy(F.spark_partition_id()).count().collect()])
            return super().fit(dataset, params)

    monkeypatch.setattr(classifiers, "Pipeline", Watched)
    rows = spark.range(0, 1000, numPartitions=5).select((F.col("id") % 2).alias("is_attack"), *[(F.col("id") * k % 7).alias(f"f{k}") for k in (2, 3)])
    classifiers.intrusion_classifier(rows, ["f2", "f3"], trees=5, depth=2)
    classifiers.intrusion_classifier(rows.coalesce(1), ["f2", "f3"], trees=5, depth=2)
    assert seen[0] == [200] * 5 and sum(seen[1]) == 1000 and max(seen[1]) <= 100


def test_counts_of_a_pass_come_from_as_many_tasks_as_cores(spark):
    rows = spark.range(4000).select(F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("x"), (F.col("id") % 2).cast("double").alias("label"))
    fit = forest.HistogramForest(3, 4, [1.0, 1.0], 2, 7)
    splits = forest._splits(rows)
    blocks = session.cut_lineage(forest._blocks(rows.repartition(23), splits, 2), "blocks")
    spark.sparkContext.setJobGroup("grown", "grown")
    try:
        many = fit._grow(blocks.repartition(23, "block"), 2)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("grown") for s in tracker.getJobInfo(j).stageIds}
    assert max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) <= spark.sparkContext.defaultParallelism
    for p, q in zip(many, fit._grow(blocks.coalesce(1), 2)):
        assert len(p.feature) > 7 and all((x == y).all() for x, y in zip((p.feature, p.bin, p.left, p.counts), (q.feature, q.bin, q.left, q.counts)))


@pytest.mark.parametrize("most, width", [(0, 1), (255, 1), (256, 2), (65535, 2), (65536, 4), (2**32 - 1, 4), (2**32, 8)])
def test_counts_travel_in_as_few_bytes_as_hold_them(most, width):
    counts = np.array([[0.0, min(3.0, most)], [most, min(1.0, most)]])
    narrow = forest._narrow(counts)
    assert narrow.itemsize == width and forest._WIDTHS[width] == narrow.dtype and (narrow == counts).all()
