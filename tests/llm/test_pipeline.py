"""The pipeline on the smallest tables and on planted documents."""

import random

import corpus_pipeline
from flowlake.session import scratch_path


def test_stages_keep_their_contract(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice("the of and on re than with for this inor erble thation ndou".split()) for _ in range(n))
    secret = "token = " + "0123456789abcdef" * 3
    body = prose(300)
    extra = [
        (900_001, "12345 67890", None, None, None), (900_002, None, "en", "s", 0), (900_003, body, "en", "s", 1), (900_004, body, "en", "s", 1),
        (900_005, body + " more", "en", "s", 1), (900_006, prose(80) + " " + item + " " + prose(80), "en", "s", 1), (900_007, prose(120) + " " + secret, "en", "s", 1),
    ]
    docs = docs.limit(60).unionByName(spark.createDataFrame(extra, docs.schema))
    kept, counts = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        path = scratch_path(spark, f"test-{k}")
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        counts.append(kept.count())
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert 900_003 in rows and 900_007 in rows
    assert not {900_001, 900_002, 900_004, 900_005, 900_006} & set(rows)
    assert "0123456789abcdef" not in rows[900_007]["text"] and rows[900_007]["n_chars"] == len(rows[900_007]["text"])
    assert all(r["round_trip"] for r in rows.values()) and counts == sorted(counts, reverse=True)


def test_empty_documents(spark, sf_dir):
    kept = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf_dir)
    assert kept.count() == 0
