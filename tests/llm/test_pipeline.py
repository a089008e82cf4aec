"""The pipeline's stages, each against what it may do to its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, brute_words, corpus


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame([r for r in corpus() if r[0] is not None][:-2], DOCS)
    docs = docs.withColumn("lang", F.lit("en"))
    kept = docs
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        stage(spark, kept, "").write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before, kept)
        if name != "bpe":
            assert kept.columns == list(corpus_pipeline.COLUMNS)
    before, after = seen["near_dedup"]
    ids = {r["doc_id"] for r in after.collect()}
    assert {3, 4, 5} <= ids and not {30, 31} & ids
    before, after = seen["substring_dedup"]
    expected = {d: (n, gone, text) for (d, n, gone, text) in brute_words([(d, t) for d, t in before.items()])}
    got = {r["doc_id"]: r["text"] for r in after.collect()}
    assert set(got) == {d for d, (n, gone, _) in expected.items() if n > gone}
    assert all(t == (expected[d][2] if expected[d][1] else before[d]) for d, t in got.items())
    before, after = seen["mixing"]
    assert {r["doc_id"] for r in after.collect()} <= set(before)
    before, after = seen["bpe"]
    assert after.count() >= len(before) and after.where("size(ids) <> n_tokens").count() == 0


def test_near_dedup_decides_per_row(spark):
    one, two = (" ".join(f"{a}{k * k}" for k in range(80)) for a in "pq")
    rows = [(1, one, "en", "a", 9), (1, two, "en", "a", 9), (1, two, "en", "a", 9), (1, two, "en", "b", 9), (2, one, "en", "a", 9)]
    for _ in range(2):
        out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect()
        assert sum(r["text"] == one for r in out) == 1 and sum(r["text"] == two for r in out) == 1 and len(out) == 2
        assert {r["doc_id"] for r in out if r["text"] == one} == {1}


def test_run(spark, tmp_path):
    spark.createDataFrame(corpus(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[0] == "doc_id"
