"""Small windows of sequential learners in blocks: the same versions as one job a window, in fewer jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelearn.params import MixtureParams, SvmParams, TopicParams
from tidelearn.plans import blocks, mixture, topics
from tidelearn.plans.mixture import GrowingMixture
from tidelearn.plans.svm import OnlineSvm
from tidelearn.plans.topics import TopicModel


def stream(spark, n=400, seed=3):
    """Two models; the second ends early.  Some rows have no label."""
    rng = np.random.default_rng(seed)
    label = rng.integers(1, 4, size=n)
    x = np.array([[0, 0], [8, 0], [0, 8]])[label - 1] + rng.normal(size=(n, 2))
    rows = [(i, i % 2, None if i % 7 == 3 else float(label[i]), x[i].tolist()) for i in range(n) if i % 2 == 0 or i < n // 2]
    return spark.createDataFrame(rows, "seq long, model_id int, label double, features array<double>").repartition(3)


def jobs(spark, run):
    """What ``run`` returns, collected, and the number of Spark jobs."""
    group = f"blocks-{np.random.default_rng().integers(1 << 40)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = {(r.model_id, r.version): r for r in run().collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def same(a, b):
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    return np.isclose(a, b, atol=1e-9) if isinstance(a, float) else a == b


def both(spark, monkeypatch, module, name, run, least):
    monkeypatch.setattr(module, name, least)
    got, few = jobs(spark, run)
    monkeypatch.setattr(module, name, 0)
    want, many = jobs(spark, run)
    assert got.keys() == want.keys() and len(got) > 10
    for key in got:
        assert same(tuple(got[key]), tuple(want[key])), key
    return few, many


def test_mixture_blocks(spark, monkeypatch):
    learner = GrowingMixture(MixtureParams(dimension=2, window=20, max_components=6, split_above=4.0))
    rows = stream(spark)
    few, many = both(spark, monkeypatch, mixture, "BLOCK_ROWS", lambda: learner.fit(rows), 65)
    assert few < many / 2


@pytest.mark.parametrize("merge", ["count", "step"])
def test_svm_blocks(spark, monkeypatch, merge):
    learner = OnlineSvm(SvmParams(dimension=2, window=20, step=0.3, step_intercept=0.2, merge=merge))
    rows = stream(spark).withColumn("label", F.col("label") - 2)
    few, many = both(spark, monkeypatch, blocks, "BLOCK_ROWS", lambda: learner.fit(rows), 65)
    assert few < many


@pytest.mark.parametrize("merge", ["count", "step"])
def test_svm_round_blocks(spark, monkeypatch, merge):
    learner = OnlineSvm(SvmParams(dimension=2, window=5, shards=2, step=0.3, step_intercept=0.2, merge=merge))
    rows = stream(spark).withColumn("label", F.col("label") - 2)
    few, many = both(spark, monkeypatch, blocks, "BLOCK_ROWS", lambda: learner.fit_sharded(rows, steps=2), 65)
    assert few < many


@pytest.mark.parametrize("start", [False, True])
def test_topic_blocks(spark, monkeypatch, start):
    rng = np.random.default_rng(5)
    cells = [(d, int(w), int(rng.integers(1, 4))) for d in range(95) for w in rng.choice(12, 4, replace=False) if d % 9]
    counts = spark.createDataFrame(cells, "doc_id long, word_id long, cnt long").repartition(3)
    vocab = spark.range(12).select(F.col("id").alias("word_id"))
    model = TopicModel(TopicParams(topics=3))
    first = model.start(vocab).withColumn("weight", F.col("weight") * 2) if start else None

    def run():
        return model.fit(counts, vocab, 7, first).selectExpr("struct(topic, word_id) AS model_id", "version", "n", "weight")

    few, many = both(spark, monkeypatch, topics, "BLOCK_DOCS", run, 29)
    assert few < many / 2


def test_window_of_fewer_documents_than_tasks(spark):
    counts = spark.createDataFrame([(1, 0, 2), (1, 1, 1)], "doc_id long, word_id long, cnt long")
    model = TopicModel(TopicParams(topics=2))
    first = model.start(spark.range(3).select(F.col("id").alias("word_id")))
    sums = model.e_step(first).sstats(counts).groupBy("word_id").agg(F.round(F.sum("s"), 6)).collect()
    assert {tuple(r) for r in sums} == {(0, 2.0), (1, 1.0)}
