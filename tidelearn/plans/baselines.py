"""Batch baselines on Spark ML, and matrix factorisation of tf-idf rows."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from tidelearn.functions.noise import uniform
from tidelearn.operators import topics as tp
from tidelearn.params import TopicParams
from tidelearn.plans.topics import TopicModel
from tidelearn.session import materialize


def _vectors(rows: DataFrame, label) -> DataFrame:
    return rows.select(label.cast("double").alias("label"), array_to_vector("features").alias("features"))


def _weights(spark, coef, intercept: float) -> DataFrame:
    return spark.createDataFrame(
        [([float(c) for c in coef], float(intercept))], "weights array<double>, intercept double"
    )


def linear_svc(rows: DataFrame, reg: float = 1e-4, passes: int = 100) -> DataFrame:
    """Linear support vector classifier on all labelled rows."""
    model = LinearSVC(regParam=reg, maxIter=passes, standardization=False).fit(
        _vectors(rows, F.when(F.col("label") > 0, 1.0).otherwise(0.0))
    )
    return _weights(rows.sparkSession, model.coefficients, model.intercept)


def linear_regression(rows: DataFrame, penalty: float, l1: bool, intercept: bool = False) -> DataFrame:
    """Least squares with an L1 or L2 penalty on the summed (not averaged) loss; penalty 0 is plain."""
    vectors = _vectors(rows, F.col("label"))
    n, spread = vectors.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    # Spark divides the label by its deviation first, which scales an L2 penalty.
    reg = penalty / n if l1 else penalty / n * (spread or 1.0)
    model = LinearRegression(
        regParam=reg, elasticNetParam=1.0 if l1 else 0.0, standardization=False, fitIntercept=intercept,
        maxIter=1000, tol=1e-12,
    ).fit(vectors)
    return _weights(rows.sparkSession, model.coefficients, model.intercept)


def batch_lda(counts: DataFrame, vocab: DataFrame, topics: int = 10, passes: int = 5, seed: int = 0) -> DataFrame:
    """Topics of ``(doc_id, word_id, cnt)`` after whole passes: ``(topic, word, weight)``.

    Every pass solves every document against the topics of the pass before and builds the topics anew from all of them.
    Documents are gathered once, for all passes.
    """
    model = TopicModel(TopicParams(topics=topics, seed=seed))
    state = materialize(model.start(vocab), "lda-start")
    docs = materialize(tp.pack_documents(counts), "lda-documents")
    for k in range(passes):
        step = model.e_step(state)
        sstats = step.sstats(tp.unpack_documents(docs), docs)
        state = materialize(tp.blend(state, sstats, 1.0, model.params.eta, 1.0), f"lda-{k}")
        step.release()
    return state.join(vocab, "word_id").select("topic", "word", "weight")


def _refine(part: np.ndarray, cross: np.ndarray, gram: np.ndarray, l1: float, l2: float, steps: int) -> np.ndarray:
    """Multiplicative steps that lower the loss of ``part`` against fixed other factors."""
    for _ in range(steps):
        part = part * cross / (part @ gram + l1 + l2 * part + 1e-12)
    return part


def batch_nmf(
    weights: DataFrame, vocab: list[str], topics: int = 10, passes: int = 100, alpha: float = 0.1, l1_ratio: float = 0.5, seed: int = 1,
    tolerance: float = 1e-3,
) -> DataFrame:
    """Non-negative factors of ``(doc_id, word, tfidf)``: ``(topic, word, weight)``.

    The word factors (topics x vocabulary, both bounded) travel to the tasks;
    document factors are solved where the documents lie.  A pass sends back one
    partial sum per task, so nothing grows with the number of documents.  Passes end
    when the squared error falls by less than ``tolerance`` of itself; after ``passes`` without that a warning is given.
    """
    spark = weights.sparkSession
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    place = spark.createDataFrame(list(enumerate(vocab)), "w int, word string")
    cells = weights.join(place, "word").groupBy("doc_id").agg(
        F.collect_list("w").alias("ids"), F.collect_list("tfidf").alias("vals")
    )
    docs = materialize(cells, "nmf-documents")
    draws = place.select("w", F.explode(F.sequence(F.lit(0), F.lit(topics - 1))).alias("topic"))
    unit = uniform(F.concat_ws("-", F.col("topic").cast("string"), F.col("w").cast("string")), seed, 0)
    start = draws.select("topic", "w", unit.alias("u")).orderBy("topic", "w").collect()
    h = np.array([r["u"] for r in start]).reshape(topics, len(vocab))
    norm = docs.select(F.sum(F.aggregate("vals", F.lit(0.0), lambda s, v: s + v * v))).first()[0] or 0.0
    last = None
    for _ in range(passes):
        packet = spark.sparkContext.broadcast(h)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            h = packet.value
            gram = h @ h.T
            cross, square = np.zeros_like(h), np.zeros((topics, topics))
            for pdf in batches:
                doc = np.repeat(np.arange(len(pdf)), pdf["ids"].map(len).to_numpy())
                ids = np.concatenate(pdf["ids"].to_list())
                vals = np.concatenate(pdf["vals"].to_list())
                xh = np.zeros((len(pdf), topics))
                starts = np.flatnonzero(np.diff(doc, prepend=-1))
                xh[doc[starts]] = np.add.reduceat(vals[:, None] * h.T[ids], starts)
                w = _refine(np.full_like(xh, 0.1), xh, gram, l1, l2, 50)
                order = np.argsort(ids, kind="stable")
                first = np.flatnonzero(np.diff(ids[order], prepend=-1))
                cross.T[ids[order][first]] += np.add.reduceat((vals[:, None] * w[doc])[order], first)
                square += w.T @ w
            out = np.concatenate([cross, square], axis=1)
            yield pd.DataFrame({"topic": range(topics), "v": list(out)})

        parts = docs.mapInPandas(run, "topic int, v array<double>").select("topic", F.posexplode("v").alias("i", "v"))
        sums = parts.groupBy("topic", "i").agg(F.sum("v").alias("v")).orderBy("topic", "i").collect()
        both = np.array([r["v"] for r in sums]).reshape(topics, len(vocab) + topics)
        cross, square = both[:, : len(vocab)], both[:, len(vocab):]
        error = norm - 2 * (cross * h).sum() + (square * (h @ h.T)).sum()
        if last is not None and last - error <= tolerance * last:
            break
        last = error
        h = _refine(h.T, cross.T, square, l1, l2, 1).T
        packet.unpersist()
    else:
        warnings.warn(f"factors still moved after {passes} passes", stacklevel=2)
    out = [(k, w, float(h[k, i])) for k in range(topics) for i, w in enumerate(vocab)]
    return spark.createDataFrame(out, "topic int, word string, weight double")
