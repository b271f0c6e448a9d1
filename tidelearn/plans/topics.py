"""Online variational topic model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidelearn.functions.noise import uniform
from tidelearn.functions.special import digamma_np
from tidelearn.operators import topics as tp
from tidelearn.operators.windows import count_windows
from tidelearn.params import TopicParams
from tidelearn.plans import blocks
from tidelearn.plans.learner import Stage, need_columns
from tidelearn.session import materialize, new_path
from tidelearn.streaming.store import ModelStore

# Documents in a block of windows, at most.
BLOCK_DOCS = 1 << 14


class TopicModel(Stage):
    """Topics updated window by window from word counts ``(doc_id, word_id, cnt)``."""

    def __init__(self, params: TopicParams = TopicParams()):
        self.params = params

    def start(self, vocab: DataFrame) -> DataFrame:
        """Repeatable start: ``eta`` plus a uniform draw for every topic and word."""
        p = self.params
        cells = vocab.select("word_id", F.explode(F.sequence(F.lit(0), F.lit(p.topics - 1))).alias("topic"))
        draw = uniform(F.concat_ws("-", F.col("topic").cast("string"), F.col("word_id").cast("string")), p.seed, 0)
        return cells.select("topic", "word_id", (F.lit(p.eta) + draw).alias("weight"))

    def e_step(self, topics: DataFrame) -> tp.EStep:
        p = self.params
        return tp.EStep(topics, p.alpha, p.passes, p.tolerance)

    def rate(self, t: int) -> float:
        """Weight of window ``t`` (from 0) against the topics learned so far."""
        return (self.params.offset + t + 1) ** (-self.params.decay)

    def update_topics(
        self, counts: DataFrame, topics: DataFrame, t: int, n_docs: int | None = None, corpus: int | None = None
    ) -> DataFrame:
        """The topics after one window of documents; ``corpus`` is the number of all documents (default: the window's own)."""
        p = self.params
        if n_docs is None:
            n_docs = counts.select("doc_id").distinct().count()
        if n_docs == 0:
            return topics
        sstats = self.e_step(topics).sstats(counts)
        return tp.blend(topics, sstats, self.rate(t), p.eta, (p.documents or corpus or n_docs) / n_docs)

    def fit(self, counts: DataFrame, vocab: DataFrame, window: int, start: DataFrame | None = None, **override) -> DataFrame:
        """Versions ``(version, n, topic, word_id, weight)``, one per window of documents."""
        need_columns(counts, self, "doc_id", "word_id", "cnt")
        me = self.with_params(**override)
        spark = counts.sparkSession
        counts = materialize(counts, "topic-counts")
        docs = count_windows(counts.select("doc_id").distinct(), window, order="doc_id")
        store = ModelStore(spark, new_path(spark, "topic-models"))
        topics, seen = materialize(start if start is not None else me.start(vocab), "topic-start"), 0
        span = blocks.span(window, BLOCK_DOCS)
        if span > 1 and tp.sendable(topics):
            return me._by_blocks(counts.join(docs, "doc_id"), topics, span, store)
        placed = materialize(counts.join(docs, "doc_id"), "topic-windows", ["window_id"])
        sizes = {r[0]: r[1] for r in docs.groupBy("window_id").count().collect()}
        corpus = sum(sizes.values())
        for t in sorted(sizes):
            batch = placed.filter(F.col("window_id") == t).select("doc_id", "word_id", "cnt")
            seen += sizes[t]
            new = me.update_topics(batch, topics, t, sizes[t], corpus)
            store.write(new.withColumn("n", F.lit(seen).cast("long")), t)
            topics = store.read(t).select("topic", "word_id", "weight")
        return store.all()

    def _by_blocks(self, placed: DataFrame, topics: DataFrame, span: int, store: ModelStore) -> DataFrame:
        """Versions of small windows: a job takes the windows of a block, whose documents one task solves a window at a time."""
        spark, p = placed.sparkSession, self.params
        lists = [F.collect_list("word_id").alias("ids"), F.collect_list("cnt").alias("cnts")]
        packed = placed.groupBy("window_id", "doc_id").agg(*lists).withColumn("bucket", F.expr(f"window_id div {span}"))
        packed = materialize(packed, "topic-documents", ["bucket"])
        last, corpus = packed.agg(F.max("window_id"), F.count(F.lit(1))).first()
        kind, seen = dict(topics.dtypes), 0
        schema = f"topic {kind['topic']}, word_id {kind['word_id']}, weight double, n bigint, version bigint"
        for low in range(0, (-1 if last is None else last) + 1, span):
            high = min(low + span - 1, last)
            cells = topics.select("word_id", "topic", "weight").toPandas().sort_values(["word_id", "topic"])
            ids, names = cells["word_id"].unique(), np.sort(cells["topic"].unique())
            sent = spark.sparkContext.broadcast((ids, names, cells["weight"].to_numpy().reshape(len(ids), len(names)), seen))
            block = packed.filter(F.col("bucket") == low // span).drop("bucket")
            store.write_run(block.repartition(1).sortWithinPartitions("window_id", "doc_id").mapInPandas(self._walk(sent, corpus), schema), low, high)
            sent.destroy()
            topics = store.read(high).select("topic", "word_id", "weight")
            seen += block.count()
        return store.all()

    def _walk(self, sent, corpus: int):
        p, rate = self.params, self.rate

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words, names, weight, n = sent.value

            def moved(t: int, docs: pd.DataFrame) -> pd.DataFrame:
                """One window, as :meth:`update_topics`."""
                nonlocal weight, n
                logs = digamma_np(weight) - digamma_np(weight.sum(axis=0))
                total, there = np.zeros_like(weight), np.zeros(len(words), dtype=bool)
                for pdf in tp._batches(iter([docs]), len(names)):
                    tp.add_sums(pdf, words, logs, total, there, p.alpha, p.passes, p.tolerance)
                r, scale = rate(t), (p.documents or corpus) / len(docs)
                weight, n = (1.0 - r) * weight + r * (p.eta + scale * total), n + len(docs)
                return pd.DataFrame({
                    "topic": np.tile(names, len(words)), "word_id": np.repeat(words, len(names)), "weight": weight.ravel(), "n": n, "version": t,
                })

            at, held = None, []
            for pdf in batches:
                for t, part in pdf.groupby("window_id", sort=True):
                    if held and t != at:
                        yield moved(at, pd.concat(held, ignore_index=True))
                        held = []
                    at = int(t)
                    held.append(part)
            if held:
                yield moved(at, pd.concat(held, ignore_index=True))

        return run

    def bound(self, counts: DataFrame, topics: DataFrame, scale: float = 1.0) -> DataFrame:
        """The variational bound of the documents under the topics, one row."""
        docs = self.e_step(topics).document_bound(counts).agg(F.sum("bound").alias("docs"))
        total = tp.topic_bound(topics, self.params.eta).scalar()
        return docs.select((F.lit(scale) * F.col("docs") + total).alias("bound"))

    def predict(self, counts: DataFrame, model: DataFrame | None = None, **override) -> DataFrame:
        """Topic weights ``(doc_id, topic, gamma)`` of documents under given topics."""
        return self.with_params(**override).e_step(model).gamma(counts)
