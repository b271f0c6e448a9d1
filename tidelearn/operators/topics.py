"""Variational steps of the topic model on ``(doc_id, word_id, cnt)`` rows.

Topics are ``(topic, word_id, weight)`` rows.  When they fit a checked size they
travel to the tasks as one array and a document is solved where it lies; larger
topics are joined to the counts by word and every pass is an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidelearn.functions.special import digamma, digamma_np, lgamma_np
from tidelearn.session import materialize, tasks

# Topic cells (K x V) that may be sent to every task: 32 MB of doubles.
SENT_CELLS = 4_000_000
# Entries times topics that a task works on at a time (32 MB an array).
BATCH_CELLS = 4_000_000


def dirichlet_expectation(weights: DataFrame, keys: list[str], value: str = "weight", name: str = "e") -> DataFrame:
    """``psi(a) - psi(sum a)`` within each group of ``keys``."""
    totals = weights.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    joined = weights.join(totals, keys)
    return joined.withColumn(name, digamma(F.col(value)) - digamma(F.col("_sum"))).drop("_sum")


def log_topics(topics: DataFrame) -> DataFrame:
    """One row per word with ``E[ln beta]`` of all topics, in topic order."""
    e = dirichlet_expectation(topics, ["topic"])
    return e.groupBy("word_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic", "e"))), lambda t: t["e"]).alias("lb"))


def sendable(topics: DataFrame, limit: int = SENT_CELLS) -> bool:
    """Whether the topics are small enough to be sent; counts no more rows than that."""
    return topics.limit(limit + 1).count() <= limit


def _sent(topics: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word ids and ``E[ln beta]`` as words x topics; the size was checked."""
    pdf = log_topics(topics).toPandas().sort_values("word_id")
    return pdf["word_id"].to_numpy(), np.stack(pdf["lb"].to_numpy())


def pack_documents(counts: DataFrame) -> DataFrame:
    """One row per document; it has at most as many entries as there are words."""
    placed = counts.repartition(tasks(counts.sparkSession), "doc_id")
    return placed.groupBy("doc_id").agg(F.collect_list("word_id").alias("ids"), F.collect_list("cnt").alias("cnts"))


def unpack_documents(docs: DataFrame) -> DataFrame:
    """Word counts of packed documents."""
    return docs.select("doc_id", F.explode(F.arrays_zip("ids", "cnts")).alias("e")).select("doc_id", F.col("e.ids").alias("word_id"), F.col("e.cnts").alias("cnt"))


def solve_documents(doc: np.ndarray, n_docs: int, cnt: np.ndarray, logs: np.ndarray, alpha: float, passes: int, tolerance: float):
    """Gamma of a batch of documents, and the responsibilities it implies.

    ``doc`` gives the document of each entry, in order, and ``logs`` its ``E[ln beta]``.
    Each document stops on its own when its mean change is small; one without entries keeps ``alpha``.
    """
    k = logs.shape[1]
    beta = np.exp(logs - logs.max(axis=1, keepdims=True, initial=-np.inf)) if len(logs) else logs
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    length = np.bincount(doc, weights=cnt, minlength=n_docs)
    gamma = np.repeat(alpha + length[:, None] / k, k, axis=1)
    live = np.ones(n_docs, dtype=bool)
    for _ in range(passes):
        phi = _phi(gamma, doc, beta, logs)
        new = np.full_like(gamma, alpha)
        if len(doc):
            new[doc[starts]] += np.add.reduceat(cnt[:, None] * phi, starts)
        moved = np.abs(new - gamma).mean(axis=1)
        gamma[live] = new[live]
        live &= moved > tolerance
        if not live.any():
            break
    return gamma, _phi(gamma, doc, beta, logs)


def _phi(gamma: np.ndarray, doc: np.ndarray, beta: np.ndarray, logs: np.ndarray) -> np.ndarray:
    theta = digamma_np(gamma) - digamma_np(gamma.sum(axis=1))[:, None]
    phi = np.exp(theta)[doc] * beta
    total = phi.sum(axis=1)
    lost = np.flatnonzero(total < 1e-280)
    if len(lost):
        # Products too small for a double: add logs and take the largest out before ``exp``.
        z = theta[doc[lost]] + logs[lost]
        phi[lost] = np.exp(z - z.max(axis=1, keepdims=True))
        total[lost] = phi[lost].sum(axis=1)
    return phi / total[:, None]


def _flatten(pdf: pd.DataFrame, words: np.ndarray):
    """Entries of a batch of documents; words the topics lack are left out."""
    sizes = pdf["ids"].map(len).to_numpy()
    doc = np.repeat(np.arange(len(pdf)), sizes)
    ids = np.concatenate([np.asarray(a, dtype="int64") for a in pdf["ids"]])
    cnt = np.concatenate([np.asarray(a, dtype="float64") for a in pdf["cnts"]])
    at = np.searchsorted(words, ids)
    known = (at < len(words)) & (words[np.minimum(at, len(words) - 1)] == ids)
    return doc[known], at[known], cnt[known]


def _batches(batches: Iterator[pd.DataFrame], topics: int) -> Iterator[pd.DataFrame]:
    """Arrow batches cut to at most ``BATCH_CELLS`` entries times topics, or one document."""
    for pdf in batches:
        cells = np.cumsum(pdf["ids"].map(len).to_numpy()) * topics
        at = 0
        while at < len(pdf):
            done = cells[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(cells, done + BATCH_CELLS, "right")))
            yield pdf.iloc[at:end]
            at = end


def add_sums(pdf: pd.DataFrame, words: np.ndarray, logs: np.ndarray, total: np.ndarray, seen: np.ndarray, alpha: float, passes: int, tolerance: float):
    """Adds ``cnt * phi`` of a batch of documents to ``total`` (words x topics)."""
    doc, at, cnt = _flatten(pdf, words)
    if not len(at):
        return
    _, phi = solve_documents(doc, len(pdf), cnt, logs[at], alpha, passes, tolerance)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    total[at[order][first]] += np.add.reduceat((cnt[:, None] * phi)[order], first)
    seen[at] = True


class EStep:
    """E-step of many documents against fixed topics."""

    def __init__(self, topics: DataFrame, alpha: float, passes: int, tolerance: float, limit: int = SENT_CELLS):
        self.topics, self.alpha, self.passes, self.tolerance = topics, alpha, passes, tolerance
        self.sent = sendable(topics, limit)
        if self.sent:
            words, logs = _sent(topics)
            self.packet = topics.sparkSession.sparkContext.broadcast((words, logs))

    # Both ways return the same three tables.

    def gamma(self, counts: DataFrame) -> DataFrame:
        """``(doc_id, topic, gamma)``."""
        vectors = self._gamma_sent(counts) if self.sent else self._gamma_joined(counts)
        return vectors.select("doc_id", F.posexplode("g").alias("topic", "gamma"))

    def release(self) -> None:
        """Takes what was sent back from the tasks; tables that need it must be written."""
        if self.sent:
            self.packet.destroy()

    def sstats(self, counts: DataFrame, packed: DataFrame | None = None) -> DataFrame:
        """``(topic, word_id, s)`` with ``s`` the sum of ``cnt * phi`` over the documents; ``packed``: the same documents, packed already."""
        if self.sent:
            return self._sstats_sent(pack_documents(counts) if packed is None else packed)
        return self._sstats_joined(counts)

    def document_bound(self, counts: DataFrame) -> DataFrame:
        """``(doc_id, bound)``: the documents' part of the variational bound."""
        if self.sent:
            return self._bound_sent(counts)
        return self._bound_joined(counts)

    def _gamma_sent(self, counts: DataFrame) -> DataFrame:
        packet, alpha, passes, tolerance = self.packet, self.alpha, self.passes, self.tolerance

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words, logs = packet.value
            for pdf in _batches(batches, logs.shape[1]):
                doc, at, cnt = _flatten(pdf, words)
                gamma, _ = solve_documents(doc, len(pdf), cnt, logs[at], alpha, passes, tolerance)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "g": list(gamma)})

        return pack_documents(counts).mapInPandas(run, "doc_id long, g array<double>")

    def _sstats_sent(self, docs: DataFrame) -> DataFrame:
        packet, alpha, passes, tolerance = self.packet, self.alpha, self.passes, self.tolerance

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words, logs = packet.value
            total, seen = np.zeros_like(logs), np.zeros(len(words), dtype=bool)
            for pdf in _batches(batches, logs.shape[1]):
                add_sums(pdf, words, logs, total, seen, alpha, passes, tolerance)
            # One partial sum per task and word, so the shuffle does not grow with the documents.  A task without words has none.
            if seen.any():
                yield pd.DataFrame({"word_id": words[seen], "s": list(total[seen])})

        parts = docs.mapInPandas(run, "word_id long, s array<double>")
        cells = parts.select("word_id", F.posexplode("s").alias("topic", "s"))
        return cells.groupBy("topic", "word_id").agg(F.sum("s").alias("s"))

    def _bound_sent(self, counts: DataFrame) -> DataFrame:
        packet, alpha, passes, tolerance = self.packet, self.alpha, self.passes, self.tolerance

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words, logs = packet.value
            for pdf in _batches(batches, logs.shape[1]):
                doc, at, cnt = _flatten(pdf, words)
                gamma, _ = solve_documents(doc, len(pdf), cnt, logs[at], alpha, passes, tolerance)
                theta = digamma_np(gamma) - digamma_np(gamma.sum(axis=1))[:, None]
                z = theta[doc] + logs[at]
                top = z.max(axis=1, initial=-np.inf)
                likely = np.bincount(doc, weights=cnt * (top + np.log(np.exp(z - top[:, None]).sum(axis=1))), minlength=len(pdf))
                k = gamma.shape[1]
                prior = ((alpha - gamma) * theta + lgamma_np(gamma) - lgamma_np(np.array(alpha))).sum(axis=1)
                prior += lgamma_np(np.array(alpha * k)) - lgamma_np(gamma.sum(axis=1))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "bound": likely + prior})

        return pack_documents(counts).mapInPandas(run, "doc_id long, bound double")

    # Topics too large to send: word vectors joined to the counts, one aggregate per pass.

    def _joined(self, counts: DataFrame) -> DataFrame:
        vectors = log_topics(self.topics)
        return counts.join(vectors, ["word_id"]).select("doc_id", "word_id", "cnt", "lb")

    def _gamma_joined(self, counts: DataFrame) -> DataFrame:
        k = self.topics.agg(F.max("topic")).first()[0] + 1
        entries = materialize(self._joined(counts), "topic-entries")
        length = entries.groupBy("doc_id").agg(F.sum("cnt").cast("double").alias("len"))
        # A document none of whose words is in the topics keeps ``alpha``.
        length = counts.select("doc_id").distinct().join(length, "doc_id", "left")
        start = F.array_repeat(F.lit(self.alpha) + F.coalesce("len", F.lit(0.0)) / k, k)
        state = length.select("doc_id", start.alias("g"), F.lit(True).alias("live"))
        for i in range(self.passes):
            phi = self._phi_column(self._with_theta(entries, state))
            sums = [F.sum(F.col("cnt") * F.col("phi")[j]).alias(f"_{j}") for j in range(k)]
            new = phi.groupBy("doc_id").agg(*sums)
            joined = state.join(new, "doc_id", "left")
            fresh = F.array(*[F.coalesce(f"_{j}", F.lit(0.0)) + F.lit(self.alpha) for j in range(k)])
            moved = F.aggregate(F.zip_with(fresh, "g", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / k
            state = joined.select(
                "doc_id",
                F.when(F.col("live"), fresh).otherwise(F.col("g")).alias("g"),
                (F.col("live") & (moved > self.tolerance)).alias("live"),
            )
            state = materialize(state, f"gamma-{i}")
        return state.select("doc_id", "g")

    def _with_theta(self, entries: DataFrame, state: DataFrame) -> DataFrame:
        total = F.aggregate("g", F.lit(0.0), lambda s, v: s + v)
        summed = state.withColumn("_psi", digamma(total))
        theta = summed.select("doc_id", F.transform("g", lambda v: digamma(v) - F.col("_psi")).alias("lt"))
        return entries.join(theta, ["doc_id"])

    @staticmethod
    def _phi_column(entries: DataFrame) -> DataFrame:
        z = entries.withColumn("_z", F.zip_with("lt", "lb", lambda a, b: a + b)).withColumn("_top", F.array_max("_z"))
        z = z.withColumn("_z", F.transform("_z", lambda v: F.exp(v - F.col("_top"))))
        total = z.withColumn("_t", F.aggregate("_z", F.lit(0.0), lambda s, v: s + v))
        return total.withColumn("phi", F.transform("_z", lambda v: v / F.col("_t")))

    def _sstats_joined(self, counts: DataFrame) -> DataFrame:
        entries = self._joined(counts)
        phi = self._phi_column(self._with_theta(entries, self._gamma_joined(counts)))
        cells = phi.select("word_id", "cnt", F.posexplode("phi").alias("topic", "p"))
        return cells.groupBy("topic", "word_id").agg(F.sum(F.col("cnt") * F.col("p")).alias("s"))

    def _bound_joined(self, counts: DataFrame) -> DataFrame:
        alpha = self.alpha
        state = self._gamma_joined(counts)
        entries = self._with_theta(self._joined(counts), state)
        entries = entries.withColumn("_z", F.zip_with("lt", "lb", lambda a, b: a + b)).withColumn("_top", F.array_max("_z"))
        total = F.aggregate("_z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("_top")))
        likely = entries.groupBy("doc_id").agg(F.sum(F.col("cnt") * (F.col("_top") + F.ln(total))).alias("likely"))

        @F.pandas_udf("double")
        def prior(g: pd.Series) -> pd.Series:
            if len(g) == 0:
                return pd.Series([], dtype=float)
            gamma = np.stack(g.to_numpy())
            k = gamma.shape[1]
            theta = digamma_np(gamma) - digamma_np(gamma.sum(axis=1))[:, None]
            out = ((alpha - gamma) * theta + lgamma_np(gamma) - lgamma_np(np.array(alpha))).sum(axis=1)
            return pd.Series(out + lgamma_np(np.array(alpha * k)) - lgamma_np(gamma.sum(axis=1)))

        return state.join(likely, "doc_id", "left").select("doc_id", (F.coalesce("likely", F.lit(0.0)) + prior("g")).alias("bound"))


def topic_bound(topics: DataFrame, eta: float) -> DataFrame:
    """The topics' part of the bound, one row."""

    @F.pandas_udf("double")
    def lgamma(x: pd.Series) -> pd.Series:
        return pd.Series(lgamma_np(x.to_numpy(dtype=float)))

    e = dirichlet_expectation(topics, ["topic"])
    words = e.groupBy("topic").agg(
        F.sum((eta - F.col("weight")) * F.col("e") + lgamma("weight") - lgamma(F.lit(eta))).alias("a"),
        F.sum("weight").alias("total"),
        F.count(F.lit(1)).alias("v"),
    )
    return words.select((F.col("a") + lgamma(F.col("v") * eta) - lgamma("total")).alias("b")).agg(F.sum("b").alias("bound"))


def blend(topics: DataFrame, sstats: DataFrame, rate: float, eta: float, scale: float) -> DataFrame:
    """``(1 - rate) * old + rate * (eta + scale * s)`` for every topic and word."""
    joined = topics.join(sstats, ["topic", "word_id"], "left")
    new = F.lit(eta) + F.lit(scale) * F.coalesce("s", F.lit(0.0))
    return joined.select("topic", "word_id", ((1.0 - rate) * F.col("weight") + rate * new).alias("weight"))
