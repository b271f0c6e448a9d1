"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text come from its UTF-8 bytes by numpy, a run of documents
at a time.  Trees are grown on histograms of a bounded sample of labelled rows and
kept as flat arrays, one slot per node of a complete tree; scoring moves all rows of
a batch down one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from tidelearn.llm import words
from tidelearn.llm.memory import give_back, stay_few
from tidelearn.llm.registry import register, table

#: Labelled rows that a model is fitted on, at most; the rows with the least hash of their id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_HESSIAN, SHRINK = 80, 4, 64, 0.15, 2.0, 1.0
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "ascii_mark", "symbol", "bar", "exclamation", "stop", "comma", "newline", "high_byte",
    "distinct_words", "distinct_pairs", "distinct_triples", "next_equal", "marked_ends", "one_byte_words", "long_words", "shouted", "distinct_lines", "line_words",
)


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


UPPER, DIGIT, HIGH = _class((65, 90)), _class((48, 57)), _class((128, 255))
MARK = _class((33, 47), (58, 64), (91, 96), (123, 126))
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&<>")] = True
LINE = np.zeros(256, bool)
LINE[10] = True


def _distinct_share(h: np.ndarray) -> float:
    return len(words.distinct(h)) / len(h) if len(h) else 1.0


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; null counts as empty.  Shares of nothing are 0, or 1 for shares of distinct items."""
    out = np.zeros((len(column), len(FEATURES)))
    for first, data, bounds in words.chunks(column):
        n = len(bounds) - 1
        starts, ends, head = words.spans(data, bounds)
        hashed = words.hashes(data, starts, ends)
        pairs, triples = words.windows(hashed, 2), words.windows(hashed, 3)
        line_starts, line_ends, line_head = words.spans(data, bounds, LINE)
        lines = words.hashes(data, line_starts, line_ends)
        size, count = np.diff(bounds), np.diff(head)
        per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(count, 1)
        length = ends - starts
        same = np.zeros(len(hashed) + 1, bool)
        if len(hashed) > 1:
            same[1:-1] = hashed[1:] == hashed[:-1]
        same[head[:-1]] = False
        last = data[ends - 1] if len(ends) else data[:0]

        def of_bytes(kind: np.ndarray) -> np.ndarray:
            return words.per_text(kind[data], bounds) * per_byte

        def of_words(flags: np.ndarray) -> np.ndarray:
            return np.diff(np.searchsorted(np.flatnonzero(flags), head)) * per_word

        one = np.zeros(256, bool)

        def only(c: str) -> np.ndarray:
            kind = one.copy()
            kind[ord(c)] = True
            return of_bytes(kind)

        block = out[first : first + n]
        block[:, 0], block[:, 1], block[:, 2] = np.log1p(size), np.log1p(count), size * per_word * (count > 0)
        for k, v in enumerate((of_bytes(UPPER), of_bytes(DIGIT), of_bytes(MARK), of_bytes(SYMBOL), only("|"), only("!"), only("."), only(","), only("\n"), of_bytes(HIGH)), 3):
            block[:, k] = v
        first_two = (UPPER[data[starts]] & UPPER[data[np.minimum(starts + 1, len(data) - 1)]] & (length > 1)) if len(starts) else same[:0]
        for d in range(n):
            a, b = head[d], head[d + 1]
            block[d, 13] = _distinct_share(hashed[a:b])
            block[d, 14] = _distinct_share(pairs[a : max(a, b - 1)])
            block[d, 15] = _distinct_share(triples[a : max(a, b - 2)])
            block[d, 21] = _distinct_share(lines[line_head[d] : line_head[d + 1]])
        for k, flags in ((16, same[: len(hashed)]), (17, MARK[last]), (18, length == 1), (19, length > 20), (20, first_two)):
            block[:, k] = of_words(flags)
        block[:, 22] = np.log1p(count / np.maximum(np.diff(line_head), 1))
    return out


@dataclass
class Trees:
    """Node i of a tree has the children 2i+1 and 2i+2; arrays hold tree after tree."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        inner, leaves = 2**self.depth - 1, 2**self.depth
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for t in range(len(self.feature) // inner):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = t * inner + node
                node = 2 * node + 1 + (x[rows, self.feature[at]] > self.cut[at])
            total += self.value[t * leaves + node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees of the logistic loss, each split chosen on histograms of gradients and hessians.

    Without rows the model is 0.5 everywhere; with one class only it is nearly that class everywhere.
    """
    inner, leaves, width = 2**depth - 1, 2**depth, x.shape[1]
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(prior / (1 - prior)))
    feature, cut, value = np.zeros(trees * inner, np.int64), np.full(trees * inner, np.inf), np.zeros(trees * leaves)
    if not len(y):
        return Trees(feature, cut, value, base, depth)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            here = node - first
            best = np.full(count, 1e-6)
            g0, h0 = np.bincount(here, grad, count), np.bincount(here, hess, count)
            for f in range(width):
                if not len(edges[f]):
                    continue
                slot = here * bins + binned[:, f]
                g = np.bincount(slot, grad, count * bins).reshape(count, bins).cumsum(1)[:, :-1]
                h = np.bincount(slot, hess, count * bins).reshape(count, bins).cumsum(1)[:, :-1]
                gr, hr = g0[:, None] - g, h0[:, None] - h
                gain = g * g / (h + SHRINK) + gr * gr / (hr + SHRINK) - (g0 * g0 / (h0 + SHRINK))[:, None]
                gain[(h < LEAST_HESSIAN) | (hr < LEAST_HESSIAN)] = -1
                gain[:, len(edges[f]) :] = -1
                k = gain.argmax(1)
                found = gain[np.arange(count), k]
                better = np.flatnonzero(found > best)
                best[better] = found[better]
                feature[t * inner + first + better] = f
                cut[t * inner + first + better] = edges[f][k[better]]
            at = t * inner + node
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = node - inner
        value[t * leaves : (t + 1) * leaves] = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + SHRINK)
        total += value[t * leaves + leaf]
    return Trees(feature, cut, value, base, depth)


@arrow_udf(T.ArrayType(T.DoubleType()))
def statistics_of(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in text:
        x = statistics(column)
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def training_rows(labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids (id, y) for fitting.

    Never those whose crc32 of the id as text is divisible by 5: they are held out.  Rows with a
    null id or label are left out; an id with several labels has their mean, rounded.
    """
    return (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.round(F.avg(label)).cast("double").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learnt from: one fifth of all ids.  A null id is not held out, nor learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on at most ``rows`` labelled documents; only the statistics of those come to the driver.

    The ids of the sample are few by their limit, so they are sent to the scan of the documents.
    Of several documents with one id, the one whose statistics come first in order counts.
    """
    sample = F.broadcast(training_rows(labels, label, doc_id, rows))
    found = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(sample, "id").select("id", "y", statistics_of("text").alias("x")).toArrow()
    x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    ids, y = found["id"].to_numpy(), found["y"].to_numpy()
    order = np.lexsort((*x.T[::-1], ids))
    first = order[np.unique(ids[order], return_index=True)[1]] if len(order) else order
    return grow(x[first], y[first])


def scorer(model: Trees):
    """A column function: the probability of label 1 of a text column."""

    @arrow_udf("double")
    def score(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in text:
            yield pa.array(model.score(statistics(column)))
        give_back()

    return score


def classify(docs: DataFrame, model: Trees, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold, else 0); columns of these names are replaced.

    The score depends on the text alone: equal texts score alike, null scores as the empty text.
    An empty table gives no rows.
    """
    return docs.withColumn("score", scorer(model)(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@register("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; fitted on the labelled rows among ``docs``."""
    stay_few(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    score = scorer(model)(F.col("text"))
    return docs.where(score >= THRESHOLD)
